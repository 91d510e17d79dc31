"""Queries of the document operators and the SQL they are compared with. All run over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import codecs, fields, proto
from foliospark.functions.text import tokens
from foliospark.operators import indexes, revlog, routing, search, sets, stats
from foliospark.plans.kept import kept_index
from foliospark.sources import files
from foliospark.sources.numbering import numbered
from foliospark.sources.schema import docs_view
from foliospark.sources.tables import keep_for_release, shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_DOCS = """
WITH docs AS (SELECT DISTINCT id, rev, coalesce(deleted, false) AS deleted, data_json, tags, content,
  CASE WHEN json_valid(data_json) THEN CAST(data_json AS JSON) END AS j FROM document_store)
"""
_ID_PAGE = "ORDER BY id LIMIT {limit} OFFSET {skip}"
_LIVE = _DOCS + "SELECT id, rev FROM docs WHERE NOT deleted AND {where} ORDER BY id LIMIT {limit} OFFSET 0"
_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}]{{2,}}'))"
_KEYS = r"list_filter(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL), lambda t: upper(trim(t, E' \t\r\n')))), lambda t: t <> '')"
# Strings below the data: every scalar of kind VARCHAR in the tree.
_LEAVES = """
, leaves AS (
  SELECT docs.id AS id, string_agg(t.atom ->> '$', chr(10)) AS s FROM docs, json_tree(docs.j) t WHERE t.type = 'VARCHAR' GROUP BY docs.id
), tok AS (
  SELECT d.id, d.rev, d.deleted, """ + _TOKENS.format("coalesce(l.s, '') || chr(10) || coalesce(array_to_string(d.tags, chr(10)), '') || chr(10) || coalesce(d.content, '')") + """ AS w
  FROM docs d LEFT JOIN leaves l ON l.id = d.id
)
"""


@query(_DOCS + "SELECT id, rev, deleted FROM docs " + _ID_PAGE.format(limit=100, skip=50))
def all_docs_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.all_docs(docs_view(spark, sf), 50, 100).select("id", "rev", "deleted")


@query(_DOCS + "SELECT id, rev FROM docs WHERE NOT deleted " + _ID_PAGE.format(limit=200, skip=0))
def all_docs_alive(spark: SparkSession, sf: str) -> DataFrame:
    return search.all_docs(docs_view(spark, sf), 0, 200, include_deleted=False).select("id", "rev")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "wal_records")
    op = F.lower(F.trim("op"))
    return lines.where((op == "put") & F.col("doc").isNotNull()).select("db", "shard", "seq", "id", "rev", F.col("doc.deleted").alias("deleted"), F.col("doc.data_json").alias("data_json"), F.col("doc.content").alias("content"))


@query("SELECT db, shard, id, max(seq) AS seq FROM wal_records WHERE lower(trim(op)) = 'put' AND doc IS NOT NULL GROUP BY ALL")
def log_heads(spark: SparkSession, sf: str) -> DataFrame:
    return revlog.heads(_log(spark, sf), ("db", "shard", "id")).select("db", "shard", "id", "seq")


@query("""
WITH l AS (SELECT db, shard, seq, id, rev, doc.deleted AS deleted FROM wal_records WHERE lower(trim(op)) = 'put' AND doc IS NOT NULL),
pick AS (SELECT min(rev) AS rev FROM l WHERE id = 'heartbeat-main' AND rev IS NOT NULL AND NOT deleted)
SELECT DISTINCT db, shard, seq, l.rev FROM l JOIN pick ON l.rev = pick.rev WHERE id = 'heartbeat-main' AND NOT deleted
""")
def get_revision(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    rev = log.where((F.col("id") == "heartbeat-main") & F.col("rev").isNotNull() & ~F.col("deleted")).agg(F.min("rev")).first()[0]
    return revlog.get_revision(log, "heartbeat-main", rev).select("db", "shard", "seq", "rev").distinct()


@query(_DOCS + "SELECT id, rev, content FROM docs WHERE id = (SELECT min(id) FROM docs WHERE NOT deleted)")
def get_head(spark: SparkSession, sf: str) -> DataFrame:
    docs = docs_view(spark, sf)
    first = docs.where(~F.col("deleted")).agg(F.min("id")).first()[0]
    return revlog.get(docs, first or "").select("id", "rev", "content")


@query(_LIVE.format(where="coalesce(j ->> '$.type', CASE WHEN json_type(j, '$.type') = 'NULL' THEN '' END) = 'note'", limit=1000))
def find_eq_scan(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), {"type": "note"}, limit=1000).select("id", "rev")


@query(_LIVE.format(where="json_type(j, '$.profile.city') = 'VARCHAR' AND (j ->> '$.profile.city') = (SELECT min(x.j ->> '$.profile.city') FROM docs x WHERE NOT x.deleted AND json_type(x.j, '$.profile.city') = 'VARCHAR')", limit=100))
def find_eq_path(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    city = docs_view(spark, sf).where(~F.col("deleted")).agg(F.min(fields.path_text(F.col("data_json"), "profile.city"))).first()[0]
    return index.fetch(index.by_fields({"data.profile.city": city or ""})).select("id", "rev")


@query(_LIVE.format(where="(json_type(j, '$.active') = 'BOOLEAN' OR json_type(j, '$.active') = 'VARCHAR') AND (j ->> '$.active') = 'true'", limit=1000))
def find_eq_bool(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), {"data.active": "true"}, limit=1000).select("id", "rev")


@query(_LIVE.format(where="(j ->> '$.type') = 'user' AND (json_type(j, '$.active') IN ('BOOLEAN', 'VARCHAR')) AND (j ->> '$.active') = 'false'", limit=1000))
def find_eq_multi(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), {"type": "user", "data.active": "false"}, limit=1000).select("id", "rev")


@query(_LIVE.format(where="json_type(j, '$.rating') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(j ->> '$.rating' AS DOUBLE) BETWEEN 3 AND 7", limit=1000))
def find_range_closed(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.by_fields(None, ("data.rating", 3, 7), limit=1000)).select("id", "rev")


_RATED = "json_type(j, '$.rating') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(j ->> '$.rating' AS DOUBLE) BETWEEN 3 AND 7"


@query(_LIVE.format(where=_RATED, limit=1000))
def find_range_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same without an index."""
    return search.find_by_fields(docs_view(spark, sf), None, ("data.rating", 3, 7), limit=1000).select("id", "rev")


@query(_LIVE.format(where="json_type(j, '$.age') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(j ->> '$.age' AS DOUBLE) >= 40", limit=1000))
def find_range_open(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), None, ("data.age", 40, None), limit=1000).select("id", "rev")


@query(_LIVE.format(where="json_type(j, '$.rating') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') AND TRY_CAST(j ->> '$.rating' AS DOUBLE) BETWEEN 3 AND 7", limit=1000))
def find_range_numeric_string(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), None, ("rating", 3, 7), limit=1000).select("id", "rev")


@query(_LIVE.format(where="(j ->> '$.type') = 'note' AND json_type(j, '$.rating') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(j ->> '$.rating' AS DOUBLE) <= 5", limit=1000))
def find_eq_and_range(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_fields(docs_view(spark, sf), {"type": "note"}, ("data.rating", None, 5), limit=1000, mode="data").select("id", "rev")


def _tags(where: str) -> str:
    return _LIVE.format(where=where, limit=1000)


@query(_tags(f"list_has_all({_KEYS}, ['ACTIVE', 'URGENT'])"))
def tags_all(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_tags(docs_view(spark, sf), all_of=["active", " Urgent "], limit=1000).select("id", "rev")


@query(_tags(f"list_has_any({_KEYS}, ['BLUE', 'GREEN'])"))
def tags_any(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_tags(docs_view(spark, sf), any_of=["blue", "GREEN"], limit=1000).select("id", "rev")


@query(_tags(f"NOT list_has_any({_KEYS}, ['ACTIVE', 'ARCHIVED'])"))
def tags_none(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_tags(docs_view(spark, sf), none_of=["active", "archived"], limit=1000).select("id", "rev")


@query(_tags(f"list_has_all({_KEYS}, ['ACTIVE']) AND list_has_any({_KEYS}, ['URGENT', 'BLUE']) AND NOT list_has_any({_KEYS}, ['LEGACY'])"))
def tags_combo(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.by_tags(["active"], ["urgent", "blue"], ["legacy"], limit=1000)).select("id", "rev")


@query(_tags("false"))
def tags_any_empty(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_by_tags(docs_view(spark, sf), any_of=[], limit=1000).select("id", "rev")


def _fts(words: str, limit: int = 100, order: str = "id") -> str:
    return _DOCS + _LEAVES + f"SELECT id, rev FROM tok WHERE NOT deleted AND list_has_all(w, {words}) ORDER BY {order} LIMIT {limit}"


@query(_fts("['the', 'beside']"))
def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.full_text("The BESIDE")).select("id", "rev")


@query(_fts("['the', 'beside']"))
def fts_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same without an index: every document is tokenised."""
    return search.full_text_search(docs_view(spark, sf), "The BESIDE").select("id", "rev")


@query(_fts("['urgent']", 1000))
def fts_single(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.full_text("urgent", limit=1000)).select("id", "rev")


@query(_fts("['zzznothing']"))
def fts_miss(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.full_text("zzznothing")).select("id", "rev")


@query(_fts("['note', 'the']", 1000))
def fts_data_and_tags(spark: SparkSession, sf: str) -> DataFrame:
    return search.full_text_search(docs_view(spark, sf), "note the", limit=1000).select("id", "rev")


@query(_fts("['the', 'beside']", 100, "md5(id), id"))
def fts_compact_order(spark: SparkSession, sf: str) -> DataFrame:
    index = kept_index(spark, sf)
    return index.fetch(index.full_text("the beside", order=("doc_num",)), ("doc_num",)).select("id", "rev")


@query(_DOCS + _LEAVES + "SELECT token, count(*) AS df FROM (SELECT unnest(w) AS token FROM tok WHERE NOT deleted) GROUP BY token")
def postings_df(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.document_frequencies(docs_view(spark, sf))


_EF = "greatest(0, floor(log2(hi // n))::BIGINT)"


@query(_DOCS + _LEAVES + f"""
, num AS (SELECT id, crc32_rank AS k FROM (SELECT id, row_number() OVER (ORDER BY id) AS crc32_rank FROM docs)),
e AS (SELECT token, count(*) AS n, max(k) AS hi FROM (SELECT unnest(w) AS token, k FROM tok JOIN num USING (id) WHERE NOT deleted) GROUP BY token),
s AS (SELECT token, n, hi, CASE WHEN hi < n THEN 0 ELSE {_EF} END AS low FROM e),
b AS (SELECT n, ((n + (hi >> low)) + 63) // 64 AS hw, (n * low + 63) // 64 AS lw, length(token) AS t FROM s)
SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS postings, (SELECT count(*) FROM docs WHERE NOT deleted) AS documents,
  CAST(sum(hw * 8 + (hw + 1) * 4 + 8 + lw * 8 + 12 + 2 * t) AS BIGINT) AS compact_bytes, CAST(sum(n) * 48 AS BIGINT) AS hash_set_bytes,
  sum(n) * 48 / sum(hw * 8 + (hw + 1) * 4 + 8 + lw * 8 + 12 + 2 * t) AS ratio, sum(hw * 8 + (hw + 1) * 4 + 8 + lw * 8 + 12 + 2 * t) * 8 / sum(n) AS bits_per_posting FROM b
""")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.index_stats(numbered(docs_view(spark, sf), ["id"], "doc_num", 1))


_TREE = """
SELECT id, path, kind, text FROM (
  SELECT docs.id AS id, 'data' || replace(replace(t.fullkey, '$', ''), '"', '') AS path,
    CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'bool' WHEN t.type = 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN t.type = 'NULL' THEN NULL ELSE t.atom ->> '$' END AS text, t.type
  FROM docs, json_tree(docs.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$')
"""


@query(_DOCS + _TREE)
def flatten_fields(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.flatten_fields(docs_view(spark, sf)).select("id", "path", "kind", "text")


@query(_DOCS + f", f AS ({_TREE}) SELECT path AS field, count(DISTINCT id) AS n_docs, min(CAST(text AS DOUBLE)) AS lo, max(CAST(text AS DOUBLE)) AS hi FROM f JOIN docs USING (id) WHERE kind = 'number' AND NOT deleted GROUP BY path")
def num_index_summary(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.num_index(docs_view(spark, sf)).groupBy("field").agg(F.count_distinct("id").alias("n_docs"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query(_DOCS + f"SELECT tag_key, count(*) AS n_docs FROM (SELECT id, unnest({_KEYS}) AS tag_key FROM docs WHERE NOT deleted) GROUP BY tag_key")
def tag_index_counts(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.tag_index(docs_view(spark, sf)).groupBy("tag_key").agg(F.count("*").alias("n_docs"))


_EQ_FIELDS = f"""(SELECT count(DISTINCT field) FROM (
  SELECT path AS field, id FROM ({_TREE}) WHERE kind IN ('string', 'bool') AND id IN (SELECT id FROM docs WHERE NOT deleted)
  UNION ALL SELECT 'tags[' || (i - 1) || ']', id FROM (SELECT id, tags, unnest(range(1, len(tags) + 1)) AS i FROM docs WHERE NOT deleted) WHERE tags[i] IS NOT NULL
  UNION ALL SELECT 'content', id FROM docs WHERE NOT deleted AND content IS NOT NULL) {{where}})"""


@query(_DOCS + _LEAVES + "SELECT 7 AS seq, count(*) AS docs_total, count(*) FILTER (WHERE NOT deleted) AS docs_alive, count(*) FILTER (WHERE deleted) AS docs_deleted, "
       + _EQ_FIELDS.format(where="") + f" AS eq_index_fields, (SELECT count(DISTINCT k) FROM (SELECT unnest({_KEYS}) AS k FROM docs WHERE NOT deleted)) AS tag_index_count, "
       "(SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM tok WHERE NOT deleted)) AS full_text_tokens FROM docs")  # fmt: skip
def db_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.db_stats(docs_view(spark, sf), 7)


@query(_DOCS + _LEAVES + ", sh AS (SELECT id, CAST(id[-1:] AS INTEGER) % 3 AS shard FROM docs) SELECT shard, count(*) AS docs_total, count(*) FILTER (WHERE NOT deleted) AS docs_alive, count(*) FILTER (WHERE deleted) AS docs_deleted, "
       "any_value(t.n) AS full_text_tokens FROM docs JOIN sh USING (id) JOIN (SELECT shard, count(DISTINCT t) AS n FROM (SELECT id, unnest(w) AS t FROM tok WHERE NOT deleted) JOIN sh USING (id) GROUP BY shard) t USING (shard) GROUP BY shard")  # fmt: skip
def shard_stats_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = docs_view(spark, sf).withColumn("shard", F.right("id", F.lit(1)).cast("int") % 3)
    return stats.shard_stats(docs).select("shard", "docs_total", "docs_alive", "docs_deleted", "full_text_tokens")


@query(_DOCS + _LEAVES + ", sh AS (SELECT id, CAST(id[-1:] AS INTEGER) % 3 AS shard FROM docs) SELECT count(*) AS docs_total, count(*) FILTER (WHERE NOT deleted) AS docs_alive, "
       "(SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT t) AS n FROM (SELECT id, unnest(w) AS t FROM tok WHERE NOT deleted) JOIN sh USING (id) GROUP BY shard)) AS full_text_tokens FROM docs")  # fmt: skip
def shard_stats_compat(spark: SparkSession, sf: str) -> DataFrame:
    docs = docs_view(spark, sf).withColumn("shard", F.right("id", F.lit(1)).cast("int") % 3)
    return stats.merge_shard_stats(stats.shard_stats(docs).withColumn("seq", F.lit(0))).select("docs_total", "docs_alive", "full_text_tokens")


@query("""
WITH d AS (SELECT DISTINCT id, sha256(id) AS h FROM document_store),
u AS (SELECT id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS v FROM d)
SELECT id, CAST(abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) % 3 AS INTEGER) AS shard FROM u
""")
def route_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_shard(docs_view(spark, sf).select("id"), 3, algorithm="sha256")


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(text), '[^\x{0}-\x{FFFF}]', ' ', 'g'), '[\p{L}\p{Nd}]{2,}'), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def tokenise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT db, shard, coalesce(max(seq), 0) AS seq FROM wal_records GROUP BY db, shard")
def wal_seq(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sequence(table(spark, sf, "wal_records"))


@query("SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY ALL")
def latest_metric(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latest_metric(table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id"), ["event_type", "user_id"], "ts").select("event_type", "user_id", "ts")


_INTENTS = """
WITH d AS (SELECT DISTINCT id, rev, coalesce(deleted, false) AS deleted FROM document_store),
i AS (SELECT id, rev AS head, CASE CAST(id[-1:] AS INTEGER) % 3 WHEN 0 THEN rev WHEN 1 THEN '0-stale' END AS given FROM d)
"""


def _intents(spark: SparkSession, sf: str, op: str) -> tuple[DataFrame, DataFrame]:
    docs = docs_view(spark, sf)
    kind = F.right("id", F.lit(1)).cast("int") % 3
    changed = docs.withColumn("rev", F.when(kind == 0, F.col("rev")).when(kind == 1, "0-stale")).withColumn("content", F.lit("changed"))
    return docs, changed.select(F.xxhash64("id").alias("seq"), F.lit(op).alias("op"), "id", "rev", "deleted", "data_json", "tags", "content")


@query(_INTENTS + "SELECT id, given IS NOT DISTINCT FROM head AS ok, CASE WHEN given IS NOT DISTINCT FROM head THEN NULL ELSE 'Document update conflict' END AS error, CASE WHEN given IS NOT DISTINCT FROM head THEN coalesce(TRY_CAST(split_part(head, '-', 1) AS INTEGER), 0) + 1 END AS rev_number FROM i")
def put_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    docs, intents = _intents(spark, sf, "put")
    return revlog.apply_intents(docs, intents).select("id", "ok", "error", F.when(F.col("rev").isNotNull(), revlog.rev_number(F.col("rev"))).alias("rev_number"))


@query(_INTENTS + "SELECT id, true AS deleted, coalesce(TRY_CAST(split_part(head, '-', 1) AS INTEGER), 0) + 1 AS rev_number FROM i WHERE given IS NOT DISTINCT FROM head")
def delete_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    docs, intents = _intents(spark, sf, "del")
    rows = revlog.accepted(revlog.apply_intents(docs, intents), intents)
    return rows.select("id", "deleted", revlog.rev_number(F.col("rev")).alias("rev_number"))


_NEWS = ("link", "headline", "category", "short_description", "authors", "date")


@query(_DOCS + "SELECT id, CAST(coalesce(len(tags), -1) AS INTEGER) AS tags_count, CAST(length(content) AS INTEGER) AS content_len, " + ", ".join(f"CASE WHEN json_type(j, '$.{c}') IS NOT NULL THEN j ->> '$.{c}' END AS {c}" for c in _NEWS) + " FROM docs")
def news_projection(spark: SparkSession, sf: str) -> DataFrame:
    return files.news_projection(docs_view(spark, sf)).select("id", "tags_count", "content_len", *_NEWS)


@query("SELECT event_type, avg(value) AS value_mean, stddev_pop(value) AS value_std FROM events GROUP BY event_type")
def bench_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_and_deviation(table(spark, sf, "events"), ["event_type"], ["value"])


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_p95(spark: SparkSession, sf: str) -> DataFrame:
    return stats.percentiles(table(spark, sf, "events"), "value", [0.5, 0.95], ["event_type"])


@query(_DOCS + f", k AS (SELECT id, unnest({_KEYS}) AS t FROM docs WHERE NOT deleted) (SELECT id FROM k WHERE t = 'ACTIVE' INTERSECT SELECT id FROM k WHERE t = 'URGENT') EXCEPT SELECT id FROM k WHERE t = 'LEGACY'")
def id_sets(spark: SparkSession, sf: str) -> DataFrame:
    tags = indexes.tag_index(docs_view(spark, sf))
    of = lambda t: tags.where(F.col("tag_key") == t).select("id")
    return sets.except_all(sets.intersect_all([of("ACTIVE"), of("URGENT")]), [of("LEGACY")])


@query(_DOCS + _LEAVES + "SELECT id FROM tok WHERE NOT deleted AND list_has_all(w, ['the', 'beside']) ORDER BY id LIMIT 100")
def postings_search(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.search_postings(indexes.token_index(docs_view(spark, sf)), ["the", "beside"])


@query(_DOCS + _LEAVES + """
, num AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM docs)
SELECT token, 0 AS block, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS postings FROM (SELECT unnest(w) AS token, k FROM tok JOIN num USING (id) WHERE NOT deleted) GROUP BY token
""")
def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = indexes.posting_lists(numbered(docs_view(spark, sf), ["id"], "doc_num", 1))
    return lists.select("token", "block", F.array_join(F.col("postings").cast("array<string>"), ",").alias("postings"))


@query(_DOCS + "SELECT id, coalesce(rev, '') AS rev, deleted, nullif(content, '') AS content, CASE WHEN len(tags) > 0 THEN array_to_string(list_transform(tags, lambda t: coalesce(t, '')), '|') END AS tags, j ->> '$.type' AS type, j ->> '$.profile.city' AS city, j ->> '$.rating' AS rating FROM docs")
def binary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to their binary form and back."""
    back = codecs.from_binary(codecs.to_binary(docs_view(spark, sf)))
    data = [F.get_json_object("data_json", f"$.{p}").alias(n) for n, p in (("type", "type"), ("city", "profile.city"), ("rating", "rating"))]
    return back.select("id", F.coalesce("rev", F.lit("")).alias("rev"), "deleted", "content", F.array_join("tags", "|").alias("tags"), *data)


@query(_DOCS + "SELECT id, nullif(rev, '') AS rev, deleted, nullif(content, '') AS content, CASE WHEN len(tags) > 0 THEN array_to_string(list_transform(tags, lambda t: coalesce(t, '')), '|') END AS tags, j ->> '$.type' AS type, j ->> '$.profile.city' AS city FROM docs")
def proto_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to messages in a folder of binary rows and back."""
    folder = keep_for_release(f"{shared_dir(spark)}/foliospark/messages-{uuid.uuid4().hex}")
    proto.to_proto(docs_view(spark, sf)).write.parquet(folder)
    data = [F.get_json_object("data_json", f"$.{p}").alias(n) for n, p in (("type", "type"), ("city", "profile.city"))]
    return proto.from_proto(spark.read.parquet(folder)).select("id", "rev", "deleted", "content", F.array_join("tags", "|").alias("tags"), *data)


@query("SELECT doc_id, text, true AS is_gzip FROM documents WHERE text IS NOT NULL")
def gzip_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    packed = table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", codecs.gzip_bytes(F.col("text")).alias("z"))
    return packed.select("doc_id", codecs.gunzip_bytes(F.col("z")).cast("string").alias("text"), codecs.is_gzip(F.col("z")).alias("is_gzip"))
