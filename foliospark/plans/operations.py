"""Queries of the remaining document operators (files, databases, sets, routing, measurements) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import tag_keys
from foliospark.operators import indexes, revlog, routing, search, sets, stats
from foliospark.operators.database import Engine
from foliospark.sources import files
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


def _folder(spark: SparkSession, name: str) -> str:
    return keep_for_release(f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}")


# sets and lists


@query(r"""
SELECT DISTINCT id FROM (SELECT id, upper(trim(unnest(tags), E' \t\r\n')) AS t FROM document_store WHERE NOT coalesce(deleted, false)) WHERE t IN ('ACTIVE', 'URGENT')
""")
def id_union(spark: SparkSession, sf: str) -> DataFrame:
    tags = indexes.tag_index(docs_view(spark, sf))
    return sets.union_all([tags.where(F.col("tag_key") == t).select("id") for t in ("ACTIVE", "URGENT")])


_LISTS = """
WITH l AS (SELECT l_suppkey, list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 2))) AS a,
  list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber >= 2))) AS b, list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <> 3))) AS c FROM lineitem GROUP BY l_suppkey)
"""


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    own = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("l_partkey"))))
    n = F.col("l_linenumber")
    return rows.groupBy("l_suppkey").agg(own(n <= 2).alias("a"), own(n >= 2).alias("b"), own(n != 3).alias("c"))


@query(_LISTS + "SELECT l_suppkey, array_to_string(list_sort(list_intersect(list_intersect(a, b), c)), ',') AS common FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def lists_intersect(spark: SparkSession, sf: str) -> DataFrame:
    lists = _lists(spark, sf).where((F.size("a") > 0) & (F.size("b") > 0) & (F.size("c") > 0))
    return lists.select("l_suppkey", F.array_join(sets.list_intersect([F.col("a"), F.col("b"), F.col("c")]).cast("array<string>"), ",").alias("common"))


@query(_LISTS + "SELECT l_suppkey, list_filter(c, lambda v: v >= 500)[1] AS next_value, CAST(len(list_filter(c, lambda v: v < 500)) AS INTEGER) AS next_index FROM l WHERE c IS NOT NULL")
def lists_next(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).where(F.size("c") > 0).select("l_suppkey", sets.next_geq(F.col("c"), F.lit(500)).alias("next_value"), sets.next_geq_index(F.col("c"), F.lit(500)).alias("next_index"))


@query("""
SELECT o_orderkey, CAST(len(replace(bits[1:3], '0', '')) AS INTEGER) AS rank_3, CAST(coalesce(ones[2] - 1, -1) AS INTEGER) AS select_1
FROM (SELECT o_orderkey, bits, list_filter(range(1, len(bits) + 1), lambda p: bits[p] = '1') AS ones FROM (SELECT o_orderkey, bin(o_orderkey) AS bits FROM orders))
""")
def bits_rank_select(spark: SparkSession, sf: str) -> DataFrame:
    bits = table(spark, sf, "orders").select("o_orderkey", F.bin("o_orderkey").alias("bits"))
    return bits.select("o_orderkey", sets.rank(F.col("bits"), F.lit(3)).alias("rank_3"), sets.select(F.col("bits"), F.lit(1)).alias("select_1"))


# scalars


@query("SELECT DISTINCT rev, coalesce(CASE WHEN contains(rev, '-') THEN TRY_CAST(split_part(rev, '-', 1) AS INTEGER) END, 0) AS number FROM wal_records")
def rev_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wal_records").select("rev").distinct().select("rev", revlog.rev_number(F.col("rev")).alias("number"))


@query("SELECT doc_id, sha1(text) AS digest FROM documents WHERE text IS NOT NULL")
def sha1_hex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))


@query("""
SELECT DISTINCT id, path, kind, text FROM (
  SELECT d.id AS id, ltrim(replace(replace(t.fullkey, '$', ''), '"', ''), '.') AS path,
    CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'bool' WHEN t.type = 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN t.type = 'NULL' THEN NULL ELSE t.atom ->> '$' END AS text, t.type
  FROM (SELECT id, CAST(data_json AS JSON) AS j FROM document_store WHERE json_valid(data_json)) d, json_tree(d.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$')
""")
def flatten_plain(spark: SparkSession, sf: str) -> DataFrame:
    return indexes.flatten_fields(docs_view(spark, sf), "").select("id", "path", "kind", "text").distinct()


# routing and topology


_U32 = "4294967295"


def _rotated(x: str, r: int) -> str:
    return f"(((({x}) << {r}) & {_U32}) | (({x}) >> {32 - r}))"


_WORD = "list_reduce(list_transform(range(0, 4), lambda j: coalesce(ascii(nullif(id[4 * i + j + 1], '')), 0) << (8 * j)), lambda x, y: x + y, 0)"
_MIXED = "((" + _rotated("((x * 3432918353) & " + _U32 + ")", 15) + " * 461845907) & " + _U32 + ")"


@query(f"""
WITH d AS (SELECT DISTINCT id FROM document_store),
w AS (SELECT id, len(id) AS n, list_transform(list_transform(range(0, len(id) // 4), lambda i: CAST({_WORD} AS UBIGINT)), lambda x: {_MIXED}) AS words, CAST({_WORD.replace("4 * i", "4 * (len(id) // 4)")} AS UBIGINT) AS x FROM d),
h AS (SELECT id, n, xor(list_reduce(words, lambda a, b: ({_rotated("xor(a, b)", 13)} * 5 + 3864292196) & {_U32}, CAST(2538058380 AS UBIGINT)), CASE WHEN n % 4 = 0 THEN CAST(0 AS UBIGINT) ELSE {_MIXED} END) AS a FROM w),
f AS (SELECT id, xor(a, CAST(n AS UBIGINT)) AS a FROM h),
g AS (SELECT id, (xor(a, a >> 16) * 2246822507) & {_U32} AS a FROM f),
e AS (SELECT id, (xor(a, a >> 13) * 3266489909) & {_U32} AS a FROM g)
SELECT id, CAST((xor(a, a >> 16) & 2147483647) % 3 AS INTEGER) AS shard FROM e
""")
def route_murmur3(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_shard(docs_view(spark, sf).select("id").distinct(), 3)


@query("""
WITH d AS (SELECT DISTINCT id FROM document_store),
c AS (SELECT id, list_reduce(list_transform(range(1, len(id) + 1), lambda i: CAST(ascii(id[i]) AS UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)::UBIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END), CAST(4294967295 AS UBIGINT)) AS a FROM d)
SELECT id, CAST((xor(a, CAST(4294967295 AS UBIGINT)) & 2147483647) % 3 AS INTEGER) AS shard FROM c
""")
def route_crc32(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_shard(docs_view(spark, sf).select("id").distinct(), 3, algorithm="crc32")


@query("""
WITH d AS (SELECT DISTINCT id, sha256(id) AS h FROM document_store),
u AS (SELECT id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS v FROM d)
SELECT CAST(abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) % 3 AS INTEGER) AS shard, id AS key FROM u
""")
def keys_of_shards(spark: SparkSession, sf: str) -> DataFrame:
    lists = routing.group_by_shards(docs_view(spark, sf).select("id"), 3, algorithm="sha256")
    return lists.select("shard", F.explode("keys").alias("key"))


@query("""
SELECT s_suppkey, 'added' AS change FROM supplier WHERE s_nationkey >= 8 AND NOT s_nationkey < 16
UNION ALL SELECT s_suppkey, 'removed' FROM supplier WHERE s_nationkey < 16 AND NOT s_nationkey >= 8
""")
def topology_diff(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "supplier")
    return routing.topology_diff(nodes.where("s_nationkey < 16"), nodes.where("s_nationkey >= 8"), "s_suppkey")


@query("""
SELECT s_nationkey AS shard, list(s_name ORDER BY s_suppkey)[1] AS "primary", array_to_string(list(s_name ORDER BY s_suppkey)[2:], ',') AS replicas FROM supplier GROUP BY s_nationkey
""")
def topology(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("shard"), F.col("s_name").alias("url"), F.col("s_suppkey").alias("position"))
    return routing.topology(nodes).withColumn("replicas", F.array_join("replicas", ","))


@query("SELECT seq, shard AS replica_index FROM wal_records ORDER BY seq DESC NULLS LAST, shard LIMIT 1")
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return routing.best_candidate(table(spark, sf, "wal_records").select("seq", F.col("shard").alias("replica_index")))


# measurements


@query("SELECT db, max(seq) AS seq FROM wal_records GROUP BY db")
def sharded_seq(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence number of a sharded database: the highest of its shards."""
    return stats.sequence(table(spark, sf, "wal_records")).groupBy("db").agg(F.max("seq").alias("seq"))


@query("""
WITH e AS (SELECT o_orderkey AS seq, o_orderstatus <> 'F' AS ok, CASE WHEN o_orderpriority <> '5-LOW' THEN 'status F' END AS error FROM orders),
f AS (SELECT seq, coalesce(error, 'Unknown error') AS error FROM e WHERE NOT ok ORDER BY seq LIMIT 1000)
SELECT count(*) FILTER (WHERE ok) AS success_count, count(*) FILTER (WHERE NOT ok) AS failed_count, coalesce(max(seq) FILTER (WHERE ok), 0) AS last_seq,
  (SELECT string_agg(seq || '=' || error, ',' ORDER BY seq) FROM f) AS errors FROM e
""")
def batch_counters(spark: SparkSession, sf: str) -> DataFrame:
    error = F.when(F.col("o_orderpriority") != "5-LOW", "status F")
    entries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("ok"), error.alias("error"))
    text = F.array_join(F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return stats.batch_result(entries).withColumn("errors", text)


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total_bytes, sum(user_id) / max(user_id) AS avg_bytes_per_doc FROM events GROUP BY event_type")
def bench_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", F.col("user_id").cast("long").alias("bytes"), F.col("user_id").cast("long").alias("docs"))
    return stats.bench_sizes(rows, "bytes", "docs", ["event_type"])


@query("""
WITH m AS (SELECT event_type, avg(value) AS ms FROM events GROUP BY event_type), b AS (SELECT ms FROM m WHERE event_type = (SELECT min(event_type) FROM m))
SELECT event_type, m.ms AS ms, b.ms / m.ms AS speedup FROM m, b
""")
def speedup(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    means = events.groupBy("event_type").agg(F.avg("value").alias("ms"))
    return stats.speedup(means, "event_type", "ms", events.agg(F.min("event_type")).first()[0] or "")


@query("SELECT DISTINCT least(l_quantity, 30) AS n FROM lineitem WHERE l_quantity IS NOT NULL")
def bench_scales(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scales(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("n")), 30)


# listing


@query("SELECT DISTINCT id, link FROM news_articles ORDER BY id, link LIMIT 1000")
def all_docs_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """A page of more rows than a page may have."""
    return search.page(table(spark, sf, "news_articles").select("id", "link").distinct(), -5, 5000, ("id", "link"))


# logs and databases


@query("""
WITH e AS (
  SELECT db, seq, lower(trim(op)) AS op, id, rev, doc.deleted AS dead FROM wal_records
  UNION ALL SELECT DISTINCT db, CAST(-1 AS BIGINT), 'createdb', NULL, NULL, NULL FROM wal_records WHERE db <> 'audit'
  UNION ALL SELECT 'sales', 100, 'deletedb', NULL, NULL, NULL UNION ALL SELECT 'sales', 101, 'createdb', NULL, NULL, NULL UNION ALL SELECT 'users', 150, 'deletedb', NULL, NULL, NULL
), s AS (
  SELECT db, coalesce(max(seq) FILTER (WHERE op = 'deletedb'), -1) AS since FROM e WHERE op IN ('createdb', 'deletedb') GROUP BY db HAVING arg_max(op, seq) = 'createdb'
), w AS (
  SELECT e.db, id, rev, op IN ('delete', 'del') OR coalesce(dead, false) AS deleted, seq FROM e JOIN s USING (db) WHERE op IN ('put', 'post', 'delete', 'del') AND seq > since
), b AS (SELECT *, row_number() OVER (PARTITION BY db, id ORDER BY seq DESC, rev DESC NULLS LAST, deleted DESC) AS n FROM w)
SELECT db, id, rev, deleted, seq FROM b WHERE n = 1
""")
def replicated_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The log's lines as entries of a replica, with databases created and deleted among them."""
    log = table(spark, sf, "wal_records")
    entries = log.select("db", "seq", F.trim("op").alias("op"), "id", "rev", F.struct(F.col("doc.deleted").alias("deleted")).alias("doc"))
    none = F.lit(None).cast("string")
    ddl = log.where(F.col("db") != "audit").select("db").distinct().select("db", F.lit(-1).cast("long").alias("seq"), F.lit("createdb").alias("op"))
    ddl = ddl.union(spark.createDataFrame([("sales", 100, "deletedb"), ("sales", 101, "CreateDb"), ("users", 150, "deletedb")], "db string, seq long, op string"))
    empty = F.struct(F.lit(None).cast("boolean").alias("deleted"))
    return revlog.apply_entries(entries.unionByName(ddl.select("db", "seq", "op", none.alias("id"), none.alias("rev"), empty.alias("doc"))))


@query("""
WITH d AS (SELECT DISTINCT id, rev, coalesce(deleted, false) AS deleted, content FROM document_store WHERE trim(coalesce(id, '')) <> '' AND trim(coalesce(rev, '')) <> '')
SELECT id, CASE WHEN id LIKE '%3' THEN '9-later' ELSE rev END AS rev, CASE WHEN id LIKE '%3' THEN false ELSE deleted END AS deleted, CASE WHEN id LIKE '%3' THEN 'later' ELSE content END AS content FROM d
""")
def recovered_heads(spark: SparkSession, sf: str) -> DataFrame:
    """A database filled by import, snapshotted, written to again, and recovered from its files."""
    engine = Engine(spark, _folder(spark, "engine"))
    docs = docs_view(spark, sf)
    engine.create_db("store")
    engine.import_docs("store", docs)
    engine.snapshot("store")
    later = docs.where(F.col("id").endswith("3") & F.col("rev").isNotNull())
    engine.import_docs("store", later.withColumns({"rev": F.lit("9-later"), "deleted": F.lit(False), "content": F.lit("later")}))
    return Engine(spark, engine.root).recover()["store"].select("id", "rev", "deleted", "content")


# files


@query("""
WITH d AS (SELECT DISTINCT id, regexp_replace(data_json, '[\\r\\n]', ' ', 'g') AS line FROM document_store WHERE data_json IS NOT NULL)
SELECT count(*) FILTER (WHERE json_valid(line)) AS parsed, count(*) FILTER (WHERE NOT json_valid(line)) AS skipped, count(DISTINCT line) FILTER (WHERE json_valid(line)) > 0 AS any_line FROM d WHERE trim(line) <> ''
""")
def loaded_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark, "lines")
    lines = table(spark, sf, "document_store").where(F.col("data_json").isNotNull()).select("id", F.regexp_replace("data_json", "[\\r\\n]", " ").alias("value")).distinct()
    lines.select("value").write.text(folder)
    docs, seen = files.load_json(spark, folder)
    return docs.agg(F.count_distinct("id").alias("parsed"), F.lit(seen.skipped_bad_lines).cast("long").alias("skipped"), (F.count("data_json") > 0).alias("any_line"))


@query("""
WITH n AS (SELECT DISTINCT link, headline, category, short_description, date FROM news_articles)
SELECT 'news-' || sha1(coalesce(link, coalesce(headline, '') || '|' || coalesce(date, '')))[1:16] AS id, nullif(category, '') AS tag,
  nullif(concat_ws(' ', nullif(headline, ''), nullif(short_description, '')), '') AS content FROM n
""")
def prepared_news(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as irregular lines, salvaged and made documents."""
    rows = table(spark, sf, "news_articles").select("link", "headline", "category", "short_description", "date").distinct()
    lines = rows.select(F.concat(F.lit("junk "), F.to_json(F.struct(*rows.columns)), F.lit(" tail")).alias("line"))
    docs = files.to_documents(files.salvage(lines))
    return docs.select("id", F.get("tags", F.lit(0)).alias("tag"), "content")


@query("""
WITH d AS (SELECT DISTINCT id, rev, deleted, data_json, tags, content FROM document_store)
SELECT format, id, CAST(coalesce(len(tags), -1) AS INTEGER) AS tags_count, CAST(length(content) AS INTEGER) AS content_len FROM d, (SELECT unnest(['parquet', 'orc']) AS format)
""")
def columnar_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """The columnar form written as Parquet and ORC and read back."""
    folder = _folder(spark, "columnar")
    files.write_columnar(docs_view(spark, sf), folder)
    back = [getattr(spark.read, f)(f"{folder}/{f}").select(F.lit(f).alias("format"), "id", "tags_count", "content_len") for f in ("parquet", "orc")]
    return back[0].union(back[1])


@query("SELECT event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY event_type UNION ALL SELECT event_type, CAST(count(*) AS VARCHAR) FROM events GROUP BY event_type")
def metrics_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements appended twice to CSV and read back."""
    folder = _folder(spark, "metrics")
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    for _ in range(2):
        files.append_metrics(rows, folder)
    return spark.read.csv(folder, header=True)


@query(r"""
SELECT id, lower(trim(op)) AS op, rev, seq, doc.content AS content, doc.deleted AS deleted, doc IS NULL AS no_doc FROM (SELECT DISTINCT * FROM wal_records)
""")
def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as JSON lines and read back."""
    folder = _folder(spark, "wal")
    log = table(spark, sf, "wal_records").distinct()
    files.append_log(log.select("op", "id", "rev", "seq", "doc", "ts"), folder)
    back = files.read_log(spark, folder)
    return back.select("id", F.lower(F.trim("op")).alias("op"), "rev", "seq", "doc.content", "doc.deleted", F.col("doc").isNull().alias("no_doc"))


@query(r"""
SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_transform(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL), lambda t: upper(trim(t, E' \t\r\n')))), lambda t: t <> '')), ',') AS keys
FROM (SELECT DISTINCT id, tags FROM document_store)
""")
def tag_keys_of(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "document_store").select("id", "tags").distinct()
    return docs.select("id", F.array_join(F.array_sort(tag_keys(F.col("tags"))), ",").alias("keys"))
