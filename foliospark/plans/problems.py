"""Queries of the general data-pipeline operators and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import incremental, nested, packed, replay
from foliospark.sources.tables import table


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_store").select("id", "data_json", "tags").distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.elements(table(spark, sf, "document_store"))


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each flat table."""
    rows = nested.read_rows(spark, nested.flattened(_stored(spark, sf)))
    return rows.groupBy("tag", "kind").agg(F.count("*").alias("n_rows"), F.sum((F.col("parent_path") == nested.ROOT).cast("long")).alias("at_root"), F.sum((F.col("owner") == nested.ROOT).cast("long")).alias("no_owner"))


def p1_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every scalar element of a list, with the object it lies in."""
    rows = nested.read_rows(spark, nested.flattened(_stored(spark, sf))).where((F.col("kind") == "value") & (F.col("tag") != "tags"))
    return rows.select("id", "path", "parent_path", "owner", F.get_json_object("payload", "$.value").alias("value"))


def p1_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """Two flat tables with their schemas, child and parent, joined by their keys."""
    folder = nested.flattened(_stored(spark, sf))
    parcel = nested.read_table(spark, folder, "data.shipments[].parcels[]", "sku string, qty string")
    shipment = nested.read_table(spark, folder, "data.shipments[]", "carrier string").select("id", F.col("path").alias("parent_path"), "carrier")
    return parcel.join(shipment, ["id", "parent_path"]).select("id", "path", "sku", "qty", "carrier")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(table(spark, sf, "wal_records"))


def p5_committed(spark: SparkSession, sf: str) -> DataFrame:
    """The state that each log's contiguous watermark exposes."""
    return replay.replay(table(spark, sf, "wal_records"), closed=False)


def p5_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    return replay.watermarks(table(spark, sf, "wal_records"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.run_history(table(spark, sf, "wal_records"), table(spark, sf, "snapshot_runs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack(table(spark, sf, "news_articles"), "id", "authors", value="author")


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p1_values, p1_parcels, p5_found, p5_committed, p5_watermarks, p6_found, p7_found)}

_WALK = """
WITH RECURSIVE docs AS (
  SELECT DISTINCT id, data_json, tags FROM document_store
), walk AS (
  SELECT id, 'data' AS path, '$' AS parent_path, '$' AS owner, false AS is_element, CAST(data_json AS JSON) AS v
  FROM docs WHERE json_valid(data_json)
  UNION ALL
  SELECT w.id, w.path || c.step, CASE WHEN json_type(w.v) = 'OBJECT' AND w.is_element THEN w.path ELSE w.parent_path END,
         CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path ELSE w.owner END, c.step[1] = '[', c.v
  FROM walk w, LATERAL (
    SELECT '.' || k AS step, json_extract(w.v, '$."' || k || '"') AS v
    FROM (SELECT unnest(json_keys(w.v)) AS k) WHERE json_type(w.v) = 'OBJECT'
    UNION ALL
    SELECT '[' || i || ']', json_extract(w.v, '$[' || i || ']')
    FROM (SELECT unnest(range(CASE WHEN json_type(w.v) = 'ARRAY' THEN CAST(json_array_length(w.v) AS BIGINT) ELSE 0 END)) AS i)
  ) c
  WHERE json_type(c.v) IN ('OBJECT', 'ARRAY') OR json_type(w.v) = 'ARRAY'
), rows AS (
  SELECT id, path, parent_path, owner, is_element, v, CASE WHEN json_type(v) = 'OBJECT' THEN 'object' ELSE 'value' END AS kind,
         regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS tag FROM walk WHERE json_type(v) <> 'ARRAY'
), objects AS (
  SELECT * FROM rows WHERE kind = 'object'
), tagged AS (
  SELECT id, 'tags[' || (i - 1) || ']' AS path, tags[i] AS t FROM (SELECT id, tags, unnest(range(1, len(tags) + 1)) AS i FROM docs)
)
"""

_LIVE = """
WITH lines AS (
  SELECT DISTINCT db, shard, id, seq, ts, rev, lower(trim(op)) AS op, doc IS NULL AS no_doc, doc.deleted AS dead
  FROM wal_records
), best AS (
  SELECT *, row_number() OVER (PARTITION BY db, shard, id ORDER BY seq DESC, ts DESC NULLS LAST, rev DESC NULLS LAST) AS n
  FROM lines WHERE (op = 'del' OR (op = 'put' AND NOT no_doc)) {and_where}
)
SELECT db, shard, id, seq, rev FROM best WHERE n = 1 AND op = 'put' AND dead = false
"""

_MARKS = """
SELECT db, shard, min(seq) AS first_seq, max(seq) AS last_seq,
       min(seq) + count(*) FILTER (WHERE seq = lo + n - 1) - 1 AS watermark,
       count(*) - count(*) FILTER (WHERE seq = lo + n - 1) AS held
FROM (SELECT db, shard, seq, min(seq) OVER (PARTITION BY db, shard) AS lo, row_number() OVER (PARTITION BY db, shard ORDER BY seq) AS n
      FROM (SELECT DISTINCT db, shard, seq FROM wal_records WHERE seq IS NOT NULL))
GROUP BY db, shard
"""

_SPLIT = r"""
WITH raw AS (
  SELECT DISTINCT id, regexp_replace(regexp_replace(trim(authors, E' \t\r\n'), '(?i)^by[\s:]+', ''), '(?s)^\[(.*)\]$', '\1') AS s
  FROM news_articles WHERE authors IS NOT NULL
), pieces AS (
  SELECT id, string_split(s, '"') AS p FROM raw
), marked AS (
  SELECT id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 THEN
    regexp_replace(regexp_replace(regexp_replace(x, '[,;|/&\t\r\n]', chr(1), 'g'), '(?i)(^|\s|\x01)and(\s|\x01|$)', '\1' || chr(1) || '\2', 'g'), '(?i)(^|\s|\x01)and(\s|\x01|$)', '\1' || chr(1) || '\2', 'g')
    ELSE x END), chr(2)) AS s FROM pieces
), cut AS (
  SELECT id, list_filter(list_transform(string_split(s, chr(1)), lambda v:
    trim(replace(replace(regexp_replace(regexp_replace(trim(v, E' \t\r\n'), '(?i)^by[\s:]+', ''), '(?s)^\x02((?:[^\x02]|\x02\x02)*)\x02$', '\1'), chr(2) || chr(2), '"'), chr(2), '"'), E' \t\r\n')), lambda v: v <> '') AS vs
  FROM marked
)
SELECT DISTINCT id, CAST(i AS INTEGER) AS position, vs[i] AS author
FROM (SELECT id, vs, unnest(range(1, len(vs) + 1)) AS i FROM cut)
"""

SQL = {
    "p1_found": _WALK
    + """
SELECT DISTINCT id, path, parent_path FROM objects WHERE is_element
UNION
SELECT id, path, '$' FROM tagged WHERE t IS NOT NULL
""",
    "p1_tables": _WALK
    + """
SELECT tag, kind, count(*) AS n_rows, count(*) FILTER (WHERE parent_path = '$') AS at_root, count(*) FILTER (WHERE owner = '$') AS no_owner
FROM (SELECT tag, kind, parent_path, owner FROM rows UNION ALL SELECT 'tags', 'value', '$', '$' FROM tagged WHERE t IS NOT NULL) GROUP BY tag, kind
""",
    "p1_values": _WALK + "SELECT id, path, parent_path, owner, v ->> '$' AS value FROM rows WHERE kind = 'value'",
    "p1_parcels": _WALK
    + """
SELECT p.id, p.path, p.v ->> '$.sku' AS sku, p.v ->> '$.qty' AS qty, s.v ->> '$.carrier' AS carrier
FROM objects p JOIN objects s ON p.id = s.id AND p.parent_path = s.path
WHERE p.tag = 'data.shipments[].parcels[]' AND s.tag = 'data.shipments[]'
""",
    "p5_found": _LIVE.format(and_where=""),
    "p5_committed": _LIVE.format(and_where=f"AND EXISTS (SELECT 1 FROM ({_MARKS}) m WHERE m.db = lines.db AND m.shard = lines.shard AND lines.seq <= m.watermark)"),
    "p5_watermarks": _MARKS,
    "p6_found": """
WITH ok AS (
  SELECT DISTINCT run_id, db, shard, read_until FROM snapshot_runs WHERE lower(trim(status)) = 'ok'
), lines AS (
  SELECT DISTINCT db, shard, seq, ts, lower(trim(op)) AS op, rev FROM wal_records
), owned AS (
  SELECT l.db, l.shard, l.seq, l.op, l.rev, coalesce(min(r.run_id), 0) AS run_id
  FROM lines l LEFT JOIN ok r ON r.db = l.db AND r.shard = l.shard AND r.read_until >= l.ts
  GROUP BY l.db, l.shard, l.seq, l.ts, l.op, l.rev
), firsts AS (
  SELECT db, shard, seq, op, rev, min(CASE WHEN run_id = 0 THEN 9223372036854775807 ELSE run_id END) AS r
  FROM owned GROUP BY db, shard, seq, op, rev
)
SELECT DISTINCT CASE WHEN r = 9223372036854775807 THEN 0 ELSE r END AS run_id, db, shard, seq FROM firsts
""",
    "p7_found": _SPLIT,
}
