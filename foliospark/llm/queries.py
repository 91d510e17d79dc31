"""Queries of the training-data operators."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, enrichment, leakage, neardup, pii, sampling
from foliospark.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    _, report = sampling.cube_sample(table(spark, sf, "news_articles"), table(spark, sf, "category_targets"))
    return report.where((F.col("sampled") < F.col("needed")) & (F.col("shortfall") > 0)).select("category")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cube_sample(table(spark, sf, "news_articles"), table(spark, sf, "category_targets"))[1]


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cube_sample(table(spark, sf, "news_articles"), table(spark, sf, "category_targets"))[0]


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The sample itself, counted: rows and different articles of each category that has any."""
    return p2_sample(spark, sf).groupBy("category").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    news = table(spark, sf, "news_articles").select(F.lit("news_articles").alias("tab"), "id", F.concat(F.coalesce("headline", F.lit("")), F.lit(" "), F.coalesce("short_description", F.lit(""))).alias("text"))
    return news.union(table(spark, sf, "document_store").select(F.lit("document_store"), "id", "content"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.similar_pairs(_texts(spark, sf))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(_texts(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that are enriched in their record (a score above 0), as rare and as frequent as asked."""
    scored = enrichment.distinctive(table(spark, sf, "document_store")).where(F.col("score") > 0)
    content = (F.col("field") == "content") & (F.col("tf") >= 3) & (F.col("df") <= 5)
    tags = (F.col("field") == "tags") & F.col("df").between(2, 5)
    return scored.where(content | tags).select("field", "id", "term").distinct()


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = enrichment.distinctive(table(spark, sf, "document_store"))
    return scored.select("field", "id", "term", "tf", "df", "cf", F.round("p_log", 3).alias("p_log"), F.round("score", 3).alias("score"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items with the number of documents that hold part of them."""
    return p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def _key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms, from the session; without one, a new one each time, so that no one can undo them."""
    given = spark.conf.get("spark.foliospark.pseudonymKey", None)
    return given.encode() if given else secrets.token_bytes(32)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.items(table(spark, sf, "documents"), table(spark, sf, "name_list"), _key(spark)).select("doc_id", "kind", "found")


def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"), table(spark, sf, "name_list"), _key(spark))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_sample, p2_counts, p3_found, p3_groups, p4_found, p4_scores, p8_ids, p9_found, p9_items, p10_found, p10_redacted)}

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]{{2,}}')"

_NEED = r"""
WITH n AS (
  SELECT upper(regexp_replace(trim(category, E' \t\r\n'), '\s+', ' ', 'g')) AS cat, min(category) AS category,
         max(greatest(min_rows, CAST(ceil(target_permille * sample_rows / 1000.0) AS BIGINT))) AS needed
  FROM category_targets GROUP BY 1
), a AS (
  SELECT upper(regexp_replace(trim(category, E' \t\r\n'), '\s+', ' ', 'g')) AS cat, count(DISTINCT id) AS available FROM news_articles GROUP BY 1
), r AS (
  SELECT category, needed, coalesce(available, 0) AS available FROM n LEFT JOIN a ON n.cat = a.cat
)
"""

_PAIRS = f"""
WITH texts AS (
  SELECT DISTINCT 'news_articles' AS tab, id, coalesce(headline, '') || ' ' || coalesce(short_description, '') AS t FROM news_articles
  UNION SELECT DISTINCT 'document_store', id, content FROM document_store WHERE content IS NOT NULL
), sets AS (
  SELECT tab, id, list_distinct({_WORDS.format("t")}) AS w FROM texts
), big AS (
  SELECT DISTINCT tab, id, w, len(w) AS n FROM sets WHERE len(w) >= 16
), inter AS (
  SELECT a.tab, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.w, b.w)) AS c
  FROM big a JOIN big b ON a.tab = b.tab AND a.id < b.id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n
)
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
ds AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
es AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e WHERE len(w) >= 12)),
found AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (s))
"""

SQL = {
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p9_items": _LEAKS + "SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id",
    "p2_found": _NEED + "SELECT category FROM r WHERE available < needed",
    "p2_report": _NEED + "SELECT category, needed, available, least(needed, available) AS sampled, greatest(needed - available, 0) AS shortfall, least(needed, available) - needed AS residual FROM r",
    "p2_counts": _NEED + "SELECT category, least(needed, available) AS n_rows, least(needed, available) AS n_ids FROM r WHERE least(needed, available) > 0",
    "p3_groups": _PAIRS.replace("WITH texts", "WITH RECURSIVE texts")
    + """, kin AS (SELECT tab, id_a, id_b FROM inter WHERE c >= 0.6 * (n_a + n_b - c)),
    cls AS (SELECT tab, id, min(id) OVER (PARTITION BY tab, list_sort(w)) AS class_id FROM big),
    near AS (SELECT DISTINCT k.tab, a.class_id AS x, b.class_id AS y FROM kin k JOIN cls a ON a.tab = k.tab AND a.id = k.id_a JOIN cls b ON b.tab = k.tab AND b.id = k.id_b WHERE a.class_id <> b.class_id),
    edge AS (SELECT tab, x, y FROM near UNION SELECT tab, y, x FROM near),
    reach AS (SELECT DISTINCT tab, class_id AS x, class_id AS y FROM cls UNION SELECT r.tab, r.x, e.y FROM reach r JOIN edge e ON r.tab = e.tab AND r.y = e.x),
    root AS (SELECT tab, x, min(y) AS group_id FROM reach GROUP BY ALL),
    deg AS (SELECT tab, x, count(*) AS links FROM edge GROUP BY ALL)
    SELECT c.tab, c.id, c.class_id, coalesce(d.links, 0) AS links, r.group_id
    FROM cls c JOIN root r ON r.tab = c.tab AND r.x = c.class_id LEFT JOIN deg d ON d.tab = c.tab AND d.x = c.class_id""",
    "p3_found": _PAIRS + "SELECT DISTINCT tab, id_a, id_b FROM inter WHERE c >= 0.6 * (n_a + n_b - c)",
    "p4_scores": f"""
WITH d AS (SELECT DISTINCT id, content, tags FROM document_store WHERE id IS NOT NULL),
o AS (
  SELECT 'content' AS field, id, unnest({_WORDS.format("content")}) AS term FROM d
  UNION ALL
  SELECT DISTINCT 'tags', id, term FROM (SELECT id, lower(trim(x, E' \\t\\r\\n')) AS term FROM (SELECT id, unnest(tags) AS x FROM d)) WHERE term <> ''
),
t AS (SELECT field, id, term, count(*) AS k FROM o GROUP BY ALL),
p AS (
  SELECT *, count(*) OVER (PARTITION BY field, term) AS df, sum(k) OVER (PARTITION BY field, term) AS cf,
         sum(k) OVER (PARTITION BY field, id) AS n, sum(k) OVER (PARTITION BY field) AS total FROM t
),
c AS (SELECT field, k, cf, n, total, count(*) AS w FROM p GROUP BY ALL),
x AS (
  SELECT field, k, cf, n, w, CASE WHEN k <= greatest(0, n + cf - total) THEN 0.0 ELSE least(0.0, ln(list_sum(list_transform(range(CAST(k AS BIGINT), CAST(least(n, cf) AS BIGINT) + 1), lambda i:
    exp(lgamma(cf + 1) - lgamma(i + 1) - lgamma(cf - i + 1) + CASE WHEN n - i > total - cf THEN -1e9 ELSE lgamma(total - cf + 1) - lgamma(n - i + 1) - lgamma(total - cf - n + i + 1) END
        - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)))))) END AS p_log FROM c
),
r AS (SELECT *, p_log + ln(sum(w) OVER (PARTITION BY field) / sum(w) OVER (PARTITION BY field ORDER BY p_log RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS raw FROM x),
q AS (SELECT *, least(0.0, min(raw) OVER (PARTITION BY field ORDER BY p_log DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_log FROM r)
SELECT p.field, id, term, p.k AS tf, df, CAST(p.cf AS BIGINT) AS cf, round(p_log, 3) + 0.0 AS p_log, round(-q_log, 3) + 0.0 AS score
FROM p JOIN q ON p.field = q.field AND p.k = q.k AND p.cf = q.cf AND p.n = q.n
""",
    "p4_found": f"""
WITH c AS (SELECT DISTINCT id, content FROM document_store WHERE content IS NOT NULL),
t AS (SELECT id, unnest({_WORDS.format("content")}) AS term FROM c),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(DISTINCT id) AS df FROM tf GROUP BY term),
g AS (SELECT DISTINCT id, lower(trim(x, E' \\t\\r\\n')) AS term FROM (SELECT id, unnest(tags) AS x FROM document_store)),
gf AS (SELECT term, count(DISTINCT id) AS df FROM g WHERE term <> '' GROUP BY term)
SELECT 'content' AS field, id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df <= 5
UNION ALL
SELECT 'tags', id, term FROM g JOIN gf USING (term) WHERE df BETWEEN 2 AND 5
""",
}
