"""Statistics of databases and shards, and of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import indexes


def db_stats(docs: DataFrame, seq: int | None = None) -> DataFrame:
    """One row: ``seq, docs_total, docs_alive, docs_deleted, eq_index_fields, tag_index_count, full_text_tokens``.

    The index counts are over live documents. The three of them are scalar subqueries, so each aggregates by itself.
    """
    heads = docs.agg(F.count("*").alias("docs_total"), F.count_if(~F.col("deleted")).alias("docs_alive"), F.count_if(F.col("deleted")).alias("docs_deleted"))
    eq, tags, tokens = indexes.eq_index(docs), indexes.tag_index(docs), indexes.token_index(docs)
    return heads.select(
        F.lit(seq).cast("long").alias("seq"), "docs_total", "docs_alive", "docs_deleted",
        eq.agg(F.count_distinct("field")).scalar().alias("eq_index_fields"),
        tags.agg(F.count_distinct("tag_key")).scalar().alias("tag_index_count"),
        tokens.agg(F.count_distinct("token")).scalar().alias("full_text_tokens"),
    )


def sequence(log: DataFrame) -> DataFrame:
    """The highest sequence number of each log, 0 where it has none."""
    return log.groupBy("db", "shard").agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def merge_shard_stats(shards: DataFrame) -> DataFrame:
    """Statistics of shards as one row: highest ``seq`` and index counts, sums of documents and tokens.

    Tokens that shards share count in each. For exact counts take :func:`db_stats` over all documents.
    """
    return shards.agg(
        F.coalesce(F.max("seq"), F.lit(0)).alias("seq"), F.sum("docs_total").alias("docs_total"), F.sum("docs_alive").alias("docs_alive"),
        F.sum("docs_deleted").alias("docs_deleted"), F.max("eq_index_fields").alias("eq_index_fields"),
        F.max("tag_index_count").alias("tag_index_count"), F.sum("full_text_tokens").alias("full_text_tokens"),
    )


def shard_stats(docs: DataFrame, shard: str = "shard") -> DataFrame:
    """:func:`db_stats` without ``seq`` for each shard, by one pass of each index."""
    live = docs.where(~F.col("deleted"))
    heads = docs.groupBy(shard).agg(F.count("*").alias("docs_total"), F.count_if(~F.col("deleted")).alias("docs_alive"), F.count_if(F.col("deleted")).alias("docs_deleted"))
    of = live.select("id", shard).distinct()
    eq = indexes.eq_index(docs).join(of, "id").groupBy(shard).agg(F.count_distinct("field").alias("eq_index_fields"))
    tags = indexes.tag_index(docs).join(of, "id").groupBy(shard).agg(F.count_distinct("tag_key").alias("tag_index_count"))
    tokens = indexes.token_index(docs).join(of, "id").groupBy(shard).agg(F.count_distinct("token").alias("full_text_tokens"))
    return heads.join(eq, shard, "left").join(tags, shard, "left").join(tokens, shard, "left").na.fill(0)


def latest_metric(metrics: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: combined before the shuffle."""
    rest = [c for c in metrics.columns if c not in keys]
    best = metrics.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def mean_and_deviation(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and population standard deviation of measurements."""
    return rows.groupBy(*keys).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def percentiles(rows: DataFrame, value: str, at: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as columns ``p50`` and so on."""
    return rows.groupBy(*(keys or [])).agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in at))


def bench_sizes(rows: DataFrame, size: str, docs: str, keys: list[str]) -> DataFrame:
    """Total bytes over all iterations, and bytes a document: the total over the documents of one iteration."""
    return rows.groupBy(*keys).agg(F.sum(size).alias("total_bytes"), (F.sum(size) / F.max(docs)).alias("avg_bytes_per_doc"))


def speedup(rows: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """How many times faster than ``base`` each row is, within the same rows otherwise."""
    ref = F.max(F.when(F.col(key) == base, F.col(value))).over(Window.partitionBy(*(c for c in rows.columns if c not in (key, value))))
    return rows.withColumn("speedup", ref / F.col(value))


def scales(asked: DataFrame, most: int, name: str = "n") -> DataFrame:
    """The sizes to measure at: different ones, none above ``most``, in order."""
    return asked.select(F.least(F.col(name), F.lit(most)).alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name)


#: Messages that the counters of a batch carry at most; :func:`batch_errors` has all of them.
MESSAGES = 1000


def batch_result(entries: DataFrame) -> DataFrame:
    """Counters of an applied batch (``seq, ok, error``): successes, failures, last successful seq, messages by seq.

    ``errors`` maps the first thousand failed numbers to their messages; :func:`batch_errors` is the table of all.
    """
    first = batch_errors(entries).orderBy("seq").limit(MESSAGES)
    errors = first.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("seq", "error"))))).scalar()
    return entries.agg(F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failed_count"), F.coalesce(F.max(F.when(F.col("ok"), F.col("seq"))), F.lit(0)).alias("last_seq")).select("*", errors.alias("errors"))


def batch_errors(entries: DataFrame) -> DataFrame:
    """``seq, error`` of the failures."""
    return entries.where(~F.col("ok")).select("seq", F.coalesce("error", F.lit("Unknown error")).alias("error"))
