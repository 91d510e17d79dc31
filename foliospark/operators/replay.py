"""Applying a log of puts and deletes (problem 5): commit-ordered, transactional replay.

What stands under one sequence number of a log is a transaction: all its deliveries are assembled, for each document
the one that decides. Transactions of different documents don't conflict and are applied in parallel; those of one
document in the order of ``seq``. A gap in ``seq`` holds back all that follows: the first commit applies the contiguous
transactions up to each log's watermark and is all that an open log exposes. At the end of a log gaps are final, and the
held transactions are released over that state as a second commit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.sources.state import StateStore
from foliospark.sources.tables import keep_for_release, shared_dir, stage

LOG = ["db", "shard"]
#: Sequence numbers in one block of the search for gaps.
BLOCK = 16_384


def _op() -> Column:
    return F.lower(F.regexp_replace("op", r"(?U)^\s+|\s+$", ""))


def transactions(log: DataFrame) -> DataFrame:
    """``db, shard, seq, id, ts, rev, is_del, alive``: each transaction's deciding line for every document it changes.

    Lines that count are ``del``, or ``put`` with a ``doc``; within a transaction the latest ``ts`` decides, full ties
    take the highest ``rev``, a delete before a put. A line that changes nothing, or has no ``id``, fills its place: it
    is there with a null ``id``. Lines without ``seq`` are no part of the order and are left out. Repeated deliveries
    are combined before the shuffle.
    """
    op = _op()
    counts = (op == "del") | ((op == "put") & F.col("doc").isNotNull())
    order = F.struct("ts", "rev", (op == "del").alias("is_del"), ((op == "put") & F.coalesce(~F.col("doc.deleted"), F.lit(False))).alias("alive"))
    rows = log.where(F.col("seq").isNotNull()).select(*LOG, "seq", F.when(counts, F.col("id")).alias("id"), order.alias("_o"))
    return rows.groupBy(*LOG, "seq", "id").agg(F.max("_o").alias("_b")).select(*LOG, "seq", "id", "_b.ts", "_b.rev", "_b.is_del", "_b.alive")


def apply(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after transactions: for each document the line of the highest ``seq``, over a state's own if given.

    Lines are combined before the shuffle, so a document with a large part of all changes costs no more there than any
    other.
    """
    rows = changes.where(F.col("id").isNotNull()).select(*LOG, "id", "seq", "rev", "ts", "is_del", "alive")
    rows = rows if state is None else rows.unionByName(state.select(rows.columns))
    best = rows.groupBy(*LOG, "id").agg(F.max(F.struct("seq", "ts", "rev", "is_del", "alive")).alias("_b"))
    return best.select(*LOG, "id", "_b.seq", "_b.rev", "_b.ts", "_b.is_del", "_b.alive")


def _blocks(log: DataFrame) -> DataFrame:
    """``db, shard, block`` with the lowest and highest number, how many there are, and how far they reach.

    Any line fills its place. ``reached`` is the last number of a block up to which its log has no gap, null beyond the
    first gap. The numbers of a block are a bounded set; only blocks, not numbers, are looked at log by log.
    """
    rows = log.where(F.col("seq").isNotNull()).select(*LOG, F.floor(F.col("seq") / BLOCK).alias("block"), "seq")
    own = rows.groupBy(*LOG, "block").agg(F.array_sort(F.collect_set("seq")).alias("_a"))
    lo = F.col("_a")[0]
    run = F.size(F.filter("_a", lambda x, i: x - i == lo))
    own = own.select(*LOG, "block", lo.alias("lo"), F.element_at("_a", -1).alias("hi"), F.size("_a").cast("long").alias("n"), (lo + run - 1).alias("_run"))
    in_order = Window.partitionBy(*LOG).orderBy("block")
    joins = F.coalesce(F.lag("hi").over(in_order), F.col("lo") - 1) + 1 == F.col("lo")
    own = own.withColumn("_joins", joins).withColumn("_whole", F.col("_joins") & (F.col("_run") == F.col("hi")))
    before = F.coalesce(F.min("_whole").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return own.select(*LOG, "block", "lo", "hi", "n", F.when(before & F.col("_joins"), F.col("_run")).alias("reached"))


def watermarks(log: DataFrame) -> DataFrame:
    """For each log ``first_seq, last_seq, watermark, held``: the contiguous watermark and the numbers beyond it."""
    logs = _blocks(log).groupBy(*LOG).agg(F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"), F.max("reached").alias("watermark"), F.sum("n").alias("_n"))
    return logs.select(*LOG, "first_seq", "last_seq", "watermark", (F.col("_n") - (F.col("watermark") - F.col("first_seq") + 1)).alias("held"))


def ready(changes: DataFrame) -> DataFrame:
    """``changes`` with ``ready``: whether the transaction is within its log's contiguous watermark.

    Changes meet the watermark by log and block of numbers, so no log goes through one task.
    """
    mark = F.max("reached").over(Window.partitionBy(*LOG))
    limits = _blocks(changes).select(*(F.col(c).alias(f"_{c}") for c in LOG), F.col("block").alias("_block"), mark.alias("_mark"))
    here = F.floor(F.col("seq") / BLOCK) == F.col("_block")
    return changes.join(limits, [*(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LOG), here]).select(*changes.columns, (F.col("seq") <= F.col("_mark")).alias("ready"))


def replay(log: DataFrame, closed: bool = True, store: StateStore | None = None) -> DataFrame:
    """Current documents ``db, shard, id, seq, rev`` after the log, read from the committed state.

    The first version of the state holds what each log's contiguous watermark exposes; with ``closed`` (the log is at
    its end) the held transactions are released over it as the second. A document is live if its deciding line is a put
    whose ``doc.deleted`` is false. Repeated lines count once; an empty log gives no rows. ``store`` must be empty.
    """
    spark = log.sparkSession
    store = store or StateStore(spark, keep_for_release(f"{shared_dir(spark)}/foliospark/replay-{uuid.uuid4().hex}"))
    assembled = stage(transactions(log), "transactions")
    changes = stage(ready(assembled), "changes")
    store.add(apply(changes.where("ready")), 0, {"commit": "watermark"})
    if closed:
        store.replace(apply(changes.where(~F.col("ready")), store.read()), 1, {"commit": "end of log"})
    return store.read().where("alive").select(*LOG, "id", "seq", "rev")
