"""Processing only new or changed records (problem 6): key and content-hash state.

The state holds for every record (key) the hashes of the contents already processed. A run hashes its current rows and
joins them with the state; what the state doesn't hold is new or changed. What a run took is staged; committing it adds
exactly those keys and hashes to the state and swaps in the next version, so a failed run leaves the version before in
force and is simply repeated, and rows that arrive in between are left for the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.sources.state import StateStore
from foliospark.sources.tables import keep_for_release, shared_dir, stage

KEY = ["db", "shard", "seq"]
#: Rounds in which a history of runs is replayed; each takes an equal share of every log's runs.
ROUNDS = 4


def content_hash(*columns: Column) -> Column:
    """A hash of the columns that keeps nulls and borders between values apart."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.md5(c.cast("string"))), F.lit("n")) for c in columns)))


def select_changes(current: DataFrame, state: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """The rows of ``current`` (with ``key`` and ``_hash``) whose key and hash the state doesn't hold. Null keys are equal."""
    if state is None:
        return current
    names = [*key, "_hash"]
    held = state.select(*(F.col(c).alias(f"_held_{c}") for c in names))
    return current.join(held.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in names], "left_anti")


@dataclass
class Run:
    """What one run took: ``rows`` (staged, with ``_hash``), and the version of the state it is based on."""

    rows: DataFrame
    key: Sequence[str]
    version: int


def run_once(rows: DataFrame, store: StateStore, key: Sequence[str], content: Sequence[str]) -> Run:
    """One run over a table: rows that are new or changed since the state in force, one for each key and content.

    Until :func:`commit` is called with what it gives, a repeated run gives the same again.
    """
    version = store.version()
    hashed = rows.withColumn("_hash", content_hash(*(F.col(c) for c in content))).dropDuplicates([*key, "_hash"])
    return Run(stage(select_changes(hashed, store.read(version), key), "changes"), key, version)


def commit(run: Run, store: StateStore) -> int:
    """Add what the run took to the state; fails if another run was committed since. Gives the new version."""
    return store.add(run.rows.select(*run.key, "_hash"), run.version)


def _frontier(runs: DataFrame) -> DataFrame:
    """Successful runs that read further than every earlier one of their log: the only ones a line can belong to."""
    ok = runs.where((F.lower(F.regexp_replace("status", r"(?U)^\s+|\s+$", "")) == "ok") & F.col("read_until").isNotNull() & F.col("run_id").isNotNull())
    ok = ok.select("run_id", "db", "shard", "read_until").groupBy("db", "shard", "run_id").agg(F.max("read_until").alias("read_until"))
    before = Window.partitionBy("db", "shard").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("read_until").over(before)
    return ok.withColumn("_r", reached).where(F.col("_r").isNull() | (F.col("read_until") > F.col("_r"))).drop("_r")


def _slot(ts: Column) -> Column:
    """The hour of a time without a zone, counted from the epoch."""
    return F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)


def assign_runs(seen: DataFrame, runs: DataFrame, rounds: int = 1) -> DataFrame:
    """``seen`` (``db, shard, ts`` and more) with ``run_id`` of the first successful run that read its ``ts``, else 0.

    ``round`` is the share of the log's runs that the run is in, from 1 to ``rounds``, and one more for run 0.

    Lines meet runs by log and time slot: each slot that has lines carries its own few runs and the first run of a later
    slot. That is an equi-join with one row a slot on the other side, which splits where a slot is hot; no log is
    gathered in one task.
    """
    front = _frontier(runs).withColumn("round", F.ntile(rounds).over(Window.partitionBy("db", "shard").orderBy("run_id")))
    slots = front.groupBy("db", "shard", _slot(F.col("read_until")).alias("_slot")).agg(F.sort_array(F.collect_list(F.struct("read_until", "run_id", "round"))).alias("_runs"))
    seen = seen.withColumn("_slot", _slot(F.col("ts")))
    wanted = seen.where(F.col("_slot").isNotNull()).select("db", "shard", "_slot").distinct()
    both = wanted.withColumn("_runs", F.lit(None).cast(slots.schema["_runs"].dataType)).unionByName(slots)
    both = both.groupBy("db", "shard", "_slot").agg(F.max("_runs").alias("_runs"))
    later = Window.partitionBy("db", "shard").orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_next", F.last(F.col("_runs")[0], ignorenulls=True).over(later))
    b = both.select(*(F.col(c).alias(f"_b{c}") for c in ("db", "shard", "_slot")), "_runs", "_next")
    joined = seen.join(b, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in ("db", "shard", "_slot")], "left")
    here = F.filter("_runs", lambda r: r["read_until"] >= F.col("ts"))
    run = F.when(F.size(here) > 0, here[0]).otherwise(F.col("_next"))
    joined = joined.withColumn("_run", run).withColumn("run_id", F.coalesce("_run.run_id", F.lit(0).cast("long"))).withColumn("round", F.coalesce("_run.round", F.lit(rounds + 1)))
    return joined.drop("_slot", "_bdb", "_bshard", "_b_slot", "_runs", "_next", "_run")


def run_history(log: DataFrame, runs: DataFrame, store: StateStore | None = None, rounds: int = ROUNDS, between: Callable[[int], None] | None = None) -> DataFrame:
    """Which run takes which record: distinct ``run_id, db, shard, seq``; run 0 is the next one.

    Every line belongs to the successful run with the smallest ``run_id`` that read its ``ts``. A record is a case for a
    run if a line of that run has a content (``op`` trimmed and lower case, ``rev``) that no earlier run had. Lines
    without ``ts`` wait for run 0; null ``rev``s are equal.

    The history is replayed against one store in rounds of runs, the pending run last: each round joins its lines with
    the state in force, takes what the state doesn't hold, and commits it as the next version, which records the round.
    Called again with the same store after a failure, also one between taking and committing (``between`` is called
    there), it goes on after the last committed round.
    """
    spark = log.sparkSession
    store = store or StateStore(spark, keep_for_release(f"{shared_dir(spark)}/foliospark/state-{uuid.uuid4().hex}"))
    op = F.lower(F.regexp_replace("op", r"(?U)^\s+|\s+$", ""))
    hashed = log.select(*KEY, "ts", content_hash(op, F.col("rev")).alias("_hash"))
    # A line's place in the history; repeated lines of a run are combined before the shuffle.
    taken = assign_runs(hashed, runs, rounds).groupBy(*KEY, "_hash", "round").agg(F.min("run_id").alias("run_id"))
    taken = stage(taken, "runs")
    while (done := store.manifest().get("meta", {}).get("round", 0)) <= rounds:
        version = store.version()
        fresh = select_changes(taken.where(F.col("round") == done + 1).drop("round"), store.read(version), KEY)
        if between is not None:
            fresh = stage(fresh, "round")
            between(done + 1)
        store.add(fresh, version, {"round": done + 1})
    return store.read().select("run_id", *KEY).distinct()
