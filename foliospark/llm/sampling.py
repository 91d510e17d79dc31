"""A sample whose category shares match targets (problem 2): the cube method on category indicators.

Every article of a category starts with the same inclusion probability: rows needed over rows there are. A flight step
moves along a direction in the kernel of the balancing matrix until an article is decided. The balancing variables are
category indicators, so the directions with two articles of one category span that kernel, and each step decides at
least one of the two while their sum, hence the balance, stays exactly as it was. Flights run within buckets of
articles; what stays undecided, at most one article for each category and bucket, merges upward into fewer buckets until
one is left, where the landing decides the remainder. Probabilities are whole numbers over the category's size, so
nothing is lost to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import folded
from foliospark.sources.tables import stage

#: Articles in a bucket of the first flight, about; buckets that merge into one of the next level.
BUCKET_ROWS = 8_192
FAN_IN = 64

_FLOWN = "key string, cat string, psi long, size long, bucket long, draw long"
_NAMES = ["key", "cat", "psi", "size", "bucket", "draw"]


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the articles' draws alone, so that a repeated task decides alike."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(y).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) / 2.0**64


def flight_step(a: np.ndarray, b: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step from inclusion numerators ``a, b`` (over ``size``): along (1, -1) or back, to the cube's border."""
    up, down = np.minimum(size - a, b), np.minimum(a, size - b)
    forth = u * (up + down) < down
    return np.where(forth, a + up, a - down), np.where(forth, b - up, b + down)


def fly(psi: np.ndarray, size: np.ndarray, group: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The numerators after flights within groups (rows in order of groups): at most one in each is left undecided.

    Every round pairs neighbours among a group's undecided rows and takes a step in each pair, so at least one of the
    two is decided; all groups fly together.
    """
    psi = psi.copy()
    open_ = np.nonzero((psi > 0) & (psi < size))[0]
    while len(open_):
        g = group[open_]
        start = np.nonzero(np.diff(g, prepend=g[0] - 1))[0]
        place = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
        first = np.nonzero((place[:-1] % 2 == 0) & (g[:-1] == g[1:]))[0]
        if not len(first):
            break
        i, j = open_[first], open_[first + 1]
        psi[i], psi[j] = flight_step(psi[i], psi[j], size[i], _mix(draw[i], draw[j]))
        open_ = open_[(psi[open_] > 0) & (psi[open_] < size[open_])]
    return psi


def _flight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flights over rows sorted by bucket, category and draw, for all buckets that are complete; the last one is held."""

    def flown(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        bucket, psi, size, draw = (table.column(c).to_numpy() for c in ("bucket", "psi", "size", "draw"))
        cat = table.column("cat").combine_chunks().dictionary_encode().indices.to_numpy()
        group = np.cumsum((np.diff(bucket, prepend=bucket[0]) != 0) | (np.diff(cat, prepend=cat[0]) != 0))
        psi = fly(psi, size, group, draw)
        yield from table.set_column(2, "psi", pa.array(psi)).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        if held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield from flown(pa.Table.from_batches(held))
            held = []
        cut = int(np.searchsorted(bucket, bucket[-1], "left"))
        if cut:
            yield from flown(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from flown(pa.Table.from_batches(held))


def _fly(rows: DataFrame) -> DataFrame:
    """A partition holds as many buckets as fall to it, in order: their number follows the rows, that of tasks doesn't."""
    return rows.select(*_NAMES).repartition("bucket").sortWithinPartitions("bucket", "cat", "draw", "key").mapInArrow(_flight, _FLOWN)


def _targets(targets: DataFrame) -> DataFrame:
    """One row for each wanted category, named as first spelled, with ``needed`` rows. Repeated rows count once."""
    share = F.coalesce("target_permille", F.lit(0)).cast("decimal(20,0)") * F.coalesce("sample_rows", F.lit(0)).cast("decimal(18,0)")
    needed = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.ceil(share / 1000).cast("long"))
    key = folded(F.col("category"))
    return targets.where(key.isNotNull()).groupBy(key.alias("cat")).agg(F.min("category").alias("category"), F.max(needed).alias("needed"), F.max("target_permille").alias("target_permille"))


def cube_sample(rows: DataFrame, targets: DataFrame, key: str = "id", category: str = "category", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report): a balanced sample of distinct ``key`` and what could not be met.

    ``targets`` has ``category, target_permille, min_rows, sample_rows``; a category needs the larger of its minimum
    and its share of the sample, rounded up. Names are compared without case, blanks at the ends and the amount of
    white space. Rows without key or of categories not wanted take no part; repeated rows count once; a key in two
    categories counts in each.

    sample: ``key, category``. report, a row for each target: ``category, needed, available, sampled, shortfall,
    residual`` where residual is sampled minus needed, 0 wherever there are enough rows. The two are staged and flown
    once; the sample is the same for the same rows and seed, whatever the partitions.
    """
    wanted = stage(_targets(targets), "targets")
    units = rows.select(F.col(key).cast("string").alias("key"), folded(F.col(category)).alias("cat")).where(F.col("key").isNotNull() & F.col("cat").isNotNull())
    units = stage(units.join(wanted.select("cat"), "cat", "left_semi").distinct(), "units")
    sizes = units.groupBy("cat").agg(F.count("*").alias("size"))
    plan = stage(wanted.join(sizes, "cat", "left").na.fill(0, ["size"]), "plan")
    total = plan.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_ROWS))
    draw = F.xxhash64(F.lit(seed).cast("long"), "key", "cat")
    psi = F.least("needed", "size")
    rows_in = units.join(plan.select("cat", psi.alias("psi"), "size"), "cat").withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(buckets))).withColumn("draw", draw)
    flown = stage(_fly(rows_in), "flight")
    open_ = (F.col("psi") > 0) & (F.col("psi") < F.col("size"))
    taken = flown.where(F.col("psi") == F.col("size"))
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        up = flown.where(open_).withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
        flown = stage(_fly(up), "flight")
        taken = taken.unionByName(flown.where(F.col("psi") == F.col("size")))
    # Landing: a remainder below one article, which whole numerators leave only if a target was no whole number of rows.
    landed = flown.where(open_ & (F.pmod("draw", F.col("size")) < F.col("psi")))
    sample = stage(taken.unionByName(landed).select("key", "cat"), "sample")
    got = sample.groupBy("cat").agg(F.count("*").alias("sampled"))
    report = plan.join(got, "cat", "left").na.fill(0, ["sampled"])
    report = report.select("category", "needed", F.col("size").alias("available"), "sampled", F.greatest(F.col("needed") - F.col("size"), F.lit(0)).alias("shortfall"), (F.col("sampled") - F.col("needed")).alias("residual"))
    return sample.join(wanted.select("cat", "category"), "cat").select(F.col("key").alias(key), "category"), report
