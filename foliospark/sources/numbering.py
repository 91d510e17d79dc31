"""Consecutive numbers for the rows of a table in order, without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.sources.tables import stage


def numbered(rows: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """``rows`` with consecutive numbers from ``start`` in order.

    Rows are sorted over ranges and written; each range's rows are counted, and the running sum of those counts, one row
    for each partition of the sort, is broadcast to shift the numbers within the ranges.
    """
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = stage(rows.orderBy(*order).select("*", part.alias("_part"), within.alias("_within")), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = fixed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_shift"))
    return fixed.join(F.broadcast(shifts), "_part").select(*rows.columns, (F.col("_shift") + F.col("_within")).cast("long").alias(name))
