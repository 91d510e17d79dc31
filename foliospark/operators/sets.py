"""Sets of ids, and sorted lists of numbers as arrays: intersection, union, difference, search, rank and select."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    """Rows in all of the sets."""
    return reduce(DataFrame.intersect, sets)


def union_all(sets: list[DataFrame]) -> DataFrame:
    """Rows in any of the sets, each once."""
    return reduce(DataFrame.union, sets).distinct()


def except_all(rows: DataFrame, banned: list[DataFrame]) -> DataFrame:
    """Rows in none of the banned sets."""
    return reduce(DataFrame.subtract, banned, rows)


def list_intersect(lists: list[Column]) -> Column:
    """The numbers in all of the sorted lists."""
    return F.array_sort(reduce(F.array_intersect, lists))


def next_geq(values: Column, at_least: Column) -> Column:
    """The first number of a sorted list that is not less, null if there is none."""
    return F.get(F.filter(values, lambda v: v >= at_least), F.lit(0))


def next_geq_index(values: Column, at_least: Column) -> Column:
    """Its place from 0, or the length of the list."""
    return F.size(F.filter(values, lambda v: v < at_least))


def rank(bits: Column, i: Column) -> Column:
    """How many of the first i characters of a string of 0 and 1 are 1."""
    return F.length(F.replace(F.substring(bits, F.lit(1), i), F.lit("0")))


def select(bits: Column, k: Column) -> Column:
    """The place from 0 of the 1 with number k from 0, or -1."""
    ones = F.filter(F.sequence(F.lit(1), F.greatest(F.length(bits), F.lit(1))), lambda p: F.substring(bits, p, F.lit(1)) == "1")
    return F.coalesce(F.get(ones, k) - 1, F.lit(-1))
