"""Listing and searching documents: fields, tags, full text. Every search sees live documents only and is paged by id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import fields
from foliospark.functions.text import tag_key, tag_keys, tokens

MAX_LIMIT = 1000
Range = tuple[str, float | None, float | None]


@dataclass
class FieldQuery:
    """A search by fields as a request carries it."""

    equals: Mapping[str, str] = field(default_factory=dict)
    numeric_field: str | None = None
    min: float | None = None
    max: float | None = None
    skip: int = 0
    limit: int = 100

    def run(self, docs: DataFrame) -> DataFrame:
        return find_by_fields(docs, self.equals, (self.numeric_field, self.min, self.max) if self.numeric_field else None, self.skip, self.limit)


@dataclass
class TagQuery:
    """A search by tags as a request carries it."""

    all_of: Sequence[str] | None = None
    any_of: Sequence[str] | None = None
    none_of: Sequence[str] | None = None
    skip: int = 0
    limit: int = 100

    def run(self, docs: DataFrame) -> DataFrame:
        return find_by_tags(docs, self.all_of, self.any_of, self.none_of, self.skip, self.limit)


def page(docs: DataFrame, skip: int, limit: int, order: Sequence[str] = ("id",)) -> DataFrame:
    """One page in order. A limit of 0 or less gives nothing, one over 1000 counts as 1000, a negative skip as 0.

    Spark keeps the least skip + limit rows of each partition and merges those, so nothing is sorted as a whole.
    """
    if limit <= 0:
        return docs.limit(0)
    ordered = docs.orderBy(*order)
    return (ordered.offset(skip) if skip > 0 else ordered).limit(min(limit, MAX_LIMIT))


def all_docs(docs: DataFrame, skip: int = 0, limit: int = 1000, include_deleted: bool = True) -> DataFrame:
    """Documents in id order."""
    return page(docs if include_deleted else docs.where(~F.col("deleted")), skip, limit)


def _indexed_text(name: str) -> Column | None:
    if name.startswith("data."):
        return fields.path_text(F.col("data_json"), name[5:])
    if name == "content":
        return F.col("content")
    if name.startswith("tags[") and name.endswith("]") and name[5:-1].isdigit():
        return F.get("tags", F.lit(int(name[5:-1])))
    return None


def equality(name: str, value: str) -> tuple[Column | None, Column]:
    """(match by path, match by top-level name) of one field; by path only strings and booleans match."""
    by_path = _indexed_text(name)
    return None if by_path is None else F.coalesce(by_path == value, F.lit(False)), F.coalesce(fields.top_text(F.col("data_json"), name) == value, F.lit(False))


def _between(number: Column, low: float | None, high: float | None) -> Column:
    tests = [number.isNotNull()] + ([number >= low] if low is not None else []) + ([number <= high] if high is not None else [])
    return F.coalesce(reduce(and_, tests), F.lit(False))


def find_by_fields(
    docs: DataFrame, equals: Mapping[str, str] | None = None, numeric: Range | None = None, skip: int = 0, limit: int = 100, mode: Literal["address", "data"] = "address", paged: bool = True
) -> DataFrame:
    """Live documents with all the field values and the number in the range (ends included, None leaves one open).

    ``mode="address"``: the way a field is addressed decides: ``data.a.b[0]``, ``content`` and ``tags[0]`` by path
    (strings and booleans, or JSON numbers), other names by top-level field (its string form; numbers and numeric
    strings). ``mode="data"`` decides by the data: by path if any live document has that path and value (or, for
    ranges, a number at that path), else by top-level name; this costs one aggregate over the documents for each test.
    """
    live = docs.where(~F.col("deleted"))
    tests = []
    for name, value in (equals or {}).items():
        by_path, by_name = equality(name, value)
        if by_path is None:
            tests.append(by_name)
        elif mode == "address":
            tests.append(by_path)
        else:
            tests.append(F.when(live.agg(F.coalesce(F.max(by_path), F.lit(False))).scalar(), by_path).otherwise(by_name))
    if numeric is not None:
        name, low, high = numeric
        by_name = _between(fields.top_number(F.col("data_json"), name), low, high)
        if not name.startswith("data."):
            tests.append(by_name)
        else:
            number = fields.path_number(F.col("data_json"), name[5:])
            by_path = _between(number, low, high)
            tests.append(by_path if mode == "address" else F.when(live.agg(F.coalesce(F.max(number.isNotNull()), F.lit(False))).scalar(), by_path).otherwise(by_name))
    found = live.where(reduce(and_, tests)) if tests else live
    return page(found, skip, limit) if paged else found


def find_by_tags(
    docs: DataFrame, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None, none_of: Sequence[str] | None = None, skip: int = 0, limit: int = 100, paged: bool = True
) -> DataFrame:
    """Live documents with all of, any of and none of the tags, compared trimmed and without case.

    None and, for all and none, an empty list don't constrain; an empty ``any_of`` gives nothing.
    """
    keys = tag_keys(F.col("tags"))

    def wanted(tags: Sequence[str]) -> Column:
        return F.array(*(tag_key(F.lit(t)) for t in tags))

    tests = [~F.col("deleted")]
    if all_of:
        tests.append(F.size(F.array_except(wanted(all_of), keys)) == 0)
    if any_of is not None:
        tests.append(F.arrays_overlap(wanted(any_of), keys) if any_of else F.lit(False))
    if none_of:
        tests.append(~F.arrays_overlap(wanted(none_of), keys))
    found = docs.where(reduce(and_, tests))
    return page(found, skip, limit) if paged else found


def _with_tokens(docs: DataFrame, query: str) -> DataFrame:
    asked = F.array_distinct(tokens(F.lit(query)))
    have = fields.searchable_tokens(F.col("data_json"), F.col("tags"), F.col("content"))
    return docs.where(~F.col("deleted") & (F.size(asked) > 0) & (F.size(F.array_except(asked, have)) == 0))


def full_text_search(docs: DataFrame, query: str, skip: int = 0, limit: int = 100, paged: bool = True) -> DataFrame:
    """Live documents that hold every token of the query in their data, tags or content; none for a query without tokens."""
    found = _with_tokens(docs, query)
    return page(found, skip, limit) if paged else found


def full_text_search_compact(docs: DataFrame, query: str, skip: int = 0, limit: int = 100, order: Sequence[str] = ("doc_num", "id")) -> DataFrame:
    """The same matches in the order in which documents were first indexed, as given by ``order``."""
    return page(_with_tokens(docs, query), skip, limit, order)


def full_text(docs: DataFrame, query: str, skip: int = 0, limit: int = 100, order: Literal["id", "insertion"] = "id") -> DataFrame:
    """Full-text search with the order as an option."""
    return full_text_search(docs, query, skip, limit) if order == "id" else full_text_search_compact(docs, query, skip, limit)
