"""Deeply nested records to related flat tables (problem 1).

One pass over each record: a depth-first visitor emits a row for every object, every scalar that is an element of a list
and every tag, carrying the table it belongs to, its own key, its parents' keys and its payload. The rows are written
partitioned by table; each table's schema is applied when it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.json_tree import _Number, _Object, parse, texts
from foliospark.sources.tables import keep_for_release, shared_dir

ROOT = "$"
SCHEMA = "tag string, id string, path string, parent_path string, owner string, is_element boolean, kind string, payload string"
_ARROW = pa.schema([(n, pa.bool_() if n == "is_element" else pa.string()) for n in ("tag", "id", "path", "parent_path", "owner", "is_element", "kind", "payload")])
#: Folders that tables are written to, by a hash of the tag: names of fields are data and may be any number. So many are
#: still listed by the driver alone.
FOLDERS = 32
_BATCH = 20_000


def _plain(value) -> str:
    """The JSON of a scalar; numbers have kept their text."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return encode_basestring(value)
    return "null" if value is None else "true" if value else "false"


def visit(value, path: str = "data") -> Iterator[tuple[str, str, str, str, bool, str, str]]:
    """(table, path, parent path, owner, whether a list element, kind, payload), depth first, with a stack of its own.

    A row for every object (kind ``object``, its scalar fields and empty lists as JSON) and for every scalar element of
    a list or scalar as a whole (kind ``value``, as ``{"value": ...}``), so that nothing of the record is lost. The
    table is the path without list places. The parent path is that of the nearest enclosing object that is itself a list
    element, the owner that of the nearest enclosing object of any kind; ``$`` if there is none.
    """
    stack = [(value, path, path, ROOT, ROOT, False)]
    while stack:
        node, table, at, parent, owner, element = stack.pop()
        if isinstance(node, _Object):
            inner = at if element else parent
            scalars = ",".join(f"{encode_basestring(k)}:{'[]' if isinstance(v, list) else _plain(v)}" for k, v in node if not isinstance(v, list) or not (v or isinstance(v, _Object)))
            yield table, at, parent, owner, element, "object", "{" + scalars + "}"
            stack.extend((v, f"{table}.{k}", f"{at}.{k}", inner, at, False) for k, v in reversed(node) if isinstance(v, list))
        elif isinstance(node, list):
            stack.extend((v, table + "[]", f"{at}[{i}]", parent, owner, True) for i, v in reversed(list(enumerate(node))))
        else:
            yield table, at, parent, owner, element, "value", f'{{"value":{_plain(node)}}}'


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([texts(c) if t == pa.string() else pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        rows.clear()
        return made

    for batch in batches:
        for i, data, tags in zip(*(batch.column(c).to_pylist() for c in ("id", "data_json", "tags"))):
            value = parse(data)
            if value is not None or data is not None and data.strip() == "null":
                rows.extend((tag, i, *row) for tag, *row in visit(value))
            rows.extend(("tags", i, f"tags[{n}]", ROOT, ROOT, True, "value", f'{{"value":{encode_basestring(t)}}}') for n, t in enumerate(tags or ()) if t is not None)
            if len(rows) >= _BATCH:
                yield flush()
    if rows:
        yield flush()


def relational(docs: DataFrame) -> DataFrame:
    """Rows ``tag, id, path, parent_path, owner, is_element, kind, payload`` of all that ``data_json`` and ``tags`` hold.

    ``docs`` needs ``id, data_json, tags``; further columns are ignored. ``path`` is the key of the row within its
    document, ``owner`` the key of the row it lies in, ``parent_path`` that of the list element it lies in. A null,
    blank or broken ``data_json`` and a null list of tags give no rows; null tags are left out and keep their place;
    repeated rows repeat. Each input row is handled alone, so nothing is shuffled.
    """
    return docs.select("id", "data_json", "tags").mapInArrow(_emit, SCHEMA)


def _folder(tag: Column) -> Column:
    return F.pmod(F.xxhash64(tag), F.lit(FOLDERS)).cast("int")


def write_tables(rows: DataFrame, folder: str) -> None:
    """Write the rows of :func:`relational`, each table to one folder, ordered by table within the files.

    The shuffle is a rebalancing one: tasks that a large table overfills are split by size at run time, small ones are
    put together.
    """
    placed = rows.withColumn("part", _folder(F.col("tag"))).hint("rebalance", "part")
    placed.sortWithinPartitions("part", "tag").write.mode("overwrite").partitionBy("part").parquet(folder)


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all tables."""
    return spark.read.schema(f"{SCHEMA}, part int").parquet(folder).drop("part")


def read_table(spark: SparkSession, folder: str, tag: str, fields: str | None = None) -> DataFrame:
    """One flat table, its payload parsed by the DDL schema ``fields``, or as a map of texts without one.

    Only the table's folder is read, and of its files only the groups of rows that may hold the table. A list's scalar
    elements are rows of its table with the field ``value``.
    """
    own = spark.read.schema(f"{SCHEMA}, part int").parquet(folder).where((F.col("part") == _folder(F.lit(tag))) & (F.col("tag") == tag))
    keys = ["id", "path", "parent_path", "owner"]
    if fields is None:
        return own.select(*keys, F.from_json("payload", "map<string,string>").alias("fields"))
    return own.select(*keys, F.from_json("payload", fields).alias("_f")).select(*keys, "_f.*")


def flattened(docs: DataFrame) -> str:
    """The folder of a document table's flat tables, written below the shared folder and kept until the driver's end."""
    folder = keep_for_release(f"{shared_dir(docs.sparkSession)}/foliospark/nested-{uuid.uuid4().hex}")
    write_tables(relational(docs), folder)
    return folder


def elements(docs: DataFrame) -> DataFrame:
    """Distinct ``id, path, parent_path`` of the objects in lists and of the tags, from the flat tables as written."""
    rows = read_rows(docs.sparkSession, flattened(docs))
    return rows.where(F.col("is_element") & ((F.col("kind") == "object") | (F.col("tag") == "tags"))).select("id", "path", "parent_path").distinct()
