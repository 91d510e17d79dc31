"""An index of documents that is kept: tokens, field values, numbers and tags in buckets by their key, and the documents.

Searches read only the buckets of what they ask for. The index lives in versions (:mod:`foliospark.sources.state`): a
build writes one part, every update adds a part with the changed documents and their entries, and :meth:`compact` makes
one part of all. An entry counts while no later part holds its document, so a changed or deleted document is out of the
index at once and nothing is rewritten.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import fields
from foliospark.functions.text import tag_key, tag_keys, tokens
from foliospark.operators import indexes, search
from foliospark.sources.files import _exists, _fs, _path
from foliospark.sources.numbering import numbered
from foliospark.sources.schema import DOC_COLUMNS, DOCUMENT
from foliospark.sources.state import StateStore
from foliospark.sources.tables import stage

#: Folders that the entries of each kind are written to, by a hash of the key: as many as are still listed by the driver
#: alone. A large collection wants more.
BUCKETS = 32
_DOC = "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in DOCUMENT) + ">"
_SCHEMA = f"key string, value double, id string, doc_num long, gen int, doc {_DOC}, kind string, bucket int"
_CUT = "\x1f"


_listed: dict[str, set[int]] = {}


def _buckets(spark: SparkSession, folder: str) -> set[int]:
    """The buckets that a part has of a kind; parts never change, so they are listed once."""
    if folder not in _listed:
        names = [s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder))] if _exists(spark, folder) else []
        _listed[folder] = {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}
    return _listed[folder]


class DocumentIndex:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, StateStore(spark, folder), buckets
        self.refresh()

    def refresh(self) -> None:
        """See the version now in force; until then an object keeps to the one it was made with."""
        self.version = self.store.version()
        manifest = self.store.manifest(self.version)
        self.parts, self.buckets = manifest["parts"], manifest["meta"].get("buckets", self.buckets)

    def _folders(self, kind: str) -> int:
        return max(1, self.buckets // 4) if kind == "doc" else self.buckets

    # writing

    def build(self, docs: DataFrame, order: Sequence[str] = ("id",)) -> None:
        """Index ``docs`` (heads: one row an id) anew; ``order`` is the order in which they count as first indexed."""
        self._write(numbered(docs, list(order), "doc_num", 1), 1, replace=True)

    def update(self, changed: DataFrame) -> None:
        """Take in new states of documents, deleted ones too; known documents keep their number."""
        changed = stage(changed.select(*DOC_COLUMNS), "changed")
        known = self.documents(deleted=True).select("id", F.col("doc_num").alias("_known"))
        both = stage(changed.join(known.hint("merge"), "id", "left"), "changed")
        last = known.agg(F.coalesce(F.max("_known"), F.lit(0))).first()[0]
        fresh = numbered(both.where(F.col("_known").isNull()).drop("_known"), ["id"], "doc_num", last + 1)
        self._write(fresh.unionByName(both.where(F.col("_known").isNotNull()).withColumnRenamed("_known", "doc_num")), self.version + 1, replace=False)

    def compact(self) -> None:
        """Make one part of all."""
        self._write(stage(self.documents(deleted=True), "documents"), self.version + 1, replace=True)

    def _write(self, docs: DataFrame, gen: int, replace: bool) -> None:
        docs = docs.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        live, number = docs.where(~F.col("deleted")), docs.select("id", "doc_num")

        def entries(rows: DataFrame, kind: str, key: Column, value: Column | None = None, doc: Column | None = None) -> DataFrame:
            empty = F.lit(None)
            return rows.select(key.alias("key"), (empty if value is None else value).cast("double").alias("value"), "id", "doc_num", F.lit(gen).alias("gen"), (empty if doc is None else doc).cast(_DOC).alias("doc"), F.lit(kind).alias("kind"))

        searchable = fields.searchable_tokens(F.col("data_json"), F.col("tags"), F.col("content"))
        eq, num = indexes.eq_index(docs).where(F.col("value").isNotNull()).join(number.hint("merge"), "id"), indexes.num_index(docs).join(number.hint("merge"), "id")
        rows = [
            entries(live.select(F.explode(searchable).alias("t"), "id", "doc_num"), "token", F.col("t")),
            entries(live.select(F.explode(tag_keys(F.col("tags"))).alias("t"), "id", "doc_num"), "tag", F.col("t")),
            entries(eq, "eq", F.concat_ws(_CUT, "field", "value")),
            entries(num, "num", F.col("field"), F.col("value")),
            entries(docs, "doc", F.col("id"), doc=F.struct(*DOC_COLUMNS)),
        ]
        folders = F.when(F.col("kind") == "doc", self._folders("doc")).otherwise(self.buckets)
        placed = reduce(DataFrame.unionByName, rows).withColumn("bucket", F.pmod(F.crc32(F.col("key").cast("binary")), folders).cast("int"))
        placed = placed.hint("rebalance", "kind", "bucket").sortWithinPartitions("kind", "bucket", "key", "id")
        write = self.store.replace if replace else self.store.add
        write(placed, self.version, {"buckets": self.buckets}, ["kind", "bucket"])
        self.refresh()

    # reading

    def _entries(self, kind: str, keys: Sequence[str] | None, parts: Sequence[str] | None = None) -> DataFrame:
        """The entries of some keys: only the folders of their buckets are listed and read."""
        parts = self.parts if parts is None else parts
        rows = None
        for part in parts:
            root = f"{self.store.folder}/{part}"
            if keys is None:
                places = [f"{root}/kind={kind}"]
            else:
                wanted = sorted({zlib.crc32(k.encode()) % self._folders(kind) for k in keys})
                there = _buckets(self.spark, f"{root}/kind={kind}") if wanted else set()
                places = [f"{root}/kind={kind}/bucket={b}" for b in wanted if b in there]
            places = places if keys is not None or _exists(self.spark, places[0]) else []
            if places:
                own = self.spark.read.schema(_SCHEMA).option("basePath", root).parquet(*places)
                rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            rows = self.spark.createDataFrame([], _SCHEMA)
        return rows if keys is None else rows.where(F.col("key").isin(list(keys)))

    def _valid(self, hits: DataFrame) -> DataFrame:
        """Hits (with ``id, gen``) whose document no later part holds. With one part there is nothing to compare."""
        later = self.parts[1:]
        if not later:
            return hits
        newest = self._entries("doc", None, later).groupBy(F.col("id").alias("_id")).agg(F.max("gen").alias("_gen"))
        return hits.join(newest.hint("merge"), (F.col("id") == F.col("_id")) & (F.col("_gen") > F.col("gen")), "left_anti")

    def documents(self, deleted: bool = False) -> DataFrame:
        """All documents (or those not deleted) with ``doc_num, gen``."""
        rows = self._valid(self._entries("doc", None).select("id", "doc_num", "gen", "doc"))
        rows = rows.select("doc.*", "doc_num", "gen")
        return rows if deleted else rows.where(~F.col("deleted"))

    def fetch(self, page: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
        """The documents of a page of at most 1000 hits, in an order by ``id`` or ``doc_num``."""
        ids = [r.id for r in page.select("id").limit(search.MAX_LIMIT).collect()]
        if not ids:
            return self._entries("doc", []).select("doc.*")
        rows = self._valid(self._entries("doc", ids).select("id", "doc_num", "gen", "doc"))
        return rows.orderBy(*order).limit(len(ids)).select("doc.*")

    def postings(self, token: str) -> DataFrame:
        """``id, doc_num`` of the live documents with a token."""
        return self._valid(self._entries("token", [token])).select("id", "doc_num")

    def _all_of(self, kind: str, keys: Sequence[str]) -> DataFrame:
        """``id, doc_num, gen`` of documents that have all keys. One key needs no shuffle."""
        hits = self._entries(kind, keys).select("id", "doc_num", "gen", "key")
        if len(set(keys)) > 1:
            hits = hits.groupBy("id", "doc_num", "gen").agg(F.count_distinct("key").alias("_n")).where(F.col("_n") == len(set(keys)))
        return self._valid(hits.select("id", "doc_num", "gen"))

    # searching

    def full_text(self, query: str, skip: int = 0, limit: int = 100, order: Sequence[str] = ("id",)) -> DataFrame:
        """``id, doc_num`` of a page of live documents with every token of the query; none for a query without tokens."""
        asked = sorted(set(self.spark.sql("SELECT 1").select(tokens(F.lit(query))).first()[0]))
        hits = self._all_of("token", asked) if asked else self._entries("token", [])
        return search.page(hits.select("id", "doc_num"), skip, limit, order)

    def by_tags(self, all_of: Sequence[str] | None = None, any_of: Sequence[str] | None = None, none_of: Sequence[str] | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
        """``id, doc_num`` of a page of live documents, as :func:`search.find_by_tags` defines it."""
        asked = [list(g or ()) for g in (all_of, any_of, none_of)]
        flat = [t for g in asked for t in g]
        folded = self.spark.sql("SELECT 1").select(F.array(*(tag_key(F.lit(t)) for t in flat)).alias("k")).first()[0] if flat else []
        groups, at = [], 0
        for g in asked:
            groups.append(sorted(set(folded[at : at + len(g)])))
            at += len(g)
        every, some, none = groups
        if any_of is not None and not some:
            hits = self._entries("tag", []).select("id", "doc_num")
        elif every or some:
            rows = self._entries("tag", [*every, *some, *none])
            counts = rows.groupBy("id", "doc_num", "gen").agg(F.count_distinct(F.when(F.col("key").isin(every), F.col("key"))).alias("_all"), *(F.coalesce(F.max(F.col("key").isin(g)), F.lit(False)).alias(n) for n, g in (("_any", some), ("_none", none))))
            hits = self._valid(counts.where((F.col("_all") == len(every)) & (F.col("_any") if some else F.lit(True)) & ~F.col("_none"))).select("id", "doc_num")
        else:
            hits = self.documents().select("id", "doc_num", "gen")
            if none:
                hits = hits.join(self._entries("tag", none).select(F.col("id").alias("_id"), F.col("gen").alias("_gen")).hint("merge"), (F.col("id") == F.col("_id")) & (F.col("gen") == F.col("_gen")), "left_anti")
            hits = hits.select("id", "doc_num")
        return search.page(hits, skip, limit)

    def by_fields(self, equals: Mapping[str, str] | None = None, numeric: search.Range | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
        """``id, doc_num`` of a page of live documents with all the field values and the number in the range.

        A value that the index holds under a field's path is looked up, any other one is compared with the top-level
        field of that name; a range goes by the index if it holds numbers under that path.
        """
        looked, scanned = [], []
        for name, value in (equals or {}).items():
            key = f"{name}{_CUT}{value}"
            if self._all_of("eq", [key]).take(1):
                looked.append(self._entries("eq", [key]).select("id", "gen", F.lit(len(looked)).alias("_c")))
            else:
                scanned.append(search.equality(name, value)[1])
        if numeric is not None:
            name, low, high = numeric
            if self._all_of("num", [name]).take(1):
                looked.append(self._entries("num", [name]).where(search._between(F.col("value"), low, high)).select("id", "gen", F.lit(len(looked)).alias("_c")))
            else:
                scanned.append(search._between(fields.top_number(F.col("data_json"), name), low, high))
        found = None
        if looked:
            found = reduce(DataFrame.unionByName, looked)
            found = self._valid(found.groupBy("id", "gen").agg(F.count_distinct("_c").alias("_n")).where(F.col("_n") == len(looked)).select("id", "gen"))
        if scanned or found is None:
            docs = self.documents()
            docs = docs.where(reduce(lambda a, b: a & b, scanned)) if scanned else docs
            found = docs.select("id") if found is None else docs.join(found.select(F.col("id").alias("_id")).hint("merge"), F.col("id") == F.col("_id"), "left_semi").select("id")
        return search.page(found.select("id"), skip, limit)
