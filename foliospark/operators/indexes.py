"""Derived tables of documents: flat fields, tags, postings; their statistics and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.fields import searchable_tokens
from foliospark.functions.json_tree import leaves, parse, texts
from foliospark.functions.text import tag_keys

FLAT = "id string, path string, kind string, text string, number double"
_FLAT_ARROW = pa.schema([("id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("number", pa.float64())])


def flatten_fields(docs: DataFrame, prefix: str = "data") -> DataFrame:
    """``id, path, kind, text, number``: every scalar of ``data_json`` with its dotted path.

    With the prefix ``data`` that is the index's view; with an empty one the plain flat form, in which null and boolean
    values stay too. Broken JSON gives nothing. Rows are handled where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *leaf) for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leaf in leaves(parse(d) if d else None, prefix) if d and leaf[0] != prefix]
            if rows:
                yield pa.RecordBatch.from_arrays([texts(c) if t == pa.string() else pa.array(c, t) for c, t in zip(zip(*rows), _FLAT_ARROW.types)], schema=_FLAT_ARROW)

    return docs.select("id", "data_json").mapInArrow(run, FLAT)


def _live(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("deleted"))


def eq_index(docs: DataFrame) -> DataFrame:
    """``field, value, id`` of strings and booleans in the data, of tags and of the content of live documents."""
    live = _live(docs)
    data = flatten_fields(live).where(F.col("kind").isin("string", "bool")).select(F.col("path").alias("field"), F.col("text").alias("value"), "id")
    tags = live.select("id", F.posexplode("tags").alias("_n", "value")).where(F.col("value").isNotNull())
    tags = tags.select(F.concat(F.lit("tags["), F.col("_n"), F.lit("]")).alias("field"), "value", "id")
    content = live.where(F.col("content").isNotNull()).select(F.lit("content").alias("field"), F.col("content").alias("value"), "id")
    return data.union(tags).union(content).distinct()


def num_index(docs: DataFrame) -> DataFrame:
    """``field, value, id`` of numbers in the data of live documents."""
    return flatten_fields(_live(docs)).where(F.col("kind") == "number").select(F.col("path").alias("field"), F.col("number").alias("value"), "id").distinct()


def tag_index(docs: DataFrame) -> DataFrame:
    """``tag_key, id`` of live documents."""
    return _live(docs).select(F.explode(tag_keys(F.col("tags"))).alias("tag_key"), "id").distinct()


def token_index(docs: DataFrame) -> DataFrame:
    """``token, id`` of live documents."""
    return _live(docs).select(F.explode(searchable_tokens(F.col("data_json"), F.col("tags"), F.col("content"))).alias("token"), "id").distinct()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``token, df``: in how many live documents each token is."""
    return token_index(docs).groupBy("token").agg(F.count("*").alias("df"))


#: Document numbers that one posting list may span.
SPAN = 65_536


def posting_lists(docs: DataFrame, number: str = "doc_num") -> DataFrame:
    """``token, block, postings``: sorted document numbers of each token, one list for each block of numbers.

    A token in many documents has as many lists as there are blocks, so no list grows with the collection.
    """
    rows = _live(docs).select(F.explode(searchable_tokens(F.col("data_json"), F.col("tags"), F.col("content"))).alias("token"), F.col(number).alias("_n"))
    return rows.groupBy("token", F.floor(F.col("_n") / SPAN).alias("block")).agg(F.array_sort(F.collect_set("_n")).alias("postings"))


def elias_fano_bytes(n: Column, greatest: Column) -> Column:
    """The size in bytes of n sorted numbers up to ``greatest`` in Elias-Fano form, from the formula."""
    low = F.when(greatest < n, 0).otherwise(F.floor(F.log2(F.floor(greatest / n)))).cast("int")
    high_words = F.ceil((n + F.floor(greatest / F.pow(F.lit(2.0), low))) / 64)
    return (high_words * 8 + (high_words + 1) * 4 + 8 + F.ceil(n * low / 64) * 8 + 12).cast("long")


def index_stats(docs: DataFrame, number: str = "doc_num") -> DataFrame:
    """One row ``tokens, postings, documents, compact_bytes, hash_set_bytes`` (48 bytes a posting), ratio, bits a posting."""
    rows = _live(docs).select(F.explode(searchable_tokens(F.col("data_json"), F.col("tags"), F.col("content"))).alias("token"), F.col(number).alias("_n"))
    each = rows.groupBy("token").agg(F.count("*").alias("n"), F.max("_n").cast("long").alias("greatest"))
    sized = each.select("n", (elias_fano_bytes(F.col("n"), F.col("greatest")) + 2 * F.length("token")).alias("b"))
    total = sized.agg(F.count("*").alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum("b"), F.lit(0)).alias("compact_bytes"))
    total = total.select("tokens", "postings", _live(docs).agg(F.count("*")).scalar().alias("documents"), "compact_bytes", (F.col("postings") * 48).alias("hash_set_bytes"))
    ratio = F.when(F.col("compact_bytes") > 0, F.col("hash_set_bytes") / F.col("compact_bytes")).otherwise(0.0)
    return total.withColumns({"ratio": ratio, "bits_per_posting": F.when(F.col("postings") > 0, F.col("compact_bytes") * 8 / F.col("postings")).otherwise(0.0)})


def search_postings(index: DataFrame, asked: list[str], limit: int = 100) -> DataFrame:
    """``id`` of documents in the token index with every asked token, in order; the index side of a full-text search."""
    asked = sorted(set(asked))
    hits = index.where(F.col("token").isin(asked)).groupBy("id").agg(F.countDistinct("token").alias("n"))
    return hits.where(F.col("n") == len(asked)).select("id").orderBy("id").limit(limit) if asked else index.select("id").limit(0)
