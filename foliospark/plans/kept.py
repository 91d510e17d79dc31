"""Indexes of document tables, built at the first use by a session and kept for its further queries."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.operators.kept import DocumentIndex
from foliospark.sources.files import _fs, _path
from foliospark.sources.schema import docs_view
from foliospark.sources.tables import keep_for_release, shared_dir

_built: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: a changed table is indexed anew."""
    found = _fs(spark, path).listStatus(_path(spark, path))
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))


def kept_index(spark: SparkSession, folder: str) -> DocumentIndex:
    """The index of the folder's documents; they count as first indexed in the order of a hash of their ids."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{folder}/document_store.parquet"))
    if key not in _built:
        place = keep_for_release(f"{shared_dir(spark)}/foliospark/index-{uuid.uuid4().hex}")
        DocumentIndex(spark, place).build(docs_view(spark, folder), [F.md5("id"), F.col("id")])
        _built[key] = place
    return DocumentIndex(spark, _built[key])
