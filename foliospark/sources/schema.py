"""Fixed schemas of documents, logs, manifests and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.sources.tables import table

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("rev", T.StringType()),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("data_json", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("content", T.StringType()),
    ]
)
DOC_COLUMNS = DOCUMENT.names
WAL = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("rev", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("doc", T.StructType([T.StructField(f.name, f.dataType) for f in DOCUMENT])),
        T.StructField("ts", T.TimestampType()),
    ]
)
#: The typed fields of a news document's data.
NEWS = T.StructType([T.StructField(n, T.StringType()) for n in ("link", "headline", "category", "short_description", "authors", "date")])


def docs_view(spark: SparkSession, folder: str) -> DataFrame:
    """The document table of a folder with repeated rows counted once and nulls in ``deleted`` read as false."""
    docs = table(spark, folder, "document_store").select(*DOC_COLUMNS).distinct()
    return docs.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
