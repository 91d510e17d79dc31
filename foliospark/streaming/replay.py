"""A log applied as a stream: each micro-batch of new lines is merged into the current documents.

The state is a table of deciding lines in versions. Every batch adds its own lines as a part of the next version, which
records the batch's number, so a repeated batch changes nothing and none is skipped; now and then the parts are merged
into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.replay import LOG, apply, transactions
from foliospark.sources.schema import DOCUMENT
from foliospark.sources.state import StateStore

#: Parts of the state after which they are merged.
PARTS = 16

LINE = T.StructType(
    [T.StructField("db", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("id", T.StringType()), T.StructField("rev", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField("doc", T.StructType([T.StructField(f.name, f.dataType) for f in DOCUMENT])), T.StructField("ts", T.TimestampNTZType())]
)


def merged(state: DataFrame) -> DataFrame:
    """One deciding line for each document of a state in parts."""
    return apply(state)


def replay_stream(spark: SparkSession, source: str, state_dir: str, checkpoint: str, fmt: str = "json", files_per_batch: int = 100, schema: T.StructType = LINE) -> StreamingQuery:
    """Start a query that applies all lines now in ``source`` and then ends; call it again for later ones."""
    store = StateStore(spark, state_dir)

    def run(batch: DataFrame, number: int) -> None:
        manifest, version = store.manifest(), store.version()
        if number <= manifest["meta"].get("batch", -1):
            return
        fresh, meta = apply(transactions(batch)), {"batch": number}
        if len(manifest["parts"]) < PARTS:
            store.add(fresh, version, meta)
        else:
            store.replace(merged(store.read().unionByName(fresh)), version, meta)

    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """Live documents after what the stream has applied, None before its first batch."""
    state = StateStore(spark, state_dir).read()
    return None if state is None else merged(state).where("alive").select(*LOG, "id", "seq", "rev")


def late_counts(lines: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Lines for each log and window of ``ts``, for a stream: those later than ``delay`` behind the newest are dropped."""
    return lines.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), *LOG).agg(F.count("*").alias("n_lines"))
