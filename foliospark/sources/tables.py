"""Reading named tables and staging intermediate ones in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def attach(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: workers then find it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_foliospark_sent", False):
        return
    context._foliospark_sent = True
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(context._temp_dir, "foliospark")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    attach(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (a local session, as in tests) a temporary folder is made once and set.
    """
    attach(spark)
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    made = getattr(spark.sparkContext, "_foliospark_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        made = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
        spark.sparkContext._foliospark_dir = made
    return made


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor never makes earlier stages run again, and the rows are fixed even where the plan
    before was not deterministic. The copies are removed when the Python driver ends, or earlier by :func:`release`.
    """
    path = keep_for_release(f"{shared_dir(df.sparkSession)}/foliospark/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_for_release(path: str) -> str:
    """Note a folder that :func:`release` and the end of the driver remove; called before it is written."""
    _staged.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all staged tables; results that still read them can't be used afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)


def _sweep() -> None:
    """At the driver's end: through the session where it still runs, else local folders by themselves."""
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        try:
            release(session)
        except Exception:  # the JVM may be gone already
            pass
    for path in _staged:
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, True)


atexit.register(_sweep)
