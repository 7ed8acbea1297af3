"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
#: Seconds between two collections of garbage: small tables that follow each other closely leave little on the disk.
PAUSE = 2.0


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory is bounded by a few hundred texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def anchored(value: Column) -> Column:
    """``value`` as it is, in a form that keeps later filters above the projection it stands in.

    A filter that Catalyst moves below a projection repeats the projection's expressions,
    inside lambda bodies even once per element. The condition holds for every row.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a folder of our own is made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mosaiq-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named if re.match(r"[a-z][a-z0-9+.-]*:", named) else f"file://{named}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage.

    The shuffle files behind it are released at once, and a lost executor costs nothing
    that was written.
    """
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    release(spark)
    return spark.read.schema(df.schema).parquet(at)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by ``stored`` when no later step reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_RELEASED = [0.0]


def release(spark: SparkSession, pause: float = PAUSE) -> None:
    """Let Spark's cleaner delete the shuffle files of queries that are over, if the last time is ``pause`` seconds ago or more."""
    import gc
    import time

    if time.monotonic() - _RELEASED[0] < pause:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _RELEASED[0] = time.monotonic()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
