"""Tables between the steps of a loop, written to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that go to Python together.
BATCH = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, as a URI; one of our own only where none is named and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mosaiq-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named if re.match(r"[a-z][a-z0-9+.-]*:", named) else f"file://{named}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of Parquet files: a plan ends there, and a lost executor costs nothing that was written.

    A join with a written aggregate is one that Spark can split where a key has most rows.
    """
    at = f"{shared_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded(spark: SparkSession) -> None:
    """Let tasks hold a few MB of fat rows at a time: rows with a file's bytes or all of its nodes are counted by bytes, not by thousands.

    Arrow batches end at BATCH bytes. Parquet files with nested columns are read row by
    row, as Spark's columnar reader takes 4,096 rows at once, however long their arrays are.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` when no later step reads it."""
    spark = df.sparkSession
    path_of, root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, shared_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = path_of(folder)
        if path.toUri().getPath().startswith(path_of(root).toUri().getPath()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
