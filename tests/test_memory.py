"""Fat rows, a file's bytes or all of its nodes, are held a few at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import layout
from mosaiq.operators.steps import BATCH
from mosaiq.plans import scene_queries
from mosaiq.sources import scenes


@pytest.fixture
def defaults(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.enableNestedColumnVectorizedReader")
    for n in names:
        spark.conf.unset(n)
    yield names
    for n in names:
        spark.conf.unset(n)


def _largest_batch(df):
    def run(batches):
        yield pa.RecordBatch.from_pylist([{"b": b.nbytes} for b in batches], pa.schema([("b", pa.int64())]))

    return df.mapInArrow(run, "b long").agg(F.max("b")).first()[0]


def test_files_and_nodes_come_in_small_batches(spark, data, defaults):
    files = scene_queries._scene_files(spark, data)
    copies = files.crossJoin(spark.range(100)).select("content").repartition(1)
    assert copies.agg(F.sum(F.octet_length("content"))).first()[0] > 4 * BATCH
    assert _largest_batch(copies) <= 1.2 * BATCH


def test_tables_of_nested_rows_are_read_row_by_row(spark, data, defaults):
    models = scene_queries._models(spark, data)
    plan = models.select("nodes")._jdf.queryExecution().executedPlan().toString()
    assert "Batched: false" in plan
    assert scenes.placements(models).count() == spark.read.parquet(f"{data}/lineitem.parquet").count()


@pytest.mark.parametrize("name", ["glb_roundtrip", "instancing_of_scenes", "tileset_errors"])
def test_scenes_are_not_kept_in_memory(spark, data, name):
    spark.catalog.clearCache()
    out = scene_queries.QUERIES[name](spark, data)
    assert out.count() > 0
    assert "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString()


def test_numbering_holds_no_partition_in_a_window(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.expr("repeat('x', 100)").alias("fat")).repartition(7)
    out = layout.numbered(df, ["k"], "ix")
    assert all(r.k == r.ix for r in out.collect())
    # The one window is over the sums of partitions.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
