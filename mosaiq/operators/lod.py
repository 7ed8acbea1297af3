"""Levels of detail: clusters of like meshes, their representatives, error chains.

The module behind levels 4 to 1 was never published, so their rules are our own: sizes
fall into logarithmic buckets as wide as the tolerance, which needs no order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.boxes import Box
from mosaiq.operators.layout import running_within
from mosaiq.operators.skew import looked_up

SIZE_TOLERANCE, ASPECT_TOLERANCE = 0.05, 0.20


def log_bucket(value: Column, tolerance: float) -> Column:
    """Values whose ratio is within the tolerance share a bucket or are in neighbouring ones; null for values not above zero."""
    return F.floor(F.log(F.when(value > 0, value.cast("double"))) / F.log(F.lit(1 + tolerance))).cast("long")


def cluster(df: DataFrame, by: list[str], feature: Column, tolerance: float, order: list[Column | str], id_: str) -> DataFrame:
    """Clusters of ``by`` and bucket: representative (first in order) and size."""
    df = df.withColumn("bucket", log_bucket(feature, tolerance))
    return df.groupBy(*by, "bucket").agg(F.min_by(id_, F.struct(*order)).alias("rep"), F.count(F.lit(1)).alias("n"))


def variant(df: DataFrame, family: str, volume: Column, id_: str) -> DataFrame:
    """Level 4: one family, sizes within the tolerance."""
    return cluster(df, [family], volume, SIZE_TOLERANCE, [id_], id_)


def kind(df: DataFrame, category: str, aspect: Column, id_: str) -> DataFrame:
    """Level 3: one category, proportions within the tolerance."""
    return cluster(df, [category], aspect, ASPECT_TOLERANCE, [id_], id_)


def abstract(df: DataFrame, category: Column, size: str, id_: str) -> DataFrame:
    """Level 2: one abstract category, the simplest model."""
    return df.groupBy(category.alias("abstract")).agg(F.min_by(id_, F.struct(size, id_)).alias("rep"), F.count(F.lit(1)).alias("n"))


def nearest_to_mean(df: DataFrame, by: list[str], value: str, id_: str) -> DataFrame:
    """Per group the row whose value is nearest to the group's mean, of equals the least id."""
    mean = df.groupBy(*by).agg(F.avg(value).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    return looked_up(df, mean, by, "__n").groupBy(*by).agg(F.min_by(id_, F.struct(F.round(F.abs(F.col(value) - F.col("__mean")), 9), F.col(id_))).alias("rep"))


def least_of(df: DataFrame, by: list[str], value: str, id_: str) -> DataFrame:
    """Per group the row with the least value (fewest vertices, simplest shape), of equals the least id."""
    return df.groupBy(*by).agg(F.min_by(id_, F.struct(value, id_)).alias("rep"))


def proxy(box: Box) -> list[Column]:
    """Level 1: translation and scale that make a unit cube a box's stand-in."""
    c, e = box.center(), box.extent()
    return [v.alias(f"t_{a}") for v, a in zip(c, "xyz")] + [v.alias(f"s_{a}") for v, a in zip(e, "xyz")]


def chain(spark: SparkSession, levels: int, ratio: float) -> DataFrame:
    """Level 0 and its simplified levels: cumulative ratio, error, and the next coarser level as parent (null for the last)."""
    i = F.col("level")
    return spark.range(levels + 1).select(
        F.col("id").cast("int").alias("level"),
    ).select("level", F.pow(F.lit(ratio), i).alias("ratio"), F.when(i == 0, 0.0).otherwise(16.0 * F.pow(F.lit(2.0), i - 1)).alias("error"), F.when(i < levels, i + 1).alias("parent"))


def present_chain(levels: DataFrame) -> DataFrame:
    """Levels (level) that are there, linked from the coarsest, the root, to the finest; missing ones are skipped.

    There are five levels at most, so one window over all of them is small.
    """
    from pyspark.sql import Window

    w = Window.orderBy("level")
    return levels.select("level", F.lag("level").over(w).alias("parent"))


def screen_error(error: Column, distance: Column, height: float = 1080.0, half_fov_tan: float = 0.5773502691896258) -> Column:
    """Pixels that an error covers at a distance."""
    return error * height / (2 * half_fov_tan * F.when(distance > 0, distance))


def box_error(a: Box, b: Box) -> Column:
    """The greatest difference between two boxes' corners."""
    return F.greatest(*[F.abs(p - q) for p, q in zip((*a.low, *a.high), (*b.low, *b.high))])


def weld(vertices: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, new_ix): vertices of one position become one, numbered by first use within each mesh.

    Positions, not vertices, are numbered; a mesh or a position with most of the vertices
    isn't one task.
    """
    places = vertices.groupBy(*by, "x", "y", "z").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n"))
    numbered = running_within(places, by, ["__first"], F.lit(1).cast("long"), "new_ix").drop("__first")
    return looked_up(vertices, numbered, [*by, "x", "y", "z"], "__n", keep_size=False).withColumn("new_ix", F.col("new_ix").cast("int"))
