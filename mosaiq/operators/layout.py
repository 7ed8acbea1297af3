"""Consecutive numbers and running offsets over a whole table, without one task seeing all of it.

Rows are dealt into ranges of the order and summed per range; the sums, one row per range,
are added up, and every range then counts from its own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.operators.skew import looked_up
from mosaiq.operators.steps import written


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in the order, which must be unique."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.withColumn("__v", value).repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranged")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").agg(F.sum("__v").alias("__v")).select("__p", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "__p")  # a row per partition
    return out.withColumn(name, (F.col("__start") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).cast("long")).drop("__p", "__v", "__start")


def running_within(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """As ``running``, from zero in each group of ``keys``; null keys are a key.

    One order runs over all groups, so that a group with most of the rows is many ranges;
    what lies before a group is a row for each of them.
    """
    whole = written(running(df, [*keys, *order], value, name), "running")
    first = whole.groupBy(*keys).agg(F.min(name).alias("__begin"), F.count(F.lit(1)).alias("__rows"))
    return looked_up(whole, first, keys, "__rows").withColumn(name, F.col(name) - F.col("__begin")).drop("__begin", "__rows")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` numbered from 0 in the order, which must be unique.

    Rows are counted as they pass, so none is held, however large it is: a row's place in
    its partition is the lower part of Spark's increasing id, the partition the upper one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"__p": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    out = placed.join(F.broadcast(starts), "__p")  # a row per partition
    return out.withColumn(name, F.col("__start") + F.col("__at")).drop("__p", "__at", "__start")


def buffer_offsets(df: DataFrame, order: list[str], length: str, name: str = "offset", align: int = 4) -> DataFrame:
    """Where each part starts when parts are laid out in order, each padded to ``align`` bytes."""
    return running(df, order, (F.ceil(F.col(length) / align) * align).cast("long"), name)
