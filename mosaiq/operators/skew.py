"""Lookups in which a key with most of the rows isn't one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.steps import written


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], size: str, keep_size: bool = True) -> DataFrame:
    """``df`` with the columns that ``table`` has for its key; ``size`` is the table's column with the number of rows of each key.

    A key is hot if it has more rows than a task should get; of those there are fewer than
    tasks, so they go to all executors and their rows stay where they are. All other rows
    are dealt by key. Every row of ``df`` has its key in the table; null keys are a key.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(table.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in table.columns if c not in keys]), "lookup")
    hot = F.col(size) * tasks > F.lit(table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    few = F.broadcast(table.filter(hot))  # fewer rows than tasks
    out = df.join(few, same).unionByName(df.join(few, same, "left_anti").join(table.filter(~hot), same))
    return out.drop(*[f"__k_{k}" for k in keys], *([] if keep_size else [size]))
