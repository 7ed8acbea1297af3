"""Id lists held against names: matches, and what either side has alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHED, ALONE = "Non-Instanced", "Instanced"


def matched(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``ids`` (name, component_id) whose name is among ``names``; repeated rows stay."""
    return ids.join(names.select("name"), "name", "left_semi").withColumn("status", F.lit(MATCHED))


def unmatched(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``ids`` whose name is not among ``names``."""
    return ids.join(names.select("name"), "name", "left_anti").withColumn("status", F.lit(ALONE))


def nameless(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Names, each once, that ``ids`` doesn't have; their component is empty."""
    return names.select("name").distinct().join(ids.select("name"), "name", "left_anti").select("name", F.lit("").alias("component_id"), F.lit(ALONE).alias("status"))


def reconcile(ids: DataFrame, names: DataFrame) -> DataFrame:
    """All three, with ``part`` 1 to 3 for their order."""
    cols = ["name", "component_id", "status"]
    parts = [f(ids, names).select(*cols, F.lit(i).alias("part")) for i, f in enumerate((matched, unmatched, nameless), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
