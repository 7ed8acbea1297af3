"""Report rows: counts and ratios with their guards against empty denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Percent of a whole; 0 of nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def reduction(now: Column, before: Column) -> Column:
    """Percent saved; 0 where there was nothing."""
    return F.when(before > 0, (1 - now / before) * 100).otherwise(0.0)


#: Names of the instancing report in the order of its file.
INSTANCING = (
    "Input Models", "Initial Nodes", "Initial Meshes", "Initial Instances", "Instanced Groups", "Final Instances", "Non-instanced Meshes",
    "Final Nodes", "Final Meshes", "Total Displayed Meshes", "Node Reduction (%)", "Initial Instancing Ratio (%)", "Final Instancing Ratio (%)", "Instancing Increase (%)",
)


def instancing(counts: DataFrame) -> DataFrame:
    """All metrics from a row of the seven counted ones, percentages to two places."""
    c = F.col
    df = counts.withColumns({"final_nodes": c("instanced_groups") + c("non_instanced"), "total_displayed": c("final_instances") + c("non_instanced")})
    df = df.withColumn("final_meshes", c("final_nodes"))
    before, after = share(c("initial_instances"), c("total_displayed")), share(c("final_instances"), c("total_displayed"))
    return df.select(
        "input_models", "initial_nodes", "initial_meshes", "initial_instances", "instanced_groups", "final_instances", "non_instanced", "final_nodes", "final_meshes", "total_displayed",
        F.round(reduction(c("final_nodes"), c("initial_nodes")), 2).alias("node_reduction"), F.round(before, 2).alias("initial_ratio"), F.round(after, 2).alias("final_ratio"), F.round(after - before, 2).alias("increase"),
    )


def triangles(indices: Column, vertices: Column | None = None) -> Column:
    """Whole triangles of a primitive: by its indices, else by its vertices; none without indices if ``vertices`` isn't given."""
    n = F.coalesce(indices, vertices) if vertices is not None else F.coalesce(indices, F.lit(0))
    return F.floor(n / 3).cast("long")


def tile_stats(df: DataFrame, by: list[str], tris: Column, instances: Column, mesh: str) -> DataFrame:
    """Per tile: meshes, instances, triangles stored and rendered, and their ratio (1 if none is rendered)."""
    out = df.groupBy(*by).agg(F.countDistinct(mesh).alias("unique_meshes"), F.sum(instances).cast("long").alias("instances"), F.sum(tris).cast("long").alias("stored"), F.sum(tris * instances).cast("long").alias("rendered"))
    return out.withColumn("ratio", F.round(F.when(F.col("rendered") > 0, F.col("stored") / F.col("rendered")).otherwise(1.0), 4))


def pivot_levels(df: DataFrame, metric: str, level: str, value: Column, levels: list[int]) -> DataFrame:
    """Metrics as rows, levels as columns ``lod<level>``, '-' where a level has none."""
    sums = [F.sum(F.when(F.col(level) == n, value)).alias(f"lod{n}") for n in levels]
    df = df.groupBy(metric).agg(*sums)
    return df.select(metric, *[F.coalesce(F.col(f"lod{n}").cast("long").cast("string"), F.lit("-")).alias(f"lod{n}") for n in levels])


def top(df: DataFrame, order: list[Column], most: int = 50) -> tuple[DataFrame, int]:
    """The first rows of a report, and how many more there are."""
    return df.orderBy(*order).limit(most), max(df.count() - most, 0)
