"""Levels of detail 5 to 1 by what things are: groups, variants, classes, abstract kinds, boxes.

The module behind levels 4 to 1 was never published; ``operators.lod`` has our rules for
who stands for whom. Here every level is a table of items, each drawn in place of the items
of the level before, and of the placements that come with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.boxes import Box
from mosaiq.functions.transforms import from_columns, to_columns
from mosaiq.operators import lod
from mosaiq.operators.skew import looked_up
from mosaiq.operators.steps import written
from mosaiq.plans.instancing import Instancing, mesh_features
from mosaiq.sinks.models import proxy_model
from mosaiq.sources import semantics as sem

#: The model whose only mesh is the unit cube.
CUBE = -1


def _item(found: str, left: str) -> Column:
    return F.concat(F.lit(found), F.col(left))


def placed_items(found: Instancing) -> DataFrame:
    """(item, model_id, mesh_ix, trav_ord, world): placements by what is drawn, a group's as one item, all others each by itself."""
    groups = looked_up(found.members.select("signature", "trav_ord", "world"), found.groups, ["signature"], "n", keep_size=False)
    a = groups.select(_item("g:", "signature").alias("item"), "model_id", "mesh_ix", "trav_ord", "world")
    own = F.concat_ws("_", "model_id", "mesh_ix", F.array_join(F.transform("trav_ord", lambda x: x.cast("string")), "."))
    return a.unionByName(found.left.select(F.concat(F.lit("m:"), own).alias("item"), "model_id", "mesh_ix", "trav_ord", "world"))


def lod5(placed: DataFrame, models: DataFrame, semantics: DataFrame) -> DataFrame:
    """Items with their number of placements, the features of their mesh, and what it is.

    ``semantics`` (actor_hash, category, family, type) are found by the mesh's name; a mesh
    without any has nulls.
    """
    items = placed.groupBy("item").agg(F.min(F.struct("model_id", "mesh_ix")).alias("mesh"), F.count(F.lit(1)).alias("n")).select("item", "mesh.*", "n")
    return sem.with_semantics(items.join(mesh_features(models), ["model_id", "mesh_ix"]), semantics)


@dataclass
class Level:
    """``items``: who stands for others at this level, with the mesh and features of each. ``placed``: all placements by item. ``error``: how far a stand-in's box is off at most."""

    level: int
    items: DataFrame
    placed: DataFrame
    error: float


def _stand_in(before: Level, level: int, key: list[Column], feature: Column | None, tolerance: float, by_mean: str | None) -> Level:
    """The next level: items of one key and, if there is a ``feature``, one size of it are shown by one of them, the one nearest to the mean of ``by_mean`` or the one with the fewest vertices."""
    bucket = lod.log_bucket(feature, tolerance) if feature is not None else F.lit(0)
    alone = F.when(F.coalesce(*key).isNull() | bucket.isNull(), F.col("item"))  # what is unknown stands for itself
    names = [f"k{i}" for i in range(len(key) + 2)]
    items = written(before.items.select("*", *[k.alias(n) for k, n in zip([*key, bucket, alone], names)]).fillna({n: "" for n in names if n != names[-2]}).fillna({names[-2]: 0}), f"items-{level}")
    reps = lod.nearest_to_mean(items, names, by_mean, "item") if by_mean else lod.least_of(items, names, "n_vertices", "item")
    shown = written(items.join(reps, names).select("item", "rep", *Box.named().columns("o_")), f"shown-{level}")
    own = before.items.withColumnRenamed("item", "rep")
    error = shown.join(own, "rep").agg(F.max(lod.box_error(Box.named("o_"), Box.named()))).first()[0]
    kept = shown.select(F.col("rep").alias("item")).distinct()
    sizes = before.placed.groupBy("item").agg(F.count(F.lit(1)).alias("__n")).join(shown.select("item", "rep"), "item")
    meshes = own.select("rep", "model_id", "mesh_ix")
    placed = looked_up(before.placed.select("item", "trav_ord", "world"), sizes.join(meshes, "rep"), ["item"], "__n", keep_size=False)
    placed = written(placed.select(F.col("rep").alias("item"), "model_id", "mesh_ix", "trav_ord", "world"), f"placed-{level}")
    counts = placed.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return Level(level, before.items.drop("n").join(kept, "item").join(counts, "item"), placed, max(before.error, float(error or 0.0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _boxed(world: pd.Series, center: pd.Series, extent: pd.Series) -> pd.Series:
    """The matrix that makes the unit cube a mesh's box, placed like the mesh."""
    m = from_columns(np.array(world.tolist(), float)).copy()
    c, e = (np.array(x.tolist(), float).reshape(-1, 3) for x in (center, extent))
    m[:, :3, 3] += np.einsum("nij,nj->ni", m[:, :3, :3], c)
    m[:, :3, :3] *= e[:, None, :]
    return pd.Series(list(to_columns(m)))


def build(found: Instancing, models: DataFrame, semantics: DataFrame, size_tolerance: float = lod.SIZE_TOLERANCE, aspect_tolerance: float = lod.ASPECT_TOLERANCE, abstract: dict[str, str] | None = None) -> list[Level]:
    """Levels from 5, as detected, to 1, boxes only.

    Level 4 joins items of one family and size, 3 of one category and proportion, 2 of one
    abstract kind, which ``abstract`` says of a category (else it is its own).
    """
    placed = written(placed_items(found), "placed-5")
    five = Level(5, written(lod5(placed, models, semantics), "items-5"), placed, 0.0)
    four = _stand_in(five, 4, [F.col("family")], F.col("volume"), size_tolerance, "volume")
    three = _stand_in(four, 3, [F.col("category")], F.col("aspect"), aspect_tolerance, "volume")
    kinds = F.col("category")
    for category, kind in (abstract or {}).items():
        kinds = F.when(F.col("category") == category, kind).otherwise(kinds)
    two = _stand_in(three, 2, [kinds], None, 0.0, None)
    b = Box.named()
    boxes = two.items.filter(b.valid()).select("item", F.array(*b.center()).alias("center"), F.array(*b.extent()).alias("extent"), "n")
    cubes = looked_up(two.placed.join(boxes.select("item"), "item", "left_semi"), boxes, ["item"], "n", keep_size=False)
    cubes = cubes.select("item", F.lit(CUBE).cast("long").alias("model_id"), F.lit(0).alias("mesh_ix"), "trav_ord", _boxed("world", "center", "extent").alias("world"))
    one = Level(1, two.items.filter(b.valid()).withColumns({"model_id": F.lit(CUBE).cast("long"), "mesh_ix": F.lit(0), "n_vertices": F.lit(24).cast("long")}), written(cubes, "placed-1"), two.error)
    return [five, four, three, two, one]


def to_draw(level: Level) -> DataFrame:
    """Rows for ``sinks.assembly``: an item's placements are instances of its mesh; boxes are all instances of one cube."""
    key = F.when(F.col("model_id") == CUBE, "cube").otherwise(F.col("item"))
    return level.placed.select(F.lit(f"LOD{level.level}.glb").alias("name"), key.alias("mesh_key"), "model_id", "mesh_ix", F.lit(True).alias("instanced"), "trav_ord", "world")


def with_cube(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """Contents (model_id, content) and the model of the unit cube."""
    cube = spark.createDataFrame([(CUBE, bytearray(proxy_model([])))], "model_id long, content binary")
    return contents.select(F.col("model_id").cast("long").alias("model_id"), "content").unionByName(cube)


def analysis(levels: list[Level], saved: DataFrame, files: DataFrame, models: DataFrame) -> DataFrame:
    """The report of levels, a row per metric: file size, meshes, instances, vertices and reduction at the input and at levels 5 to 1; ``-`` where there is none.

    ``saved`` (name, size) are the levels' files, ``files`` (length) those that were read.
    """
    mb = 1024.0 * 1024.0
    given = files.agg((F.coalesce(F.sum("length"), F.lit(0)) / mb).alias("mb")).first().mb
    vertices = mesh_features(models).agg(F.coalesce(F.sum("n_vertices"), F.lit(0))).first()[0]
    sizes = {r.name: r.size / mb for r in saved.select("name", "size").collect()}  # a row per level
    counts = {x.level: x.items.agg(F.count(F.lit(1)).alias("meshes"), F.coalesce(F.sum("n"), F.lit(0)).alias("instances"), F.coalesce(F.sum("n_vertices"), F.lit(0)).alias("vertices")).first() for x in levels if f"LOD{x.level}.glb" in sizes}
    of = lambda f: [f(n) if n in counts else "-" for n in (5, 4, 3, 2, 1)]
    size = lambda n: sizes[f"LOD{n}.glb"]
    rows = [
        ["File Size (MB)", f"{given:.2f}", *of(lambda n: f"{size(n):.2f}")],
        ["Unique Meshes", "-", *of(lambda n: str(counts[n].meshes))],
        ["Total Instances", str(counts[5].instances if 5 in counts else 0), *of(lambda n: str(counts[n].instances))],
        ["Vertices (Loaded)", str(vertices), *of(lambda n: str(counts[n].vertices))],
        ["Reduction Rate (%)", "-", *of(lambda n: f"{(1 - size(n) / given) * 100:.2f}%" if given else "-")],
    ]
    return saved.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` string" for c in LOD_ANALYSIS))


#: The columns of the two reports.
LOD_ANALYSIS = ("Metric", "Original (Input)", "Instanced (LOD5)", "LOD4 (Variant)", "LOD3 (Class)", "LOD2 (Abstract)", "LOD1 (Proxy)")
HLOD_ANALYSIS = ("Level", "Tile", "FileSize(KB)", "UniqueMeshes", "Instances", "StoredTriangles", "RenderedTriangles", "ReductionRatio")


def tile_analysis(saved: DataFrame) -> DataFrame:
    """The report of tiles, deepest first, from ``saved`` (name, size, n_meshes, grouped, stored, rendered)."""
    level = F.regexp_extract("name", r"^T(\d+)_", 1).cast("int")
    ratio = F.when(F.col("rendered") > 0, F.col("stored") / F.col("rendered")).otherwise(1.0)
    values = [level, F.col("name"), F.format_string("%.2f", F.col("size") / 1024.0), F.col("n_meshes"), F.col("grouped"), F.col("stored"), F.col("rendered"), F.format_string("%.4f", ratio)]
    return saved.select(*[v.alias(n) for v, n in zip(values, HLOD_ANALYSIS)]).orderBy(F.desc("Level"), "Tile")
