"""Whole runs over scenes: from files to groups, models, tiles and levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.boxes import Box
from mosaiq.functions.signatures import EXACT, mesh_signatures, primitive_signatures
from mosaiq.operators import grouping, reports
from mosaiq.operators.steps import written
from mosaiq.sources import scenes


@dataclass
class Instancing:
    """``groups``: signature, representative, n. ``members``: placements of groups. ``left``: all others, with why."""

    groups: DataFrame
    members: DataFrame
    left: DataFrame


def detect(models: DataFrame, tolerance: float = 0.0, limit: int = 2, skip: tuple[str, ...] = ()) -> Instancing:
    """Placements grouped by the signature of their mesh.

    With a tolerance a placement also needs the boxes of all its primitives near those of
    the group's first placement; those of files' own instances are taken untested. Meshes
    without a valid box then match nothing. Groups below the limit are dissolved. Geometry
    is never shuffled: signatures and boxes are made per mesh and joined to placements.
    """
    prims = scenes.primitives(models)
    boxes = prims.groupBy("model_id", "mesh_ix").agg(
        F.array_sort(F.collect_list(F.struct("prim_ix", F.array(*[F.col(f"{m}_{a}") for m in ("min", "max") for a in "xyz"]).alias("b")))).alias("boxes"),
    )
    meshes = mesh_signatures(primitive_signatures(prims, tolerance, skip)).join(boxes, ["model_id", "mesh_ix"])
    placed = scenes.placements(models).join(meshes, ["model_id", "mesh_ix"])
    order = ["model_id", "trav_ord"]
    judged = grouping.with_representative(placed, ["signature"], order, ["model_id", "mesh_ix", "boxes"])
    if tolerance <= EXACT:
        judged = judged.withColumn("accepted", F.lit(True))
    else:
        near = F.forall(
            F.zip_with("boxes", "rep_boxes", lambda a, b: F.forall(F.zip_with(a["b"], b["b"], lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))),
            lambda ok: F.coalesce(ok, F.lit(False)),
        )
        judged = judged.withColumn("accepted", F.col("is_ext") | near)
    judged = written(judged.drop("boxes", "rep_boxes", "n"), "judged")
    sizes = judged.filter("accepted").groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col("rep_model_id").alias("model_id"), F.col("rep_mesh_ix").alias("mesh_ix")), F.struct(*order)).alias("rep"))
    groups = grouping.having(sizes, limit).select("signature", "rep.*", "n")
    kept = judged.filter("accepted").join(groups.select("signature"), "signature", "left_semi")
    small = judged.filter("accepted").join(groups.select("signature"), "signature", "left_anti").withColumn("why", F.lit("limit"))
    far = judged.filter("NOT accepted").withColumn("why", F.lit("box"))
    return Instancing(groups, kept, far.unionByName(small))


def remap_duplicates(found: Instancing, models: DataFrame) -> Instancing:
    """Model ids of equal files become that of the first; placements all stay."""
    same = grouping.duplicates(models.select("model_id", "file_hash"), F.col("file_hash"), "model_id").select(F.col("model_id").alias("id"), "rep_id")
    put = lambda df: grouping.remapped(df, "model_id", same).drop("model_id").withColumnRenamed("rep_id", "model_id")
    return Instancing(put(found.groups), put(found.members), put(found.left))


def report(models: DataFrame, found: Instancing) -> DataFrame:
    """The instancing report's one row."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    nodes = scenes.nodes(models).agg(
        F.coalesce(F.sum("visits"), F.lit(0)).cast("long").alias("initial_nodes"),
        F.coalesce(F.sum(F.when(F.col("instanced"), F.size("instances"))), F.lit(0)).cast("long").alias("initial_instances"),
    )
    meshes = models.agg(F.coalesce(F.sum("n_meshes"), F.lit(0)).cast("long").alias("initial_meshes"))
    df = one(models, "input_models").crossJoin(nodes).crossJoin(meshes)
    df = df.crossJoin(one(found.groups, "instanced_groups")).crossJoin(one(found.members, "final_instances")).crossJoin(one(found.left, "non_instanced"))  # one row each
    return reports.instancing(df)


def to_draw(found: Instancing) -> DataFrame:
    """Rows for ``sinks.assembly``: groups drawn once with instances, all else as it is."""
    groups = found.members.select("signature", "trav_ord", "world").join(found.groups.select("signature", "model_id", "mesh_ix"), "signature")
    a = groups.select(F.col("signature").alias("mesh_key"), "model_id", "mesh_ix", F.lit(True).alias("instanced"), "trav_ord", "world")
    b = found.left.select(F.concat_ws("_", "model_id", "mesh_ix", F.array_join(F.transform("trav_ord", lambda x: x.cast("string")), ".")).alias("mesh_key"), "model_id", "mesh_ix", F.lit(False).alias("instanced"), "trav_ord", "world")
    return a.unionByName(b)


def mesh_features(models: DataFrame) -> DataFrame:
    """Per mesh its name, box, volume, diagonal, aspect ratio, main axis, vertices and triangles."""
    prims = scenes.primitives(models)
    b = Box.named()
    df = prims.groupBy("model_id", "mesh_ix").agg(F.min("mesh_name").alias("mesh_name"), *b.union(), F.sum("n_vertices").alias("n_vertices"), F.sum(reports.triangles(F.col("n_indices"), F.col("n_vertices"))).alias("n_triangles"))
    return df.withColumns({"volume": b.volume(), "diagonal": b.diagonal(), "aspect": b.aspect_ratio(), "main_axis": b.main_axis()})
