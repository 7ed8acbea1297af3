"""Queries that SQL can't express: they encode binary files or geometry and read them back."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mosaiq.functions.boxes import Box, tile_error, tileset_error
from mosaiq.operators import grouping, quadtree, simplify
from mosaiq.operators.steps import bounded, written
from mosaiq.plans import catalog, instancing, levels, semantic_levels
from mosaiq.sinks import tilesets
from mosaiq.sources import scenes
from mosaiq.sources.gltf import Node, Primitive, Writer


def _scene_files(s: SparkSession, d: str) -> DataFrame:
    """(path, length, content): a GLB per supplier, which places a box per part that it supplies, as large as the part."""
    bounded(s)
    items = catalog.lineitem(s, d).join(catalog.part(s, d).select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    at = ["l_suppkey", "l_orderkey", "l_linenumber", "p_size"]
    kinds = to_arrow_schema(T._parse_datatype_string("path string, length long, content binary"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The items of a supplier come one behind another, and one file at a time is open.
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("l_suppkey", "l_linenumber", "p_size"))))
        for supp, own in groupby(rows, key=lambda r: r[0]):
            w, meshes = Writer(), {}
            for i, (_, line, size) in enumerate(own):
                if size not in meshes:
                    corners = np.array([[a, b, c] for a in (0, size) for b in (0, size) for c in (0, size)], np.float32)
                    meshes[size] = w.mesh([Primitive({"POSITION": corners}, np.arange(8, dtype=np.uint16))], f"box {size}")
                w.node(Node(meshes[size], (float(i), 0.0, float(line))))
            data = w.finish()
            yield pa.RecordBatch.from_pylist([{"path": f"supplier-{supp:09d}.glb", "length": len(data), "content": data}], kinds)

    n = int(s.conf.get("spark.sql.shuffle.partitions"))
    return items.select(*at).repartition(n, "l_suppkey").sortWithinPartitions(*at).mapInArrow(build, "path string, length long, content binary")


def _models(s: SparkSession, d: str) -> DataFrame:
    """The suppliers' scenes, parsed once and written: kept in memory they would be as large as all files."""
    return scenes.models(written(scenes.read_scenes(_scene_files(s, d)), "scenes"))


def glb_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Per file of the suppliers' scenes: placements, groups' instances and those left, as read back from the bytes."""
    models = _models(s, d)
    found = instancing.detect(models, limit=3)
    rows = found.members.select("model_id", F.lit("instanced").alias("kind")).unionByName(found.left.select("model_id", F.lit("left").alias("kind")))
    counts = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("placements"), F.count_if(F.col("kind") == "instanced").alias("instanced"), F.count_if(F.col("kind") == "left").alias("left_over"))
    return counts.join(models.select("model_id", "path"), "model_id").select("path", "placements", "instanced", "left_over")


def instancing_of_scenes(s: SparkSession, d: str) -> DataFrame:
    """The instancing report of the suppliers' scenes, with a tolerance on boxes."""
    models = _models(s, d)
    return instancing.report(models, instancing.detect(models, tolerance=0.5, limit=3))


def tileset_json(s: SparkSession, d: str) -> DataFrame:
    """The quadtree over positions as one hierarchy of tiles."""
    tiles = catalog._tree(s, d).tiles
    name = quadtree.tile_name(F.col("level"), F.col("x"), F.col("y"))
    up = quadtree.tile_name(F.col("level") - 1, (F.col("x") / 2).cast("int"), (F.col("y") / 2).cast("int"))
    rows = tiles.select("level", "x", "y", Box.named().oriented(z_up=True).alias("box"), tile_error(Box.named().diagonal(), F.col("level"), F.col("leaf")).alias("error"))
    rows = rows.select(name.alias("tile"), F.when(F.col("level") > 0, up).alias("parent"), "level", "error", "box", name.alias("uri"))
    return tilesets.from_tree(rows)


def surfaces(embeddings: DataFrame, run: int = 6) -> DataFrame:
    """(id, positions, indices, n_rows): a label's embeddings in order of vec_id, ``run`` or up to twice as many to a grid.

    Every number is the height of one point and every point is a corner of a triangle. A
    grid is bounded, so the work grows by more grids and not by larger ones.
    """
    ranked = grouping.ranked(embeddings.select("label", "vec_id", "embedding"), ["label"], ["vec_id", "embedding"])
    runs = F.greatest(F.lit(1), F.floor(F.col("group_size") / run))
    # The last run takes what is left over, so that none is too small to simplify.
    dealt = ranked.withColumn("run", F.least(F.floor((F.col("member_ix") - 1) / run), runs - 1))
    grid = dealt.groupBy("label", "run").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for label, k, e in zip(b["label"], b["run"], b["e"]):
                h = np.concatenate([np.asarray(x["embedding"], float) for x in e])
                n = max(i for i in range(1, int(len(h) ** 0.5) + 1) if len(h) % i == 0)
                m = len(h) // n
                v = np.stack([np.repeat(np.arange(m), n), np.tile(np.arange(n), m), h], axis=1).astype(float)
                c = np.add.outer(np.arange(m - 1) * n, np.arange(n - 1)).ravel()
                ix = np.stack([c, c + 1, c + n, c + 1, c + n + 1, c + n], axis=1).ravel()
                rows.append((f"{label}-{k}", v.ravel(), ix, len(e)))
            yield pd.DataFrame(rows, columns=["id", "positions", "indices", "n_rows"])

    return grid.mapInPandas(build, "id string, positions array<double>, indices array<int>, n_rows long")


def simplify_chain(s: SparkSession, d: str) -> DataFrame:
    """Levels of the surfaces whose heights are the embeddings of a label, all of them."""
    return simplify.simplify_chain(surfaces(catalog.embeddings(s, d)), levels=3, ratio=0.5).select("id", "level", "triangles")


def tileset_errors(s: SparkSession, d: str) -> DataFrame:
    """Per supplier's scene the box around all placements and the error of its flat tileset."""
    models = _models(s, d)
    box = scenes.scene_box(scenes.placements(models), scenes.mesh_boxes(scenes.primitives(models)), ["model_id"])
    return box.select("model_id", *[F.round(f"{m}_{a}", 4).alias(f"{m}_{a}") for m in ("min", "max") for a in "xyz"], F.round(tileset_error(Box.named().diagonal()), 4).alias("error"))


def lod5_start(s: SparkSession, d: str) -> DataFrame:
    """The first level's items of the suppliers' scenes by mesh: how many, their placements, features, and the part that they are."""
    models = _models(s, d)
    found = instancing.detect(models, limit=3)
    parts = catalog.part(s, d).groupBy(F.concat(F.lit("box "), F.col("p_size").cast("string")).alias("actor_hash"))
    what = parts.agg(F.max("p_brand").alias("category"), F.min("p_type").alias("family"), F.lit("").alias("type")).filter("actor_hash <> 'box 7'")
    items = semantic_levels.lod5(semantic_levels.placed_items(found), models, what)
    return items.groupBy("mesh_name", "category", "family", "n_vertices", F.round("volume", 3).alias("volume")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").cast("long").alias("placements"))


def level_instancing(s: SparkSession, d: str) -> DataFrame:
    """Instancing detected anew in the suppliers' scenes at level 1; their meshes are too small to be simplified."""
    made = levels.level_models(_scene_files(s, d), 1)
    (one,) = levels.instanced_levels(made, 1, limit=3)
    return one.report.select(F.lit(1).alias("level"), "input_models", "instanced_groups", "final_instances", "non_instanced")


QUERIES = {f.__name__: f for f in (glb_roundtrip, instancing_of_scenes, tileset_json, simplify_chain, tileset_errors, lod5_start, level_instancing)}

_ITEMS = """i AS (SELECT l_suppkey, p_size, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, p_size) - 1 AS x,
    l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT l_suppkey, 'supplier-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '.glb' AS path FROM i GROUP BY 1)"""

ORACLES = {
    "lod5_start": f"""WITH {_ITEMS}, n AS (SELECT p_size, count(*) AS n FROM i GROUP BY 1),
w AS (SELECT p_size, max(p_brand) AS category, min(p_type) AS family FROM part WHERE p_size <> 7 GROUP BY 1)
SELECT 'box ' || p_size AS mesh_name, category, family, 8::BIGINT AS n_vertices, round((p_size * p_size * p_size)::DOUBLE, 3) AS volume, CASE WHEN n >= 3 THEN 1 ELSE n END AS items, n AS placements FROM n LEFT JOIN w USING (p_size)""",
    "level_instancing": f"""WITH {_ITEMS}, n AS (SELECT p_size, count(*) AS n FROM i GROUP BY 1)
SELECT 1 AS level, (SELECT count(*) FROM f) AS input_models, count(*) FILTER (n >= 3) AS instanced_groups, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS final_instances, CAST(coalesce(sum(n) FILTER (n < 3), 0) AS BIGINT) AS non_instanced FROM n""",
    "glb_roundtrip": f"""WITH {_ITEMS}, n AS (SELECT p_size, count(*) AS n FROM i GROUP BY 1)
SELECT path, count(*) AS placements, count(*) FILTER (n >= 3) AS instanced, count(*) FILTER (n < 3) AS left_over FROM i JOIN n USING (p_size) JOIN f USING (l_suppkey) GROUP BY 1""",
    "instancing_of_scenes": f"""WITH {_ITEMS}, rep AS (SELECT p_size FROM i JOIN f USING (l_suppkey) ORDER BY path, x LIMIT 1),
k AS (SELECT count(DISTINCT l_suppkey) AS input_models, count(*) AS initial_nodes, count(DISTINCT (l_suppkey, p_size)) AS initial_meshes, CAST(0 AS BIGINT) AS initial_instances,
    count(*) FILTER (p_size = (SELECT p_size FROM rep)) AS m FROM i),
c AS (SELECT *, CASE WHEN m >= 3 THEN 1::BIGINT ELSE 0 END AS instanced_groups, CASE WHEN m >= 3 THEN m ELSE 0 END AS final_instances, CASE WHEN m >= 3 THEN initial_nodes - m ELSE initial_nodes END AS non_instanced FROM k)
SELECT input_models, initial_nodes, initial_meshes, initial_instances, instanced_groups, final_instances, non_instanced, instanced_groups + non_instanced AS final_nodes, instanced_groups + non_instanced AS final_meshes,
    final_instances + non_instanced AS total_displayed, round((1 - (instanced_groups + non_instanced) / initial_nodes) * 100, 2) AS node_reduction, 0.0::DOUBLE AS initial_ratio,
    round(final_instances / (final_instances + non_instanced) * 100, 2) AS final_ratio, round(final_instances / (final_instances + non_instanced) * 100, 2) AS increase FROM c""",
    "tileset_errors": f"""WITH {_ITEMS}, b AS (SELECT l_suppkey, min(x)::DOUBLE AS min_x, 0.0::DOUBLE AS min_y, min(l_linenumber)::DOUBLE AS min_z, max(x + p_size)::DOUBLE AS max_x, max(p_size)::DOUBLE AS max_y, max(l_linenumber + p_size)::DOUBLE AS max_z FROM i GROUP BY 1)
SELECT row_number() OVER (ORDER BY path) - 1 AS model_id, min_x, min_y, min_z, max_x, max_y, max_z, round(greatest(0.1 * sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2), 1.0), 4)::DOUBLE AS error FROM b JOIN f USING (l_suppkey)""",
}
