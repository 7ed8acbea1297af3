"""Models at levels of detail, and tiles of a quadtree with their models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mosaiq.functions.boxes import Box, tile_error
from mosaiq.operators import quadtree
from mosaiq.operators.simplify import LEAST_INDICES, simplified
from mosaiq.operators.steps import bounded, written
from mosaiq.plans import instancing
from mosaiq.sinks import tilesets
from mosaiq.sinks.assembly import write_models
from mosaiq.sources import scenes
from mosaiq.sources.gltf import Gltf, GltfError, Node, Writer, parse, primitives_of, roots_of

#: What a parent tile keeps of the indices of the level below it.
PARENT_RATIO = 0.5


def simplify_model(data: bytes, ratio: float, least: int = LEAST_INDICES) -> tuple[bytes, int, int]:
    """A model with all meshes simplified, placed as before, and its triangles before and after.

    Nodes without a mesh of their own or below them are dropped, and materials that no
    mesh uses any more.
    """
    return next(simplified_models(data, [ratio], least))


def simplified_models(data: bytes, ratios: list[float], least: int = LEAST_INDICES) -> Iterator[tuple[bytes, int, int]]:
    """``simplify_model`` at each ratio, from one reading of the model."""
    g = parse(data)
    meshes = [(mesh.get("name"), primitives_of(g, m)) for m, mesh in enumerate(g.items("meshes"))]
    triangles = lambda of: sum(len(p.indices) // 3 for p in of if p.indices is not None)
    before = sum(triangles(old) for _, old in meshes)
    for ratio in ratios:
        w, after = Writer(), 0
        for name, old in meshes:
            new = [simplified(p, ratio, least) for p in old]
            after += triangles(new)
            w.mesh(new, name)
        _copy_nodes(g, w)
        yield w.finish(), before, after


def _copy_nodes(g: Gltf, w: Writer) -> None:
    """The nodes that lead to a mesh, with their transforms, children and instances."""
    nodes = g.items("nodes")
    number: dict[int, int] = {}

    def full(i: int) -> bool:
        return "mesh" in nodes[i] or any([full(c) for c in nodes[i].get("children", [])])

    def put(i: int) -> int:
        n = nodes[i]
        out = {k: n[k] for k in ("name", "mesh", "translation", "rotation", "scale", "matrix") if k in n}
        inst = scenes._instances(g, n)
        if inst is not None:
            # Written by the same code as any other instances, then taken over.
            w.node(Node(n.get("mesh", 0), instances=[(tuple(x["t"]), tuple(x["r"]), tuple(x["s"])) for x in inst]))
            out["extensions"] = w.doc["nodes"].pop()["extensions"]
            w.doc["scenes"][0]["nodes"].pop()
        kids = [put(c) for c in n.get("children", []) if full(c)]
        if kids:
            out["children"] = kids
        w.doc["nodes"].append(out)
        number[i] = len(w.doc["nodes"]) - 1
        return number[i]

    for root in roots_of(g):
        if full(root):
            w.doc["scenes"][0]["nodes"].append(put(root))


def level_models(files: DataFrame, levels: int = 3, ratio: float = 0.5, least: int = LEAST_INDICES) -> DataFrame:
    """(path, level, glb, size, triangles, original_triangles, error): level 0 as it is, each next at ratio**level.

    A file's bytes are moved and read once for all its levels. Unreadable files have no
    rows; their error is in ``read_scenes``.
    """
    schema = T._parse_datatype_string("path string, level int, glb binary, size long, triangles long, original_triangles long, error double")
    kinds = to_arrow_schema(schema)
    unreadable = (GltfError, KeyError, IndexError, TypeError, ValueError)

    def of(content: bytes) -> Iterator[tuple[int, bytes, int, int]]:
        """(level, glb, triangles, those of level 0), until a level can't be made."""
        made = simplified_models(content, [ratio**level for level in range(1, levels + 1)], least)
        try:
            try:
                first = next(made, None)
            except unreadable:
                first = None
            # What is written simplified could be written as it is; only without that is it tried.
            before = first[1] if first else simplify_model(content, 1.0, least)[1]
            yield 0, content, before, before
            for level, (glb, _, after) in enumerate(chain([first] if first else [], made), 1):
                yield level, glb, after, before
        except unreadable:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            for level, glb, after, before in of(content):
                row = (path, level, glb, len(glb), after, before, 0.0 if not level else 16.0 * 2 ** (level - 1))
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row))], kinds)

    bounded(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, schema)


@dataclass
class LevelInstancing:
    """Of one level: models of what is instanced and of what is left, by ``part``, and the report's row.

    Models are put together when they are first asked for: the report comes from what was
    detected and needs none of them.
    """

    level: int
    assemble: Callable[[], DataFrame]
    report: DataFrame

    @cached_property
    def models(self) -> DataFrame:
        return self.assemble()


def instanced_levels(levels: DataFrame, count: int, tolerance: float = 0.0, limit: int = 2, skip: tuple[str, ...] = (), normal_tolerance: float = 0.0) -> list[LevelInstancing]:
    """Instancing detected anew in the models of each level from 1 to ``count`` (rows of ``level_models``), as simplified meshes may agree where their originals don't."""

    def of(level: int) -> LevelInstancing:
        files = levels.filter(F.col("level") == level).select("path", F.col("size").alias("length"), F.col("glb").alias("content"))
        models = scenes.models(written(scenes.read_scenes(files, normal_tolerance), "scenes"))
        found = instancing.detect(models, tolerance, limit, skip)

        def assemble() -> DataFrame:
            drawn = instancing.to_draw(found).withColumn("part", F.when(F.col("instanced"), "instanced").otherwise("non_instanced"))
            return write_models(drawn, files.join(models.select("path", "model_id"), "path"), ["part"]).withColumn("level", F.lit(level))

        return LevelInstancing(level, assemble, instancing.report(models, found))

    return [of(level) for level in range(1, count + 1)]


def instanced_level_tileset(parts: list[tuple[float, list[str]]]) -> str:
    """Levels (error, uris) from finest to coarsest: a level of two files is shown by a tile with both, each inside the next coarser; a root error under 100 counts as 1000."""
    node = None
    for error, uris in parts:
        if node is not None and error <= node["geometricError"]:
            error = max(node["geometricError"] * 1.05, node["geometricError"] + 1)
        uri = uris[0] if len(uris) == 1 else list(uris)
        node = tilesets.tile(tilesets.cube_box(tilesets.CHAIN_HALF), error, uri, [node] if node else None)
    if node is None:
        return tilesets.chain([])
    return tilesets.tileset(node, node["geometricError"] if node["geometricError"] >= 100 else tilesets.ROOT_ERROR)


def level_report(models: DataFrame) -> DataFrame:
    """Per file and level how many percent of triangles and bytes are saved, to two places."""
    first = models.filter("level = 0").select("path", F.col("size").alias("size0"))
    saved = lambda a, b: F.round(F.when(F.col(b) > 0, (1 - F.col(a) / F.col(b)) * 100).otherwise(0.0), 2)
    return models.join(first, "path").select("path", "level", "size", "triangles", "original_triangles", saved("triangles", "original_triangles").alias("triangle_reduction"), saved("size", "size0").alias("size_reduction"))


def level_tileset(levels: list[tuple[str, float]]) -> str:
    """Levels (uri, error) from finest to coarsest as a chain with the coarsest outside."""
    return tilesets.chain(levels[::-1])


def tile_models(models: DataFrame, files: DataFrame, depth: int = 6, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(tiles with their models as values, roots with their JSON): see ``tile_members``."""
    drawn, json_ = tile_members(models, depth, most)
    name = quadtree.tile_name(F.col("level"), F.col("x"), F.col("y"))
    return write_models(drawn, files, ["level", "x", "y"]).withColumn("tile", name), json_


def tile_members(models: DataFrame, depth: int = 6, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows for ``assembly`` by level, x and y; roots with their JSON) of a quadtree over all placements.

    A tile holds all placements below it. A mesh that it shows more than once is stored
    once with instances. Each level up halves the indices of the level below, from the
    original, so levels don't wait for each other's files.
    """
    boxes = scenes.mesh_boxes(scenes.primitives(models))
    placed = scenes.placements(models).join(boxes, ["model_id", "mesh_ix"])
    world = placed.select("model_id", "mesh_ix", "trav_ord", "world", *Box.named().moved(F.col("world")).columns()).filter("min_x IS NOT NULL")
    tree = quadtree.build(written(world, "placed"), Box.named(), depth, most)
    tiles = tree.tiles
    name = quadtree.tile_name(F.col("level"), F.col("x"), F.col("y"))
    up = quadtree.tile_name(F.col("level") - 1, (F.col("x") / 2).cast("int"), (F.col("y") / 2).cast("int"))
    rows = tiles.select("level", "x", "y", Box.named().oriented(z_up=True).alias("box"), tile_error(Box.named().diagonal(), F.col("level"), F.col("leaf")).alias("error"))
    json_ = tilesets.from_tree(rows.select(name.alias("tile"), F.when(F.col("level") > 0, up).alias("parent"), "level", "error", "box", name.alias("uri")))

    deepest = tiles.agg(F.max("level").alias("d"))  # one row
    drawn = tree.members(["model_id", "mesh_ix", "trav_ord", "world"]).crossJoin(F.broadcast(deepest))
    shown = drawn.groupBy("level", "x", "y", "model_id", "mesh_ix").agg(F.count(F.lit(1)).alias("k"))
    drawn = drawn.join(shown, ["level", "x", "y", "model_id", "mesh_ix"]).select(
        "level", "x", "y", F.concat_ws("_", "model_id", "mesh_ix").alias("mesh_key"), "model_id", "mesh_ix", (F.col("k") > 1).alias("instanced"), "trav_ord", "world",
        F.when(F.col("leaf"), 1.0).otherwise(F.pow(F.lit(PARENT_RATIO), F.col("d") - F.col("level"))).alias("ratio"),
    )
    return drawn, json_
