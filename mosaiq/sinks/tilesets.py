"""Tile hierarchies as JSON: flat, wrapped, chained, and from rows of a tree."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.steps import written

_HEAD = '{"asset":{"version":"1.1"},"geometricError":'
#: Boxes of hierarchies whose extent isn't computed, and the root's own error.
WRAPPER_HALF, CHAIN_HALF, ROOT_ERROR = 100000.0, 10000.0, 1000.0


def cube_box(half: float) -> list[float]:
    return [0.0, 0.0, 0.0, half, 0.0, 0.0, 0.0, half, 0.0, 0.0, 0.0, half]


def z_up(box: list[float]) -> list[float]:
    """Center and half axes with y and z exchanged, without a change of sign."""
    out = list(box)
    out[1], out[2], out[7], out[11] = box[2], box[1], box[11], box[7]
    return out


def tile(box: list[float], error: float, uri: str | list[str] | None = None, children: list[dict] | None = None, refine: str = "REPLACE", transform: list[float] | None = None) -> dict[str, Any]:
    out: dict[str, Any] = {"boundingVolume": {"box": box}, "geometricError": error, "refine": refine}
    if isinstance(uri, list):
        out["contents"] = [{"uri": u} for u in uri]
    elif uri is not None:
        out["content"] = {"uri": uri}
    if transform is not None:
        out["transform"] = transform
    if children:
        out["children"] = children
    return out


def tileset(root: dict[str, Any], error: float | None = None) -> str:
    return json.dumps({"asset": {"version": "1.1"}, "geometricError": root["geometricError"] if error is None else error, "root": root})


def flat(content: list[tuple[str, list[float], float]], root_box: list[float], transform: list[float] | None = None, error: float = ROOT_ERROR) -> str:
    """A root over one child per file (uri, box, error)."""
    return tileset(tile(root_box, error, children=[tile(b, e, u) for u, b, e in content], transform=transform))


def wrapper(uris: list[str], error: float = ROOT_ERROR) -> str:
    """A tile that shows several files together."""
    return tileset(tile(cube_box(WRAPPER_HALF), error, list(uris), refine="ADD"))


def chain(levels: list[tuple[str, float]], box: list[float] | None = None, error: float = ROOT_ERROR) -> str:
    """Levels from the coarsest to the finest, each inside the one before; errors never grow downwards."""
    node = None
    for uri, e in reversed(levels):
        if node is not None and e <= node["geometricError"]:
            e = max(node["geometricError"] * 1.05, node["geometricError"] + 1)
        node = tile(box or cube_box(CHAIN_HALF), e, uri, [node] if node else None)
    if node is None:
        return tileset(tile(box or cube_box(CHAIN_HALF), error))
    return tileset(node, max(error, node["geometricError"]))


def from_tree(tiles: DataFrame, most: int = 8 << 20) -> DataFrame:
    """(tile, uri, json): the hierarchy of ``tiles`` (tile, parent, level, error, box ARRAY<DOUBLE>, uri) as tilesets of ``most`` bytes at most.

    A root's tileset has no uri. Built level by level from the deepest: a level's tiles take
    in their children's JSON by one join, and raise their error above the greatest of their
    children's. Where that would be over the bound, the children become tilesets of their
    own, called by the tile with ``.json``, and the parent has a tile for each that names
    it. A row never holds more than the JSON of one tile's children. A tile with so many
    children that even their names are over the bound is an error.
    """
    levels = [r.level for r in tiles.select("level").distinct().orderBy(F.desc("level")).collect()]
    bare = tiles.select("tile", "parent", "level", "error", "box", "uri")
    texts = "array<string>"
    done, cut = None, []
    for n in levels:
        now = bare.filter(F.col("level") == n)
        if done is None:
            now = now.withColumns({"kids": F.array().cast(texts), "stubs": F.array().cast(texts), "most": F.lit(None).cast("double")})
        else:
            below = done.groupBy(F.col("parent").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("tile", "json", "stub"))).alias("k"), F.max("error").alias("most"))
            below = below.select("tile", F.transform("k", lambda x: x["json"]).alias("kids"), F.transform("k", lambda x: x["stub"]).alias("stubs"), "most")
            now = now.join(below, "tile", "left").withColumns({c: F.coalesce(c, F.array().cast(texts)) for c in ("kids", "stubs")})
        now = now.withColumn("error", F.when(F.col("error") <= F.col("most"), F.greatest(F.col("most") * 1.05, F.col("most") + 1)).otherwise(F.col("error")))
        as_json = lambda uri: F.to_json(F.struct(F.struct("box").alias("boundingVolume"), F.col("error").alias("geometricError"), F.lit("REPLACE").alias("refine"), F.when(uri.isNotNull(), F.struct(uri.alias("uri"))).alias("content")))
        file = F.concat(F.regexp_replace(F.col("tile").cast("string"), r"\.glb$", ""), F.lit(".json"))
        now = now.withColumns({"body": as_json(F.col("uri")), "stub": as_json(file), "file": file})
        # to_json leaves null fields out; children are JSON already.
        whole = lambda kids: F.when(F.size(kids) > 0, F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"children":['), F.array_join(kids, ","), F.lit("]}"))).otherwise(F.col("body"))
        room = F.lit(most - len(_HEAD) - 64)
        long = F.octet_length("body") + F.aggregate("kids", F.lit(20).cast("long"), lambda a, k: a + F.octet_length(k) + 1)
        now = now.withColumn("fits", long <= room)
        now = now.withColumn("json", whole(F.when(F.col("fits"), F.col("kids")).otherwise(F.col("stubs"))))
        now = now.withColumn("json", F.when(F.octet_length("json") <= room, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("too many children for a tileset: "), F.col("tile").cast("string")))))
        now = written(now.select("tile", "parent", "error", "json", "stub", "file", "fits"), "level")
        if done is not None:
            cut.append(done.join(now.filter("NOT fits").select(F.col("tile").alias("parent")), "parent", "left_semi"))
        done = now
    if done is None:
        return tiles.select("tile", F.lit("").alias("uri"), F.lit("").alias("json")).limit(0)
    # Levels above may begin below the first: what has no parent is a root.
    roots = done.filter("parent IS NULL").select("tile", F.lit(None).cast("string").alias("uri"), "error", "json")
    rows = reduce(DataFrame.unionByName, [roots, *[c.select("tile", F.col("file").alias("uri"), "error", "json") for c in cut]])
    return rows.select("tile", "uri", F.concat(F.lit(_HEAD), F.col("error").cast("string"), F.lit(',"root":'), "json", F.lit("}")).alias("json"))
