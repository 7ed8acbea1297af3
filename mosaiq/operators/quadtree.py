"""A quadtree over the XZ plane: cells by midpoint comparison, splits by number of objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.boxes import Box, tile_error
from mosaiq.operators.steps import written

#: Added to the side of the root square, so that objects on its far edge lie inside.
MARGIN = 0.01


def root_square(objects: DataFrame, box: Box) -> DataFrame:
    """One row (x0, z0, side) around all objects' boxes."""
    side = F.greatest(F.max(box.high[0]) - F.min(box.low[0]), F.max(box.high[2]) - F.min(box.low[2])) + MARGIN
    return objects.agg(F.min(box.low[0]).alias("x0"), F.min(box.low[2]).alias("z0"), side.alias("side"))


def located(objects: DataFrame, box: Box, depth: int) -> DataFrame:
    """``objects`` with their cell ``zx``, ``zy`` at the deepest level; the bits of these two, taken in turn, are its Z-order key.

    A level halves both intervals at the midpoint and compares the center with it,
    half-open, so the cell n levels up is the one without the last n bits. No row is
    multiplied; the square is one row.
    """
    cx, _, cz = box.center()
    df = objects.crossJoin(F.broadcast(root_square(objects, box)))  # one row
    sides = {"__xa": F.col("x0"), "__xb": F.col("x0") + F.col("side"), "__za": F.col("z0"), "__zb": F.col("z0") + F.col("side")}
    df = df.withColumns({"__cx": cx, "__cz": cz, "zx": F.lit(0), "zy": F.lit(0)} | sides).drop("x0", "z0", "side")
    for _ in range(depth):
        mx, mz = (F.col("__xa") + F.col("__xb")) * 0.5, (F.col("__za") + F.col("__zb")) * 0.5
        right, top = F.col("__cx") >= mx, F.col("__cz") >= mz
        df = df.withColumns({
            "zx": F.col("zx") * 2 + right.cast("int"), "zy": F.col("zy") * 2 + top.cast("int"),
            "__xa": F.when(right, mx).otherwise(F.col("__xa")), "__xb": F.when(right, F.col("__xb")).otherwise(mx),
            "__za": F.when(top, mz).otherwise(F.col("__za")), "__zb": F.when(top, F.col("__zb")).otherwise(mz),
        })
    return df.drop("__cx", "__cz", "__xa", "__xb", "__za", "__zb")


@dataclass(frozen=True)
class Tree:
    """``tiles``: level, x, y, n, leaf and the box around the tile's objects. ``objects``: what was located, with zx and zy."""

    tiles: DataFrame
    objects: DataFrame
    depth: int

    def _cells(self, tiles: DataFrame) -> DataFrame:
        """(zx, zy, level, x, y, leaf): the tiles over each deepest cell that has objects."""
        cells = self.objects.select("zx", "zy").distinct()
        df = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.depth))))
        above = {a: F.expr(f"shiftright({c}, {self.depth} - level)") for a, c in (("x", "zx"), ("y", "zy"))}
        return df.withColumns(above).join(tiles.select("level", "x", "y", "leaf"), ["level", "x", "y"])

    def _placed(self, cells: DataFrame, keep: list[str]) -> DataFrame:
        # Cells are 4**depth at most; objects don't move where that is few.
        cells = F.broadcast(cells) if self.depth <= 8 else cells
        return self.objects.join(cells, ["zx", "zy"]).select(*keep, "level", "x", "y", "leaf")

    def leaves(self, id_: str) -> DataFrame:
        """(id, level, x, y): the leaf of every object."""
        return self._placed(self._cells(self.tiles.filter("leaf")), [id_]).drop("leaf")

    def members(self, keep: list[str]) -> DataFrame:
        """``keep``, level, x, y, leaf: every object in every tile over it, for those who draw all levels."""
        return self._placed(self._cells(self.tiles), keep)


def build(objects: DataFrame, box: Box, depth: int = 6, most: int = 50) -> Tree:
    """The quadtree over objects whose boxes are ``box``.

    A tile splits when it holds more than ``most`` objects and lies above ``depth``. As a
    tile never holds more than its parent, a tile is there exactly if its parent splits.
    Objects are counted once, at the deepest level, before they move; what is above is
    added up from those cells, a level's from the level below.
    """
    placed = located(objects, box, depth)
    counts = written(placed.groupBy("zx", "zy").agg(F.count(F.lit(1)).alias("n"), *box.union()), "cells")
    levels = counts.select(F.lit(depth).alias("level"), F.col("zx").alias("x"), F.col("zy").alias("y"), "n", *Box.named().columns())
    every = levels
    for level in range(depth - 1, -1, -1):
        half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        levels = levels.groupBy(half("x"), half("y")).agg(F.sum("n").cast("long").alias("n"), *Box.named().union()).select(F.lit(level).alias("level"), "x", "y", "n", *Box.named().columns())
        every = every.unionByName(levels)
    every = written(every, "tiles")
    splits = (F.col("n") > most) & (F.col("level") < depth)
    parents = every.filter(splits).select((F.col("level") + 1).alias("level"), F.col("x").alias("__px"), F.col("y").alias("__py"))
    inside = every.withColumns({"__px": F.floor(F.col("x") / 2).cast("int"), "__py": F.floor(F.col("y") / 2).cast("int")})
    made = inside.join(parents, ["level", "__px", "__py"], "left_semi").unionByName(inside.filter("level = 0")).drop("__px", "__py")
    return Tree(made.withColumn("leaf", ~splits), placed, depth)


def tile_name(level: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("T"), level.cast("string"), F.lit("_"), x.cast("string"), F.lit("_"), y.cast("string"), F.lit(".glb"))


def tile_errors(tiles: DataFrame) -> DataFrame:
    """(level, x, y, error) from the tiles' own boxes."""
    return tiles.select("level", "x", "y", tile_error(Box.named().diagonal(), F.col("level"), F.col("leaf")).alias("error"))


def deepest_first(tiles: DataFrame) -> list[int]:
    """Levels in the order in which parents are built from their children; as many as the depth."""
    return [r.level for r in tiles.select("level").distinct().orderBy(F.desc("level")).collect()]
