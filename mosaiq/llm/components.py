"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import drop_stored, stored


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One step: every node's neighbours are linked to the least of them (Kiveris and others, 2014).

    The large star moves the greater neighbours of a node, the small star the lesser ones
    and the node itself. The least neighbour is found before the shuffle as far as it can
    be. It is written before a join brings it to the links: Spark splits a hot key, a node
    with very many links, only in a join without an aggregate on its inputs.
    """
    if small:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = stored(out.filter("a <> b").distinct(), "links")
    drop_stored(least)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the least node that it reaches.

    Links may repeat, run either way or join a node to itself (such nodes are left out if
    they have no other link); an empty table gives an empty one. Each round is written to
    the shared folder, so a lost executor repeats one round at most.
    """
    now = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if found == mark or not found.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = found
        half = _stars(now, small=False)
        drop_stored(now)
        now = _stars(half, small=True)
        drop_stored(half)
    raise RuntimeError(f"the components are not complete after {rounds} rounds")
