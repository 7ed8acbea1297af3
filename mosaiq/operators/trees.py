"""Trees given as rows (node, parent), climbed by doubling.

Every node holds a pointer to the ancestor some number of steps above it, and what lies
between. One join doubles the number, so a tree of depth d takes log d joins of as many rows
as it has nodes, and each is written before the next. Nodes on a cycle, or below one, have
no root: their pointers never end. They are left out of all results, once the steps are more
than there are nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.steps import dropped, written

Join = Callable[[Column, Column], Column]


def _doubled(state: DataFrame, double: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state`` (node, up, ...) after as many doublings as it takes until no pointer is left; rows whose pointers never end are dropped."""
    now, steps = written(state, "climb"), 1
    while (left := now.filter("up IS NOT NULL").count()) and steps <= (n := now.count()):
        more = written(double(now), "climb")
        dropped(now)
        now, steps = more, steps * 2
    return now.filter("up IS NULL") if left else now


def descend(nodes: DataFrame, roots: DataFrame, carry: dict[str, tuple[Column, Join]]) -> DataFrame:
    """(node, root, depth, carried columns) of every node that is in ``roots`` (node) or has its nearest such ancestor there.

    Per carried column its own value at a node and an associative function of two: a node's
    result is that of all values from its root down to itself, in this order.
    """
    top = roots.select(F.col("node").alias("root")).distinct()
    own = nodes.select("node", "parent", *[v.alias(k) for k, (v, _) in carry.items()]).join(top, F.col("node") == F.col("root"), "left")
    # A chain that ends without a root has none; its last node points nowhere.
    state = own.select("node", F.when(F.col("root").isNull(), F.col("parent")).alias("up"), "root", F.lit(0).alias("depth"), *carry)

    def double(now: DataFrame) -> DataFrame:
        above = now.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), *[F.col(k).alias(f"__c_{k}") for k in carry])
        met = now.join(above, F.col("up") == F.col("__n"), "left")
        there = F.col("__n").isNotNull()
        carried = [F.when(there, f(F.col(f"__c_{k}"), F.col(k))).otherwise(F.col(k)).alias(k) for k, (_, f) in carry.items()]
        depth = F.when(there, F.col("depth") + F.col("__depth") + 1).otherwise(F.col("depth"))
        return met.select("node", F.col("__up").alias("up"), F.coalesce("root", "__root").alias("root"), depth.alias("depth"), *carried)

    return _doubled(state, double).filter("root IS NOT NULL").select("node", "root", "depth", *carry)


def subtree_sums(nodes: DataFrame, value: Column) -> DataFrame:
    """(node, total): the sum of ``value`` over the subtree of each node, itself included.

    After k rounds a node has the sum of all within 2**k steps below it; what lies further
    comes from the nodes that are exactly that far below, to each of which it is the
    ancestor their pointer names.
    """
    state = nodes.select("node", F.col("parent").alias("up"), value.alias("total"))

    def double(now: DataFrame) -> DataFrame:
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("__at")).agg(F.sum("total").alias("__below"))
        above = now.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
        df = now.join(above, F.col("up") == F.col("__n"), "left").join(below, F.col("node") == F.col("__at"), "left")
        return df.select("node", F.col("__up").alias("up"), (F.col("total") + F.coalesce("__below", F.lit(0))).cast(now.schema["total"].dataType).alias("total"))

    return _doubled(state, double).select("node", "total")


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """(node, n): nodes in the subtree of each, itself included."""
    return subtree_sums(nodes, F.lit(1).cast("long")).withColumnRenamed("total", "n")


def pruned(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """``nodes`` that are in ``full`` (node) or have a descendant in it."""
    marked = nodes.select("node", "parent").join(full.select(F.col("node").alias("__full")).distinct(), F.col("node") == F.col("__full"), "left")
    kept = subtree_sums(marked, F.col("__full").isNotNull().cast("long")).filter("total > 0")
    return nodes.join(kept.select("node"), "node", "left_semi")


def roots_or_all(candidates: DataFrame) -> DataFrame:
    """Of rows (node, priority), those of the best (least) priority that occurs."""
    best = candidates.agg(F.min("priority").alias("__best"))
    return candidates.join(F.broadcast(best), F.col("priority") == F.col("__best")).drop("__best")  # one row


def used_first(rows: DataFrame, used: str, order: list[str]) -> DataFrame:
    """(used, new_ix): values in use, numbered from 0 by first use."""
    from mosaiq.operators.layout import numbered

    first = rows.filter(F.col(used).isNotNull()).groupBy(used).agg(F.min(F.struct(*order)).alias("__first"))
    return numbered(first, ["__first"], "new_ix").select(used, "new_ix")
