"""Groups of equal or similar things, their representatives, and the rule of the least count.

The representative is the first in an order given by columns. It is found by an aggregate
that is summed before the shuffle (``min_by``), and brought back to the rows by a join.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.layout import running_within
from mosaiq.operators.skew import looked_up
from mosaiq.operators.steps import written


def representatives(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Per key ``rep_<value>`` of the first row in order, and the number of rows ``n``."""
    first = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("rep"), F.count(F.lit(1)).alias("n")).select(*keys, *[F.col(f"rep.{v}").alias(f"rep_{v}") for v in values], "n")


def having(groups: DataFrame, limit: int) -> DataFrame:
    """Groups with ``limit`` members at least."""
    return groups.filter(F.col("n") >= limit)


def demoted(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows of groups with fewer than ``limit`` members; null keys are a key."""
    small = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < limit)
    return _on(df, small, keys, "left_semi")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys of which null equals null; left columns keep their names."""
    right = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]), how).drop(*[f"__k_{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with its place ``member_ix`` in its group, from 1, and the group's size ``group_size``.

    Rows are dealt by ranges of keys and order, so a group may be many tasks.
    """
    placed = running_within(df, keys, order, F.lit(1).cast("long"), "member_ix")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    return looked_up(placed, sizes, keys, "group_size").withColumn("member_ix", (F.col("member_ix") + 1).cast("int"))


def with_representative(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Every row with ``rep_<value>`` of its group's first row and ``n``; a group with most of the rows isn't one task."""
    return looked_up(df, representatives(df, keys, order, values), keys, "n")


def tolerance_groups(df: DataFrame, keys: list[str], order: list[str], values: list[str], tolerance: float, always: Column | None = None) -> DataFrame:
    """Every row with ``accepted``: all values within ``tolerance`` of the group's first row.

    Nearness is to the first row only, so it need not be transitive, and the others open
    no group of their own. A null value is near to nothing, itself included. Rows for
    which ``always`` holds (placements that were instances already) are accepted untested.
    """
    out = with_representative(df, keys, order, values)
    near = reduce(Column.__and__, [F.coalesce(F.abs(F.col(v) - F.col(f"rep_{v}")) <= tolerance, F.lit(False)) for v in values])
    return out.withColumn("accepted", near if always is None else near | always)


def split_groups(df: DataFrame, keys: list[str], order: list[str], values: list[str], tolerance: float, limit: int) -> DataFrame:
    """``tolerance_groups`` with ``outcome``: 'instanced', 'box' (too far off) or 'limit' (too few accepted)."""
    judged = tolerance_groups(df, keys, order, values, tolerance)
    sizes = judged.filter("accepted").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_accepted"))
    judged = _on(judged, written(sizes, "sizes"), keys, "left")
    outcome = F.when(~F.col("accepted"), "box").when(F.col("n_accepted") < limit, "limit").otherwise("instanced")
    return judged.withColumn("outcome", outcome)


def duplicates(df: DataFrame, identity: Column, id_: str) -> DataFrame:
    """Every row with ``rep_id``, the least id of the same identity; a null or empty identity equals no other."""
    df = df.withColumn("__identity", identity)
    named = F.coalesce(F.col("__identity").cast("string") != "", F.lit(False))
    first = df.filter(named).groupBy("__identity").agg(F.min(id_).alias("rep_id"), F.count(F.lit(1)).alias("__n"))
    same = looked_up(df.filter(named), first, ["__identity"], "__n", keep_size=False)
    return same.unionByName(df.filter(~named).withColumn("rep_id", F.col(id_))).drop("__identity")


def remapped(df: DataFrame, id_: str, map_: DataFrame) -> DataFrame:
    """``df`` with ``rep_id`` looked up in ``map_`` (id, rep_id); ids without an entry stay as they are."""
    return df.join(map_.select(F.col("id").alias(id_), F.col("rep_id").alias("__rep")), id_, "left").withColumn("rep_id", F.coalesce("__rep", id_)).drop("__rep")


def similar_pairs(df: DataFrame, keys: list[str], values: list[str], tolerance: float, id_: str) -> DataFrame:
    """(id_a, id_b) of rows of one key whose values all differ by ``tolerance`` at most.

    Rows are dealt into cells as wide as the tolerance over up to three values. A row meets
    those of its own cell and of one half of the cells around it, 13 for three values; the
    other half meets it from there. So each pair meets once, and no cell pairs more rows
    than lie near each other.
    """
    width = tolerance * (1 + 1e-9) or 1.0  # values just one tolerance apart are never two cells apart
    by = values[:3]
    cells = [F.floor(F.col(v).cast("double") / width) for v in by]
    left = df.select(*keys, F.col(id_).alias("a"), *[F.col(v).alias(f"a_{v}") for v in values], *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    right = df.select(*keys, F.col(id_).alias("b"), *[F.col(v).alias(f"b_{v}") for v in values], *[c.alias(f"d{i}") for i, c in enumerate(cells)])
    steps = [s for s in product((0, 1, -1), repeat=len(by)) if s >= (0,) * len(by)]
    around = F.array(*[F.struct(F.lit(any(s)).alias("other"), *[(F.col(f"d{i}") + n).alias(f"c{i}") for i, n in enumerate(s)]) for s in steps])
    right = right.withColumn("x", F.explode(around)).select("*", "x.*").drop("x", *[f"d{i}" for i in range(len(by))])
    near = reduce(Column.__and__, [F.abs(F.col(f"a_{v}").cast("double") - F.col(f"b_{v}").cast("double")) <= tolerance for v in values])
    met = left.join(right, [*keys, *[f"c{i}" for i in range(len(by))]]).filter(((F.col("a") < F.col("b")) | (F.col("other") & (F.col("a") != F.col("b")))) & near)
    return met.select(*keys, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def extremes(df: DataFrame, keys: list[str], value: Column | str, order: list[str | Column], name: str, greatest: bool = False) -> DataFrame:
    """Per key the value of the first (or last) row in order."""
    pick = F.max_by if greatest else F.min_by
    return df.groupBy(*keys).agg(pick(value, F.struct(*order)).alias(name))
