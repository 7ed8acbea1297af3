"""Axis-aligned boxes as six double columns.

A box that is not valid is null in all six; aggregates then pass over it, as a union should.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """Columns of the least and the greatest corner."""

    low: tuple[Column, Column, Column]
    high: tuple[Column, Column, Column]

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        """Columns <prefix>min_x ... <prefix>max_z."""
        return cls(tuple(F.col(f"{prefix}min_{a}") for a in AXES), tuple(F.col(f"{prefix}max_{a}") for a in AXES))

    def valid(self) -> Column:
        """All corners given, and the least nowhere above the greatest."""
        ok = F.lit(True)
        for a, b in zip(self.low, self.high):
            ok = ok & a.isNotNull() & b.isNotNull() & (a <= b)
        return F.coalesce(ok, F.lit(False))

    def similar(self, other: Box, tolerance: float) -> Column:
        """Both valid, and every component within ``tolerance``, that included."""
        near = self.valid() & other.valid()
        for a, b in zip((*self.low, *self.high), (*other.low, *other.high)):
            near = near & (F.abs(a - b) <= tolerance)
        return F.coalesce(near, F.lit(False))

    def center(self) -> tuple[Column, ...]:
        return tuple((a + b) * 0.5 for a, b in zip(self.low, self.high))

    def half(self) -> tuple[Column, ...]:
        return tuple((b - a) * 0.5 for a, b in zip(self.low, self.high))

    def extent(self) -> tuple[Column, ...]:
        return tuple(b - a for a, b in zip(self.low, self.high))

    def diagonal(self) -> Column:
        x, y, z = self.extent()
        return F.sqrt(x * x + y * y + z * z)

    def volume(self) -> Column:
        x, y, z = self.extent()
        return x * y * z

    def aspect_ratio(self) -> Column:
        """The longest side over the second longest; null where that has no length."""
        return aspect_ratio(*self.extent())

    def main_axis(self) -> Column:
        """Number of the longest side, of equals the first."""
        x, y, z = self.extent()
        return F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)

    def oriented(self, z_up: bool = False) -> Column:
        """Center and half axes as 12 numbers; ``z_up`` swaps y and z, without a change of sign.

        An invalid box becomes a point at the origin.
        """
        c, h = self.center(), self.half()
        if z_up:
            c, h = (c[0], c[2], c[1]), (h[0], h[2], h[1])
        zero = F.lit(0.0)
        whole = F.array(*c, h[0], zero, zero, zero, h[1], zero, zero, zero, h[2])
        return F.when(self.valid(), whole).otherwise(F.array(*[zero] * 12))

    def moved(self, matrix: list[float] | Column) -> Box:
        """The box around this one after a column-major 4x4 matrix.

        Each bound takes, per axis, the lesser or the greater product: the same as the
        bounds of all eight corners.
        """
        m = [matrix[i] if isinstance(matrix, Column) else F.lit(float(matrix[i])) for i in range(16)]
        low, high = [], []
        for row in range(3):
            a = b = m[12 + row]
            for k in range(3):
                p, q = m[4 * k + row] * self.low[k], m[4 * k + row] * self.high[k]
                a, b = a + F.least(p, q), b + F.greatest(p, q)
            ok = self.valid()
            low.append(F.when(ok, a))
            high.append(F.when(ok, b))
        return Box(tuple(low), tuple(high))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}min_{a}") for a, c in zip(AXES, self.low)] + [c.alias(f"{prefix}max_{a}") for a, c in zip(AXES, self.high)]

    def union(self) -> list[Column]:
        """Aggregates for the box around all boxes of a group."""
        return [F.min(c).alias(f"min_{a}") for a, c in zip(AXES, self.low)] + [F.max(c).alias(f"max_{a}") for a, c in zip(AXES, self.high)]


def aspect_ratio(x: Column, y: Column, z: Column) -> Column:
    sides = F.sort_array(F.array(F.abs(x), F.abs(y), F.abs(z)), asc=False)
    return F.when(sides[1] > 0, sides[0] / sides[1])


def point_box(x: Column, y: Column, z: Column) -> Box:
    p = (x.cast("double"), y.cast("double"), z.cast("double"))
    return Box(p, p)


def tileset_error(diagonal: Column) -> Column:
    """Geometric error of a flat tileset's root."""
    return F.greatest(diagonal * 0.1, F.lit(1.0))


#: Error factors by tile level; deeper levels have none.
LEVEL_FACTORS = (2.0, 0.8, 0.4, 0.1)


def level_factor(level: Column) -> Column:
    out = F.lit(0.0)
    for n, f in reversed(list(enumerate(LEVEL_FACTORS))):
        out = F.when(level == n, f).otherwise(out)
    return out


def tile_error(diagonal: Column, level: Column, leaf: Column) -> Column:
    """A tile's error: its diagonal by the level's factor; a parent's is never next to nothing."""
    e = diagonal * level_factor(level)
    return F.when(~leaf & (e < 0.001), F.greatest(diagonal * 0.05, F.lit(0.1))).otherwise(e)


def monotone(error: Column, most_of_children: Column) -> Column:
    """A parent's error, raised above the greatest of its children's where it isn't."""
    return F.when(error <= most_of_children, F.greatest(most_of_children * 1.05, most_of_children + 1)).otherwise(error)
