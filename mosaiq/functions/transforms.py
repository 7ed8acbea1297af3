"""Translation, rotation and scale as arrays of doubles; matrices as 16 doubles, column by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def trs_matrices(t: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """T·R·S of translations (n, 3), quaternions (n, 4: x, y, z, w) and scales (n, 3) as matrices (n, 4, 4).

    A quaternion may have any length; one without length turns nothing.
    """
    length = np.linalg.norm(r, axis=1, keepdims=True)
    q = np.where(length > 0, r, [0.0, 0.0, 0.0, 1.0]) / np.where(length > 0, length, 1.0)
    x, y, z, w = q.T
    out = np.zeros((len(t), 4, 4))
    out[:, 0, 0], out[:, 0, 1], out[:, 0, 2] = 1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)
    out[:, 1, 0], out[:, 1, 1], out[:, 1, 2] = 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)
    out[:, 2, 0], out[:, 2, 1], out[:, 2, 2] = 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)
    out[:, :3, :3] *= s[:, None, :]
    out[:, :3, 3], out[:, 3, 3] = t, 1.0
    return out


def from_columns(m: np.ndarray) -> np.ndarray:
    """Matrices (n, 4, 4) of 16 numbers each, column by column."""
    return m.reshape(-1, 4, 4).transpose(0, 2, 1)


def to_columns(m: np.ndarray) -> np.ndarray:
    """The 16 numbers of matrices (n, 4, 4), column by column."""
    return np.ascontiguousarray(m.transpose(0, 2, 1)).reshape(-1, 16)


def rows_of(lists: pa.ListArray, default: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as (n, len(default)), those of another length replaced by ``default``; and the length of each, 0 for null."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.tile(np.array(default), (len(lists), 1))
    fits = size == len(default)
    if fits.any():
        out[fits] = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(default))
    return out, size


#: What a node has where it gives nothing of its own.
NEUTRAL = {"t": [0.0, 0.0, 0.0], "r": [0.0, 0.0, 0.0, 1.0], "s": [1.0, 1.0, 1.0]}


def local_matrices(of: pa.StructArray) -> np.ndarray:
    """The own transforms of nodes (t, r, s, matrix): from translation, rotation and scale if any is given, else the matrix, else identity.

    A matrix without 16 numbers counts as none. Nodes without a field ``matrix`` have none.
    """
    parts, sizes = zip(*(rows_of(of.field(k), v) for k, v in NEUTRAL.items()))
    out = trs_matrices(*parts)
    if of.type.get_field_index("matrix") >= 0:
        matrix, size = rows_of(of.field("matrix"), IDENTITY)
        own = (size == 16) & ~np.any([n > 0 for n in sizes], axis=0)
        out[own] = from_columns(matrix[own])
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def trs_matrix(t: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
    """T·R·S as 16 numbers."""
    return pd.Series(list(to_columns(trs_matrices(*(np.array(c.tolist(), float) for c in (t, r, s))))))


def apply(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point through a matrix."""
    return tuple(m[i] * x + m[4 + i] * y + m[8 + i] * z + m[12 + i] for i in range(3))


def decompose_arrays(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Translations, unit quaternions (x, y, z, w) and scales of matrices (n, 16); shear and perspective are lost.

    A mirroring matrix has a negative scale along x. An axis without length keeps that of the identity.
    """
    m = from_columns(m)
    t, axes = m[:, :3, 3], m[:, :3, :3].copy()
    s = np.linalg.norm(axes, axis=1)
    s[np.linalg.det(axes) < 0, 0] *= -1
    with np.errstate(divide="ignore", invalid="ignore"):
        rot = np.where(s[:, None, :] != 0, axes / s[:, None, :], np.eye(3))
    # The largest of the four is computed first, which keeps the others exact.
    d = np.stack([rot[:, 0, 0], rot[:, 1, 1], rot[:, 2, 2]], axis=1)
    w2 = np.concatenate([1 + 2 * d - d.sum(axis=1, keepdims=True), 1 + d.sum(axis=1, keepdims=True)], axis=1)
    q = np.zeros((len(m), 4))
    for i, k in enumerate(np.argmax(w2, axis=1) if len(m) else ()):
        r, root = rot[i], np.sqrt(max(w2[i, k], 1e-30))
        pairs = {(0, 1): r[1, 0] + r[0, 1], (0, 2): r[0, 2] + r[2, 0], (1, 2): r[2, 1] + r[1, 2], (0, 3): r[2, 1] - r[1, 2], (1, 3): r[0, 2] - r[2, 0], (2, 3): r[1, 0] - r[0, 1]}
        for j in range(4):
            q[i, j] = root / 2 if j == k else pairs[min(j, k), max(j, k)] / (2 * root)
    return t, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30), s


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in "trs"]))
def decompose(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A matrix's translation, rotation and scale; branches per row make it a batched function."""
    for m in batches:
        t, r, s = decompose_arrays(np.array(m.tolist(), np.float64).reshape(-1, 16))
        yield pd.DataFrame({"t": list(t), "r": list(r), "s": list(s)})


def quantised(value: Column, step: float) -> Column:
    """A number in steps, halves away from zero."""
    return F.round(value.cast("double") / F.lit(step)).cast("long")


def quantised_floats(values: np.ndarray, step: float) -> np.ndarray:
    """Single-precision numbers in steps, divided in single precision as they are stored, halves away from zero."""
    v = np.asarray(values, np.float32) / np.float32(step)
    return np.sign(v) * np.floor(np.abs(v) + np.float32(0.5))
