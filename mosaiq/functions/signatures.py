"""Signatures of geometry: digests of a canonical text of all that must agree.

Digests of 256 bits stand for the whole key, so groups never merge by accident.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Under this tolerance positions and normals are compared exactly.
EXACT = 1e-9


def digest(*parts: Column) -> Column:
    """SHA-256 of parts in order; null and empty differ, and no part runs into the next."""
    texts = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def _listed(items: Column) -> Column:
    return F.to_json(F.array_sort(items))


def primitive_signatures(primitives: DataFrame, tolerance: float = 0.0, skip: tuple[str, ...] = ()) -> DataFrame:
    """``primitives`` with ``signature``.

    Columns: material, mode, n_vertices, n_indices, index_hash, attrs ARRAY<STRUCT<name,
    type, ctype, norm, hash, near_hash>>, morphs of the same kind. Exact: everything counts.
    With a tolerance the positions and the attributes of ``skip`` count by their names alone
    and indices by their number, as boxes are compared afterwards; normals count in steps
    where they were read with a tolerance of their own.
    """
    none = F.lit("-")
    common = [F.coalesce(F.col("material"), F.lit(-1)), F.col("mode")]
    bare = lambda items: F.transform(items, lambda a: F.struct(*[a[n].alias(n) for n in ("name", "type", "ctype", "norm", "hash")]))
    exact, morphs = bare("attrs"), _listed(bare("morphs"))
    if tolerance <= EXACT:
        parts = [*common, F.coalesce("index_hash", none), F.coalesce("n_indices", F.lit(0)), _listed(exact), morphs]
    else:
        loose = ["POSITION", *skip]
        attrs = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), F.when(a["name"].isin(loose), none).otherwise(F.coalesce(a["near_hash"], a["hash"])).alias("hash")))
        parts = [*common, F.coalesce("n_vertices", F.lit(-1)), F.coalesce("n_indices", F.lit(0)), _listed(attrs), morphs]
    return primitives.withColumn("signature", digest(*parts))


def mesh_signatures(primitives: DataFrame, mesh: tuple[str, ...] = ("model_id", "mesh_ix"), order: str = "prim_ix") -> DataFrame:
    """One signature per mesh from those of its primitives in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, "signature")))
    return primitives.groupBy(*mesh).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["signature"]), "|"), 256).alias("signature"))
