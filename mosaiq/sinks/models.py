"""Merged models, segments, proxies, and files that executors write."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.sources.gltf import Node, Writer, cube, merged, parse


def sanitised(name: Column) -> Column:
    """A name as a file can bear it."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")


def merge_models(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, glb, n_models): the models (path, content) of a group as one, in the order of their paths."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("path")
        glb = merged([parse(bytes(c)) for c in group["content"]])
        return pd.DataFrame({k: [group[k].iloc[0]] for k in by} | {"glb": [glb], "n_models": [len(group)]})

    kinds = ", ".join(f"`{n}` {t}" for n, t in files.select(*by).dtypes)
    return files.select(*by, "path", "content").groupBy(*by).applyInPandas(build, f"{kinds}, glb binary, n_models long")


def segments(placed: DataFrame, names: DataFrame) -> DataFrame:
    """Rows for ``assembly`` with ``file_name``, one per mesh with all of its placements; names carry the mesh's number, so none overwrites another."""
    file_name = F.concat(F.col("stem"), F.lit("_"), sanitised(F.coalesce("mesh_name", F.lit("mesh"))), F.lit("_"), F.col("mesh_ix").cast("string"), F.lit(".glb"))
    df = placed.join(names.select("model_id", "mesh_ix", file_name.alias("file_name")), ["model_id", "mesh_ix"])
    return df.select("file_name", F.concat_ws("_", "model_id", "mesh_ix").alias("mesh_key"), "model_id", "mesh_ix", F.lit(False).alias("instanced"), "trav_ord", "world")


def proxy_model(boxes: list[tuple[list[float], list[float]]], name: str = "LOD1_Proxy_Cube") -> bytes:
    """A GLB of unit cubes, one per (center, extent)."""
    w = Writer()
    mesh = w.mesh([cube()], name)
    w.node(Node(mesh, instances=[(tuple(c), (0.0, 0.0, 0.0, 1.0), tuple(e)) for c, e in boxes], name=name))
    return w.finish()


def save(models: DataFrame, folder: str, name: str) -> DataFrame:
    """Write every ``glb`` as a file called by column ``name``; (name, uri, size) of those written.

    Executors write them to a store that all machines share. A file is written whole under
    another name and then moved, so a repeated task leaves the same file.
    """
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for b in batches:
            rows = []
            for file_name, glb in zip(b[name], b["glb"]):
                part = f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(bytes(glb))
                where.move(part, f"{base}/{file_name}")
                rows.append((file_name, f"{folder}/{file_name}", len(glb)))
            yield pd.DataFrame(rows, columns=["name", "uri", "size"])

    return models.select(name, "glb").mapInPandas(run, "name string, uri string, size long")
