"""GLB files as tables: models, nodes, primitives, placements.

Files are found and read by Spark (``binaryFile``) and parsed in one pass, a row per file
with nested arrays. The parse is opaque to Catalyst, so write its result as Parquet before
querying it: the tables below are then plain projections with column pruning.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from posixpath import dirname, normpath
from typing import Any
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mosaiq.functions import transforms
from mosaiq.functions.boxes import Box
from mosaiq.functions.signatures import EXACT
from mosaiq.operators.layout import numbered
from mosaiq.operators.steps import bounded
from mosaiq.sources.gltf import INSTANCING, Gltf, GltfError, buffer_uris, gathered, parse, roots_of

_ATTR = "array<struct<name: string, type: string, ctype: int, norm: boolean, hash: string, near_hash: string>>"
_SCHEMA = f"""path string, length long, file_hash string, error string,
nodes array<struct<node_ix: int, parent_ix: int, child_ord: int, root_ord: int, name: string, mesh_ix: int, t: array<double>, r: array<double>, s: array<double>, matrix: array<double>,
  instanced: boolean, visits: int, instances: array<struct<t: array<double>, r: array<double>, s: array<double>>>>>,
primitives array<struct<mesh_ix: int, mesh_name: string, prim_ix: int, material: int, mode: int, n_vertices: long, n_indices: long, index_hash: string,
  attrs: {_ATTR}, morphs: {_ATTR}, min_x: double, min_y: double, min_z: double, max_x: double, max_y: double, max_z: double>>,
extensions array<string>, n_meshes int"""


def find(spark: SparkSession, folder: str, suffixes: str = "*.[gG][lL][bB]") -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffixes).load(folder).select("path", "length", "content")


def beside(path: str, uri: str) -> str:
    """The path that a file at ``path`` means by ``uri``."""
    # Only the part behind the store's name is a path whose dots mean something.
    store, rest = re.match(r"((?:[a-z][a-z0-9+.-]*:(?://[^/]*)?)?)(.*)", path).groups()
    return uri if ":" in uri else store + normpath(f"{dirname(rest)}/{uri}")


def documents(spark: SparkSession, folder: str, buffers: str = "*.bin") -> DataFrame:
    """(path, length, content, error) of the ``.gltf`` documents below a folder, each with its buffers as one GLB.

    Buffers are in the document itself or in files below the folder whose names match
    ``buffers``; they meet the documents that name them in a join, one file as often as it
    is named. A document without one of its buffers has an error and is left as it is.
    """
    docs = find(spark, folder, "*.gltf")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    uris = buffer_uris(json.loads(content))
                except (ValueError, AttributeError, TypeError):
                    continue
                rows += [(path, i, beside(path, unquote(u))) for i, u in enumerate(uris) if u is not None and not u.startswith("data:")]
            yield pd.DataFrame(rows, columns=["path", "ix", "buffer"]).astype({"ix": "int32"})

    wanted = docs.select("path", "content").mapInPandas(named, "path string, ix int, buffer string")
    found = wanted.join(find(spark, folder, buffers).select(F.col("path").alias("buffer"), F.col("content").alias("bytes")), "buffer")
    parts = found.groupBy("path").agg(F.collect_list(F.struct("ix", "bytes")).alias("parts"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in some(batches, 1):
            content, parts, error = bytes(b["content"].iat[0]), b["parts"].iat[0], None
            try:
                content = gathered(json.loads(content), b"", {p["ix"]: bytes(p["bytes"]) for p in (parts if parts is not None else [])})
            except (GltfError, ValueError, AttributeError, TypeError, KeyError) as e:
                error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"path": [b["path"].iat[0]], "length": [len(content)], "content": [content], "error": [error]})

    return docs.join(parts, "path", "left").select("path", "content", "parts").mapInPandas(gather, "path string, length long, content binary, error string")


def referenced(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of models that ``*tileset.json`` files below a folder name, each once, whether they are there or not."""
    tilesets = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*tileset*.json").load(folder).select("path", "content")

    def walk(x: Any) -> Iterator[str]:
        if isinstance(x, list):
            for v in x:
                yield from walk(v)
        elif isinstance(x, dict):
            for k, v in x.items():
                if k in ("uri", "url"):
                    if isinstance(v, str) and v.endswith((".glb", ".gltf")):
                        yield v
                else:
                    yield from walk(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    found = list(walk(json.loads(content)))
                except ValueError:
                    continue
                out += [beside(path, u) for u in found]
            yield pd.DataFrame({"path": out}, dtype=object)

    return tilesets.mapInPandas(run, "path string").distinct()


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder and those its tilesets name, each once; names without a file are left out."""
    files = find(spark, folder).withColumn("error", F.lit(None).cast("string")).unionByName(documents(spark, folder))
    named = referenced(spark, folder).join(files.select("path"), "path", "left_anti")
    more = [r.path for r in named.toLocalIterator()]  # only names of files outside the folder
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in more if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    return files.unionByName(spark.read.format("binaryFile").load(there).select("path", "length", "content"), allowMissingColumns=True) if there else files


def _attribute(g: Gltf, name: str, ix: int, step: float = 0.0) -> dict[str, Any]:
    """An attribute's description and the hash of its data; ``near_hash``, for normals, of its data in steps."""
    a, data = g.items("accessors")[ix], g.accessor(ix)
    out = {"name": name, "type": a["type"], "ctype": a["componentType"], "norm": bool(a.get("normalized")), "hash": hashlib.sha256(data.tobytes()).hexdigest(), "near_hash": None}
    if name == "NORMAL" and step > EXACT and (out["type"], out["ctype"]) == ("VEC3", 5126):
        # Adding zero makes of a negative zero a positive one.
        out["near_hash"] = hashlib.sha256((transforms.quantised_floats(data, step) + np.float32(0)).tobytes()).hexdigest()
    return out


def _primitive(g: Gltf, mesh_ix: int, prim_ix: int, step: float) -> dict[str, Any]:
    mesh = g.items("meshes")[mesh_ix]
    p = mesh["primitives"][prim_ix]
    attrs = p.get("attributes", {})
    out: dict[str, Any] = {"mesh_ix": mesh_ix, "mesh_name": mesh.get("name"), "prim_ix": prim_ix, "material": p.get("material"), "mode": p.get("mode", 4)}
    out["attrs"] = [_attribute(g, k, v, step) for k, v in sorted(attrs.items())]
    out["morphs"] = [_attribute(g, f"{i}:{k}", v) for i, t in enumerate(p.get("targets", [])) for k, v in sorted(t.items())]
    position = g.items("accessors")[attrs["POSITION"]] if "POSITION" in attrs else None
    out["n_vertices"] = position["count"] if position else None
    out["n_indices"] = g.items("accessors")[p["indices"]]["count"] if "indices" in p else None
    out["index_hash"] = _attribute(g, "", p["indices"])["hash"] if "indices" in p else None
    low, high = (position.get("min") or [], position.get("max") or []) if position else ([], [])
    if position and (len(low) < 3 or len(high) < 3) and position["count"]:
        v = g.accessor(attrs["POSITION"]).astype(float)
        low, high = v.min(axis=0), v.max(axis=0)
    ok = len(low) >= 3 and len(high) >= 3 and all(a <= b for a, b in zip(low, high))
    for i, a in enumerate("xyz"):
        out[f"min_{a}"], out[f"max_{a}"] = (float(low[i]), float(high[i])) if ok else (None, None)
    return out


def _instances(g: Gltf, node: dict[str, Any]) -> list[dict[str, list[float]]] | None:
    ext = (node.get("extensions") or {}).get(INSTANCING)
    if ext is None:
        return None
    of = ext.get("attributes", {})
    arrays = {k: g.accessor(of[n]).astype(float) for k, n in (("t", "TRANSLATION"), ("r", "ROTATION"), ("s", "SCALE")) if n in of}
    count = max(map(len, arrays.values()), default=0)
    return [{k: arrays[k][i].tolist() if k in arrays and i < len(arrays[k]) else v for k, v in transforms.NEUTRAL.items()} for i in range(count)]


def _visits(nodes: list[dict[str, Any]], roots: list[int]) -> list[int]:
    """How often a walk from ``roots`` comes to each node."""
    out, todo = [0] * len(nodes), list(roots)
    while todo:
        i = todo.pop()
        out[i] += 1
        if out[i] > len(nodes):
            raise GltfError("the nodes form a cycle")
        todo += [c for c in nodes[i].get("children", []) if 0 <= c < len(nodes)]
    return out


def describe(data: bytes, step: float = 0.0) -> dict[str, Any]:
    """A file's nodes, primitives and extensions; nodes have their parent, for roots their place in the scene, and how often a walk of the default scene comes to them."""
    g = parse(data)
    nodes = g.items("nodes")
    parent = {ch: (i, k) for i, n in enumerate(nodes) for k, ch in enumerate(n.get("children", []))}
    order = {r: i for i, r in enumerate(roots_of(g))}
    visits = _visits(nodes, list(order))
    scenes, at = g.items("scenes"), g.json.get("scene", 0)
    shown = [r for r in (scenes[at].get("nodes", []) if 0 <= at < len(scenes) else []) if 0 <= r < len(nodes)]
    visits = visits if shown == list(order) else _visits(nodes, shown)
    meshes = g.items("meshes")
    rows = []
    for i, n in enumerate(nodes):
        inst = _instances(g, n)
        mesh = n.get("mesh")
        up, ord_ = parent.get(i, (None, None))
        rows.append({
            "node_ix": i, "parent_ix": up, "child_ord": ord_, "root_ord": order.get(i), "name": n.get("name"), "mesh_ix": mesh if mesh is not None and mesh < len(meshes) else None,
            "t": n.get("translation"), "r": n.get("rotation"), "s": n.get("scale"), "matrix": n.get("matrix"), "instanced": inst is not None, "visits": visits[i], "instances": inst,
        })
    prims = [_primitive(g, m, p, step) for m, mesh in enumerate(meshes) for p in range(len(mesh.get("primitives", [])))]
    return {"nodes": rows, "primitives": prims, "extensions": sorted(g.json.get("extensionsUsed") or []), "n_meshes": len(meshes)}


def some(batches: Iterator[pd.DataFrame], rows: int = 4) -> Iterator[pd.DataFrame]:
    """Batches cut into parts of a few rows, as each holds a file's bytes."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def read_scenes(files: DataFrame, normal_tolerance: float = 0.0) -> DataFrame:
    """One row per file: path, length, file_hash, error, nodes, primitives, extensions, n_meshes. An unreadable file has an error and nulls.

    ``files`` may say by ``error`` that a file is unreadable already.
    With a tolerance normals are also hashed in steps of it, for signatures with a tolerance.
    """
    schema = T._parse_datatype_string(_SCHEMA)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, length, content, error in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            row = dict.fromkeys(kinds.names) | {"path": path, "length": length, "file_hash": hashlib.sha256(content).hexdigest(), "error": error}
            try:
                row |= {} if error else describe(content, normal_tolerance)
            except (GltfError, KeyError, IndexError, TypeError, ValueError) as e:
                row["error"] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([row], kinds)

    bounded(files.sparkSession)
    error = "error" if "error" in files.columns else F.lit(None).cast("string").alias("error")
    return files.select("path", "length", "content", error).mapInArrow(run, schema)


def models(scenes: DataFrame) -> DataFrame:
    """Readable files numbered from 0 by path."""
    return numbered(scenes.filter("error IS NULL"), ["path"], "model_id")


def nodes(models_: DataFrame) -> DataFrame:
    return models_.select("model_id", F.explode("nodes").alias("n")).select("model_id", "n.*")


def primitives(models_: DataFrame) -> DataFrame:
    return models_.select("model_id", F.explode("primitives").alias("p")).select("model_id", "p.*")


def mesh_boxes(prims: DataFrame) -> DataFrame:
    return prims.groupBy("model_id", "mesh_ix").agg(*Box.named().union())


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + count[i] - 1 of all i, one after another."""
    return np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)


def _before(sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The sum of the sizes before each within its group; groups are runs of equal numbers."""
    total = np.cumsum(sizes) - sizes
    first = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    return total - np.maximum.accumulate(np.where(first, total, 0)) if len(group) else total


def _walk(row: np.ndarray, base: np.ndarray, flat: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, order, world) of every visit of a walk through the nodes of several files.

    ``row`` is the file of each node and ``base`` the place of a file's first node. All
    files go down one level at a time; the order within a file, a node before its children,
    follows from the sizes of the parts below each visit.
    """
    number = lambda name: pc.fill_null(flat.field(name), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    root_ord, up = number("root_ord"), number("parent_ix")
    parent = np.where(up >= 0, base[row] + up, -1)
    children = np.lexsort((number("child_ord"), parent))
    begin, end = (np.searchsorted(parent[children], np.arange(len(row)), side) for side in ("left", "right"))
    local = transforms.local_matrices(flat)
    roots = np.flatnonzero(root_ord >= 0)
    roots = roots[np.lexsort((root_ord[roots], row[roots]))]
    waves, worlds, above = [roots], [local[roots]], [row[roots]]
    while len(waves[-1]):
        if len(waves) > len(row) + 1:
            raise GltfError("the nodes form a cycle")
        now = waves[-1]
        count = end[now] - begin[now]
        down = children[_spread(begin[now], count)]
        waves.append(down)
        above.append(np.repeat(np.arange(len(now)), count))
        worlds.append(worlds[-1][above[-1]] @ local[down])
    sizes = [np.ones(len(w), np.int64) for w in waves]
    for k in range(len(waves) - 1, 0, -1):
        np.add.at(sizes[k - 1], above[k], sizes[k])
    order = [_before(sizes[0], above[0])]
    for k in range(1, len(waves)):
        order.append(order[-1][above[k]] + 1 + _before(sizes[k], above[k]))
    return np.concatenate(waves), np.concatenate(order), np.concatenate(worlds)


def _placed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The placements of a few files (model_id, nodes)."""
    lists = batch.column("nodes")
    flat, count = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, base = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    node, order, world = _walk(row, base, flat)
    ids, node_ix, mesh = batch.column("model_id"), flat.field("node_ix"), flat.field("mesh_ix")
    instanced = pc.fill_null(flat.field("instanced"), False).to_numpy(zero_copy_only=False)
    drawn = pc.is_valid(mesh).to_numpy(zero_copy_only=False)[node]

    def out(at: np.ndarray, worlds: np.ndarray, ord_: pa.Array, ext: bool) -> pa.RecordBatch:
        own = pa.array(node[at])
        matrices = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * 16, pa.array(transforms.to_columns(worlds).ravel()))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row[node[at]])), node_ix.take(own), mesh.take(own), ord_, pa.array(np.full(len(at), ext)), matrices], ["model_id", "node_ix", "mesh_ix", "trav_ord", "is_ext", "world"])

    plain = np.flatnonzero(drawn & ~instanced[node])
    lists_of = lambda width, *cols: pa.ListArray.from_arrays(np.arange(len(cols[0]) + 1, dtype=np.int32) * width, pa.array(np.stack(cols, axis=1).astype(np.int32).ravel()))
    for at in np.array_split(plain, len(plain) // PLACED + 1):
        yield out(at, world[at], lists_of(1, order[at]), False)
    own = flat.field("instances")
    begin = own.offsets.to_numpy()[:-1].astype(np.int64)
    number = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    visits = np.flatnonzero(drawn & instanced[node])
    each = np.repeat(visits, number[node[visits]])
    of = _spread(begin[node[visits]], number[node[visits]])
    for k in range(0, len(each), PLACED):
        at, item = each[k : k + PLACED], of[k : k + PLACED]
        inner = transforms.local_matrices(own.values.take(pa.array(item)))
        yield out(at, world[at] @ inner, lists_of(2, order[at], item - begin[node[at]]), True)


#: Placements to a batch, and nodes of files that are walked together (a larger file by itself).
PLACED, TOGETHER = 1 << 14, 1 << 16


def placements(models_: DataFrame) -> DataFrame:
    """(model_id, node_ix, mesh_ix, trav_ord, is_ext, world): every placed mesh with its column-major matrix.

    Nodes come in the order of a walk from the scene's roots, a node before its children;
    instances of a node by their number, each behind the node's own matrix. ``trav_ord``
    is an array that sorts in that order: a node's place in the walk, and for instances
    their number. A file's nodes are one row, so its walk needs no shuffle, however deep
    it is; a node's ``node_ix`` is its place in that row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, total = 0, 0
            for i, n in enumerate(pc.fill_null(pc.list_value_length(b.column("nodes")), 0).to_pylist()):
                if total and total + n > TOGETHER:
                    yield from _placed(b.slice(begin, i - begin))
                    begin, total = i, 0
                total += n
            yield from _placed(b.slice(begin))

    bounded(models_.sparkSession)
    kind = dict(models_.dtypes)["model_id"]
    return models_.select("model_id", "nodes").mapInArrow(run, f"model_id {kind}, node_ix int, mesh_ix int, trav_ord array<int>, is_ext boolean, world array<double>")


def scene_box(placed: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """The box around all placements of a group, from the boxes of their meshes."""
    df = placed.join(boxes, ["model_id", "mesh_ix"])
    return df.select(*by, *Box.named().moved(F.col("world")).columns()).groupBy(*by).agg(*Box.named().union())


def vertex_counts(prims: DataFrame) -> DataFrame:
    return prims.groupBy("model_id", "mesh_ix").agg(F.sum("n_vertices").alias("n_vertices"))
