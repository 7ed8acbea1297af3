"""Model files of any size, put together from parts that no task holds together.

Every file is a list of items: buffer views, accessors, images, samplers, textures,
materials, meshes, nodes. An item is JSON with gaps where it refers to others, which it names
by kind and digest of their content, so equal items of a file are one. Spark numbers the
items of each kind, adds up the lengths of what goes into the buffer, and fills the gaps by
joins; the pieces of a file then come to its writer in order, and each is written and
forgotten.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mosaiq.functions.transforms import decompose_arrays
from mosaiq.operators.layout import running_within
from mosaiq.operators.simplify import simplified
from mosaiq.operators.steps import bounded, written
from mosaiq.sources.gltf import BIN_CHUNK, INSTANCING, JSON_CHUNK, MAGIC, Gltf, Writer, parse, primitives_of, references
from mosaiq.sources.scenes import some

#: Lists of a model in the order in which they are written.
KINDS = ("accessors", "bufferViews", "images", "samplers", "textures", "materials", "meshes", "nodes")
_ITEM = "kind string, digest string, pieces array<string>, refs array<string>, extensions array<string>, data binary"
#: Placements of a mesh that are encoded together.
CHUNK = 4096


def gapped(doc: dict[str, Any], refs: list[tuple[dict[str, Any], str, str]]) -> tuple[list[str], list[str]]:
    """``doc`` as JSON in pieces around its references: (holder, key, "kind:digest") within it, in any order."""
    nonce = uuid.uuid4().hex  # nobody's name can look like it
    for i, (holder, key, _) in enumerate(refs):
        holder[key] = f"{nonce}{i:08d}"
    first, *rest = json.dumps(doc, separators=(",", ":")).split(f'"{nonce}')
    return [first, *(r[9:] for r in rest)], [refs[int(r[:8])][2] for r in rest]


def items_of(g: Gltf, salt: str) -> list[dict[str, Any]]:
    """All items of a model but its nodes and scenes; ``salt`` keeps its meshes apart from equal ones."""
    out, digests = [], {}

    def add(kind: str, ix: int, doc: dict[str, Any], data: bytes | None = None) -> None:
        doc = json.loads(json.dumps(doc))
        extensions = sorted(doc.get("extensions") or ())
        refs = [(holder, key, f"{of}:{digests[of, holder[key]]}") for holder, key, of in references(kind, doc)]
        pieces, names = gapped(doc, refs) if data is None else ([], [])
        text = json.dumps([kind, pieces, names, salt if kind == "meshes" else ""]).encode()
        digests[kind, ix] = digest = hashlib.sha256(text + b"\0" + (data or b"")).hexdigest()
        out.append({"kind": kind, "digest": digest, "pieces": pieces, "refs": names, "extensions": extensions, "data": data})

    for i, v in enumerate(g.items("bufferViews")):
        at = v.get("byteOffset", 0)
        add("bufferViews", i, {}, bytes(g.bin[at : at + v["byteLength"]]))
    for kind in ("accessors", "images", "samplers", "textures", "materials", "meshes"):
        for i, x in enumerate(g.items(kind)):
            add(kind, i, x)
    return out


def _geometry(members: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Items (by, mesh_key, mesh_name_, ...) of every mesh that an output draws; a file is parsed once for all of them."""
    meshes = members.select(*by, "mesh_key", "model_id", "mesh_ix", "ratio").distinct()
    wanted = meshes.groupBy("model_id").agg(F.collect_list(F.struct(*[F.col(k).alias(f"by{i}_") for i, k in enumerate(by)], "mesh_key", "mesh_ix", "ratio")).alias("wanted"))
    drawn = wanted.join(files.select("model_id", "content"), "model_id").select("content", "wanted")
    names = [*by, "mesh_key", "mesh_name_", "triangles", "kind", "digest", "pieces", "refs", "extensions", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in some(batches, 1):
            g, made = parse(bytes(b["content"].iat[0])), {}
            for r in b["wanted"].iat[0]:
                mesh, name = (r["mesh_ix"], r["ratio"]), g.items("meshes")[r["mesh_ix"]].get("name")
                if mesh not in made:
                    w = Writer()
                    own = [simplified(p, r["ratio"]) for p in primitives_of(g, r["mesh_ix"])]
                    w.mesh(own, name)
                    made = {mesh: (parse(w.finish()), sum(len(p.attributes.get("POSITION", ()) if p.indices is None else p.indices) // 3 for p in own))}  # one mesh at a time
                model, triangles = made[mesh]
                rows = [[*[r[f"by{i}_"] for i in range(len(by))], str(r["mesh_key"]), name, triangles, *x.values()] for x in items_of(model, str(r["mesh_key"]))]
                yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in members.select(*by).dtypes)
    return drawn.mapInPandas(run, f"{kinds}, mesh_key string, mesh_name_ string, triangles long, {_ITEM}")


def _node(name: str | None, t: Any = (), r: Any = (), s: Any = ()) -> dict[str, Any]:
    """A plain node's JSON; what is neutral isn't written."""
    out: dict[str, Any] = {"mesh": 0} | ({"name": name} if name else {})
    for key, value, neutral in (("translation", t, (0, 0, 0)), ("rotation", r, (0, 0, 0, 1)), ("scale", s, (1, 1, 1))):
        if len(value) and any(abs(a - b) > 1e-10 for a, b in zip(value, neutral)):
            out[key] = list(map(float, value))
    return out


def _plain_nodes(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, mesh_key, rank, pieces, refs): a node for each placement (by, mesh_key, digest, mesh_name_, first, rank, world)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                trs = decompose_arrays(np.array(b["world"].tolist(), float))
                made = [gapped(d := _node(n, *x), [(d, "mesh", f"meshes:{m}")]) for n, m, *x in zip(b["mesh_name_"], b["digest"], *trs)]
                yield b[[*by, "first", "mesh_key", "rank"]].assign(pieces=[p for p, _ in made], refs=[r for _, r in made])

    kinds = ", ".join(f"`{n}` {t}" for n, t in placed.select(*by).dtypes)
    return placed.select(*by, "first", "mesh_key", "rank", "mesh_name_", "digest", "world").mapInPandas(run, f"{kinds}, first array<int>, mesh_key string, rank long, pieces array<string>, refs array<string>")


def _instance_chunks(placed: DataFrame, by: list[str]) -> DataFrame:
    """(by, mesh_key, chunk, t, r, s, low, high, n): placements of a mesh in order, CHUNK at a time, as the bytes of three arrays, and the bounds of the first and last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in some(batches, 16):
            rows = []
            for at in b["at"]:
                t, r, s = (x.astype(np.float32) for x in decompose_arrays(np.array([x["world"] for x in at], float)))
                bounds = [f(x.min(axis=0).astype(float).tolist() + x.max(axis=0).astype(float).tolist()) for x, f in ((t, list), (s, list))]
                rows.append((t.tobytes(), r.tobytes(), s.tobytes(), *bounds, len(at)))
            yield pd.concat([b[[*by, "mesh_key", "chunk"]].reset_index(drop=True), pd.DataFrame(rows, columns=["t", "r", "s", "t_box", "s_box", "n"])], axis=1)

    grouped = placed.groupBy(*by, "mesh_key", F.floor(F.col("rank") / CHUNK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("rank", "world"))).alias("at"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in placed.select(*by).dtypes)
    return grouped.mapInPandas(run, f"{kinds}, mesh_key string, chunk long, t binary, r binary, s binary, t_box array<double>, s_box array<double>, n long")


def _instanced(chunks: DataFrame, meshes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items, data) of nodes with instances: three accessors and a node per mesh, and the bytes of their views by chunk."""
    box = lambda c: [(F.min if i < 3 else F.max)(F.col(c)[i]).alias(f"{c}{i}") for i in range(6)]
    per = chunks.groupBy(*by, "mesh_key").agg(F.sum("n").alias("n"), *box("t_box"), *box("s_box")).join(meshes, [*by, "mesh_key"])
    kinds = ", ".join(f"`{n}` {t}" for n, t in meshes.select(*by).dtypes)
    names = [*by, "first", "mesh_key", "kind", "digest", "pieces", "refs", "extensions"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                own = [r[k] for k in by]
                accessors = {}
                for part, kind, bounds in (("t", "VEC3", "t_box"), ("r", "VEC4", None), ("s", "VEC3", "s_box")):
                    doc: dict[str, Any] = {"bufferView": 0, "componentType": 5126, "count": int(r["n"]), "type": kind}
                    if bounds:
                        doc |= {"min": [r[f"{bounds}{i}"] for i in range(3)], "max": [r[f"{bounds}{i}"] for i in range(3, 6)]}
                    pieces, refs = gapped(doc, [(doc, "bufferView", f"bufferViews:{part}/{r['mesh_key']}")])
                    accessors[part] = f"{part}/{r['mesh_key']}"
                    rows.append([*own, None, None, "accessors", accessors[part], pieces, refs, []])
                node = _node(r["mesh_name_"])
                attributes = {"TRANSLATION": 0, "ROTATION": 0, "SCALE": 0}
                node["extensions"] = {INSTANCING: {"attributes": attributes}}
                pieces, refs = gapped(node, [(node, "mesh", f"meshes:{r['digest']}"), *[(attributes, k, f"accessors:{accessors[p]}") for k, p in zip(attributes, "trs")]])
                rows.append([*own, list(r["first"]), r["mesh_key"], "nodes", r["digest"], pieces, refs, [INSTANCING]])
            yield pd.DataFrame(rows, columns=names)

    items = per.mapInPandas(run, f"{kinds}, first array<int>, mesh_key string, kind string, digest string, pieces array<string>, refs array<string>, extensions array<string>")
    view = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{p}/"), F.col("mesh_key")).alias("digest"), F.col(p).alias("data")) for p in "trs"]))
    return items, chunks.select(*by, "chunk", view.alias("v")).select(*by, "v.digest", "chunk", "v.data")


def pieces_of(members: DataFrame, files: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces, counts): the bytes of a GLB per group of placements as rows (by, part, section, seq, data) in order, and counts (by, n_meshes, n_instances, grouped: placements of instanced meshes, stored and rendered: triangles).

    ``members`` has the ``by`` columns, whose names must be like no other here, mesh_key,
    model_id, mesh_ix (those of the mesh to draw, its group's representative), instanced, trav_ord and world; ``files`` model_id
    and content. A mesh that is instanced is one node with all its placements, else each
    placement is a node. A column ``ratio``, if there is one, says how many of a mesh's
    indices to keep. Geometry meets its file once; placements, which are most of the rows,
    are ranked and encoded apart from it.
    """
    bounded(members.sparkSession)
    members = members if "ratio" in members.columns else members.withColumn("ratio", F.lit(1.0))
    members = members.withColumn("mesh_key", F.col("mesh_key").cast("string"))
    members = written(members, "members")
    geometry = written(_geometry(members, files, by), "geometry")
    first = members.groupBy(*by, "mesh_key").agg(F.min("trav_ord").alias("first"), F.max("instanced").alias("instanced"), F.count(F.lit(1)).alias("n"))
    meshes = written(geometry.filter("kind = 'meshes'").select(*by, "mesh_key", "mesh_name_", "triangles", "digest").join(first, [*by, "mesh_key"]), "meshes")
    ranked = running_within(members.select(*by, "mesh_key", "instanced", "trav_ord", "world"), [*by, "mesh_key"], ["trav_ord", "world"], F.lit(1).cast("long"), "rank")
    plain = _plain_nodes(ranked.filter("NOT instanced").join(meshes.select(*by, "mesh_key", "mesh_name_", "digest", "first"), [*by, "mesh_key"]), by)
    chunks = written(_instance_chunks(ranked.filter("instanced"), by), "chunks")
    own, chunk_data = _instanced(chunks, meshes.drop("n", "instanced", "triangles"), by)

    # All items with what orders them within their kind; equal ones once.
    none = lambda kind: F.lit(None).cast(kind)
    shaped = lambda df, first, second, rank, digest: df.select(*by, "kind", first.alias("o1"), second.alias("o2"), rank.alias("o3"), digest.alias("digest"), "pieces", "refs", "extensions")
    c = F.col
    shared = geometry.filter("kind <> 'meshes'").dropDuplicates([*by, "kind", "digest"])
    items = shaped(shared.filter("kind <> 'bufferViews'"), none("array<int>"), c("digest"), none("long"), c("digest"))
    mesh_items = geometry.filter("kind = 'meshes'").join(meshes.select(*by, "mesh_key", "first"), [*by, "mesh_key"])
    items = items.unionByName(shaped(mesh_items, c("first"), c("mesh_key"), none("long"), c("digest")))
    items = items.unionByName(shaped(own, c("first"), F.coalesce("mesh_key", "digest"), none("long"), F.when(c("kind") == "accessors", c("digest"))))
    items = items.unionByName(shaped(plain.withColumns({"kind": F.lit("nodes"), "extensions": F.array().cast("array<string>")}), c("first"), c("mesh_key"), c("rank"), none("string")))
    items = written(items, "items")
    data = shared.filter("kind = 'bufferViews'").select(*by, "digest", F.lit(0).cast("long").alias("chunk"), "data").unionByName(chunk_data)
    data = written(data, "data")

    lengths = data.groupBy(*by, "digest").agg(F.sum(F.octet_length("data")).cast("long").alias("length"))
    views = written(running_within(lengths, by, ["digest"], (F.ceil(c("length") / 4) * 4).cast("long"), "offset"), "views")
    view_items = views.select(*by, F.lit("bufferViews").alias("kind"), none("array<int>").alias("o1"), c("digest").alias("o2"), none("long").alias("o3"), "digest", F.array(F.format_string('{"buffer":0,"byteOffset":%d,"byteLength":%d}', "offset", "length")).alias("pieces"), F.array().cast("array<string>").alias("refs"), F.array().cast("array<string>").alias("extensions"))
    numbered = written(running_within(items.unionByName(view_items), [*by, "kind"], ["o1", "o2", "o3"], F.lit(1).cast("long"), "number"), "numbered")
    texts = _filled(numbered, by)
    pieces = _laid_out(texts, numbered, views, data, by)
    total = lambda v, n: F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(n)
    counts = meshes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_meshes"), total(c("n"), "n_instances"), total(F.when(c("instanced"), c("n")), "grouped"), total(c("triangles"), "stored"), total(c("triangles") * c("n"), "rendered"))
    return pieces, counts


def _filled(numbered: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, number, text): the items' JSON with the numbers of what they refer to."""
    named = numbered.filter("digest IS NOT NULL").select(*by, F.concat_ws(":", "kind", "digest").alias("ref"), F.col("number").alias("to"))
    gaps = numbered.select(*by, "kind", "number", F.posexplode("refs").alias("i", "ref")).join(named, [*by, "ref"])
    found = gaps.groupBy(*by, "kind", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda x: x["to"]).alias("to"))
    df = numbered.select(*by, "kind", "number", "pieces").join(found, [*by, "kind", "number"], "left")
    to = F.coalesce("to", F.array().cast("array<bigint>"))
    text = F.array_join(F.zip_with("pieces", F.transform(to, lambda x: x.cast("string")), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return df.select(*by, "kind", "number", text.alias("text"))


#: Behind all others of its section.
_LAST = 1 << 62


def _laid_out(texts: DataFrame, numbered: DataFrame, views: DataFrame, data: DataFrame, by: list[str]) -> DataFrame:
    """The pieces of each file: header, JSON, header of the buffer, buffer."""
    at = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind")) * 3
    comma = F.when(F.col("number") > 0, ",").otherwise("")
    row = lambda df, section, seq, text: df.select(*by, section.alias("section"), seq.cast("long").alias("seq"), text.alias("text"))
    zero, files, lists = F.lit(0), texts.select(*by).distinct(), texts.select(*by, "kind").distinct()
    extensions = numbered.select(*by, F.explode("extensions").alias("e")).groupBy(*by).agg(F.sort_array(F.collect_set("e")).alias("e"))
    aligned = (F.ceil(F.col("length") / 4) * 4).cast("long")
    size = views.groupBy(*by).agg(F.max(F.col("offset") + aligned).alias("size"))
    ends = files.join(extensions, by, "left").join(size, by, "left")
    required = F.when(F.array_contains("e", INSTANCING), f',"extensionsRequired":["{INSTANCING}"]').otherwise("")
    end = F.concat(F.when(F.col("size") > 0, F.format_string(',"buffers":[{"byteLength":%d}]', "size")).otherwise(""), F.when(F.size("e") > 0, F.concat(F.lit(',"extensionsUsed":'), F.to_json("e"), required)).otherwise(""), F.lit("}"))
    nodes = numbered.filter("kind = 'nodes'")
    rows = [
        row(files, zero, zero, F.lit('{"asset":{"version":"2.0","generator":"mosaiq"},"scene":0,"scenes":[{"nodes":[')),
        row(nodes, zero, F.col("number") + 1, F.concat(comma, F.col("number").cast("string"))),
        row(files, zero, F.lit(_LAST), F.lit("]}]")),
        row(lists, at + 1, zero, F.concat(F.lit(',"'), "kind", F.lit('":['))),
        row(texts, at + 2, F.col("number"), F.concat(comma, "text")),
        row(lists, at + 3, zero, F.lit("]")),
        row(ends, F.lit(3 * len(KINDS) + 1), zero, end),
    ]
    json_ = written(reduce(DataFrame.unionByName, rows), "json")
    whole = json_.groupBy(*by).agg(F.sum(F.octet_length("text")).cast("long").alias("json")).join(size, by, "left")
    whole = whole.withColumns({"size": F.coalesce("size", F.lit(0).cast("long")), "pad": F.pmod(-F.col("json"), F.lit(4)).cast("int")})

    def little(*values: Column | int) -> Column:
        """Numbers as four bytes each, the lowest first."""
        hexed = [F.lpad(F.hex(v if isinstance(v, Column) else F.lit(v)), 8, "0") for v in values]
        return F.unhex(F.concat(*[F.substring(h, k, 2) for h in hexed for k in (7, 5, 3, 1)]))

    text = F.col("json") + F.col("pad")
    total = 12 + 8 + text + F.when(F.col("size") > 0, F.col("size") + 8).otherwise(0)
    piece = lambda df, part, section, seq, sub, value: df.select(*by, F.lit(part).alias("part"), section.alias("section"), seq.cast("long").alias("seq"), sub.cast("long").alias("sub"), value.alias("data"))
    body = data.join(views.select(*by, "digest", "offset"), [*by, "digest"])
    zeros = F.unhex(F.expr("repeat('00', CAST(pmod(-length, 4) AS INT))"))
    return reduce(DataFrame.unionByName, [
        piece(whole, 0, zero, zero, zero, little(MAGIC, 2, total, text, JSON_CHUNK)),
        piece(json_, 1, F.col("section"), F.col("seq"), zero, F.col("text").cast("binary")),
        piece(whole, 1, F.lit(3 * len(KINDS) + 2), zero, zero, F.expr("repeat(' ', pad)").cast("binary")),
        piece(whole.filter("size > 0"), 2, zero, zero, zero, little(F.col("size"), BIN_CHUNK)),
        piece(body, 3, zero, F.col("offset"), F.col("chunk"), F.col("data")),
        piece(views.filter("length % 4 <> 0"), 3, zero, F.col("offset"), F.lit(_LAST), zeros),
    ])


def _in_order(pieces: DataFrame, by: list[str]) -> DataFrame:
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, *by).sortWithinPartitions(*by, "part", "section", "seq", "sub").select(*by, "part", "data")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Any] | None, bytes]]:
    """(key, b"") where a file begins, then (None, bytes) for each of its pieces; files stand one behind another."""
    now = None
    for b in batches:
        for *key, part, data in zip(*(c.to_pylist() for c in b.columns)):
            if part == 0:
                now = key
                yield now, b""
            yield None, data


def write_models(members: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by, glb) and the counts of ``pieces_of``: the models as values, for files that a row can hold."""
    inner = [f"__by{i}" for i in range(len(by))]  # whatever the columns are called
    pieces, counts = pieces_of(members.withColumnsRenamed(dict(zip(by, inner))), files, inner)
    schema = T.StructType([*pieces.select(*inner).schema, T.StructField("glb", T.BinaryType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, body = None, []
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(kinds.names, [*of, b"".join(body)]))], kinds)
        for key, data in _streams(batches):
            if key is not None:
                if of is not None:
                    yield row()
                of, body = key, []
            body.append(data)
        if of is not None:
            yield row()

    return _in_order(pieces, inner).mapInArrow(run, schema).join(counts, inner).withColumnsRenamed(dict(zip(inner, by)))


def save_models(members: DataFrame, files: DataFrame, folder: str, name: Column) -> DataFrame:
    """Write the models as files, one for each value of ``name``, an expression of the members' columns; (name, uri, size) and the counts of ``pieces_of``.

    Each file is one stream, of which its task holds a piece at a time, to a store that all
    machines share. It is written under another name and moved when it is whole, so a
    repeated task leaves the same file.
    """
    pieces, counts = pieces_of(members.withColumn("__name", name), files, ["__name"])
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("size", T.LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        of, out, part, size = None, None, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            where.move(part, f"{base}/{of}")
            return pa.RecordBatch.from_pylist([{"name": of, "uri": f"{folder}/{of}", "size": size}], kinds)

        for key, data in _streams(batches):
            if key is not None:
                if out is not None:
                    yield done()
                (of,), part, size = key, f"{base}/.{uuid.uuid4().hex}", 0
                out = where.open_output_stream(part)
            out.write(data)
            size += len(data)
        if out is not None:
            yield done()

    return _in_order(pieces, ["__name"]).mapInArrow(run, schema).join(counts.withColumnRenamed("__name", "name"), "name")
