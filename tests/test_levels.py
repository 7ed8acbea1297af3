import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mosaiq.plans import levels
from mosaiq.sinks import assembly, tilesets
from mosaiq.sources import scenes
from mosaiq.sources.gltf import Node, Primitive, Writer, pack, parse, primitives_of
from tests.test_small import grid


def model(n=20, places=3):
    v, ix = grid(n, lambda x, y: ((x * 7 + y * 3) % 5) * 0.1)
    w = Writer()
    w.mesh([Primitive({"POSITION": v.astype(np.float32), "NORMAL": np.tile(np.float32([0, 0, 1]), (len(v), 1))}, ix.astype(np.uint16))], "hills")
    for i in range(places):
        w.node(Node(0, (40.0 * i, 0.0, 40.0 * (i % 2))))
    return w.finish()


def files(spark, **of):
    return spark.createDataFrame([(k, len(b), bytearray(b)) for k, b in of.items()], "path string, length long, content binary")


def test_levels_of_a_model(spark):
    out = {r.level: r for r in levels.level_models(files(spark, a=model(), bad=b"x")).collect()}
    assert sorted(out) == [0, 1, 2, 3] and bytes(out[0].glb) == model()
    assert all(out[i].triangles > out[i + 1].triangles for i in range(3)) and [out[i].error for i in range(4)] == [0, 16, 32, 64]
    p = primitives_of(parse(bytes(out[2].glb)), 0)[0]
    assert len(p.indices) // 3 == out[2].triangles <= 0.25 * out[0].triangles + 1 and set(p.attributes) == {"POSITION", "NORMAL"}
    report = {r.level: r for r in levels.level_report(levels.level_models(files(spark, a=model()))).collect()}
    assert report[0].triangle_reduction == 0.0 and report[1].triangle_reduction >= 49.9
    assert json.loads(levels.level_tileset([("l0", 0.0), ("l1", 16.0)]))["root"]["content"]["uri"] == "l1"


def test_reports_of_levels_wait_for_no_models(spark, monkeypatch):
    made, real = [], levels.write_models
    monkeypatch.setattr(levels, "write_models", lambda *of: made.append(1) or real(*of))
    (one,) = levels.instanced_levels(levels.level_models(files(spark, a=model(n=8, places=2)), 1, least=30), 1)
    assert one.report.first().final_instances == 2 and not made
    assert one.models is one.models and made == [1]


def test_the_first_level_is_not_written_anew(spark, monkeypatch):
    finished, real, run = [], Writer.finish, []
    monkeypatch.setattr(Writer, "finish", lambda w: finished.append(1) or real(w))

    class Files:
        sparkSession = spark

        def select(self, *of):
            return self

        def mapInArrow(self, f, schema):
            run.append(f)

    levels.level_models(Files(), 2)
    good = model()
    # A view that reaches beyond its buffer, and indices beyond the vertices: these can be copied, but not simplified.
    short, odd = parse(good), parse(good)
    short.bin = short.bin[:16]
    odd.bin = odd.bin[:-40] + b"\xff\x7f" * 20
    finished.clear()
    contents = {"good": good, "short": pack(short.json, short.bin), "odd": pack(odd.json, odd.bin), "bad": b"x"}
    rows = [r for b in run[0]([pa.RecordBatch.from_pylist([{"path": k, "content": v} for k, v in contents.items()])]) for r in b.to_pylist()]
    assert [(r["path"], r["level"]) for r in rows] == [("good", 0), ("good", 1), ("good", 2), ("odd", 0)]
    assert len(finished) == 3
    for r in rows[:3]:
        glb, before, after = levels.simplify_model(good, 0.5 ** r["level"])
        assert (r["glb"], r["triangles"], r["original_triangles"]) == (glb, after, before)


def test_simplified_models_keep_their_nodes():
    g = parse(model())
    g.json["nodes"] += [{"name": "empty"}, {"name": "up", "translation": [0, 5, 0], "children": [0, 3]}]
    g.json["scenes"][0]["nodes"] = [4, 1, 2, 3]
    again = parse(levels.simplify_model(pack(g.json, g.bin), 0.5)[0])
    assert len(again.items("nodes")) == 4 and len(again.items("scenes")[0]["nodes"]) == 3
    assert [n.get("name") for n in again.items("nodes") if "mesh" not in n] == ["up"]


def test_tiles_hold_every_placement(spark):
    f = files(spark, a=model(places=6), b=model(places=3))
    models = scenes.models(scenes.read_scenes(f)).persist()
    contents = models.select("path", "model_id").join(f.select("path", "content"), "path").select("model_id", "content")
    tiles, roots = levels.tile_models(models, contents, depth=2, most=2)
    by = {r.tile: r for r in tiles.collect()}
    assert by["T0_0_0.glb"].n_instances == 9
    per = {}
    for r in by.values():
        per[r.level] = per.get(r.level, 0) + r.n_instances
    assert per[1] == 9
    sizes = {r.level: len(primitives_of(parse(bytes(r.glb)), 0)[0].indices) for r in by.values()}
    assert sizes[0] < sizes[max(sizes)]
    root = json.loads(roots.first().json)["root"]
    assert root["content"]["uri"] == "T0_0_0.glb" and root["children"]


def test_hierarchies_are_cut_at_a_bound(spark):
    depth, most = 6, 6000
    tiles = spark.range(1).selectExpr(f"explode(sequence(0, {depth})) AS level").selectExpr("level", "explode(sequence(0, CAST(pow(4, level) AS INT) - 1)) AS k")
    name = "concat('T', level, '_', k, '.glb')"
    tiles = tiles.selectExpr("level", f"{name} AS tile", f"IF(level > 0, concat('T', level - 1, '_', k div 4, '.glb'), NULL) AS parent", "1.0D AS error", "array(0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) AS box", f"{name} AS uri")
    rows = tilesets.from_tree(tiles, most).collect()
    files = {r.uri: json.loads(r.json)["root"] for r in rows}
    assert len(files) == len(rows) > 50 and max(len(r.json) for r in rows) <= most
    seen, used = [], set()

    def walk(t, error):
        assert t["geometricError"] < error
        uri = t["content"]["uri"]
        if uri.endswith(".json"):
            used.add(uri)
            assert files[uri]["geometricError"] == t["geometricError"] and "children" not in t
            return walk(files[uri], error)
        seen.append(uri)
        for k in t.get("children", []):
            walk(k, t["geometricError"])

    walk(files[None], 1e9)
    assert len(seen) == len(set(seen)) == tiles.count() and used == set(files) - {None}
    assert tilesets.from_tree(tiles).count() == 1 and tilesets.from_tree(tiles.limit(0)).count() == 0


def test_large_models_are_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "CHUNK", 50)
    f = files(spark, a=model(n=6, places=3), b=model(n=6, places=700))
    models = scenes.models(scenes.read_scenes(f))
    contents = models.select("path", "model_id").join(f.select("path", "content"), "path").select("model_id", "content")
    placed = scenes.placements(models).select(F.concat_ws("_", "model_id", "mesh_ix").alias("mesh_key"), "model_id", "mesh_ix", (F.col("model_id") == 1).alias("instanced"), "trav_ord", "world", F.lit("all/one").alias("group"))
    (saved,) = assembly.save_models(placed, contents, f"file://{tmp_path}", F.lit("one.glb")).collect()
    (value,) = assembly.write_models(placed, contents, ["group"]).collect()
    data = (tmp_path / "one.glb").read_bytes()
    assert data == bytes(value.glb) and (saved.size, saved.n_meshes, saved.n_instances) == (len(data), 2, 703) and value.group == "all/one"
    g = parse(data)
    assert len(g.items("nodes")) == 4 and g.json["extensionsRequired"] == ["EXT_mesh_gpu_instancing"] and len(g.items("meshes")) == 2
    # Both meshes are equal, so their arrays are there once; instances have three of their own.
    assert len(g.items("accessors")) == 6 and len(data) == len(pack(g.json, g.bin)) == int.from_bytes(data[8:12], "little")
    (many,) = [n for n in g.items("nodes") if "extensions" in n]
    at = scenes._instances(g, many)
    assert [x["t"][0] for x in at] == [40.0 * i for i in range(700)]
    t = g.items("accessors")[many["extensions"]["EXT_mesh_gpu_instancing"]["attributes"]["TRANSLATION"]]
    assert t["min"] == [0.0, 0.0, 0.0] and t["max"] == [40.0 * 699, 0.0, 40.0]
