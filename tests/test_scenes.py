import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import transforms
from mosaiq.functions.boxes import Box
from mosaiq.plans import instancing
from mosaiq.sinks import assembly
from mosaiq.sinks import models as sink
from mosaiq.sinks import tilesets
from mosaiq.sources import scenes
from mosaiq.sources.gltf import GltfError, Node, Primitive, Writer, cube, pack, parse, primitives_of


def box(size, attr=None):
    c = np.array([[a, b, d] for a in (0, size) for b in (0, 1) for d in (0, 1)], np.float32)
    return Primitive({"POSITION": c} | (attr or {}), np.arange(6, dtype=np.uint16))


def scene(nodes, meshes, names=None):
    w = Writer()
    for i, m in enumerate(meshes):
        w.mesh(m, names[i] if names else f"m{i}")
    for n in nodes:
        w.node(n)
    return w.finish()


def load(spark, files):
    df = spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in files.items()], "path string, length long, content binary")
    return scenes.read_scenes(df)


def slow_groups(files, tolerance, limit):
    """Plain single-threaded grouping of flat scenes (no EXT): signature by tolerance mode, then the box test."""
    groups, left = {}, []
    for m, path in enumerate(sorted(files)):
        g = parse(files[path])
        for k, n in enumerate(g.items("nodes")):
            p = primitives_of(g, n["mesh"])
            b = [(q.attributes["POSITION"].min(axis=0), q.attributes["POSITION"].max(axis=0)) for q in p]
            key = tuple((len(q.attributes["POSITION"]), len(q.indices), tuple(sorted((a, v.tobytes()) for a, v in q.attributes.items() if a != "POSITION" or not tolerance)), None if tolerance else q.indices.tobytes()) for q in p)
            rep = groups.setdefault(key, [])
            if tolerance and rep and not all(np.all(abs(x[0] - y[0]) <= tolerance) and np.all(abs(x[1] - y[1]) <= tolerance) for x, y in zip(b, rep[0][2])):
                left.append((m, k))
            else:
                rep.append((m, k, b))
    kept = [r[:2] for g in groups.values() if len(g) >= limit for r in g]
    return sorted(kept), sorted(left + [r[:2] for g in groups.values() if len(g) < limit for r in g])


@pytest.mark.parametrize("tolerance", [0.0, 0.5])
@pytest.mark.parametrize("limit", [2, 3])
def test_grouping_equals_plain_model(spark, tolerance, limit):
    rng = random.Random(5)
    files = {}
    for f in range(3):
        meshes = [[box(rng.choice([1.0, 1.3, 2.0, 1.6]), {"NORMAL": np.full((8, 3), rng.choice([0.0, 1.0]), np.float32)})] for _ in range(4)]
        files[f"f{f}.glb"] = scene([Node(rng.randrange(4), (float(i), 0.0, 0.0)) for i in range(8)], meshes)
    models = scenes.models(load(spark, files))
    found = instancing.detect(models, tolerance, limit)
    pick = lambda df: sorted((r.model_id, r.node_ix) for r in df.collect())
    kept, left = slow_groups(files, tolerance, limit)
    assert (pick(found.members), pick(found.left)) == (kept, left)
    r = instancing.report(models, found).first()
    assert r.final_instances == len(kept) and r.non_instanced == len(left) and r.initial_nodes == 24


def test_box_tolerance_is_inclusive_and_not_transitive(spark):
    files = {"a.glb": scene([Node(0), Node(1), Node(2), Node(3)], [[box(1.0)], [box(1.5)], [box(2.0)], [box(1.0)]])}
    found = instancing.detect(scenes.models(load(spark, files)), 0.5, 2)
    assert sorted(r.node_ix for r in found.members.collect()) == [0, 1, 3]
    assert [(r.node_ix, r.why) for r in found.left.collect()] == [(2, "box")]


def test_mesh_without_position_never_matches_with_tolerance(spark):
    bare = Primitive({"NORMAL": np.zeros((3, 3), np.float32)}, np.arange(3, dtype=np.uint16))
    files = {"a.glb": scene([Node(0), Node(0)], [[bare]])}
    assert instancing.detect(scenes.models(load(spark, files)), 0.5, 1).members.count() == 0
    assert instancing.detect(scenes.models(load(spark, files)), 0.0, 2).members.count() == 2


def test_instances_of_a_node_stand_behind_its_own_transform(spark):
    files = {"a.glb": scene([Node(0, (10.0, 0.0, 0.0), instances=[((1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (2.0, 2.0, 2.0)), ((5.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0))]), Node(0, instances=[])], [[box(1.0)]])}
    placed = scenes.placements(scenes.models(load(spark, files))).orderBy("trav_ord").collect()
    assert [r.world[12] for r in placed] == [11.0, 15.0] and placed[0].world[0] == 2.0 and all(r.is_ext for r in placed)


def test_nested_nodes_and_matrices(spark):
    g = parse(scene([Node(0), Node(0), Node(0)], [[box(1.0)]]))
    g.json["scenes"][0]["nodes"] = [0]
    g.json["nodes"][0] |= {"translation": [1, 0, 0], "children": [2]}
    g.json["nodes"][2] |= {"matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 5, 0, 1], "children": [1]}
    g.json["nodes"][1] |= {"scale": [2, 2, 2], "matrix": [9.0] * 16}
    rows = scenes.placements(scenes.models(load(spark, {"a.glb": pack(g.json, g.bin)}))).orderBy("trav_ord").collect()
    assert [r.node_ix for r in rows] == [0, 2, 1]
    assert rows[2].world[12:15] == [1.0, 5.0, 0.0] and rows[2].world[0] == 2.0


def test_bad_files_are_rows_with_errors(spark):
    good = scene([Node(0)], [[box(1.0)]])
    rows = {r.path: r for r in load(spark, {"a.glb": b"nothing", "b.glb": good, "c.glb": good[:60], "d.glb": b""}).collect()}
    assert rows["b.glb"].error is None and all(rows[k].error for k in ("a.glb", "c.glb", "d.glb"))


def test_strided_accessors_are_compacted():
    raw = np.zeros(4, np.dtype([("p", "<f4", 3), ("n", "<f4", 3)]))
    raw["p"], raw["n"] = np.arange(12).reshape(4, 3), 7
    doc = {"asset": {"version": "2.0"}, "bufferViews": [{"buffer": 0, "byteStride": 24}], "accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": 4}, {"bufferView": 0, "byteOffset": 12, "componentType": 5126, "type": "VEC3", "count": 4}]}
    g = parse(pack(doc, raw.tobytes()))
    assert (g.accessor(0) == raw["p"]).all() and (g.accessor(1) == 7).all()
    doc["accessors"][0]["count"] = 9
    with pytest.raises(GltfError):
        parse(pack(doc, raw.tobytes())).accessor(0)


def test_written_models_read_back(spark):
    files = {"a.glb": scene([Node(0, (1.0, 2.0, 3.0)), Node(0, (4.0, 0.0, 0.0), (0.0, 0.6, 0.0, 0.8), (1.0, 2.0, 3.0)), Node(1)], [[box(1.0)], [box(2.0)]])}
    df = spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in files.items()], "path string, length long, content binary")
    models = scenes.models(scenes.read_scenes(df))
    found = instancing.detect(models, limit=2)
    contents = models.join(df.select("path", "content"), "path").select("model_id", "content")
    out = assembly.write_models(instancing.to_draw(found).withColumn("file", F.lit("all")), contents, ["file"]).first()
    assert (out.n_meshes, out.n_instances) == (2, 3)
    again = scenes.placements(scenes.models(load(spark, {"b.glb": bytes(out.glb)})))
    before = sorted(np.round(r.world, 4).tolist() for r in scenes.placements(models).collect())
    after = sorted(np.round(r.world, 4).tolist() for r in again.collect())
    assert np.allclose(before, after, atol=1e-4)


def test_equal_files_count_as_the_first(spark):
    a = scene([Node(0), Node(0)], [[box(1.0)]])
    models = scenes.models(load(spark, {"a.glb": a, "b.glb": a}))
    found = instancing.remap_duplicates(instancing.detect(models), models)
    assert {r.model_id for r in found.members.collect()} == {0} and found.members.count() == 4


def test_decompose_inverts_trs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t, q, s = rng.normal(size=3), rng.normal(size=4), rng.uniform(0.1, 3, 3)
        q /= np.linalg.norm(q)
        x, y, z, w = q
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r * s, t
        t2, q2, s2 = transforms.decompose_arrays(m.T.reshape(1, 16))
        assert np.allclose(t, t2[0]) and np.allclose(s, s2[0]) and (np.allclose(q, q2[0]) or np.allclose(q, -q2[0]))


def test_moved_box_holds_all_corners(spark):
    m = [0.6, 0.8, 0.0, 0.0, -0.8, 0.6, 0.0, 0.0, 0.0, 0.0, -2.0, 0.0, 1.0, -2.0, 0.5, 1.0]
    df = spark.createDataFrame([(-3.0, -2.0, -1.0, -2.5, 4.0, 0.0), (1.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    a, b = df.select(*Box.named().moved(m).columns()).collect()
    world = np.array(m).reshape(4, 4).T
    corners = np.array([[x, y, z, 1] for x in (-3, -2.5) for y in (-2, 4) for z in (-1, 0)]) @ world.T
    assert np.allclose([a.min_x, a.min_y, a.min_z, a.max_x, a.max_y, a.max_z], [*corners[:, :3].min(axis=0), *corners[:, :3].max(axis=0)])
    assert b.min_x is None


def test_referenced_models(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    glb = scene([Node(0)], [[box(1.0)]])
    (tmp_path / "sub" / "x.GLB").write_bytes(glb)
    (tmp_path / "y.glb").write_bytes(glb)
    doc = {"root": {"content": {"uri": "../y.glb"}, "children": [{"content": {"url": "gone.glb"}}, {"uri": {"uri": "y.glb"}}]}}
    (tmp_path / "sub" / "my_tileset.json").write_text(json.dumps(doc))
    (tmp_path / "sub" / "bad_tileset.json").write_text("{")
    names = {r.path.rsplit("/", 1)[1] for r in scenes.referenced(spark, str(tmp_path)).collect()}
    assert names == {"y.glb", "gone.glb"}
    assert scenes.discover(spark, str(tmp_path)).count() == 2


def test_saved_files(spark, tmp_path):
    df = spark.createDataFrame([("a.glb", bytearray(sink.proxy_model([([0.0] * 3, [1.0] * 3)])))], "name string, glb binary")
    rows = sink.save(df, f"file://{tmp_path}", "name").collect()
    assert rows[0].size == (tmp_path / "a.glb").stat().st_size and parse((tmp_path / "a.glb").read_bytes()).items("nodes")
    assert len(cube().indices) == 36


def test_tilesets():
    c = json.loads(tilesets.chain([("l1.glb", 5.0), ("l2.glb", 8.0), ("l3.glb", 0.0)]))
    assert c["root"]["content"]["uri"] == "l1.glb" and c["root"]["geometricError"] > c["root"]["children"][0]["geometricError"] == 8.0
    assert [x["uri"] for x in json.loads(tilesets.wrapper(["a", "b"]))["root"]["contents"]] == ["a", "b"]
    assert tilesets.z_up([1, 2, 3, 4, 0, 0, 0, 5, 0, 0, 0, 6]) == [1, 3, 2, 4, 0, 0, 0, 6, 0, 0, 0, 5]
    assert len(json.loads(tilesets.flat([("a", tilesets.cube_box(1), 1.0)], tilesets.cube_box(2)))["root"]["children"]) == 1
