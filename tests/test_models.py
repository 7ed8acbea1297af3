import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import transforms
from mosaiq.plans import instancing
from mosaiq.sources import scenes
from mosaiq.sources.gltf import Gltf, Node, Primitive, Writer, merged, pack, parse, primitives_of, roots_of
from tests.test_levels import files


def textured(colour, image=b"\x89PNG-1", extra=b""):
    """A model of one triangle whose material has two textures, one of them in an extension too."""
    w = Writer()
    w.mesh([Primitive({"POSITION": np.eye(3, dtype=np.float32)})], f"mesh {colour}")
    w.node(Node(0))
    g = parse(w.finish())
    body = g.bin + b"\0" * (-len(g.bin) % 4) + extra + image
    g.json |= {
        "materials": [{"name": "unused"}, {"name": colour, "pbrMetallicRoughness": {"baseColorTexture": {"index": 1, "texCoord": 0}}, "normalTexture": {"index": 0},
                       "extensions": {"KHR_materials_clearcoat": {"clearcoatTexture": {"index": 1}}}}],
        "textures": [{"source": 0}, {"source": 1, "sampler": 0, "extensions": {"EXT_texture_webp": {"source": 0}}}],
        "samplers": [{"magFilter": 9729}],
        "images": [{"uri": "wall.png"}, {"bufferView": 1, "mimeType": "image/png"}],
        "extensionsUsed": ["EXT_texture_webp", "KHR_materials_clearcoat"],
    }
    g.json["bufferViews"].append({"buffer": 0, "byteOffset": len(body) - len(image), "byteLength": len(image)})
    g.json["buffers"] = [{"byteLength": len(body)}]
    g.json["meshes"][0]["primitives"][0]["material"] = 1
    return pack(g.json, body)


def images_of(g, mesh):
    """What the base colour of a mesh's first primitive shows, and its sampler."""
    m = g.items("materials")[g.items("meshes")[mesh]["primitives"][0]["material"]]
    t = g.items("textures")[m["pbrMetallicRoughness"]["baseColorTexture"]["index"]]
    image = g.items("images")[t["source"]]
    v = g.items("bufferViews")[image["bufferView"]]
    assert g.items("textures")[m["extensions"]["KHR_materials_clearcoat"]["clearcoatTexture"]["index"]] == t
    assert g.items("images")[t["extensions"]["EXT_texture_webp"]["source"]]["uri"] == "wall.png"
    assert g.items("images")[g.items("textures")[m["normalTexture"]["index"]]["source"]]["uri"] == "wall.png"
    return m["name"], g.bin[v["byteOffset"] : v["byteOffset"] + v["byteLength"]], g.items("samplers")[t["sampler"]]


def test_textures_go_with_their_meshes():
    sources = [parse(textured("red", b"\x89PNG-1")), parse(textured("blue", b"\x89PNG-22", b"pad!")), parse(textured("red", b"\x89PNG-1"))]
    w = Writer()
    for g in sources:
        w.mesh(primitives_of(g, 0))
    out = parse(w.finish())
    assert [images_of(out, k) for k in range(3)] == [("red", b"\x89PNG-1", {"magFilter": 9729}), ("blue", b"\x89PNG-22", {"magFilter": 9729}), ("red", b"\x89PNG-1", {"magFilter": 9729})]
    assert [len(out.items(k)) for k in ("materials", "textures", "images", "samplers")] == [2, 3, 3, 1]
    assert out.json["extensionsUsed"] == ["EXT_texture_webp", "KHR_materials_clearcoat"]


def test_merged_models_keep_everything():
    a, b = parse(textured("red")), parse(textured("blue", b"\x89PNG-22", b"pad!"))
    w = Writer()
    w.mesh([Primitive({"POSITION": np.full((3, 3), 2, np.float32)}, np.arange(3, dtype=np.uint16), morphs=[{"POSITION": np.ones((3, 3), np.float32)}])])
    w.node(Node(0, instances=[((1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0))]))
    c = parse(w.finish())
    out = parse(merged([a, b, c, Gltf({"asset": {"version": "2.0"}})]))
    assert images_of(out, 0) == images_of(a, 0) and images_of(out, 1) == images_of(b, 0)
    p, q = primitives_of(out, 2)[0], primitives_of(c, 0)[0]
    assert (p.attributes["POSITION"] == q.attributes["POSITION"]).all() and (p.morphs[0]["POSITION"] == 1).all() and p.indices.tolist() == [0, 1, 2]
    assert out.json["scenes"][0]["nodes"] == [0, 1, 2] and [n["mesh"] for n in out.items("nodes")] == [0, 1, 2]
    assert scenes._instances(out, out.items("nodes")[2]) == scenes._instances(c, c.items("nodes")[0])


def test_roots_of_scenes_without_a_default():
    nodes = [{"children": [1]}, {}, {}]
    of = lambda **x: roots_of(Gltf({"nodes": nodes} | x))
    assert of(scene=1, scenes=[{"nodes": [0]}, {"nodes": [2]}]) == [2]
    assert of(scenes=[{"nodes": [0]}, {"nodes": [2]}]) == [0]
    assert of(scene=0, scenes=[{}, {"nodes": [2]}, {"nodes": [0, 2]}]) == [2, 0]
    assert of(scene=7) == of() == [0, 2]
    assert roots_of(Gltf({"nodes": [{"children": [1]}, {"children": [0]}]})) == [0, 1] and roots_of(Gltf({})) == []


def test_rotations_of_any_length(spark):
    m = lambda *q: spark.range(1).select(transforms.trs_matrix(*[F.array(*map(F.lit, v)) for v in ([1.0, 2.0, 3.0], list(map(float, q)), [1.0, 1.0, 2.0])]).alias("m")).first().m
    assert m(0, 0, 3, 3) == pytest.approx(m(0, 0, 0.5**0.5, 0.5**0.5)) and m(0, 0, 0, 0) == pytest.approx(m(0, 0, 0, 1))
    assert m(0, 0, 3, 3)[:3] == pytest.approx([0, 1, 0], abs=1e-12)


def test_report_counts_what_the_default_scene_reaches(spark):
    w = Writer()
    w.mesh([Primitive({"POSITION": np.eye(3, dtype=np.float32)})])
    for _ in range(4):
        w.node(Node(0))
    g = parse(w.finish())
    g.json["nodes"] += [{"children": [0, 1]}, {"name": "unreached"}]
    g.json["scenes"][0]["nodes"] = [4, 2]
    g.json["meshes"].append({"primitives": []})
    models = scenes.models(scenes.read_scenes(files(spark, a=pack(g.json, g.bin)))).persist()
    row = instancing.report(models, instancing.detect(models)).first()
    assert (row.initial_nodes, row.initial_meshes, row.final_instances) == (4, 2, 3)


@pytest.mark.parametrize("step", [0.0, 0.1])
def test_normals_count_in_steps_of_their_tolerance(spark, step):
    w = Writer()
    for shift in (0.0, 0.02, 0.3):
        w.mesh([Primitive({"POSITION": np.eye(3, dtype=np.float32), "NORMAL": np.full((3, 3), 0.5 + shift, np.float32)})])
        w.node(Node(len(w.doc["meshes"]) - 1))
    models = scenes.models(scenes.read_scenes(files(spark, a=w.finish()), step)).persist()
    assert instancing.detect(models, tolerance=0.01).members.count() == (2 if step else 0)
    assert instancing.detect(models).members.count() == 0


def test_documents_with_buffers_outside(spark, tmp_path):
    import base64
    import json

    g = parse(textured("red"))
    half = 36
    doc = json.loads(json.dumps(g.json))
    views = doc["bufferViews"]
    assert [v["byteOffset"] for v in views] == [0, 36]
    views[1] |= {"buffer": 1, "byteOffset": 0}

    def put(name, first, second):
        doc["buffers"] = [{"uri": first, "byteLength": half}, {"uri": second, "byteLength": len(g.bin) - half}]
        (tmp_path / name).write_text(json.dumps(doc))

    inline = lambda b: "data:application/octet-stream;base64," + base64.b64encode(b).decode()
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "a b.bin").write_bytes(g.bin[:half])
    (tmp_path / "rest.bin").write_bytes(g.bin[half:])
    put("outside.gltf", "parts/a%20b.bin", "rest.bin")
    put("parts/inside.gltf", inline(g.bin[:half]), inline(g.bin[half:]))
    put("parts/mixed.gltf", "./a%20b.bin", inline(g.bin[half:]))
    put("missing.gltf", "parts/a%20b.bin", "gone.bin")
    put("short.gltf", "rest.bin", "rest.bin")
    (tmp_path / "bad.gltf").write_text("[1")
    (tmp_path / "same.glb").write_bytes(textured("red"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in scenes.read_scenes(scenes.discover(spark, str(tmp_path))).collect()}
    assert set(rows) == {"outside.gltf", "inside.gltf", "mixed.gltf", "missing.gltf", "short.gltf", "bad.gltf", "same.glb"}
    assert {k for k, r in rows.items() if r.error} == {"missing.gltf", "short.gltf", "bad.gltf"} and "gone.bin is missing" in rows["missing.gltf"].error
    assert all(rows[k].primitives == rows["same.glb"].primitives for k in ("outside.gltf", "inside.gltf", "mixed.gltf"))
    again = {r.path.rsplit("/", 1)[1]: r for r in scenes.documents(spark, str(tmp_path)).collect()}
    assert images_of(parse(bytes(again["outside.gltf"].content)), 0) == images_of(g, 0)


def sparse(values, places=(1, 3), base=True):
    """A model of one mesh whose positions are a base, or zeros, with other values in some places."""
    w = Writer()
    w.mesh([Primitive({"POSITION": np.arange(15, dtype=np.float32).reshape(5, 3)})])
    w.node(Node(0))
    g = parse(w.finish())
    at, new = np.array(places, np.uint16).tobytes(), np.array(values, np.float32).tobytes()
    body = g.bin + new + at
    a = g.json["accessors"][0]
    for k in ("min", "max") if base else ("min", "max", "bufferView"):
        a.pop(k)
    views = g.json["bufferViews"]
    views += [{"buffer": 0, "byteOffset": len(g.bin), "byteLength": len(new)}, {"buffer": 0, "byteOffset": len(g.bin) + len(new), "byteLength": len(at)}]
    a["sparse"] = {"count": len(places), "indices": {"bufferView": 2 if len(views) > 2 else 1, "componentType": 5123}, "values": {"bufferView": 1}}
    g.json["buffers"] = [{"byteLength": len(body)}]
    return pack(g.json, body)


@pytest.mark.parametrize("base", [True, False])
def test_sparse_and_dense_meshes_are_the_same(spark, base):
    values = [[50.0, -7.0, 2.0], [9.0, 9.0, 90.0]]
    dense = np.arange(15, dtype=np.float32).reshape(5, 3) if base else np.zeros((5, 3), np.float32)
    dense[[1, 3]] = values
    w = Writer()
    w.mesh([Primitive({"POSITION": dense})])
    w.node(Node(0))
    f = files(spark, a=w.finish(), b=sparse(values, base=base), c=sparse(values, (3, 1), base), d=sparse(values, (1, 5), base))
    read = {r.path: r for r in scenes.read_scenes(f).collect()}
    assert read["b"].error is None and "without a place" in read["c"].error and "without a place" in read["d"].error
    models = scenes.models(scenes.read_scenes(f)).persist()
    found = instancing.detect(models)
    assert [r.n for r in found.groups.collect()] == [2]
    boxes = [tuple(r)[2:] for r in scenes.mesh_boxes(scenes.primitives(models)).collect()]
    assert boxes[0] == boxes[1] == (*map(float, dense.min(axis=0)), *map(float, dense.max(axis=0)))
    out = parse(merged([parse(w.finish()), parse(sparse(values, base=base))]))
    assert (out.accessor(0) == out.accessor(1)).all()
