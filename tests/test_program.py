"""The whole run on three small models, and levels of detail by what things are."""

import csv
import json

import numpy as np

from mosaiq.config import Settings
from mosaiq.plans import instancing, levels, program, semantic_levels
from mosaiq.sinks import assembly
from mosaiq.sources import scenes
from mosaiq.sources.gltf import Node, Primitive, Writer, parse
from tests.test_levels import files, model


def boxes(sizes):
    w = Writer()
    for i, size in enumerate(sizes):
        c = np.array([[a, b, d] for a in (0, size[0]) for b in (0, size[1]) for d in (0, size[2])], np.float32)
        w.mesh([Primitive({"POSITION": c}, np.arange(6, dtype=np.uint16))], f"box{i}")
        w.node(Node(i, (10.0 * i, 0.0, 0.0)))
    return w.finish()


def read_csv(path):
    return list(csv.reader("".join(p.read_text() for p in sorted(path.glob("part-*.csv"))).splitlines()))


def run(spark, tmp_path, **settings):
    (tmp_path / "in").mkdir()
    for name, data in (("a", model(n=8, places=2)), ("b", model(n=8, places=3)), ("c", boxes([(1, 1, 1), (1, 1, 2)])), ("broken", b"x")):
        (tmp_path / "in" / f"{name}.glb").write_bytes(data)
    out = tmp_path / "out"
    out.mkdir()
    names = program.run(spark, Settings(input_directory=str(tmp_path / "in"), output_directory=f"file://{out}", **settings))
    assert all((out / n).exists() for n in names) and len(names) == len(set(names))
    return out, names


def test_a_whole_run(spark, tmp_path):
    out, names = run(spark, tmp_path, merge_all_glb=True, mesh_segmentation=True)
    g = parse((out / "instanced.glb").read_bytes())
    assert [len(scenes._instances(g, n)) for n in g.items("nodes")] == [5] and len(parse((out / "non_instanced.glb").read_bytes()).items("nodes")) == 2
    assert len(parse((out / "merged.glb").read_bytes()).items("nodes")) == 7
    assert len([n for n in names if n.startswith("segments/")]) == 4
    (row,) = read_csv(out / "instancing_analysis.csv")[1:]
    assert row[:7] == ["3", "7", "4", "0", "1", "5", "2"]


def test_a_run_with_tiles(spark, tmp_path):
    out, names = run(spark, tmp_path, enable_hlod=True, quadtree_max_depth=2, quadtree_max_objects_per_tile=3)
    tiles = read_csv(out / "hlod_analysis.csv")
    assert tuple(tiles[0]) == semantic_levels.HLOD_ANALYSIS
    rows = {r[1]: r for r in tiles[1:]}
    assert [int(r[0]) for r in tiles[1:]] == sorted((int(r[0]) for r in tiles[1:]), reverse=True) and set(rows) == {n.removeprefix("tiles/") for n in names if n.startswith("tiles/T")}
    for name, r in rows.items():
        g = parse((out / "tiles" / name).read_bytes())
        placed = [len(scenes._instances(g, n)) if "extensions" in n else 1 for n in g.items("nodes")]
        assert int(r[3]) == len(g.items("meshes")) and int(r[4]) == sum(k for k, n in zip(placed, g.items("nodes")) if "extensions" in n)
        assert abs(float(r[2]) - (out / "tiles" / name).stat().st_size / 1024) < 0.01 and abs(float(r[7]) - int(r[5]) / int(r[6])) < 1e-4
    root = json.loads((out / "tiles" / "tileset.json").read_text())["root"]
    assert root["content"]["uri"] == "T0_0_0.glb"


def test_a_run_with_levels(spark, tmp_path):
    out, names = run(spark, tmp_path, enable_lod_generation=True, non_instanced_lod_level_count=1)
    table = read_csv(out / "instancing_lod_output" / "lod_analysis.csv")
    assert tuple(table[0]) == semantic_levels.LOD_ANALYSIS
    by = {r[0]: r[1:] for r in table[1:]}
    # Without semantics everything stands for itself until the boxes of level 1.
    assert by["Unique Meshes"] == ["-", "3", "3", "3", "3", "3"] and by["Total Instances"] == ["7"] * 6 and by["Vertices (Loaded)"][:2] == ["144", "80"] and by["Vertices (Loaded)"][5] == "72"
    assert by["Reduction Rate (%)"][0] == "-" and by["Reduction Rate (%)"][1].endswith("%")
    assert json.loads((out / "instancing_lod_output" / "tileset.json").read_text())["root"]["content"]["uri"] == "LOD1.glb"
    assert "levels/instanced_levels.json" in names


def test_levels_by_what_things_are(spark):
    sizes = [(1, 1, 1), (1, 1, 1.004), (3, 1, 1), (3.05, 1, 1), (2, 2, 2), (5, 5, 5)]
    f = files(spark, a=boxes(sizes))
    models = scenes.models(scenes.read_scenes(f)).persist()
    found = instancing.detect(models)
    what = spark.createDataFrame([("box0", "cat", "fam", ""), ("box1", "cat", "fam", ""), ("box2", "cat", "fam", ""), ("box3", "cat", "other", ""), ("box4", "dog", "fam", "")], "actor_hash string, category string, family string, type string")
    five, four, three, two, one = semantic_levels.build(found, models, what, abstract={"cat": "pet", "dog": "pet"})
    shown = lambda x: sorted((r.item, r.n) for r in x.items.collect())
    item = lambda i: f"m:0_{i}_{i}"
    assert shown(five) == [(item(i), 1) for i in range(6)]
    # One family and nearly one volume: the two cubes. The box without semantics stays.
    assert shown(four) == [(item(0), 2), *[(item(i), 1) for i in range(2, 6)]] or shown(four) == [(item(1), 2), *[(item(i), 1) for i in range(2, 6)]]
    assert len(shown(three)) == 4 and sorted(n for _, n in shown(two)) == [1, 5] and 0 < four.error <= three.error <= two.error
    assert two.placed.count() == one.placed.count() == 6
    contents = models.select("path", "model_id").join(f.select("path", "content"), "path")
    (glb,) = assembly.write_models(semantic_levels.to_draw(one), semantic_levels.with_cube(spark, contents), ["name"]).collect()
    g = parse(bytes(glb.glb))
    at = scenes._instances(g, g.items("nodes")[0])
    assert len(at) == 6 and len(g.items("meshes")) == 1
    corners = sorted((round(x["t"][0] - x["s"][0] / 2, 3), round(x["t"][1] - x["s"][1] / 2, 3)) for x in at)
    assert corners == [(10.0 * i, 0.0) for i in range(6)]


def test_instancing_is_detected_anew_at_each_level(spark):
    made = levels.level_models(files(spark, a=model(n=8, places=2), b=model(n=8, places=1)), 2, least=30)
    one, two = levels.instanced_levels(made, 2)
    for level, x in ((1, one), (2, two)):
        (row,) = x.models.collect()
        assert (x.level, row.level, row.part, row.n_instances) == (level, level, "instanced", 3)
        assert x.report.first().final_instances == 3
    chain = json.loads(levels.instanced_level_tileset([(16.0, ["a", "b"]), (32.0, ["c"])]))["root"]
    assert chain["content"]["uri"] == "c" and [c["uri"] for c in chain["children"][0]["contents"]] == ["a", "b"]
