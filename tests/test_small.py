import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq import config
from mosaiq.operators import grouping, layout, lod, reports, simplify, trees
from mosaiq.sinks import reports as report_sink
from mosaiq.sources import lists, semantics


def test_settings(tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("# note\ntolerance = 0.05\n; x\ninstance_limit=3\nmerge_all_glb = Yes\nskip_attribute_data_hash = TEXCOORD_0, NORMAL\nseparate_instanced = false\nlod_level_count = many\n\n")
    s = config.from_arguments(["--config", str(f), "--instance-limit", "4"])
    assert (s.tolerance, s.instance_limit, s.merge_all_glb, s.skip_attribute_data_hash, s.lod_level_count) == (0.05, 4, True, ("TEXCOORD_0", "NORMAL"), 5)
    with pytest.raises(SystemExit):
        config.from_arguments(["--nothing", "1"])
    with pytest.raises(ValueError):
        config.parse_bool("perhaps")


def test_id_lists(spark, tmp_path):
    (tmp_path / "a_IDExport.csv").write_text("name,id\n x , 1,2 \r\n\nnocomma\n,5\ny,\nx,1\n")
    (tmp_path / "other.csv").write_text("h\nq,1\n")
    rows = [(r.list, r.name, r.component_id) for r in lists.read_id_lists(spark, str(tmp_path)).collect()]
    assert sorted(rows) == [("a_IDExport", "x", "1"), ("a_IDExport", "x", "1,2")]


def test_semantics(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<MetaData reference="Actor.A">\n<KeyValueProperty name="Element_Category" val="w&amp;d"/>\n</MetaData>\n<MetaData reference="Actor.B">\n<KeyValueProperty name="Element_Type" val="t"/>\n</MetaData>\n<MetaData reference="Actor.A">\n<KeyValueProperty name="Element_Family" val="f"/>\n</MetaData>\n')
    assert [tuple(r) for r in semantics.read_semantics(spark, str(tmp_path / "s.xml")).collect()] == [("A", "", "f", "")]


def test_layout_over_many_partitions(spark):
    df = spark.createDataFrame([(i, (i * 7) % 11) for i in range(200)], "k long, n long").repartition(7)
    rows = layout.buffer_offsets(df, ["k"], "n").orderBy("k").collect()
    at = 0
    for r in rows:
        assert r.offset == at
        at += -(-r.n // 4) * 4
    assert [r.ix for r in layout.numbered(df, ["k"], "ix").orderBy("k").collect()] == list(range(200))


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 1.2), (3, "a", None), (4, "a", 1.0)], "id long, k string, v double")
    assert {r.id for r in grouping.demoted(df, ["k"], 3).collect()} == {1, 2, 3, 4}
    got = {r.id: r.accepted for r in grouping.tolerance_groups(df, ["k"], ["id"], ["v"], 0.2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_similar_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = rng.random((200, 3))
    df = spark.createDataFrame([(i, i % 2, *map(float, x)) for i, x in enumerate(p)], "id int, k int, x double, y double, z double")
    got = {(r.id_a, r.id_b) for r in grouping.similar_pairs(df, ["k"], ["x", "y", "z"], 0.15, "id").collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, 200) if i % 2 == j % 2 and (abs(p[i] - p[j]) <= 0.15).all()}


def test_pruned_keeps_ancestors(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None)], "node string, parent string")
    full = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in trees.pruned(nodes, full).collect()} == {"a", "b", "c"}


def test_hot_keys_are_many_tasks(spark):
    n = 8000
    keyed = spark.range(n).selectExpr("id", "IF(id % 10 < 9, 'hot', concat('k', id % 97)) AS k", "CAST(id % 31 AS DOUBLE) AS v", "CAST(IF(id % 10 < 9, 1, id % 7) AS DOUBLE) AS x", "1D AS y", "1D AS z").repartition(8)
    # So that small tables aren't put together into few tasks.
    ours = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        plain = {}
        for r in keyed.orderBy("id").collect():
            plain.setdefault(r.k, []).append(r)
        results = {
            "ranked": grouping.ranked(keyed, ["k"], ["id"]),
            "duplicates": grouping.duplicates(keyed, F.col("k"), "id"),
            "weld": lod.weld(keyed, ["k"], "id"),
        }
        rows = {name: {r.id: r for r in df.collect()} for name, df in results.items()}
        for k, own in plain.items():
            first = {}
            for i, r in enumerate(own):
                got = rows["ranked"][r.id]
                assert (got.member_ix, got.group_size) == (i + 1, len(own)) and rows["duplicates"][r.id].rep_id == own[0].id
                assert rows["weld"][r.id].new_ix == first.setdefault(r.x, len(first))
        for name, df in results.items():
            per = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
            assert sum(per) == n and per[-1] <= n / 4, name
        best = {r.k: r.rep for r in lod.nearest_to_mean(keyed, ["k"], "v", "id").collect()}
        for k, own in plain.items():
            mean = sum(r.v for r in own) / len(own)
            assert best[k] == min((round(abs(r.v - mean), 9), r.id) for r in own)[1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_meet_once(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.integers(0, 12, (150, 4)) * 0.1, 1)
    df = spark.createDataFrame([(i, 0, *map(float, x)) for i, x in enumerate(p)], "id int, k int, x double, y double, z double, w double")
    for names in (["x"], ["x", "y"], ["x", "y", "z", "w"]):
        at = p[:, : len(names)]
        got = [(r.id_a, r.id_b) for r in grouping.similar_pairs(df, ["k"], names, 0.2, "id").collect()]
        assert sorted(got) == [(i, j) for i in range(150) for j in range(i + 1, 150) if all(abs(a - b) <= 0.2 for a, b in zip(at[i].tolist(), at[j].tolist()))]


def test_deep_trees_and_cycles(spark):
    n = 10_000
    deep = spark.range(n).selectExpr("concat('n', id) AS node", "IF(id = 0, NULL, concat('n', id - 1)) AS parent", "CAST(id AS DOUBLE) AS v")
    more = [("a", None, 1.0), ("b", "a", 2.0), ("c", "b", 4.0), ("d", "a", 8.0), ("x", "z", 1.0), ("y", "x", 1.0), ("z", "y", 1.0), ("w", "z", 1.0), ("self", "self", 1.0), ("lost", "nowhere", 1.0), ("child", "lost", 1.0)]
    nodes = deep.unionByName(spark.createDataFrame(more, "node string, parent string, v double")).repartition(4)
    counts = {r.node: r.n for r in trees.subtree_counts(nodes).collect()}
    assert len(counts) == n + 6 and [counts[k] for k in ("n0", "n1", "n9999", "a", "b", "d", "lost")] == [n, n - 1, 1, 4, 2, 1, 2]
    roots = nodes.filter("parent IS NULL")
    # What comes first stays first: sums of places, and texts in the order of the path.
    found = {r.node: r for r in trees.descend(nodes, roots, {"v": (F.col("v"), lambda above, own: above + own), "last": (F.col("node"), lambda above, own: own), "first": (F.col("node"), lambda above, own: above)}).collect()}
    assert len(found) == n + 4 and (found["n9999"].depth, found["n9999"].root, found["n9999"].v) == (9999, "n0", float(n * (n - 1) // 2))
    assert (found["c"].depth, found["c"].v, found["c"].first, found["c"].last) == (2, 7.0, "a", "c") and (found["a"].depth, found["a"].root) == (0, "a")
    inner = {r.node: r.root for r in trees.descend(nodes, nodes.filter("node IN ('a', 'b')"), {}).collect()}
    assert inner == {"a": "a", "b": "b", "c": "b", "d": "a"}


def test_report_formulas(spark):
    counts = spark.createDataFrame([(1, 155, 155, 178, 18, 209, 107)], "input_models long, initial_nodes long, initial_meshes long, initial_instances long, instanced_groups long, final_instances long, non_instanced long")
    r = reports.instancing(counts).first()
    assert (r.final_nodes, r.total_displayed, r.node_reduction, r.initial_ratio, r.final_ratio, r.increase) == (125, 316, 19.35, 56.33, 66.14, 9.81)
    zero = reports.instancing(spark.createDataFrame([(0,) * 7], counts.schema)).first()
    assert (zero.node_reduction, zero.initial_ratio, zero.increase) == (0.0, 0.0, 0.0)


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    report_sink.csv(df, str(tmp_path / "r"), quote=True)
    assert spark.read.text(str(tmp_path / "r")).collect()[1].value == '"a","1"'
    groups = spark.createDataFrame([("s", 3)], "signature string, n long")
    left = spark.createDataFrame([(0, i, i) for i in range(4)], "model_id int, mesh_ix int, node_ix int")
    assert report_sink.text(groups, left, 2).endswith("... and 2 more")


def grid(n=12, height=lambda x, y: 0.0):
    v = np.array([[x, y, height(x, y)] for x in range(n) for y in range(n)], float)
    c = [x * n + y for x in range(n - 1) for y in range(n - 1)]
    return v, np.array([t for k in c for t in (k, k + 1, k + n, k + 1, k + n + 1, k + n)])


def test_simplify_reaches_its_target_inside_the_box():
    v, ix = grid()
    for ratio in (0.5, 0.25):
        p, i, came = simplify.simplify(v, ix, ratio)
        assert 3 <= len(i) <= simplify.target_count(len(ix), ratio)
        assert (p.min(axis=0) >= v.min(axis=0)).all() and (p.max(axis=0) <= v.max(axis=0)).all() and (v[came] == p).all()
    p, i, _ = simplify.simplify(v, ix[:30], 0.1)
    assert len(i) == 30


def test_weld_joins_equal_positions():
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 0, 0], [1, 1, 0]], float)
    p, i, came = simplify.weld(v, np.array([0, 1, 2, 3, 5, 4]))
    assert len(p) == 4 and i.tolist() == [0, 1, 2, 0, 3, 1] and (v[came] == p).all()


def test_levels_of_one_run_equal_levels_made_alone():
    v, ix = grid(12, lambda x, y: np.sin(3 * x) * np.cos(2 * y))
    ratios = [0.5, 0.25, 0.125]
    for ratio, (p, i, came) in zip(ratios, simplify.simplify_levels(v, ix, ratios)):
        q, j, back = simplify.simplify(v, ix, ratio)
        assert np.array_equal(p, q) and np.array_equal(i, j) and np.array_equal(came, back)
    assert [len(i) for _, i, _ in simplify.simplify_levels(v, ix[:30], ratios)] == [30] * 3


def test_flat_surfaces_collapse_without_cost():
    v, ix = grid(8, lambda x, y: x * y)
    flat = v * [1.0, 1.0, 0.0]
    p, i, _ = simplify.simplify(flat, ix, 0.1)
    e = p[i.reshape(-1, 3)]
    area = np.linalg.norm(np.cross(e[:, 1] - e[:, 0], e[:, 2] - e[:, 0]), axis=1).sum()
    whole = flat[ix.reshape(-1, 3)]
    assert np.isclose(area, np.linalg.norm(np.cross(whole[:, 1] - whole[:, 0], whole[:, 2] - whole[:, 0]), axis=1).sum())


def test_groups_with_most_rows_find_their_representative(spark):
    df = spark.range(2000).selectExpr("CASE WHEN id < 1800 THEN 'hot' WHEN id < 1900 THEN NULL ELSE CAST(id AS STRING) END AS k", "id", "CAST(id AS DOUBLE) AS x")
    rows = grouping.with_representative(df, ["k"], ["id"], ["x"]).collect()
    assert len(rows) == 2000
    first = {r.k: r.x for r in sorted(rows, key=lambda r: -r.id)}
    assert all(r.rep_x == first[r.k] and r.n == (1800 if r.k == "hot" else 100 if r.k is None else 1) for r in rows)
