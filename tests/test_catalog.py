import pytest

from mosaiq.operators import simplify
from mosaiq.plans import catalog, scene_queries
from tests.rows import check


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    check(catalog.QUERIES[name](spark, data), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", list(scene_queries.ORACLES))
def test_scene_query_equals_sql(spark, data, duck, name):
    check(scene_queries.QUERIES[name](spark, data), duck, scene_queries.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_glb_roundtrip_keeps_every_placement(spark, data):
    rows = scene_queries.glb_roundtrip(spark, data).collect()
    assert sum(r.placements for r in rows) == catalog.lineitem(spark, data).count()
    assert all(r.placements == r.instanced + r.left_over for r in rows)


def test_tileset_has_every_tile_and_rising_errors(spark, data):
    import json

    (row,) = scene_queries.tileset_json(spark, data).collect()
    names = []

    def walk(t):
        names.append(t["content"]["uri"])
        for k in t.get("children", []):
            assert t["geometricError"] > k["geometricError"]
            walk(k)

    walk(json.loads(row.json)["root"])
    assert sorted(names) == sorted(r.tile for r in catalog.quadtree_tile_names(spark, data).collect())


def test_simplified_levels_shrink(spark, data):
    by = {}
    for r in scene_queries.simplify_chain(spark, data).collect():
        by.setdefault(r.id, {})[r.level] = r.triangles
    for levels in by.values():
        assert [levels[i] >= levels[i + 1] >= 1 for i in range(3)] == [True] * 3


def test_every_embedding_enters_a_simplified_surface(spark, data):
    rows = catalog.embeddings(spark, data).select("label", "vec_id", "embedding").collect()
    grids = scene_queries.surfaces(catalog.embeddings(spark, data)).collect()
    assert sum(g.n_rows for g in grids) == len(rows)
    assert sorted(x for g in grids for x in g.positions[2::3]) == sorted(x for r in rows for x in r.embedding)
    assert all(set(g.indices) == set(range(len(g.positions) // 3)) for g in grids)
    few = scene_queries.surfaces(catalog.embeddings(spark, data).filter("vec_id < 120"))
    of = {}
    for r in simplify.simplify_chain(few, levels=1).collect():
        of.setdefault(r.id, {})[r.level] = r.triangles
    assert {k: v[0] for k, v in of.items()} == {g.id: len(g.indices) // 3 for g in few.collect()}
    assert all(v[1] < v[0] for v in of.values())


def test_whole_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
