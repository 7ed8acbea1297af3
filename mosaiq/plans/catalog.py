"""Queries over the star-schema tables, one or more per operator, each with its SQL.

Roles: ``part`` are meshes (material: brand, class: type), ``lineitem`` placements in the
order (orderkey, linenumber), the first three numbers of ``embeddings`` positions,
``documents`` files, ``labels`` an id list, regions, nations and customers a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import boxes, signatures, transforms
from mosaiq.functions.boxes import Box
from mosaiq.operators import grouping, layout, lod, quadtree, reconcile, reports, trees
from mosaiq.sinks.models import sanitised
from mosaiq.sources import scenes, semantics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

c = F.col


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


part, lineitem, documents, labels, embeddings, events, customer, supplier, nation, region, orders = map(
    _table, ("part", "lineitem", "documents", "labels", "embeddings", "events", "customer", "supplier", "nation", "region", "orders")
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Id lists


def _ids(s: SparkSession, d: str) -> DataFrame:
    return labels(s, d).select(c("doc_id").alias("name"), c("quality").cast("string").alias("component_id"))


def _names(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select(c("doc_id").alias("name"))


_MATCHED = "SELECT doc_id AS name, CAST(quality AS VARCHAR) AS component_id, 'Non-Instanced' AS status FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"


@query(_MATCHED)
def reconcile_matched(s, d):
    return reconcile.matched(_ids(s, d), _names(s, d))


@query("SELECT doc_id, 'Instanced' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reconcile_unmatched(s, d):
    return reconcile.unmatched(_names(s, d), _ids(s, d)).select(c("name").alias("doc_id"), "status")


@query(f"""SELECT *, 1 AS part FROM ({_MATCHED})
UNION ALL SELECT doc_id, CAST(quality AS VARCHAR), 'Instanced', 2 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT doc_id, '', 'Instanced', 3 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def reconcile_all(s, d):
    return reconcile.reconcile(_ids(s, d), _names(s, d))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def ids_intersect(s, d):
    return documents(s, d).select("doc_id").intersect(labels(s, d).select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def ids_except(s, d):
    return documents(s, d).select("doc_id").subtract(labels(s, d).select("doc_id"))


# Identical files


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS rep_id FROM documents")
def file_dedup(s, d):
    return grouping.duplicates(documents(s, d).select("doc_id", F.sha2("text", 256).alias("h")), c("h"), "doc_id").select("doc_id", "rep_id")


@query("SELECT sha256(text) AS file_hash, min(doc_id) AS rep_doc_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) >= 2")
def file_dedup_groups(s, d):
    df = documents(s, d).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return grouping.having(grouping.representatives(df, ["file_hash"], ["doc_id"], ["doc_id"]), 2)


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars, source) AS rep_id FROM documents")
def file_identity_compat(s, d):
    return grouping.duplicates(documents(s, d).select("doc_id", "n_chars", "source"), F.concat_ws("|", c("n_chars").cast("string"), "source"), "doc_id").select("doc_id", "rep_id")


@query("SELECT d.doc_id, coalesce(m.rep, d.doc_id) AS rep_id FROM documents d LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY quality, toxic) AS rep FROM labels) m USING (doc_id)")
def rep_id_remap(s, d):
    map_ = grouping.duplicates(labels(s, d), F.concat_ws("|", c("quality").cast("string"), c("toxic").cast("string")), "doc_id").select(c("doc_id").alias("id"), "rep_id")
    return grouping.remapped(documents(s, d).select("doc_id"), "doc_id", map_)


# Groups

KEY, LIMIT, NEAR = ["p_brand", "p_type"], 12, 5


@query("SELECT p_brand, p_type, min(p_partkey) AS rep_p_partkey, count(*) AS n FROM part GROUP BY ALL")
def group_exact(s, d):
    return grouping.representatives(part(s, d), KEY, ["p_partkey"], ["p_partkey"])


@query(f"SELECT p_brand, p_type, min(p_partkey) AS rep_p_partkey, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= {LIMIT}")
def group_having(s, d):
    return grouping.having(group_exact(s, d), LIMIT)


@query(f"SELECT p_partkey, p_brand, p_type FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_type) < {LIMIT}")
def group_demoted(s, d):
    return grouping.demoted(part(s, d).select("p_partkey", *KEY), KEY, LIMIT)


@query("SELECT p_partkey, p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS INTEGER) AS member_ix, count(*) OVER (PARTITION BY p_brand, p_type) AS group_size FROM part")
def group_members(s, d):
    return grouping.ranked(part(s, d).select("p_partkey", *KEY), KEY, ["p_partkey"])


_TOLERANT = f"""WITH r AS (SELECT *, first_value(p_size) OVER w AS rep_size, first_value(p_partkey) OVER w AS rep FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)),
j AS (SELECT *, abs(p_size - rep_size) <= {NEAR} AS accepted FROM r),
o AS (SELECT *, CASE WHEN NOT accepted THEN 'box' WHEN count(*) FILTER (accepted) OVER (PARTITION BY p_brand, p_type) < 4 THEN 'limit' ELSE 'instanced' END AS outcome FROM j)"""


def _judged(s: SparkSession, d: str) -> DataFrame:
    df = part(s, d).select("p_partkey", "p_size", *KEY)
    return grouping.split_groups(df, KEY, ["p_partkey"], ["p_size"], NEAR, 4)


@query(_TOLERANT + " SELECT p_partkey, p_brand, p_type, rep AS rep_p_partkey, p_size FROM j WHERE accepted")
def group_tolerance(s, d):
    df = part(s, d).select("p_partkey", "p_size", *KEY)
    out = grouping.tolerance_groups(df, KEY, ["p_partkey"], ["p_size"], NEAR)
    reps = grouping.representatives(df, KEY, ["p_partkey"], ["p_partkey"])
    return out.filter("accepted").join(reps.drop("n"), KEY).select("p_partkey", *KEY, "rep_p_partkey", "p_size")


@query(_TOLERANT + " SELECT p_partkey, p_brand, p_type, p_size FROM j WHERE NOT accepted")
def group_tolerance_rejects(s, d):
    return grouping.tolerance_groups(part(s, d).select("p_partkey", "p_size", *KEY), KEY, ["p_partkey"], ["p_size"], NEAR).filter("NOT accepted").select("p_partkey", *KEY, "p_size")


@query(_TOLERANT + " SELECT p_partkey, outcome FROM o WHERE outcome <> 'instanced'")
def non_instanced_union(s, d):
    return _judged(s, d).filter("outcome <> 'instanced'").select("p_partkey", "outcome")


@query(_TOLERANT + " SELECT p_brand, p_type, outcome, count(*) AS n FROM o GROUP BY ALL")
def group_outcomes(s, d):
    return _judged(s, d).groupBy(*KEY, "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def placement_count(s, d):
    # Counted per part first, so the join moves a row per part instead of one per placement.
    per = lineitem(s, d).groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("m"))
    return per.join(part(s, d).select("p_partkey", *KEY), "p_partkey").groupBy(*KEY).agg(F.sum("m").cast("long").alias("n"))


@query("SELECT l_partkey, min_by(l_suppkey, (l_orderkey, l_linenumber)) AS first_supp FROM (SELECT * FROM lineitem) GROUP BY 1")
def first_node_per_mesh(s, d):
    return grouping.extremes(lineitem(s, d), ["l_partkey"], "l_suppkey", ["l_orderkey", "l_linenumber"], "first_supp")


@query("SELECT DISTINCT p_name FROM part")
def mesh_names_distinct(s, d):
    return part(s, d).select("p_name").distinct()


# Signatures


def _primitives(s: SparkSession, d: str) -> DataFrame:
    """A mesh of one primitive per part: its positions' hash is the brand, its normals' hash the name and, in steps, the type."""
    attr = lambda name, of, near: F.struct(F.lit(name).alias("name"), F.lit("VEC3").alias("type"), F.lit(5126).alias("ctype"), F.lit(False).alias("norm"), of.alias("hash"), near.cast("string").alias("near_hash"))
    return part(s, d).select(
        F.lit(0).alias("model_id"), c("p_partkey").alias("mesh_ix"), F.lit(0).alias("prim_ix"), F.lit(None).cast("int").alias("material"), F.lit(4).alias("mode"), c("p_size").cast("long").alias("n_vertices"),
        F.lit(None).cast("long").alias("n_indices"), c("p_size").cast("string").alias("index_hash"), F.array(attr("POSITION", c("p_brand"), F.lit(None)), attr("NORMAL", c("p_name"), c("p_type"))).alias("attrs"),
        F.array().cast("array<struct<name: string, type: string, ctype: int, norm: boolean, hash: string, near_hash: string>>").alias("morphs"),
    )


def _alike(s: SparkSession, d: str, tolerance: float) -> DataFrame:
    """(p_partkey, n): how many meshes have the signature of each."""
    signed = signatures.mesh_signatures(signatures.primitive_signatures(_primitives(s, d), tolerance))
    n = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return signed.join(n, "signature").select(c("mesh_ix").alias("p_partkey"), "n")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_name, p_size) AS n FROM part")
def mesh_signature(s, d):
    return _alike(s, d, 0.0)


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_type, p_size) AS n FROM part")
def signature_tolerance(s, d):
    return _alike(s, d, 0.5)


@query("SELECT CAST(round(CAST(embedding[1] AS DOUBLE) / 0.05) AS BIGINT) AS qx, CAST(round(CAST(embedding[2] AS DOUBLE) / 0.05) AS BIGINT) AS qy, CAST(round(CAST(embedding[3] AS DOUBLE) / 0.05) AS BIGINT) AS qz, count(*) AS n FROM embeddings GROUP BY ALL")
def normal_quantise(s, d):
    q = [transforms.quantised(c("embedding")[i], 0.05).alias(n) for i, n in enumerate(("qx", "qy", "qz"))]
    return embeddings(s, d).select(*q).groupBy("qx", "qy", "qz").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT vec_id, CAST(round(CAST(embedding[1] AS DOUBLE) / 0.5) AS BIGINT) AS x, CAST(round(CAST(embedding[2] AS DOUBLE) / 0.5) AS BIGINT) AS y, CAST(round(CAST(embedding[3] AS DOUBLE) / 0.5) AS BIGINT) AS z, label FROM embeddings),
f AS (SELECT *, min(vec_id) OVER (PARTITION BY label, x, y, z) AS first FROM q)
SELECT label, vec_id, CAST(dense_rank() OVER (PARTITION BY label ORDER BY first) - 1 AS INTEGER) AS new_ix FROM f""")
def weld_vertices(s, d):
    q = [transforms.quantised(c("embedding")[i], 0.5).alias(n) for i, n in enumerate("xyz")]
    return lod.weld(embeddings(s, d).select("label", "vec_id", *q), ["label"], "vec_id").select("label", "vec_id", "new_ix")


# Boxes

_E = "CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z"
_UNION = "min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z"


def _points(s: SparkSession, d: str) -> DataFrame:
    p = boxes.point_box(*[c("embedding")[i] for i in range(3)])
    return embeddings(s, d).select("vec_id", "label", *p.columns())


def _label_boxes(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).groupBy("label").agg(*Box.named().union())


_BOXES = f"b AS (SELECT label, {_UNION} FROM (SELECT label, {_E} FROM embeddings) GROUP BY label)"


@query(f"WITH {_BOXES} SELECT * FROM b")
def box_union(s, d):
    return _label_boxes(s, d)


@query(f"SELECT {_UNION} FROM (SELECT {_E} FROM embeddings)")
def box_global(s, d):
    return _points(s, d).agg(*Box.named().union())


#: A turn of 0.6 and 0.8, a stretch along z, and a shift.
MATRIX = [0.6, 0.8, 0.0, 0.0, -0.8, 0.6, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, -2.0, 0.5, 1.0]


@query(f"""WITH {_BOXES}, p AS (SELECT label, 0.6 * x - 0.8 * y + 1 AS x, 0.8 * x + 0.6 * y - 2 AS y, 2.0 * z + 0.5 AS z FROM
(SELECT label, unnest([min_x, max_x]) AS x, min_y, max_y, min_z, max_z FROM b) CROSS JOIN LATERAL (SELECT unnest([min_y, max_y]) AS y) CROSS JOIN LATERAL (SELECT unnest([min_z, max_z]) AS z))
SELECT label, {', '.join(f'round({f}({a}), 6) AS {f}_{a}' for f in ('min', 'max') for a in 'xyz')} FROM p GROUP BY label""")
def box_transform(s, d):
    moved = Box.named().moved(MATRIX)
    return _label_boxes(s, d).select("label", *moved.columns()).select("label", *[F.round(f"{f}_{a}", 6).alias(f"{f}_{a}") for f in ("min", "max") for a in "xyz"])


@query(f"WITH {_BOXES} SELECT label, round((min_x + max_x) * 0.5, 6) AS cx, round((min_z + max_z) * 0.5, 6) AS cy, round((min_y + max_y) * 0.5, 6) AS cz, round((max_x - min_x) * 0.5, 6) AS hx, round((max_z - min_z) * 0.5, 6) AS hy, round((max_y - min_y) * 0.5, 6) AS hz FROM b")
def box_obb_axis_swap(s, d):
    o = Box.named().oriented(z_up=True)
    return _label_boxes(s, d).select("label", o.alias("o")).select("label", *[F.round(c("o")[i], 6).alias(n) for n, i in (("cx", 0), ("cy", 1), ("cz", 2), ("hx", 3), ("hy", 7), ("hz", 11))])


_SPREAD = 0.2


@query(f"WITH e AS (SELECT vec_id, label, {_E} FROM embeddings) SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.x - b.x) <= {_SPREAD} AND abs(a.y - b.y) <= {_SPREAD} AND abs(a.z - b.z) <= {_SPREAD}")
def box_similar_pairs(s, d):
    return grouping.similar_pairs(_points(s, d), ["label"], ["min_x", "min_y", "min_z"], _SPREAD, "vec_id")


@query(f"WITH {_BOXES} SELECT label, round(greatest(0.1 * sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2), 1.0), 6) AS error FROM b")
def diagonal_error(s, d):
    return _label_boxes(s, d).select("label", F.round(boxes.tileset_error(Box.named().diagonal()), 6).alias("error"))


@query("SELECT label, min(v) AS low, max(v) AS high FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label")
def box_vertex_exact(s, d):
    # The extremes of each row come first, so no row is spread out.
    e = embeddings(s, d)
    return e.groupBy("label").agg(F.min(F.array_min("embedding")).cast("double").alias("low"), F.max(F.array_max("embedding")).cast("double").alias("high"))


@query("SELECT doc_id, coalesce(quality <= toxic, false) AS valid FROM documents LEFT JOIN labels USING (doc_id)")
def box_valid(s, d):
    df = documents(s, d).select("doc_id").join(labels(s, d), "doc_id", "left")
    b = Box((c("quality"),) * 3, (c("toxic"),) * 3)
    return df.select("doc_id", b.valid().alias("valid"))


@query("""SELECT vec_id, CASE WHEN s[2] > 0 THEN round(s[1] / s[2], 4) END AS aspect FROM (SELECT vec_id, list_reverse_sort([abs(x), abs(y), abs(z)]) AS s FROM (SELECT vec_id, """ + _E + " FROM embeddings))")
def aspect_ratio(s, d):
    return _points(s, d).select("vec_id", F.round(boxes.aspect_ratio(c("min_x"), c("min_y"), c("min_z")), 4).alias("aspect"))


@query(f"WITH {_BOXES} SELECT label, round((max_x - min_x) * (max_y - min_y) * (max_z - min_z), 6) AS volume, CASE WHEN max_x - min_x >= max_y - min_y AND max_x - min_x >= max_z - min_z THEN 0 WHEN max_y - min_y >= max_z - min_z THEN 1 ELSE 2 END AS main_axis FROM b")
def box_volume(s, d):
    return _label_boxes(s, d).select("label", F.round(Box.named().volume(), 6).alias("volume"), Box.named().main_axis().alias("main_axis"))


@query(f"SELECT vec_id, round(-2 * x, 6) + 0.0 AS px, round(3 * y, 6) + 0.0 AS py, round(z, 6) + 0.0 AS pz FROM (SELECT vec_id, {_E} FROM embeddings)")
def trs_point(s, d):
    # A half turn about y by a rotation of length 2: x and z change sign, then scales 2, 3, -1.
    f = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    m = transforms.trs_matrix(f(0, 0, 0), f(0, 2, 0, 0), f(2, 3, -1))
    p = transforms.apply(c("m"), c("min_x"), c("min_y"), c("min_z"))
    return _points(s, d).withColumn("m", m).select("vec_id", *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(p, ("px", "py", "pz"))])


# Quadtree

DEPTH, MOST = 4, 10
_FROM_E = f"SELECT vec_id, {_E} FROM embeddings"
_LEVELS = [f"""o AS ({_FROM_E}), r AS (SELECT min(x) AS x0, min(z) AS z0, greatest(max(x) - min(x), max(z) - min(z)) + 0.01 AS side FROM o),
l0 AS (SELECT vec_id, x, y, z, 0 AS level, 0 AS cx, 0 AS cy, x0 AS xa, x0 + side AS xb, z0 AS za, z0 + side AS zb FROM o, r)"""]
for _n in range(1, DEPTH + 1):
    _LEVELS.append(f"""s{_n} AS (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n, (xa + xb) * 0.5 AS mx, (za + zb) * 0.5 AS mz FROM l{_n - 1}),
l{_n} AS (SELECT vec_id, x, y, z, {_n} AS level, cx * 2 + CAST(x >= mx AS INTEGER) AS cx, cy * 2 + CAST(z >= mz AS INTEGER) AS cy,
    CASE WHEN x >= mx THEN mx ELSE xa END AS xa, CASE WHEN x >= mx THEN xb ELSE mx END AS xb, CASE WHEN z >= mz THEN mz ELSE za END AS za, CASE WHEN z >= mz THEN zb ELSE mz END AS zb FROM s{_n} WHERE n > {MOST})""")
_TREE = "WITH " + ",\n".join(_LEVELS) + ",\nm AS (" + " UNION ALL ".join(f"SELECT vec_id, x, y, z, level, cx, cy FROM l{n}" for n in range(DEPTH + 1)) + f"""),
t AS (SELECT level, cx, cy, count(*) AS n, count(*) <= {MOST} OR level = {DEPTH} AS leaf, {_UNION} FROM m GROUP BY level, cx, cy)"""


def _tree(s: SparkSession, d: str) -> quadtree.Tree:
    return quadtree.build(_points(s, d), Box.named(), DEPTH, MOST)


@query(_TREE + " SELECT m.vec_id, m.level, m.cx AS x, m.cy AS y FROM m JOIN t USING (level, cx, cy) WHERE leaf")
def quadtree_leaves(s, d):
    return _tree(s, d).leaves("vec_id")


@query(_TREE + " SELECT level, cx AS x, cy AS y, n, min_x, min_y, min_z, max_x, max_y, max_z FROM t")
def quadtree_tight_bounds(s, d):
    return _tree(s, d).tiles.drop("leaf")


@query(_TREE + " SELECT 'T' || level || '_' || cx || '_' || cy || '.glb' AS tile, n, leaf FROM t")
def quadtree_tile_names(s, d):
    return _tree(s, d).tiles.select(quadtree.tile_name(c("level"), c("x"), c("y")).alias("tile"), "n", "leaf")


@query(_TREE + " SELECT vec_id, level, cx AS x, cy AS y, leaf FROM m JOIN t USING (level, cx, cy)")
def quadtree_members(s, d):
    return _tree(s, d).members(["vec_id"])


_DIAGONAL = "sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2)"


@query(_TREE + f""", e AS (SELECT level, cx AS x, cy AS y, leaf, {_DIAGONAL} AS dg, {_DIAGONAL} * CASE level WHEN 0 THEN 2.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 WHEN 3 THEN 0.1 ELSE 0.0 END AS e FROM t)
SELECT level, x, y, round(CASE WHEN NOT leaf AND e < 0.001 THEN greatest(0.05 * dg, 0.1) ELSE e END, 6) AS error FROM e""")
def tile_geometric_error(s, d):
    return quadtree.tile_errors(_tree(s, d).tiles).withColumn("error", F.round("error", 6))


@query(f"""WITH o AS (SELECT vec_id, embedding[1] AS x, embedding[3] AS z FROM embeddings), r AS (SELECT min(x) AS x0, min(z) AS z0, greatest(max(x) - min(x), max(z) - min(z)) + 0.01::FLOAT AS side FROM o)
SELECT vec_id, CAST(x >= (x0 + (x0 + side)) * 0.5::FLOAT AS INTEGER) AS x, CAST(z >= (z0 + (z0 + side)) * 0.5::FLOAT AS INTEGER) AS y FROM o, r""")
def quadtree_level1(s, d):
    o = embeddings(s, d).select("vec_id", c("embedding")[0].alias("px"), c("embedding")[2].alias("pz"))
    side = F.greatest(F.max("px") - F.min("px"), F.max("pz") - F.min("pz")) + F.lit(0.01).cast("float")
    root = o.agg(F.min("px").alias("x0"), F.min("pz").alias("z0"), side.alias("side"))
    half = F.lit(0.5).cast("float")
    mid = lambda a: (c(a) + (c(a) + c("side"))) * half
    return o.crossJoin(F.broadcast(root)).select("vec_id", (c("px") >= mid("x0")).cast("int").alias("x"), (c("pz") >= mid("z0")).cast("int").alias("y"))


@query(_TREE + " SELECT DISTINCT level, CAST(rank() OVER (ORDER BY level DESC) AS INTEGER) AS turn FROM (SELECT DISTINCT level FROM t)")
def levels_deepest_first(s, d):
    levels = quadtree.deepest_first(_tree(s, d).tiles)
    return s.createDataFrame([(n, i) for i, n in enumerate(levels, 1)], "level int, turn int")


# Trees

_NODES = "nodes AS (SELECT 'R' || r_regionkey AS node, NULL AS parent, 0.0::DOUBLE AS dx FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey * 0.5::DOUBLE FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 0.25::DOUBLE FROM customer)"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    row = lambda df, n, p, x: df.select(F.concat(F.lit(n[0]), c(n[1]).cast("string")).alias("node"), (F.concat(F.lit(p[0]), c(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent"), x.cast("double").alias("dx"))
    return row(region(s, d), ("R", "r_regionkey"), None, F.lit(0.0)).unionByName(row(nation(s, d), ("N", "n_nationkey"), ("R", "n_regionkey"), c("n_nationkey") * 0.5)).unionByName(row(customer(s, d), ("C", "c_custkey"), ("N", "c_nationkey"), F.lit(0.25)))


@query(f"WITH RECURSIVE {_NODES}, up AS (SELECT node AS top, node FROM nodes UNION ALL SELECT n.parent, up.node FROM up JOIN nodes n ON n.node = up.top WHERE n.parent IS NOT NULL) SELECT top AS node, count(*) AS n FROM up GROUP BY top")
def tree_subtree_count(s, d):
    return trees.subtree_counts(_nodes(s, d))


@query(f"WITH RECURSIVE {_NODES}, w AS (SELECT node, node AS root, 0 AS depth, dx AS x FROM nodes WHERE parent IS NULL UNION ALL SELECT n.node, w.root, w.depth + 1, w.x + n.dx FROM nodes n JOIN w ON n.parent = w.node) SELECT node, root, depth, x FROM w")
def tree_world_offset(s, d):
    nodes = _nodes(s, d)
    return trees.descend(nodes, nodes.filter("parent IS NULL"), {"x": (c("dx"), lambda above, own: above + own)})


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
def prune_empty(s, d):
    rich = supplier(s, d).filter("s_acctbal > 5000").select(c("s_nationkey").alias("node"))
    nodes = nation(s, d).select(c("n_nationkey").alias("node"), F.lit(None).cast("int").alias("parent"), "n_name")
    return trees.pruned(nodes, rich).select(c("node").alias("n_nationkey"), "n_name")


@query("SELECT p_brand, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS new_ix FROM (SELECT p_brand, min(p_partkey) AS first FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY p_brand)")
def prune_materials(s, d):
    used = part(s, d).join(lineitem(s, d).select(c("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return trees.used_first(used, "p_brand", ["p_partkey"])


@query("WITH k AS (SELECT doc_id AS node, CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS priority FROM labels UNION ALL SELECT doc_id, 3 FROM documents) SELECT node, priority FROM k WHERE priority = (SELECT min(priority) FROM k)")
def root_fallback(s, d):
    first = labels(s, d).select(c("doc_id").alias("node"), F.when(c("toxic") == 1, 1).otherwise(2).alias("priority"))
    return trees.roots_or_all(first.unionByName(documents(s, d).select(c("doc_id").alias("node"), F.lit(3).alias("priority"))))


_CHILD = "SELECT n_regionkey, n_nationkey, greatest(0.1::DOUBLE * count(c_custkey), 1.0::DOUBLE) AS e FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"


@query(f"SELECT n_regionkey, round(max(e), 6) AS child_error, round(CASE WHEN min(e) <= max(e) THEN greatest(max(e) * 1.05, max(e) + 1) ELSE min(e) END, 6) AS error FROM ({_CHILD}) GROUP BY 1")
def monotone_error(s, d):
    per = customer(s, d).groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    e = nation(s, d).join(per, "n_nationkey", "left").select("n_regionkey", F.greatest(F.coalesce("k", F.lit(0)) * 0.1, F.lit(1.0)).alias("e"))
    up = e.groupBy("n_regionkey").agg(F.max("e").alias("most"), F.min("e").alias("own"))
    return up.select("n_regionkey", F.round("most", 6).alias("child_error"), F.round(boxes.monotone(c("own"), c("most")), 6).alias("error"))


# Levels of detail


@query("SELECT CAST(i AS INTEGER) AS level, power(0.5::DOUBLE, i) AS ratio, CASE WHEN i = 0 THEN 0.0 ELSE 16.0 * power(2.0::DOUBLE, i - 1) END AS error, CASE WHEN i < 3 THEN CAST(i + 1 AS INTEGER) END AS parent FROM range(4) r(i)")
def lod_chain(s, d):
    return lod.chain(s, 3, 0.5)


@query("SELECT p_partkey, CAST(p_size % 4 AS INTEGER) AS level, round(power(0.5::DOUBLE, p_size % 4), 6) AS ratio FROM part")
def lod_ratio_pow(s, d):
    return part(s, d).select("p_partkey", (c("p_size") % 4).alias("level"), F.round(F.pow(F.lit(0.5), c("p_size") % 4), 6).alias("ratio"))


@query("SELECT level, lag(level) OVER (ORDER BY level) AS parent FROM (SELECT DISTINCT p_size % 5 + 1 AS level FROM part WHERE p_size % 5 <> 2)")
def lod_level_chain(s, d):
    return lod.present_chain(part(s, d).filter("p_size % 5 <> 2").select((c("p_size") % 5 + 1).alias("level")).distinct())


@query("SELECT p_brand, CAST(floor(ln(p_size) / ln(1.05)) AS BIGINT) AS bucket, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY ALL")
def lod4_variant(s, d):
    return lod.variant(part(s, d), "p_brand", c("p_size"), "p_partkey")


@query("SELECT p_type, CAST(floor(ln(p_retailprice / p_size) / ln(1.2)) AS BIGINT) AS bucket, min(p_partkey) AS rep, count(*) AS n FROM part GROUP BY ALL")
def lod3_class(s, d):
    return lod.kind(part(s, d), "p_type", c("p_retailprice") / c("p_size"), "p_partkey")


@query("SELECT CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 18 THEN 'medium' ELSE 'large' END AS abstract, arg_min(p_partkey, (p_size, p_partkey)) AS rep, count(*) AS n FROM part GROUP BY 1")
def lod2_abstract(s, d):
    size = F.when(c("p_size") <= 10, "small").when(c("p_size") <= 18, "medium").otherwise("large")
    return lod.abstract(part(s, d), size, "p_size", "p_partkey")


@query(f"WITH {_BOXES} SELECT label, round((min_x + max_x) * 0.5, 6) AS t_x, round((min_y + max_y) * 0.5, 6) AS t_y, round((min_z + max_z) * 0.5, 6) AS t_z, round(max_x - min_x, 6) AS s_x, round(max_y - min_y, 6) AS s_y, round(max_z - min_z, 6) AS s_z FROM b")
def lod1_proxy(s, d):
    return _label_boxes(s, d).select("label", *lod.proxy(Box.named())).select("label", *[F.round(n, 6).alias(n) for n in ("t_x", "t_y", "t_z", "s_x", "s_y", "s_z")])


@query("SELECT p_brand, arg_min(p_partkey, (round(abs(p_size - m), 9), p_partkey)) AS rep FROM (SELECT *, avg(p_size) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1")
def lod_representative_mean(s, d):
    return lod.nearest_to_mean(part(s, d), ["p_brand"], "p_size", "p_partkey")


@query("SELECT p_brand, arg_min(p_partkey, (p_size, p_partkey)) AS rep FROM part GROUP BY 1")
def lod_representative_min(s, d):
    return lod.least_of(part(s, d), ["p_brand"], "p_size", "p_partkey")


@query("SELECT p_type, " + ", ".join(f"coalesce(CAST(CAST(sum(CASE WHEN p_size % 5 + 1 = {n} THEN p_size END) AS BIGINT) AS VARCHAR), '-') AS lod{n}" for n in (5, 4, 3, 2, 1)) + " FROM part GROUP BY 1")
def lod_pivot_report(s, d):
    return reports.pivot_levels(part(s, d).withColumn("level", c("p_size") % 5 + 1), "p_type", "level", c("p_size"), [5, 4, 3, 2, 1])


@query(f"WITH {_BOXES} SELECT a.label, round(greatest(abs(a.min_x - b.min_x), abs(a.min_y - b.min_y), abs(a.min_z - b.min_z), abs(a.max_x - b.max_x), abs(a.max_y - b.max_y), abs(a.max_z - b.max_z)), 6) AS error FROM b a, (SELECT {_UNION.replace('min(x)', 'min(min_x)').replace('min(y)', 'min(min_y)').replace('min(z)', 'min(min_z)').replace('max(x)', 'max(max_x)').replace('max(y)', 'max(max_y)').replace('max(z)', 'max(max_z)')} FROM b) b")
def lod_box_error(s, d):
    one = _label_boxes(s, d)
    whole = _points(s, d).agg(*Box.named().union()).select(*Box.named().columns("g_"))
    return one.crossJoin(F.broadcast(whole)).select("label", F.round(lod.box_error(Box.named(), Box.named("g_")), 6).alias("error"))


# Reports


@query("""WITH g AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT (SELECT count(*) FROM supplier) AS input_models, (SELECT count(*) FROM lineitem) AS initial_nodes, (SELECT count(*) FROM part) AS initial_meshes,
(SELECT count(*) FROM orders) AS initial_instances, count(*) FILTER (n >= 12) AS instanced_groups, coalesce(sum(n) FILTER (n >= 12), 0)::BIGINT AS final_instances, coalesce(sum(n) FILTER (n < 12), 0)::BIGINT AS non_instanced FROM g),
f AS (SELECT *, instanced_groups + non_instanced AS final_nodes, instanced_groups + non_instanced AS final_meshes, final_instances + non_instanced AS total_displayed FROM k)
SELECT *, round(CASE WHEN initial_nodes > 0 THEN (1 - final_nodes / initial_nodes) * 100 ELSE 0 END, 2) AS node_reduction, round(CASE WHEN total_displayed > 0 THEN initial_instances / total_displayed * 100 ELSE 0 END, 2) AS initial_ratio,
round(CASE WHEN total_displayed > 0 THEN final_instances / total_displayed * 100 ELSE 0 END, 2) AS final_ratio, round(CASE WHEN total_displayed > 0 THEN final_instances / total_displayed * 100 - initial_instances / total_displayed * 100 ELSE 0 END, 2) AS increase FROM f""")
def instancing_report(s, d):
    count = lambda t, n: t(s, d).agg(F.count(F.lit(1)).alias(n))
    g = group_exact(s, d)
    big = c("n") >= LIMIT
    df = g.agg(F.count_if(big).alias("instanced_groups"), F.coalesce(F.sum(F.when(big, c("n"))), F.lit(0)).alias("final_instances"), F.coalesce(F.sum(F.when(~big, c("n"))), F.lit(0)).alias("non_instanced"))
    for t, n in ((supplier, "input_models"), (lineitem, "initial_nodes"), (part, "initial_meshes"), (orders, "initial_instances")):
        df = df.crossJoin(count(t, n))  # one row each
    return reports.instancing(df)


_TRIS = "CAST(floor(l_quantity / 3) AS BIGINT)"


@query(f"SELECT l_suppkey, count(DISTINCT l_partkey) AS unique_meshes, CAST(sum(l_linenumber) AS BIGINT) AS instances, CAST(sum({_TRIS}) AS BIGINT) AS stored, CAST(sum({_TRIS} * l_linenumber) AS BIGINT) AS rendered, round(CASE WHEN sum({_TRIS} * l_linenumber) > 0 THEN sum({_TRIS}) / sum({_TRIS} * l_linenumber) ELSE 1.0 END, 4) AS ratio FROM lineitem GROUP BY 1")
def tile_stats(s, d):
    return reports.tile_stats(lineitem(s, d), ["l_suppkey"], reports.triangles(c("l_quantity")), c("l_linenumber"), "l_partkey")


@query(f"SELECT l_partkey, CAST(sum({_TRIS}) AS BIGINT) AS triangles FROM lineitem GROUP BY 1")
def triangle_count(s, d):
    return lineitem(s, d).groupBy("l_partkey").agg(F.sum(reports.triangles(F.lit(None).cast("double"), c("l_quantity"))).alias("triangles"))


@query(f"SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE {_TRIS} END) AS BIGINT) AS triangles FROM lineitem GROUP BY 1")
def triangle_count_indexed(s, d):
    indices = F.when(c("l_returnflag") != "N", c("l_quantity"))
    return lineitem(s, d).groupBy("l_partkey").agg(F.sum(reports.triangles(indices)).alias("triangles"))


@query("SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS vertices FROM lineitem GROUP BY 1")
def vertex_count(s, d):
    prims = lineitem(s, d).select(F.lit(0).alias("model_id"), c("l_partkey").alias("mesh_ix"), c("l_quantity").cast("long").alias("n_vertices"))
    return scenes.vertex_counts(prims).select(c("mesh_ix").alias("l_partkey"), c("n_vertices").alias("vertices"))


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) ORDER BY n DESC, p_brand, p_type LIMIT 50")
def report_top50(s, d):
    return reports.top(group_exact(s, d).select(*KEY, "n"), [F.desc("n"), c("p_brand"), c("p_type")])[0]


# Layout and plain expressions


@query("SELECT doc_id, CAST(coalesce(sum(CAST(ceil(n_chars / 4.0) * 4 AS BIGINT)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM documents")
def buffer_offsets(s, d):
    return layout.buffer_offsets(documents(s, d).select("doc_id", "n_chars"), ["doc_id"], "n_chars", "offset_").select("doc_id", "offset_")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS id FROM part")
def surrogate_ids(s, d):
    return layout.numbered(part(s, d).select("p_partkey", "p_name"), ["p_name", "p_partkey"], "id").select("p_partkey", "id")


@query("SELECT p_partkey, i AS instance_ix, CAST(2 * i + 5 AS DOUBLE) AS x FROM (SELECT p_partkey, CAST(unnest(range(0, p_size)) AS INTEGER) AS i FROM part)")
def ext_unpack(s, d):
    """A model per part with one node, moved by 5 and twice as large, that has the part's size in instances, each turned by nothing."""
    doubles = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    none = F.lit(None)
    at = F.transform(F.sequence(F.lit(0), c("p_size") - 1), lambda i: F.struct(F.array(i.cast("double"), F.lit(0.0), F.lit(0.0)).alias("t"), doubles(0, 0, 0, 3).alias("r"), doubles(1, 1, 1).alias("s")))
    node = F.struct(
        F.lit(0).alias("node_ix"), none.cast("int").alias("parent_ix"), none.cast("int").alias("child_ord"), F.lit(0).alias("root_ord"), none.cast("string").alias("name"), F.lit(0).alias("mesh_ix"),
        doubles(5, 0, 0).alias("t"), none.cast("array<double>").alias("r"), doubles(2, 2, 2).alias("s"), none.cast("array<double>").alias("matrix"), F.lit(True).alias("instanced"), F.lit(1).alias("visits"), at.alias("instances"),
    )
    placed = scenes.placements(part(s, d).filter("p_size > 0").select(c("p_partkey").alias("model_id"), F.array(node).alias("nodes")))
    return placed.select(c("model_id").alias("p_partkey"), c("trav_ord")[1].alias("instance_ix"), c("world")[12].alias("x"))


@query("SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS category FROM documents d LEFT JOIN labels l USING (doc_id)")
def semantic_lookup(s, d):
    of = labels(s, d).select(c("doc_id").alias("actor_hash"), c("quality").cast("string").alias("category"))
    return semantics.with_semantics(documents(s, d).select("doc_id"), of, "doc_id").select("doc_id", "category")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def semantic_last_wins(s, d):
    blocks = events(s, d).select(F.lit("").alias("path"), c("event_id").alias("ix"), c("user_id").alias("actor_hash"), c("event_type").alias("category"), F.lit("").alias("family"), F.lit("").alias("type"))
    return semantics.last_blocks(blocks).select(c("actor_hash").alias("user_id"), c("category").alias("event_type"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g') AS file_name FROM part")
def name_sanitise(s, d):
    return part(s, d).select("p_partkey", sanitised(c("p_name")).alias("file_name"))


_LINE = "p_name || ' , ' || CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand || ',' || p_type || ' ' END"


@query(f"WITH l AS (SELECT p_partkey, {_LINE} AS line FROM part), p AS (SELECT p_partkey, trim(substr(line, 1, strpos(line, ',') - 1)) AS name, trim(substr(line, strpos(line, ',') + 1)) AS component_id FROM l WHERE strpos(line, ',') > 0) SELECT * FROM p WHERE name <> '' AND component_id <> ''")
def csv_split_first_comma(s, d):
    from mosaiq.sources.lists import parse_lines

    line = F.concat(c("p_name"), F.lit(" , "), F.when(c("p_size") % 7 == 0, "").otherwise(F.concat(c("p_brand"), F.lit(","), c("p_type"), F.lit(" "))))
    return parse_lines(part(s, d).select("p_partkey", line.alias("value"))).select("p_partkey", "name", "component_id")


@query("SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1")
def extension_union(s, d):
    return lineitem(s, d).groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
