import random

import pytest

import corpus_pipeline
from mosaiq.llm import similar


def plain_set(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(s, t):
    return len(s & t) / len(s | t) if s | t else 1.0


def plain_classes(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    group = {d: d for d, _ in sets}
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if group[i] != group[j] and similarity(s, t) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = {d: a if g == b else g for d, g in group.items()}
    return group


def texts(n):
    """Texts on few bases, with up to 14 words of 200 changed: similarities from 0.5 to 1 on both sides of 0.8."""
    rng = random.Random(7)
    bases = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(n // 20)]
    rows = []
    for d in range(n):
        words = list(bases[d % len(bases)])
        for at in rng.sample(range(200), rng.randrange(15)):
            words[at] = f"x{rng.randrange(5000)}"
        rows.append((d, " ".join(words)))
    return rows + [(n, ""), (n + 1, " \n"), (n + 2, "one two"), (n + 3, "One  two")]


@pytest.mark.parametrize("limits", [(8, 2048), (1, 5)])
def test_classes_equal_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(similar, "PAIRS", limits[0])
    monkeypatch.setattr(similar, "LOCAL", limits[1])
    rows = texts(120)
    sets = [plain_set(t) for _, t in rows]
    near = [similarity(s, t) for k, s in enumerate(sets) for t in sets[:k]]
    assert any(0.8 <= x < 0.9 for x in near) and any(0.7 < x < 0.8 for x in near)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == plain_classes(rows)


def test_pipeline_stage_takes_pairs_of_four_fifths_and_no_less(spark, data):
    rng = random.Random(3)
    words = [f"w{rng.randrange(9000)}" for _ in range(204)]
    change = lambda n: " ".join("y%d" % k if k % 10 == 4 and k < 10 * n else w for k, w in enumerate(words))
    rows = [(1, change(0)), (2, change(4)), (3, change(6))]
    s = [plain_set(t) for _, t in rows]
    assert 0.8 <= similarity(s[0], s[1]) < 0.85 and 0.7 < similarity(s[0], s[2]) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = {r.doc_id for r in stage(spark, df, data).collect()}
    assert kept == {d for d, g in plain_classes(rows).items() if d == g}
    assert 2 not in kept


def test_short_texts_are_verified_whatever_their_bits(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    far = 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 1 << 64, 5, np.uint64, endpoint=False))
        x, y = (np.frombuffer(similar.signature(s)[0], np.uint64) for s in (a, a[:4]))
        far += int(np.bitwise_count(x ^ y).sum()) > similar.FLOOR
        n, m = np.array([len(a)]), np.array([4])
        assert similar._worth(x[None], y[None], n, m).all()
    assert far > 0
    x, y = np.zeros((3, similar._WORDS), np.uint64), np.full((3, similar._WORDS), 2**64 - 1, np.uint64)
    assert similar._worth(x, y, np.array([63, 64, 4]), np.array([64, 64, 6])).tolist() == [True, False, False]


def test_the_first_key_is_the_least_common_variant_of_the_first_table(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    nodes = []
    for _ in range(12):
        a = np.unique(rng.integers(0, 1 << 64, 30, np.uint64, endpoint=False))
        nodes += [a, a[1:], a[:-2]]
    signed = [similar.signature(g) for g in nodes]
    df = spark.createDataFrame([(k, bytearray(s), bytearray(c)) for k, (s, c) in enumerate(signed)], "node long, sig binary, close binary")
    keys = {k: set() for k in range(len(nodes))}
    for r in similar._variants(df, range(similar.TABLES)).collect():
        keys[r.node].add(r.key)
    values, close = (np.array([np.frombuffer(x[i], ">u4") for x in signed]).astype(np.uint32) for i in (0, 1))
    met = 0
    for k in keys:
        for j, first in enumerate(similar._first_key(values[k], values, close[k], close).tolist()):
            both = keys[k] & keys[j]
            least = min((x >> similar.BITS for x in both), default=None)
            # Equal fingerprints meet at all of their variants; they count as met at themselves.
            alike = least is not None and values[k][least] == values[j][least]
            assert first == (-1 if not both else (least << similar.BITS) + int(values[k][least]) if alike else min(both))
            met += bool(both) and j != k
    assert met > 30


def test_odd_rows(odd, none):
    out = similar.drop_copies(odd)
    assert out.columns == odd.columns
    assert out.filter("doc_id IS NULL").count() == odd.filter("doc_id IS NULL").count()
    assert {r.doc_id for r in out.collect()} == {None, *(d for d, g in plain_classes(sorted({(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id})).items() if d == g)}
    assert similar.drop_copies(none).count() == 0


def test_rows_that_share_only_their_doc_id_stay(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, a), (2, b + " more"), (3, c), (3, c + " more"), (4, None), (4, ""), (5, " ")]
    out = similar.drop_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.text for r in out if r.doc_id == 1} == {a, b} and len(out) == 4

    assert {r.doc_id for r in out} == {1, 3, 4}


def test_pairs_of_short_texts_are_all_found(spark):
    """Fingerprints of 5 shingles and 4 of them meet with a chance of 0.82 only."""
    rng = random.Random(13)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == {d: d - d % 2 for d, _ in rows}


@pytest.mark.parametrize("limits", [(8, 2048), (1, 5)])
def test_what_fingerprints_miss_is_found_by_shingles(spark, monkeypatch, limits):
    """All links, with no bucket of fingerprints at all."""
    monkeypatch.setattr(similar, "PAIRS", limits[0])
    monkeypatch.setattr(similar, "LOCAL", limits[1])
    none = spark.createDataFrame([], "key long, node long, n long, centre long")
    monkeypatch.setattr(similar, "_buckets", lambda nodes: similar.stored(none, "buckets"))
    rows = texts(80)
    rows += [(1000 + d, t + f" tail{d}") for d, t in rows[:20]] + [rows[3], (5, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # A doc_id with two texts has a class for each.
    found = {(r.doc_id, r.component_id) for r in similar.near_copies(df).collect()}
    expected = plain_classes([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (d, _) in enumerate(rows):
        least[expected[i]] = min(least.get(expected[i], d), d)
    assert found == {(d, least[expected[i]]) for i, (d, _) in enumerate(rows)}


def test_nodes_of_one_fingerprint_have_the_variants_of_one(spark):
    """Two fingerprints one bit apart, fifty nodes each: every node meets once a table, not at every variant."""
    n = 100
    sig = [bytearray([0x55] * (similar._WORDS * 8)), bytearray([0x54, 0x55, 0x55, 0x55] * (similar._WORDS * 2))]
    close = bytearray([0xFF, 0, 0, 0] * (similar._WORDS * 2))
    nodes = spark.createDataFrame([(k, sig[k % 2], close) for k in range(n)], "node long, sig binary, close binary")
    met = similar._buckets(nodes).collect()
    assert len(met) <= n * similar.TABLES
    linked = {(r.node, r.centre) for r in met if r.node != r.centre}
    assert {a for a, _ in linked} == set(range(1, n)) and (1, 0) in linked


def test_shingles_shared_by_the_same_nodes_are_compared_once(spark, monkeypatch):
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(d, " ".join(f"x{d}" if k in {d, 60 + d, 120 + d, 150 + d, 180 + d} else w for k, w in enumerate(base))) for d in range(12)]
    monkeypatch.setattr(similar, "PAIRS", 2)
    seen = []
    real = similar._block_links
    monkeypatch.setattr(similar, "_block_links", lambda met, ready: seen.extend(met.collect()) or real(met, ready))
    none = spark.createDataFrame([], "key long, node long, n long, centre long")
    monkeypatch.setattr(similar, "_buckets", lambda nodes: similar.stored(none, "buckets"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == plain_classes(rows)
    groups = {}
    for r in seen:
        groups.setdefault(r.gram, set()).add(r.node)
    assert groups and len({frozenset(g) for g in groups.values()}) == len(groups)
