"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import collocations


def plain_phrases(rows, longest, least):
    """(lang, words): n of all frequent phrases, and the number of words per lang."""
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                found.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return {k: n for k, n in found.items() if n >= least}, {k: n for k, n in totals.items() if n}


def plain_collocations(found, totals, within, most):
    rows = []
    for (lang, words), a in found.items():
        if len(words) == 1:
            continue
        longer = [n for (of, w), n in found.items() if of == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if any(100 * n >= within * a for n in longer):
            continue
        cuts = [(1000 * a * totals[lang] // (found[lang, words[:k]] * found[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, " ".join(words), a, found[lang, words[:k]], found[lang, words[k:]], totals[lang], score))
    out = []
    for lang in totals:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[-1], -r[2], r[1].encode()))[:most]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "THE", "of", "new", "york", "a\x01", "a", "\x01b", "é", "city", "\U0001f926", "São", "paulo"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.4:
            words += "in the great state of new york today".split()
        rows.append((rng.choice(["en", "fr", None, ""]), "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "  "]) for w in words)))
    return [*rows, ("en", None), (None, None), ("en", ""), ("de", " ., \n"), ("en", "x " * 500), *[("fr", "one two three")] * 9]


@pytest.fixture
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, words string").repartition(3)


@pytest.mark.parametrize("longest,least,within", [(5, 4, 100), (3, 6, 60), (5, 40, 100)])
def test_collocations_equal_plain_counting(spark, rows, longest, least, within, monkeypatch):
    if within == 60:
        # Many small shards, and bitmaps in which most bits are set.
        monkeypatch.setattr(collocations, "SHARD", 300)
    found, totals = plain_phrases(rows, longest, least)
    phrases, sums = collocations.mine(frame(spark, rows), longest, least)
    assert {(r.lang, tuple(r.words)): r.n for r in phrases.collect()} == found
    assert {r.lang: r.total for r in sums.collect() if r.total} == totals
    got = collocations.collocations(frame(spark, rows), 7, longest, least, within)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(found, totals, within, 7)


def test_false_hits_of_the_bitmaps_change_nothing(spark, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "_bitmap", lambda h: np.full(1 << (collocations.BITS - 6), 2**64 - 1, np.uint64))
    phrases, _ = collocations.mine(frame(spark, rows), 4, 5)
    assert {(r.lang, tuple(r.words)): r.n for r in phrases.collect()} == plain_phrases(rows, 4, 5)[0]


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", ["a"], 3 * 10**12), ("x", ["b"], 2 * 10**12 + 1), ("x", ["a", "b"], 10**12 + 7)], "lang string, words array<string>, n long")
    totals = spark.createDataFrame([("x", 9 * 10**14 + 1)], "lang string, total long")
    (r,) = collocations.scored(phrases, totals).collect()
    assert r.score == 1000 * (10**12 + 7) * (9 * 10**14 + 1) // (3 * 10**12 * (2 * 10**12 + 1))


def test_empty_tables(spark, rows):
    df = frame(spark, rows)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_a_shard_gives_a_row_for_each_part_of_the_prefixes(spark, monkeypatch):
    """Not one for each projection, of which there are the more the more phrases are frequent."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(12)}" for _ in range(400))) for _ in range(40)]
    made = []
    real = collocations.projections
    monkeypatch.setattr(collocations, "projections", lambda *a: made.append(real(*a)) or made[-1])
    phrases, _ = collocations.mine(frame(spark, rows), 5, 4)
    assert {(r.lang, tuple(r.words)): r.n for r in phrases.collect()} == plain_phrases(rows, 5, 4)[0]
    assert made[0].count() <= made[0].rdd.getNumPartitions() * collocations.SPREAD * collocations.partitions(spark) < phrases.count()


def test_arrays_of_a_shard_stay_below_a_worker_s_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 700) % 10**6).encode() for _ in range(collocations.SHARD // 3500)]
    tracemalloc.start()
    collocations.Tokens(["en"] * len(texts), texts).hashes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
