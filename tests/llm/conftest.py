import pytest

#: Columns whose names the operators use themselves.
EXTRA = {"fp": 1, "key": 2, "spans": "x", "n_words": 3, "kept": True, "score": 0.5, "__t": "y", "rid": 9, "__row": 4}


def rows_with_odd_cases():
    """(doc_id, text): nulls, empties, copies, ties, repeated rows, a long text."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(300)
    passage = prose(80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (5, base), (6, base + " end"), (None, base), (None, None)]
    rows += [(7, prose(60) + "\n" + passage + "\n" + prose(60)), (8, prose(30) + "\n" + passage), (9, passage[:400] + prose(90)), (10, "x"), (11, "ab " * 400)]
    rows += [(12, "é" * 150 + " " + prose(20) + " token = '" + "a1B2c3D4e5F6g7H8i9J0" + "' 0123456789abcdef00 AKIA" + "Z" * 16), (13, prose(20000)), (14, "z" * 3000), (15, "\U0001f926 " + base.upper())]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en" if d else None, None if d == 4 else "s", None if t is None else len(t), *EXTRA.values()) for d, t in rows_with_odd_cases()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, spans string, n_words long, kept boolean, score double, __t string, rid long, __row long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0).cache()
