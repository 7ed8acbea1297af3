import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from mosaiq.llm import classifier, components, decontaminate, pieces, repeats, rollups, rules, secrets, simhash, suffixes, tokenfiles, warc


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


# 1


def plain_spans(t):
    out = []
    for kind, (p, group, least) in secrets.BASE.items():
        out += [(m.start(), secrets.KINDS.index(kind), m.end(), kind) for m in re.finditer(p, t) if len(m[group]) >= least]
    for kind, (p, least, _) in secrets.CLASSES.items():
        for m in re.finditer(p, t):
            if not re.search(secrets.ALLOW, m[0]):
                w = secrets.WINDOW
                h = max(-sum(c / w * math.log2(c / w) for c in collections.Counter(m[0][i : i + w]).values()) for i in range(len(m[0]) - w + 1))
                if h >= least:
                    out.append((m.start(), secrets.KINDS.index(kind), m.end(), kind))
    return sorted(out)


def test_secrets_equal_plain_scan(spark):
    rng = random.Random(4)
    bits = ["token=", "password: ", "API_KEY = '", "AKIA", "deadbeef", "0123", "a1b2C3d4", "é", "\U0001f926", " ", "\n", "=", "passwd=abc", "AKIAAKIA", "zz", "Secret", "\""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts.append("".join(rng.choice("abc0123456789XYZ+/ ") for _ in range(30000)))
    texts.append(" ".join(f"{rng.getrandbits(80):020x}" for _ in range(1500)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in secrets.scan_secrets(df).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans if k in secrets.BASE)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    for r in secrets.redact_secrets(df).collect():
        out, at = "", 0
        t = texts[r.doc_id]
        for s, _, e, _ in plain_spans(t):
            if s > at or not out and s == at == 0 or s == at and not out.endswith("[SECRET]"):
                out += t[at:s] + "[SECRET]"
            elif s < at or s == at:
                pass
            at = max(at, e)
        assert r.text == out + t[at:]


def test_redaction_keeps_rows_and_columns(odd, none):
    out = secrets.redact_secrets(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert "AKIA" not in out.filter("doc_id = 12").first().text
    same([(r.doc_id, r.text) for r in out.filter("doc_id <> 12 OR doc_id IS NULL").collect()], [x for x in pairs(odd) if x[0] != 12])
    assert secrets.redact_secrets(none).count() == 0


# 2


@pytest.mark.parametrize("high", [1, 2, 300, 50000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n)
    x = rng.integers(0, high, n, dtype=np.uint32)
    x[rng.random(n) < 0.05] = 2**32 - 1
    data, starts = tokenfiles.pack(x)
    assert (tokenfiles.unpack(data, starts) == x).all()
    f = tokenfiles.to_file([None, 5], [x, x[: n // 2]])
    assert [(d, y.tolist()) for d, y in tokenfiles.from_file(f)] == [(None, x.tolist()), (5, x[: n // 2].tolist())]
    assert tokenfiles.read_range(f, n // 3, n).tolist() == x[n // 3 :].tolist()


def test_token_files_equal_the_tokenizer(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = tokenfiles.read_files(tokenfiles.write_files(odd, path), with_ids=True).collect()
    rows = sorted(pairs(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    expected = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    same([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got], expected)
    assert tokenfiles.read_files(tokenfiles.write_files(none, path)).count() == 0


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, w, rng = Tokenizer.from_file(path), tokenfiles.WordEncoder(path), random.Random(1)
    w.MOST = 2000
    bits = ["a", "A", "'s", "ét", "Σσς", " ", "\n", "\t", "́", "İ", "<|endoftext|>", "<|startoftext|>", "1", "..", ",", "!", "中", "\x85", "\x1c", "ß", "The", "x" * 150]
    for _ in range(1500):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(w([x])[0], np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids, x


# 3


def test_every_rule_of_the_current_policy_can_reject(spark):
    rng = random.Random(2)
    words = [f"{rng.choice('abcdefghij')}{rng.choice('klmnop')}w{k}" for k in range(100)]
    texts = {
        None: " ".join(words), "few_words": "one two three", "repeated_words": "a bc d " * 40, "symbols": " ".join(w + "#" for w in words), "shouting": " ".join(words).upper(),
        "repeated_lines": "\n".join([" ".join(words)] + ["same line"] * 7), "word_length": " ".join(w + "x" * 12 for w in words),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.fail_bits) for r in rules.apply_policy(rules.ledger(df)).collect()}
    assert got[0] == (True, 0)
    for i, name in list(enumerate(texts))[1:]:
        assert got[i][0] is False and got[i][1] & rules.BIT[name], name
    rows = {r.rule: r for r in rules.ablations(rules.ledger(df)).collect()}
    assert rows["word_length"].n_kept_without == rows["word_length"].n_kept + 1


def test_token_counts_follow_revisions_and_deletions(spark, tmp_path):
    rows = [(1, "a b c", "s", "en"), (2, "d e", "s", None), (3, " ", "s", "en"), (4, None, None, "en"), (5, "f", None, "en"), (5, "f", None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in rollups.query(spark, str(tmp_path)).collect()]
    words = [("s", "en", "words-1", 1, 3, 5), ("s", None, "words-1", 1, 2, 3), (None, "en", "words-1", 2, 2, 2)]
    same(got, words + [(s, g, "word_bpe_49k", n, t, c) for s, g, _, n, t, c in words])


def test_rules_keep_clean_rows(odd, none):
    out = rules.keep_good(odd)
    assert out.columns == odd.columns
    book = {r.doc_id: r for r in rules.apply_policy(rules.ledger(odd)).collect() if r.doc_id is not None}
    same([(r.doc_id,) for r in out.filter("doc_id IS NOT NULL").select("doc_id").distinct().collect()], [(d,) for d, r in book.items() if r.kept])
    assert {4, 5, 6, 7} <= {d for d, r in book.items() if r.kept} and not {1, 2, 3, 11, 15} & {d for d, r in book.items() if r.kept}
    assert rules.keep_good(none).count() == 0 and {r.n_docs for r in rules.ablations(rules.ledger(none)).collect()} == {0}


# 4


def test_classifier_learns_and_scores_everything(spark, odd, none):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() + ("***" if i % 2 else "") for _ in range(60)), 1 - i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (99999, 0)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = {r.doc_id: r for r in model.score_documents(docs).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 80 and np.mean([got[d].predicted == q for d, _, q in held]) > 0.97
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in held)
    out = model.score_documents(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert model.score_documents(none).count() == 0
    flat = classifier.train(docs, labels.limit(0))
    assert {r.score for r in flat.score_documents(docs).collect()} == {0.5}


# 5


def plain_fingerprint(t, k=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    rows = [(d, plain_fingerprint(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return [(d, f, least.get(g)) for (d, f), g in zip(rows, group)]


def test_near_duplicates_equal_plain_classes(odd, none):
    got = [(r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    same(got, plain_classes(pairs(odd)))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limits", [(8, 4096), (2, 5), (0, 0)])
def test_links_in_buckets_of_every_size(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "PAIRS", limits[0])
    monkeypatch.setattr(simhash, "LOCAL", limits[1])
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        b = rng.getrandbits(64)
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    root = {r.node & 0xFFFFFFFFFFFFFFFF: r.root for r in components.components(simhash.near_links(df)).collect()}
    got = collections.defaultdict(set)
    for x in fps:
        got[root.get(x, x)].add(x)
    left, expected = set(fps), []
    while left:
        edge = [left.pop()]
        seen = set(edge)
        while edge:
            x = edge.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            seen |= near
            edge += near
        expected.append(seen)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected))


def test_components_of_a_long_chain(spark):
    n = 120
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (500, 501), (501, 500)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500, 501: 500}


# 6


def plain_removed(rows, keep_first):
    texts = [(t or "").encode() for _, t in rows]
    w = repeats.WINDOW
    count = collections.Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    first, out = set(), []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            x = t[i : i + w]
            if count[x] > 1 and (not keep_first or x in first):
                gone[i : i + w] = b"\1" * w
            first.add(x)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


ALL = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
LATER = ("doc_id", "n_bytes", "n_removed_later", "n_spans_later", "first_kept_sha256")


@pytest.mark.parametrize("kinds", [64, 1])
def test_repeats_equal_all_windows(odd, none, monkeypatch, kinds):
    monkeypatch.setattr(repeats, "KINDS", kinds)
    got = repeats.remove_repeats(odd, keep_first=False, with_text=False).collect()
    same([tuple(r[c] for c in ALL) for r in got], plain_removed(pairs(odd), False))
    named = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = repeats.remove_repeats(named, keep_first=True).collect()
    same([tuple(r[c] for c in LATER) for r in got], plain_removed(sorted(pairs(named)), True))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.first_kept_sha256 for r in got if r.text.isascii())
    assert repeats.remove_repeats(none).count() == 0


def test_first_occurrence_is_that_of_the_least_doc_id(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    rows = [(d, f"{word()} {passage} {word()}") for d in ("b", "01", "1", "a", None, "c")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    assert [r.doc_id for r in got if not r.n_removed_later] == ["01"] and all(r.n_removed for r in got)
    rows = [(7, passage), (7, f"x {passage}"), (3, f"y {passage}"), (7, passage)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect()
    assert sum(not r.n_removed_later for r in got) == 1 and next(r.doc_id for r in got if not r.n_removed_later) == 3


@pytest.mark.parametrize("kinds", [64, 3])
def test_a_passage_in_very_many_documents(spark, monkeypatch, tmp_path, kinds):
    monkeypatch.setattr(repeats, "KINDS", kinds)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, near = prose(60), prose(45)
    rows = [(d, f"{prose(8)} {passage} {prose(8)} {near[d % 7 :]}{d % 3}") for d in range(150)] + [(900, prose(100))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = repeats.query(spark, str(tmp_path)).collect()
    same([tuple(r[c] for c in ALL) for r in got], plain_removed(rows, False))
    same([tuple(r[c] for c in LATER) for r in got], plain_removed(rows, True))


def common(text, i, j):
    n = 0
    while max(i, j) + n < len(text) and text[i + n] == text[j + n] and text[i + n] >= 0:
        n += 1
    return n


@pytest.mark.parametrize("sizes", [(40, 0, 25, 1, 60), (0,), (1, 1), (90,)])
@pytest.mark.parametrize("letters", [b"ab", b"a", b"abcdefgh\0\xff"])
def test_factors_equal_brute_force_at_all_lengths(sizes, letters):
    rng = random.Random(9)
    parts = [bytes(rng.choice(letters) for _ in range(n)) for n in sizes]
    s = suffixes.of_bytes(parts)
    text = [c for k, p in enumerate(parts) for c in (*p, -1)]
    assert s.begin.tolist() == [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
    places = [i for i, c in enumerate(text) if c >= 0]
    for starts in (places, places[::3], places[::-1]):
        length, source = repeats.previous_factors(s, np.array(starts, np.int64))
        after = repeats.following_factors(s, np.array(starts, np.int64))
        for i, n, p, m in zip(starts, length.tolist(), source.tolist(), after.tolist()):
            assert n == max((common(text, i, j) for j in starts if j < i), default=0)
            assert m == max((common(text, i, j) for j in starts if j > i), default=0)
            assert (p < 0 and n == 0) or (p < i and common(text, i, p) == n)
    earlier, any_ = repeats.matched_windows(parts, 5)
    windows = [p[i : i + 5] for p in parts for i in range(len(p) - 4)]
    assert earlier.tolist() == [w in windows[:k] for k, w in enumerate(windows)]
    assert any_.tolist() == [windows.count(w) > 1 for w in windows]


def test_previous_smaller_positions():
    rng = random.Random(5)
    for n in (0, 1, 2, 50, 400):
        for v in (rng.sample(range(n), n), list(range(n)), list(range(n))[::-1]):
            got = repeats.previous_smaller(np.array(v, np.int64)).tolist()
            assert got == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]


# 7


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 3000)
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nX: y ", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "ü", "é" * 50 + "\r\n\r\n"), (8, "u", "é" * 50 + "\r\n\r\n"), (1, None, big), (None, "n", big)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    out = warc.read_archives(warc.normalise_archives(warc.write_archives(warc.with_originals(df))))
    expected = []
    for p, _, h in rows:
        body = (h or "").encode()
        first = min((q for q, _, g in rows if g == h and q is not None), default=None)
        again = len(body) >= 100 and first != p
        expected.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    same([tuple(r) for r in out.collect()], expected)
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(warc.with_originals(df.limit(0))))).count() == 0


def test_normaliser_makes_members():
    import gzip
    import io
    import json

    records = [warc.record(i, f"http://x/{i}", b"payload %d" % i, hashlib.sha256(b"payload %d" % i).hexdigest(), None) for i in range(20)]
    whole = gzip.compress(b"".join(records))
    pieces_of = lambda x: (x[i : i + 7] for i in range(0, len(x), 7))
    data, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise(pieces_of(whole), data, index) == 20
    places = list(map(json.loads, index.getvalue().splitlines()))
    assert [gzip.decompress(data.getvalue()[p["offset"] : p["offset"] + p["length"]]) for p in places] == records
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[0][:-5]])))
    for cut in (whole[:-1], whole[:-9], whole[: len(whole) // 2], b""):
        with pytest.raises(ValueError):
            list(warc.inflate(pieces_of(cut)))
    # Members that end where records end: a cut within the last one shows though all before it are whole.
    members = [gzip.compress(r) for r in records]
    assert b"".join(warc.inflate(pieces_of(b"".join(members)))) == b"".join(records)
    with pytest.raises(ValueError):
        list(warc.inflate(iter([b"".join(members[:-1]) + members[-1][:-8]])))
    large = bytes(1 << 22)
    assert b"".join(warc.inflate(iter([gzip.compress(large)]))) == large


def test_archives_take_odd_pages(spark):
    schema = "page_id long, url string, html string, rid long, file string"
    rows = [(None, None, None, 1, "x"), (None, None, "a" * 300, None, "y"), (5, "", "a" * 300, 2, None), (5, "", "a" * 300, 2, None), (6, "u", "\r\n\r\nWARC/1.1" * 9000, 3, "z")]
    df = spark.createDataFrame(rows, schema)
    got = warc.read_archives(warc.normalise_archives(warc.write_archives(warc.with_originals(df)))).collect()
    same([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got], [(None, 0, "response", None), (None, 300, "revisit", 5), (5, 300, "response", None), (5, 300, "response", None), (6, 12 * 9000, "response", None)])


# 8


def test_pieces_equal_the_library(odd, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path), random.Random(6)
    bits = list("abcdeéэ中\x00\n\t  ▁🤦ÿ.1") + ["ing", "the ", "    ", "               ", "tion", "http://", "'s"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [t or "" for _, t in pairs(odd)]
    for t, ids in zip(texts, coder.encode_all(texts)):
        assert ids.tolist() == sp.encode(t) and coder.decode(ids) == sp.decode(ids.tolist())
        assert [i for p in coder.search(coder.normal(t[:400])) for i in coder._ids(p)] == sp.encode(t[:400])
    got = pieces.encode_documents(odd, path).collect()
    same([(r.doc_id, r.ids, r.round_trip) for r in got], [(d, sp.encode(t or ""), True) for d, t in pairs(odd)])
    assert pieces.encode_documents(none, path).count() == 0


def test_unigram_models_take_the_best_path(tmp_path):
    """The public model's pieces read as a unigram model; the library's own lattice search is the measure."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = p.score / 1000 - len(p.piece) * 0.001
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model")), pieces.Pieces(str(tmp_path / "u.model"))
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for t in ("there and back again", "thereationing onthe", "a" * 100):
        ids = coder.encode(t)
        assert coder.decode(ids) == t and score(ids) >= score(sp.encode(t)) - 1e-3


def peak(f):
    import tracemalloc

    tracemalloc.start()
    f()
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return top


def test_search_gives_out_what_is_final(monkeypatch):
    """Parts of any length, side by side, equal the library, and a window of nodes is all that a column keeps."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path), random.Random(8)
    rows = []
    plain = pieces.Pieces._meeting
    monkeypatch.setattr(pieces.Pieces, "_meeting", lambda self, last, low, front: (rows.append(len(last)), plain(self, last, low, front))[1])
    words = ["".join(rng.choice("abcdething0123") for _ in range(n)) for n in (1, 2, 31, 32, 33, 64, 65, 500, 5000)] + ["z" * 3000, "abcde12345" * 400, "the" * 50]
    for w, ids in zip(words, coder.search_parts(["▁" + w for w in words])):
        assert np.frombuffer(ids, np.uint32).tolist() == sp.encode(w)
    assert len(rows) > 100 and max(rows) < 4 * pieces.Pieces.WINDOW


def test_memory_of_the_search_is_bounded(monkeypatch):
    import public_tokenizers

    coder = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces.Pieces, "CHUNK", 1 << 16)
    line = "the window of nodes moves along with its front \u00e9t\u00e9 \u4e2d "
    n = 0

    def run(text):
        nonlocal n
        n = sum(len(ids) for _, _, ids in coder.encode_stream([text]))

    short, long = line * 5_000, line * 100_000
    run(short)
    a, b = peak(lambda: run(short)), peak(lambda: run(long))
    assert n > 1_000_000 and b < 1.5 * a + (1 << 20)


def test_parts_join_up(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path), random.Random(1)
    monkeypatch.setattr(pieces.Pieces, "CHUNK", 7)
    for _ in range(300):
        t = "".join(rng.choice(["a", "the", " ", "  ", "▁", "é", "\n", "🤦", " ing"]) for _ in range(rng.randint(0, 40)))
        assert "".join(coder.chunks(t)) == t
        found = list(coder.encode_stream([t]))
        assert [i for _, _, ids in found for i in ids.tolist()] == sp.encode(t)
        assert "".join(coder.decode(ids, k == 0) for k, (_, _, ids) in enumerate(found)) == sp.decode(sp.encode(t))


# 9


def test_rollup_follows_changes_once(spark, tmp_path):
    book = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert book.totals().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    a, b, n = (1, "s", "en", "v1", 10, 50), (2, "s", "en", "v1", 4, 20), (3, None, None, "v1", 7, 30)
    assert book.commit("one", rollups.inserted(rows(a, b, n)))
    assert not book.commit("one", rollups.inserted(rows(a, b, n)))
    a2 = (1, "s", "en", "v2", 11, 50)
    assert book.commit("two", rollups.revised(rows(a), rows(a2)).unionByName(rollups.deleted(rows(n))))
    expected = [("s", "en", "v1", 1, 4, 20), ("s", "en", "v2", 1, 11, 50)]
    same([tuple(r) for r in book.totals().collect()], expected)
    book.compact()
    assert book.committed() == ["one", "two"] and not book.commit("two", rollups.inserted(rows(b)))
    assert book.commit("three", rollups.deleted(rows(b)))
    same([tuple(r) for r in book.totals().collect()], expected[1:])
    (tmp_path / "r" / "batches" / "half").mkdir()  # a writer that was lost
    assert book.committed() == ["one", "three", "two"]
    with pytest.raises(ValueError):
        book.commit("../x", rollups.inserted(rows(b)))


def test_a_compaction_between_two_reads(spark, tmp_path, monkeypatch):
    """Whatever a compaction does while totals are looked up, every batch counts once."""
    rows = lambda n: spark.createDataFrame([("s", "en", "t", n, n, n)], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
    book = rollups.Rollup(spark, f"file://{tmp_path}/r")
    whole = rollups.Rollup._whole
    for k in range(4):
        assert book.commit(f"b{k}", rows(10**k))
        early, done = book.totals(), []

        def racing(self, kind):
            found = whole(self, kind)
            if not done:
                done.append(kind)
                rollups.Rollup(spark, self.root).compact()
            return found

        monkeypatch.setattr(rollups.Rollup, "_whole", racing)
        late = book.totals()
        monkeypatch.setattr(rollups.Rollup, "_whole", whole)
        assert done and [r.n_docs for r in late.collect()] == [r.n_docs for r in early.collect()] == [sum(10**i for i in range(k + 1))]
        assert not book.commit(f"b{k}", rows(1)) and not book.commit("b0", rows(1))
    # Two at once: each folds what it saw, one of them counts.
    book.commit("x", rows(7))
    first = book._state()
    monkeypatch.setattr(rollups.Rollup, "_state", lambda self: first)
    book.compact(), book.compact()
    monkeypatch.undo()
    assert [r.n_docs for r in book.totals().collect()] == [1118] and len(book.committed()) == 5


def test_counts_of_odd_rows(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = [(r.doc_id, r.n_tokens, r.n_chars) for r in rollups.count_tokens(odd, path, "v").collect()]
    same(got, [(d, len(t.encode(x or "", add_special_tokens=False).ids), len(x or "")) for d, x in pairs(odd)])
    assert rollups.count_tokens(none, path, "v").count() == 0


# 10


def plain_words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))


def plain_leaks(t, items):
    w, hit, found = plain_words(t), set(), set()
    for item, text in items:
        b = plain_words(text)
        n = min(10, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(None if item is None else str(item))
    return len(w), len(hit), sorted(found, key=lambda x: (x is None, x))


def plain_matches(t, items):
    """(start, end) of the longest matches by brute force, for items of each length of window by themselves."""
    w, out = plain_words(t), []
    tests = [(i, plain_words(x)) for i, x in items]
    for n in sorted({min(10, len(b)) for _, b in tests} - {0}):
        reach = 0
        for i in range(len(w)):
            best = 0
            for _, b in tests:
                for k in range(len(b) if min(10, len(b)) == n else 0):
                    m = 0
                    while i + m < len(w) and k + m < len(b) and w[i + m] == b[k + m]:
                        m += 1
                    best = max(best, m)
            if best >= n and i + best > reach:
                reach = i + best
                out.append((i, i + best))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_leaks_equal_plain_search(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    texts = dict(pairs(odd.filter("doc_id IS NOT NULL")))
    w = texts[7].split()
    items = [(1, " ".join(w[20:40]).upper()), (2, " ".join(w[25:31])), (3, None), (4, "..."), (5, "X"), (6, " ".join(texts[4].split()[5:15])), (2, " ".join(w[50:60])), (10, "zz " * 9), (None, " ".join(w[70:90])), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(odd, bench).collect()
    got = [(r.doc_id, r.n_words, sum(e - s for s, e in zip(r.spans[::2], r.spans[1::2])), r["items"]) for r in rows]
    same(got, [(d, *plain_leaks(t, items)) for d, t in pairs(odd)])
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.columns == odd.columns
    same(pairs(clean), [(d, t) for d, t in pairs(odd) if not plain_leaks(t, items)[2]])
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_longest_matches_and_their_places():
    rng = random.Random(12)
    for letters in ("abcdefgh", "ab", "a"):
        item = lambda: " ".join(rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))
        items = [(str(k) if k else None, item()) for k in range(8)]
        texts = [f"{item()} Q {rng.choice(items)[1]} {rng.choice(items)[1]} {item()} {'long' * 40} {item()}" for _ in range(12)] + ["", "..."]
        items.append(("40", "Zz " * 3 + "long" * 40))
        block = decontaminate.block_of([(i, t.encode()) for i, t in items])
        found = decontaminate.scan_shard(block, [t.encode() for t in texts])
        for k, t in enumerate(texts):
            n, hit, names = plain_leaks(t, items)
            assert found.counts[k] == n and sorted(found.items.get(k, ()), key=lambda x: (x is None, x)) == names
            assert sum(e - s for s, e in found.spans.get(k, np.zeros((0, 2), int)).tolist()) == hit
            got = found.matches.get(k, [])
            assert sorted(m[:2] for m in got) == plain_matches(t, items)
            for a, b, name, at in got:
                assert any(plain_words(x)[at : at + b - a] == plain_words(t)[a:b] for i, x in items if i == name)


def test_matches_that_touch_stay_apart():
    words = [f"w{k}" for k in range(20)]
    block = decontaminate.block_of([("1", " ".join(words[:10]).encode()), ("2", " ".join(words[10:]).encode())])
    found = decontaminate.scan_shard(block, [" ".join(words).encode()])
    assert found.matches[0] == [(0, 10, "1", 0), (10, 20, "2", 0)] and found.spans[0].tolist() == [[0, 20]]


def test_equal_words_and_windows_in_one_shard_many_times(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    text = " ".join(f"w{k}" for k in range(30))
    block = decontaminate.block_of([(str(k), text.encode()) for k in range(40)] + [("x", b"a " * 60)])
    found = decontaminate.scan_shard(block, [text.encode()] * 50 + [b"a " * 500])
    assert all(len(found.items[k]) == 40 and [m[:2] for m in found.matches[k]] == [(0, 30)] for k in range(50))
    assert found.spans[50].tolist() == [[0, 500]] and found.items[50] == {"x"}


def test_filters_on_results_stay_above_them(spark, data):
    """Catalyst may not move a filter into the expressions below, where it would repeat them."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for df, cond in ((rules.apply_policy(rules.ledger(docs)), "kept"), (secrets.scan_secrets(docs), "n_hex > 0"), (secrets.redact_secrets(docs), "text LIKE '%SECRET%'")):
        plan = df.filter(cond)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(line.lstrip(" +-:").startswith("Filter") and "regexp_extract_all" in line for line in plan.splitlines())
