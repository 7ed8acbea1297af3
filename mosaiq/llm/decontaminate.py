"""Benchmark decontamination: suffix arrays of the training words, searched for every test suffix.

The training side is never shuffled: each task takes it a shard of documents at a time and
searches the benchmark in it, block by block of bounded size.

* What of both sides can matter: hashes of windows of words, rolled over the shard and
  looked up among those of the block. Most shards have none, and go no further.
* Every test suffix that begins with such a window is binary-searched in the suffix array
  of the shard's suffixes that do, both of exact words. A group of neighbours that share a
  window's words are its occurrences.
* Each of them is placed among the test suffixes in turn; the longer of the prefixes it
  shares with its two neighbours there is its longest verbatim match.

A block is written once, by executors, to the shared folder. If the benchmark has several,
documents pass them one after another, written to the shared folder in between, so that a
Python worker holds one block at any time.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm import files
from mosaiq.llm.common import drop_stored, load, scratch, stored, text_or_empty, tune
from mosaiq.llm.suffixes import Suffixes
from mosaiq.llm.words import Words, slices

#: Words in a window.
WINDOW = 10
#: Bytes of text in a shard, and of benchmark text in a block.
SHARD, BLOCK = 4 << 20, 16 << 20
#: Pairs of a document's window and an item that are looked at together.
PAIRS = 1 << 21

#: Bytes of words stay, A-Z in lower case; all others become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TURN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Block:
    """Items of a benchmark, and the windows of their texts in the order of their hashes."""

    ids: list[str | None]
    words: Words
    key: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def __post_init__(self):
        self.lengths = sorted(set(np.unique(self.size).tolist()))
        # Bits at two places for each window: a hash without both is not among them.
        self.digits = min(28, max(10, math.ceil(math.log2(16 * len(self.key) + 1))))
        bits = np.zeros(1 << (self.digits - 3), np.uint8)
        for turn in (np.uint64(1), _TURN):
            place = self._place(self.key * turn)
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        self.bits = bits

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.digits)).astype(np.int64)

    def having(self, h: np.ndarray) -> np.ndarray:
        """The places in ``h`` of hashes that windows here have."""
        at = np.arange(len(h))
        for turn in (np.uint64(1), _TURN):
            place = self._place(h[at] * turn)
            at = at[(self.bits[place >> 3] >> (place & 7)) & 1 == 1]
        found = np.searchsorted(self.key, h[at])
        return at[self.key[np.minimum(found, len(self.key) - 1)] == h[at]] if len(self.key) else at[:0]


def block_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Block:
    w = Words([t for _, t in items], _TABLE)
    h = w.hashes()
    count = np.diff(w.first)
    keys, places, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in sorted({*np.minimum(count, window).tolist()} - {0}):
        at, key = w.windows(h, n)
        own = np.minimum(count[w.text[at]], window) == n
        keys.append(key[own])
        places.append(at[own].astype(np.int32))
        sizes.append(np.full(int(own.sum()), n, np.int8))
    key, at, size = map(np.concatenate, (keys, places, sizes))
    order = np.argsort(key, kind="stable")
    return Block([i for i, _ in items], w, key[order], at[order], size[order])


def _exact(train: Words, runs: list[tuple[int, int]], test: Words, others: list[tuple[int, int]]) -> tuple[Suffixes, Callable, Callable]:
    """Suffixes of the exact words of stretches of both sides; for each side, what turns a word's place into that among them."""
    number: dict[bytes, int] = {}
    ids, sizes = [], []
    for w, stretches in ((train, runs), (test, others)):
        for a, b in stretches:
            ids += [number.setdefault(w.word(k), len(number)) for k in range(a, b)]
            sizes.append(b - a)
    s = Suffixes(np.array(ids, np.int64), np.array(sizes, np.int64))

    def mover(stretches: list[tuple[int, int]], begin: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        first = np.array([a for a, _ in stretches], np.int64)
        of = lambda at: np.searchsorted(first, at, "right") - 1
        return lambda at: begin[of(at)] + at - first[of(at)]

    return s, mover(runs, s.begin[: len(runs)]), mover(others, s.begin[len(runs) :])


def _next_to(s: Suffixes, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of suffixes ``wanted`` in a suffix array: the places before and after each, and the words shared with those."""
    ranks = s.ranks[-1]
    place = np.searchsorted(ranks[order], ranks[wanted])
    low, high = place - 1, place
    share = []
    for x in (low, high):
        has = np.flatnonzero((x >= 0) & (x < len(order)))
        n = np.zeros(len(wanted), np.int64)
        n[has] = s.common(order[x[has]], wanted[has])
        share.append(n)
    return low, high, *share


@dataclass
class Found:
    """Of a shard: per text its words; covered words, items, and longest matches (start, end, item, start there) of those that have any."""

    counts: list[int]
    spans: dict[int, np.ndarray]
    items: dict[int, set[str | None]]
    matches: dict[int, list[tuple[int, int, str | None, int]]]


def scan_shard(block: Block, texts: list[bytes]) -> Found:
    """All windows of the block's items in the shard."""
    w = Words(texts, _TABLE)
    out = Found(np.diff(w.first).tolist(), {}, {}, {})
    if not len(block.key) or not len(w.start):
        return out
    h = w.hashes()
    hits, sizes, keys = [], [], []
    for n in block.lengths:
        at, key = w.windows(h, n)
        have = block.having(key)
        hits.append(at[have])
        keys.append(key[have])
        sizes.append(np.full(len(have), n))
    hit, size = np.concatenate(hits), np.concatenate(sizes)
    if not len(hit):
        return out
    wanted = np.unique(np.concatenate(keys))
    low, high = np.searchsorted(block.key, wanted), np.searchsorted(block.key, wanted, "right")
    rows = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
    test, test_size = block.at[rows], block.size[rows]
    s, to_train, to_test = _exact(w, w.runs(hit, size), block.words, block.words.runs(test, test_size))
    covers, pairs, matches = [], [], []
    for n in block.lengths:
        train, own = np.unique(hit[size == n]), np.unique(test[test_size == n])
        if not len(train) or not len(own):
            continue
        a, b = to_train(train), to_test(own)
        order = np.argsort(s.ranks[-1][a])
        a, train = a[order], train[order]
        # Neighbours in the suffix array that share a window's words, and the test suffixes that share them too.
        group = np.cumsum(np.append(False, s.common(a[1:], a[:-1]) < n))
        before, after, with_before, with_after = _next_to(s, a, b)
        there = np.where(with_before >= n, group[before], np.where(with_after >= n, group[np.minimum(after, len(a) - 1)], -1))
        own, there = own[there >= 0], there[there >= 0]
        met = np.flatnonzero(np.isin(group, there))
        if not len(met):
            continue
        covers.append(np.stack([train[met], train[met] + n], axis=1))
        pairs.append(_items_of(w.text[train[met]], group[met], block.words.text[own], there))
        # The place of each occurrence among the test suffixes, and the longer of its two matches there.
        b = to_test(own)
        order = np.argsort(s.ranks[-1][b])
        b, own = b[order], own[order]
        before, after, with_before, with_after = _next_to(s, b, a[met])
        best = np.where(with_before >= with_after, before, np.minimum(after, len(b) - 1))
        length = np.maximum(with_before, with_after)
        start, item = train[met], own[best]
        by = np.argsort(start)
        start, length, item = start[by], length[by], item[by]
        reach = np.maximum.accumulate(start + length)
        longest = np.append(True, (start + length)[1:] > reach[:-1])
        matches.append(np.stack([start, start + length, item], axis=1)[longest])
    if not covers:
        return out
    for text, rows in _by_text(w, np.concatenate(covers)):
        out.spans[text] = _merged(rows - w.first[text])
    for text, item in np.unique(np.concatenate(pairs), axis=0).tolist():
        out.items.setdefault(text, set()).add(block.ids[item])
    for text, rows in _by_text(w, np.concatenate(matches)):
        of = block.words.text[rows[:, 2]]
        out.matches[text] = [(int(x - w.first[text]), int(y - w.first[text]), block.ids[k], int(z - block.words.first[k])) for (x, y, z), k in zip(rows.tolist(), of.tolist())]
    return out


def _items_of(text: np.ndarray, group: np.ndarray, item: np.ndarray, there: np.ndarray) -> np.ndarray:
    """(text, item) where an occurrence in the text and a suffix of the item are in one group, PAIRS at a time."""
    left = np.unique(np.stack([group, text], axis=1), axis=0)
    right = np.unique(np.stack([there, item], axis=1), axis=0)
    low, high = np.searchsorted(right[:, 0], left[:, 0]), np.searchsorted(right[:, 0], left[:, 0], "right")
    total = np.cumsum(high - low)
    found = [np.zeros((0, 2), np.int64)]
    begin = 0
    while begin < len(left):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        n = (high - low)[begin:end]
        rows = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.unique(np.stack([np.repeat(left[begin:end, 1], n), right[rows, 1]], axis=1), axis=0))
        begin = end
    return np.concatenate(found)


def _by_text(w: Words, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    text = w.text[rows[:, 0]]
    for group in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(text)) + 1):
        yield int(text[group[0]]), rows[group]


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) in order, those that touch or overlap joined: the words under windows."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > ends[:-1])
    return np.stack([spans[first, 0], ends[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], axis=1)


def write_blocks(benchmark: DataFrame) -> list[str]:
    """Files of the benchmark's items in blocks of about BLOCK bytes of text; items without text are in none.

    The number of blocks is all that the driver learns.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t") + 100)).first()[0]
    if not size:
        return []
    folder = scratch(spark, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(ids: list[str | None], texts: list[bytes]) -> pa.RecordBatch:
            out = io.BytesIO()
            packed = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.large_binary())], ["i", "t"])
            with pa.ipc.new_stream(out, packed.schema) as w:
                w.write_batch(packed)
            return pa.RecordBatch.from_pydict({"file": [files.put(folder, "block.arrow", out.getvalue())]})

        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(*b.columns):
                ids.append(i.as_py())
                texts.append(t.as_py().encode("utf-8", "surrogatepass"))
                size += len(texts[-1]) + 100
                if size >= 2 * BLOCK:
                    yield put(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield put(ids, texts)

    dealt = items.repartition(math.ceil(size / BLOCK))
    return sorted(r.file for r in stored(dealt.mapInArrow(run, "file string"), "blocks").collect())


_BLOCK: dict[str, Block] = {}


def read_block(uri: str) -> Block:
    """The block of a file, of which a Python worker holds one at a time."""
    if uri not in _BLOCK:
        _BLOCK.clear()
        with pa.ipc.open_stream(files.get(uri)) as r:
            ids, texts = r.read_all().columns
        _BLOCK[uri] = block_of(list(zip(ids.to_pylist(), texts.to_pylist())))
    return _BLOCK[uri]


_MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())])
_STATE = T.StructType([
    T.StructField("__n_words", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.LongType())),
    T.StructField("__items", T.ArrayType(T.StringType())),
    T.StructField("__matches", T.ArrayType(_MATCH)),
])
_ARROW = pa.schema([
    ("__n_words", pa.int64()),
    ("__spans", pa.list_(pa.int64())),
    ("__items", pa.list_(pa.string())),
    ("__matches", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))),
])


def _step(df: DataFrame, uri: str | None, drop: bool) -> DataFrame:
    """``df`` (__text and _STATE last) with the matches of one block added; ``drop``: only rows without any match."""
    names = df.columns
    at = {n: names.index(n) for n in ("__text", *_STATE.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = read_block(uri) if uri else block_of([])
        for batch in batches:
            for b in slices(batch, at["__text"], SHARD):
                found = scan_shard(block, [x.as_py().encode("utf-8", "surrogatepass") for x in b.column(at["__text"])])
                state = {n: b.column(at[n]).to_pylist() for n in _STATE.names}
                state["__n_words"] = found.counts
                for d, s in found.spans.items():
                    both = np.concatenate([np.array(state["__spans"][d] or [], np.int64).reshape(-1, 2), s])
                    state["__spans"][d] = _merged(both).ravel().tolist()
                    state["__items"][d] = sorted({*(state["__items"][d] or ()), *found.items[d]}, key=lambda x: (x is None, x))
                    new = [dict(zip(_MATCH.names, m)) for m in found.matches[d]]
                    state["__matches"][d] = sorted((state["__matches"][d] or []) + new, key=lambda m: (m["start"], -m["end"]))
                out = list(b.columns)
                for name in _STATE.names:
                    out[at[name]] = pa.array(state[name], _ARROW.field(name).type)
                b = pa.RecordBatch.from_arrays(out, names)
                yield b.filter(pa.array([not x for x in state["__spans"]], pa.bool_())) if drop else b

    return df.mapInArrow(run, df.schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, drop: bool = False) -> DataFrame:
    tune(docs.sparkSession)
    # The columns go along as one, so none of theirs can meet one of ours.
    state = [F.lit(0 if f.name == "__n_words" else None).cast(f.dataType).alias(f.name) for f in _STATE]
    df = docs.select(F.struct("*").alias("__row"), text_or_empty().alias("__text"), *state)
    blocks = write_blocks(benchmark) or [None]
    written = None
    for k, block in enumerate(blocks):
        df = _step(df, block, drop)
        if k + 1 < len(blocks):
            df = stored(df, "scanned")
            if written is not None:
                drop_stored(written)
            written = df
    return df


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, items, matches) per row: words; (start, end), one behind the other, of the stretches of words
    under windows; items found; the longest verbatim matches, each with its place in words in the document and in an item.

    A match is as long as words agree from its start on, in any item; those within another of the same length of window
    are left out, and matches that only touch stay apart. Where several items agree equally far, one is named.
    Null and empty texts have no words and no matches; items without words match nothing; items that repeat count by
    their id, those without one as one item of the name null. Rows may repeat; other columns are ignored.
    """
    df = _scanned(docs.select("doc_id", "text"), benchmark)
    empty = lambda name: F.coalesce(name, F.array().cast(_STATE[name].dataType)).alias(name[2:])
    return df.select("__row.doc_id", F.col("__n_words").alias("n_words"), empty("__spans"), empty("__items"), empty("__matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, unchanged, all columns."""
    return _scanned(docs, benchmark, drop=True).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(transform(spans, (x, i) -> CASE WHEN i % 2 = 0 THEN -x ELSE x END), 0L, (a, x) -> a + x)")
    items = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return leaks.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT DISTINCT least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
words AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, i + unnest(range(n)) AS at FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
