"""Repeated passages: bytes under a window of 200 that occurs anywhere else, by longest previous factors.

Equal windows have the same minimizer, the least hash among their pieces of 100 bytes, at
the same place. So each document gives one row per minimizer with the run of windows that
it stands for, and equal windows meet on its hash without any text being moved:

* Copies of a run, equal in all bytes, are put together before anything else, however many
  there are; each but the first has an earlier match at the first, over its whole length.
* The first runs of each kind that share a minimizer make up a shard, in order of document
  and place. Its suffix array, the previous and next smaller positions in suffix order and
  the longest common prefixes with those two give every window's longest previous factor;
  the same in reverse order gives its longest factor that follows. A window has an earlier
  match if the first of them is 200 bytes or longer, and any match if either is.
* A minimizer with more than KINDS kinds of runs is split by more of the bytes that its
  windows share: the places of the minimizer in them are halved, again and again, and a run
  goes in pieces to the hash of what all windows with such places have in common. In the
  end that is the window itself. Every window goes to one shard, in which all its equals are.

Both results come from the same factors: all occurrences removed, or all but the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import drop_stored, load, partitions, stored, text_or_empty, tune
from mosaiq.llm.suffixes import Suffixes, of_bytes

#: Bytes of a window and of the pieces among which its minimizer is.
WINDOW, PIECE = 200, 100
#: Bytes of text handled at once, and of runs whose suffixes are sorted at once.
SEGMENT, BATCH = 2 << 20, 256 << 10
#: Kinds of runs in a shard; a minimizer with more is split, whichever part of the rows it has.
KINDS = 64
#: Binary digits of a minimizer's place in a window that are left out of a shard's name, split by split.
SPLITS = (5, 3, 1, 0)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
            _POWERS[i] = p
    return _POWERS[0], _POWERS[1]


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    return v


def runs(data: bytes) -> list[tuple[int, int, int]]:
    """(minimizer, first window, last window) for all windows of ``data``, in order."""
    found: list[tuple[int, int, int]] = []
    for offset in range(0, max(len(data) - WINDOW + 1, 0), SEGMENT):
        raw = np.frombuffer(data, np.uint8, min(SEGMENT + WINDOW - 1, len(data) - offset), offset)
        up, down = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
        h = (total[PIECE:] - total[:-PIECE]) * up[: len(raw) - PIECE + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # Of equal hashes the first counts: its place makes up the low bits.
        h = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(h, WINDOW - PIECE + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        last = np.append(first[1:] - 1, len(at) - 1)
        found += zip((at[first] + offset).tolist(), (first + offset).tolist(), (last + offset).tolist())
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _run_rows(docs: DataFrame) -> DataFrame:
    """(rid, key, ctx, a, b): per run the hash of its minimizer, of all its bytes, and its windows' first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                view = memoryview(data)
                for p, a, b in runs(data):
                    rows.append((rid, _signed(xxhash.xxh3_64_intdigest(view[p : p + PIECE])), _signed(xxhash.xxh3_64_intdigest(view[a : b + WINDOW], p - a)), a, b))
                if len(rows) > 100_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["rid", "key", "ctx", "a", "b"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, key long, ctx long, a long, b long")


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each of different numbers the place of the nearest smaller one before it, -1 if there is none.

    All between a place and the one it points to are greater, so where that one is greater
    too, what it points to is the next to look at; all places move at once.
    """
    at = np.arange(-1, len(v) - 1)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        open_ = open_[v[at[open_]] > v[open_]]
        at[open_] = at[at[open_]]
        open_ = open_[at[open_] >= 0]
    return at


def previous_factors(suffixes: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per start, in the order given: the length of its longest match with an earlier one of ``starts``, and where that is (-1: nowhere).

    Of all earlier starts, the two next to it in suffix order, the previous and the next
    smaller position, have the longest common prefixes with it.
    """
    order = suffixes.order(starts)
    n = len(order)
    before = previous_smaller(order)
    after = n - 1 - previous_smaller(order[::-1])[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for at in (before, after):
        has = np.flatnonzero((at >= 0) & (at < n))
        found = suffixes.common(order[has], order[at[has]])
        more = found > length[has]
        length[has[more]], source[has[more]] = found[more], order[at[has[more]]]
    back = np.empty(n, np.int64)
    back[np.argsort(starts)] = np.argsort(order)
    return length[back], source[back]


def following_factors(suffixes: Suffixes, starts: np.ndarray) -> np.ndarray:
    """Per start the length of its longest match with a later one of ``starts``: the same with the order of places reversed."""
    order = suffixes.order(starts)
    n = len(order)
    length = np.zeros(n, np.int64)
    for at in (previous_smaller(-order), n - 1 - previous_smaller(-order[::-1])[::-1]):
        has = np.flatnonzero((at >= 0) & (at < n))
        length[has] = np.maximum(length[has], suffixes.common(order[has], order[at[has]]))
    back = np.empty(n, np.int64)
    back[np.argsort(starts)] = np.argsort(order)
    return length[back]


def matched_windows(parts: list[bytes], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``parts``, part by part: whether an earlier one equals it, and whether any one does."""
    suffixes = of_bytes(parts)
    n = np.maximum(np.array([len(p) for p in parts], np.int64) - depth + 1, 0)
    starts = np.repeat(suffixes.begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(starts):
        return np.zeros(0, bool), np.zeros(0, bool)
    earlier = previous_factors(suffixes, starts)[0] >= depth
    return earlier, earlier | (following_factors(suffixes, starts) >= depth)


def _covered(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set windows as (first, last)."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _shard_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards (key, rid, a, bytes), in order of key, to the spans under matched windows; several shards are sorted together."""

    def judge(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r["rid"], r["a"]))
        earlier, any_ = matched_windows([r["bytes"] for r in rows])
        found, at = [], 0
        for r in rows:
            n = len(r["bytes"]) - WINDOW + 1
            of = _covered(earlier[at : at + n])
            found += [(r["rid"], r["a"] + i, r["a"] + j + WINDOW, True) for i, j in of]
            found += [(r["rid"], r["a"] + i, r["a"] + j + WINDOW, False) for i, j in _covered(any_[at : at + n]) if (i, j) not in of]
            at += n
        columns = list(zip(*found)) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["rid", "s", "e", "later"])

    rows: list[dict] = []
    size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if size > BATCH and r["key"] != rows[-1]["key"]:
                yield judge(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r["bytes"])
    if rows:
        yield judge(rows)


def _split(digits: int):
    """Runs with their bytes to pieces whose windows have the minimizer at places that agree but for the last ``digits``."""

    def pieces_of(data: bytes) -> Iterator[tuple[int, int, int, int]]:
        at, windows = runs(data)[0][0], len(data) - WINDOW + 1
        for place in range((at - windows + 1) >> digits, (at >> digits) + 1):
            low, high = place << digits, min(((place + 1) << digits) - 1, WINDOW - PIECE)
            a, b = max(at - high, 0), min(at - low, windows - 1)
            view = memoryview(data)
            key = xxhash.xxh3_64_intdigest(view[at - low : at - high + WINDOW], place)
            yield _signed(key), _signed(xxhash.xxh3_64_intdigest(view[a : b + WINDOW], at - a)), a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "key", "ctx", "a", "b", "bytes"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["rid"], key, ctx, r["a"] + a, r["a"] + b, r["bytes"][a : b + WINDOW]) for key, ctx, a, b in pieces_of(r["bytes"])]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names)

    return run


def _met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of runs (rid, key, ctx, a, b[, bytes]): the spans of those that have copies, and (key, rid, a, b[, bytes], d) of the first of each kind where a key has d > 1 kinds.

    Every join is between written tables, so Spark splits it where one key is hot.
    """
    # Most runs share their minimizer with no other and go here.
    keys = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("t")).filter("t > 1").select("key"), "shared-keys")
    met = stored(rows.join(keys, "key", "left_semi"), "met-runs")
    drop_stored(keys)
    carried = [c for c in ("rid", "a", "b", "bytes") if c in rows.columns]
    kinds = stored(met.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*carried)).alias("f")), "kinds-of-runs")
    copies = kinds.filter("n > 1").select("key", "ctx", F.col("f.rid").alias("first_rid"), F.col("f.a").alias("first_a"))
    spans = met.select("key", "ctx", "rid", "a", "b").join(copies, ["key", "ctx"])
    spans = spans.select("rid", F.col("a").alias("s"), (F.col("b") + WINDOW).alias("e"), F.expr("rid <> first_rid OR a <> first_a").alias("later"))
    spans = stored(spans, "whole-spans")
    drop_stored(met)
    several = stored(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"), "several-kinds")
    firsts = stored(kinds.select("key", "f.*").join(several, "key"), "first-runs")
    for x in (kinds, several):
        drop_stored(x)
    return spans, firsts


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(rid, s, e, later): byte spans of ``docs`` (rid: unique long, text: never null) under repeated windows; they may overlap.

    ``later`` says that every window under the span has an equal one earlier, in the order
    of (rid, place); the other spans include those.
    """
    spark = docs.sparkSession
    rows = stored(_run_rows(docs), "runs")
    spans, firsts = _met(rows)
    drop_stored(rows)
    # The bytes of the first run of each kind, for minimizers that have several kinds.
    need = firsts.groupBy("rid").agg(F.collect_list(F.struct("key", "a", "b", "d")).alias("need"))
    found = docs.join(need, "rid").select("rid", F.encode("text", "UTF-8").alias("data"), F.explode("need").alias("x"))
    found = found.select("rid", "x.*", F.expr(f"substring(data, CAST(x.a + 1 AS INT), CAST(x.b - x.a + {WINDOW} AS INT))").alias("bytes"))
    found = stored(found, "shards")
    drop_stored(firsts)
    for digits in (*SPLITS, None):
        shard = found.filter(f"d <= {KINDS}").select("key", "rid", "a", "bytes") if digits is not None else found.select("key", "rid", "a", "bytes")
        near = shard.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_shard_spans, "rid long, s long, e long, later boolean")
        spans = spans.union(stored(near, "shard-spans"))
        hot = found.filter(f"d > {KINDS}").select("rid", "a", "bytes")
        if digits is None or hot.isEmpty():
            break
        rows = stored(hot.mapInArrow(_split(digits), "rid long, key long, ctx long, a long, b long, bytes binary"), "runs")
        drop_stored(found)
        more, found = _met(rows)
        spans = spans.union(more)
        drop_stored(rows)
    drop_stored(found)
    return spans


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique ``rid`` in the order of doc_id: doc_id itself where that is a number, unique and never null.

    Else a written copy is numbered in the order of doc_id, null last; rows of one doc_id
    come in the order of their texts' hashes, so that no doc_id has to go to one task.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("text", text_or_empty())
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.count_if(F.isnull("doc_id")).alias("nulls")).first()
        if not ids.nulls and (ids.most or 0) <= 1:
            return docs.withColumn("rid", F.col("doc_id").cast("long"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = docs.select("doc_id", "text", *[F.isnull("doc_id").alias("o0"), order[1].alias("o1"), order[2].alias("o2")])
    placed = placed.repartitionByRange(partitions(spark), "o0", "doc_id", "o1", "o2").sortWithinPartitions("o0", "doc_id", "o1", "o2")
    return stored(placed.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), "numbered")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def _without(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for s, e in cut:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


_OUT = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("n_removed_later", "long"), ("n_spans_later", "long"), ("first_kept_sha256", "string")]


def remove_repeats(docs: DataFrame, keep_first: bool = True, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, and what goes: n_removed, n_spans, kept_sha256 for all occurrences of every
    repeated window, n_removed_later, n_spans_later, first_kept_sha256 for all but the first; [text].

    Texts count as UTF-8 bytes, null as empty. ``text`` is what stays, with the first
    occurrences, by doc_id and place, if ``keep_first``. Bytes of a character cut in two at
    the edge of a span become replacement characters in it. Rows may repeat, with or without
    doc_id, which may be of any type that has an order: they are copies of each other.
    """
    tune(docs.sparkSession)
    narrow = _numbered(docs.select("doc_id", "text"))
    spans = repeated_spans(narrow.select("rid", "text"))
    # A run of windows gives a few spans at most, so a document's size bounds what is gathered.
    spans = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "later")).alias("spans"))
    whole = narrow.join(spans, "rid", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1), b.column(2)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                found = [(x["s"], x["e"], x["later"]) for x in spans.as_py() or ()]
                row, left = [len(data)], {}
                for first in (False, True):
                    cut = _merged([(s, e) for s, e, later in found if later or not first])
                    left[first] = _without(data, cut)
                    row += [len(data) - len(left[first]), len(cut), hashlib.sha256(left[first]).hexdigest()]
                rows.append((*row, *[left[keep_first].decode("utf-8", "replace")] * with_text))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*rows))], ["doc_id", *(n for n, _ in _OUT), *["text"] * with_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in _OUT), *["text string"] * with_text]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), with_text=False)
