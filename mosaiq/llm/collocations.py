"""Phrase collocations: contiguous patterns grown to the right from frequent prefixes, scored by their weakest cut.

Four passes over the texts, each pruned by those before: words are counted, then pairs of
words that are both frequent, then runs of three whose pairs may both be; last, every
occurrence of a pair that may be frequent gives away its projection, the words that follow
as long as each three may be frequent. Equal projections of a shard of text are added up
before the shuffle, and those of a part of the prefixes, the first two words, are one row. A
task adds up the different projections of a part, of which there are many times as many as
tasks, and grows patterns depth-first along them, in order of their words: what is open is a
stack as deep as the longest phrase. Pruning goes by bitmaps
of fixed size: a false hit costs a row and changes no count, as counts are made again from
the projections.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import drop_stored, load, partitions, stored, text_or_empty, tune

#: The contract: words of a phrase, its least frequency, the factor of the score, what part of a phrase's occurrences a longer one must have to replace it (percent), rows per language.
LONGEST, LEAST, FACTOR, WITHIN, MOST = 5, 100, 1000, 100, 2000
#: Bytes of text that are counted together: a worker's arrays take some 30 times as many.
SHARD = 6 << 20
#: Parts of the prefixes of a language for each task.
SPREAD = 4
#: Bits of a bitmap, as a power of two: 4 MB; and of the hashes that are counted for it.
BITS, KEY = 25, 40
#: Parts in which the best of a language are found before they meet.
PARTS = 64
UNKNOWN = "und"

#: A-Z in lower case, tabs as spaces, what ends a piece as line feeds.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class Tokens:
    """The words of several texts: ``ids`` of (lang, word), with ``langs`` and ``words`` by id, and ``joined``, whether the next word is in the same piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        flat = np.frombuffer(b"\n".join(t.translate(_TABLE) for t in texts) + b"\n", np.uint8)
        inside = (flat != 32) & (flat != 10)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        start, end = edge[::2], edge[1::2]
        size = end - start
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside].tobytes())]).dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        names, code = np.unique(np.array(langs, object), return_inverse=True)
        key, self.ids = np.unique(word * len(names) + code[text], return_inverse=True)
        self.langs = names[key % len(names)] if len(key) else names[:0]
        self.words = coded.dictionary.take(pa.array(key // len(names)))
        # Between words of one piece there are spaces only.
        piece = np.searchsorted(np.flatnonzero(flat == 10), start)
        self.joined = np.append(piece[1:] == piece[:-1], False) if len(start) else np.zeros(0, bool)

    def hashes(self) -> np.ndarray:
        return hashes(self.langs, self.words)


def hashes(langs: np.ndarray, words: pa.Array) -> np.ndarray:
    """A hash of KEY bits of each (lang, word)."""
    seeds = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[x]) for w, x in zip(words.to_pylist(), langs)), np.uint64, len(langs)) >> np.uint64(64 - KEY)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of KEY bits of two words' hashes in order."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - KEY)


def _may(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(KEY - BITS)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of a table of hashes (h: long); 2**BITS of them, whatever the table's size."""
    slot = F.shiftright("h", KEY - BITS)
    words = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftright(h, {KEY - BITS}) & 63 AS INT))")).alias("bits"))
    out, rows = np.zeros(1 << (BITS - 6), np.uint64), words.toArrow()  # a row for 64 bits at most
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """The rows (lang, text), about SHARD bytes of text at a time."""
    langs, texts, size = [], [], 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text.encode("utf-8", "surrogatepass")
            if texts and size + len(text) > SHARD:
                yield Tokens(langs, texts)
                langs, texts, size = [], [], 0
            langs.append(lang), texts.append(text)
            size += len(text)
    if texts:
        yield Tokens(langs, texts)


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(pa.binary()).cast(pa.string())


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): every word's occurrences; per lang a row without word has their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            n = np.bincount(t.ids, minlength=len(t.langs))
            yield pa.RecordBatch.from_arrays([pa.array(t.langs, pa.string()), _strings(t.words), pa.array(n)], ["lang", "word", "n"])
            names, at = np.unique(t.langs, return_inverse=True)
            total = np.bincount(at, n, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(total)], ["lang", "word", "n"])

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _word_hashes(words: DataFrame) -> DataFrame:
    """(h) of words (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes(np.array(b.column(0).to_pylist(), object), b.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return words.select("lang", "word").mapInArrow(run, "h long")


def _good(t: Tokens, h: np.ndarray, bitmaps: list) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of len(bitmaps) + 1 words of a piece begins whose words, pairs, ... may all be frequent but for the run itself; and the hashes of these runs.

    ``bitmaps`` are those of words, of pairs, and so on.
    """
    good, key = _may(bitmaps[0].value, h)[t.ids], h[t.ids]
    at = np.flatnonzero(good[:-1] & good[1:] & t.joined[:-1])
    for n, bits in enumerate(bitmaps):
        if n:
            good = np.zeros(len(t.ids) + 1, bool)
            good[at] = _may(bits.value, key)
            own = np.zeros(len(t.ids), np.uint64)
            own[at] = key
            at = at[good[at] & good[at + 1]]
            key = own
        key = pair_hash(key[at], h[t.ids[at + n + 1]])
    return at, key


def _run_counts(texts: DataFrame, bitmaps: list) -> DataFrame:
    """(h, n): hashes of the runs of ``_good``, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            key, n = np.unique(_good(t, t.hashes(), bitmaps)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def projections(texts: DataFrame, bitmaps: list, longest: int, parts: int) -> DataFrame:
    """(lang, part, phrases, n): what begins at each occurrence of a pair that may be frequent, up to ``longest`` words and as far as every three may be.

    A row has the different ones of a shard whose pairs fall into one of ``parts``, words
    joined by spaces, and how often each occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            h, ids = t.hashes(), t.ids
            at, key = _good(t, h, bitmaps[:1])
            at = at[_may(bitmaps[1].value, key)]
            on3, key = _good(t, h, bitmaps[:2])
            good = np.zeros(len(ids) + longest, bool)
            good[on3] = _may(bitmaps[2].value, key)
            # A kind is a sequence of words; it grows by one word at a time.
            first, kind = np.unique(ids[at] * len(h) + ids[at + 1], return_inverse=True)
            a, b = first // max(1, len(h)), first % max(1, len(h))
            kinds, pair = [[x, y] for x, y in zip(a.tolist(), b.tolist())], np.arange(len(first))
            part = (pair_hash(h[a], h[b]) % np.uint64(parts)).astype(np.int32)
            counts = np.zeros(len(kinds), np.int64)
            for k in range(2, longest + 1):
                on = good[at + k - 2] if k < longest else np.zeros(len(at), bool)
                counts += np.bincount(kind[~on], minlength=len(kinds))
                at, kind = at[on], kind[on]
                if not len(at):
                    break
                key, new = np.unique(kind * len(h) + ids[at + k], return_inverse=True)
                kind, pair = new + len(kinds), np.append(pair, pair[key // len(h)])
                kinds += [[*kinds[x], y] for x, y in zip((key // len(h)).tolist(), (key % len(h)).tolist())]
                counts = np.append(counts, np.zeros(len(key), np.int64))
            there = np.flatnonzero(counts)
            if not len(there):
                continue
            names, lang = np.unique(t.langs[a[pair[there]]], return_inverse=True)
            group = lang * parts + part[pair[there]]
            order = np.argsort(group, kind="stable")
            there, group = there[order], group[order]
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            flat = np.array([w for k in there.tolist() for w in kinds[k]], np.int64)
            words = pa.ListArray.from_arrays(np.cumsum([0] + [len(kinds[k]) for k in there.tolist()]).astype(np.int32), _strings(t.words.take(pa.array(flat))))
            ends = np.append(starts, len(there)).astype(np.int32)
            columns = [pa.array(names[group[starts] // parts], pa.string()), pa.array((group[starts] % parts).astype(np.int32)), pa.ListArray.from_arrays(ends, pc.binary_join(words, " ")), pa.ListArray.from_arrays(ends, pa.array(counts[there]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "part", "phrases", "n"])

    return texts.mapInArrow(run, "lang string, part int, phrases array<string>, n array<long>")


def grow(rows: Iterator[tuple[str, list[str], int]], least: int) -> Iterator[tuple[str, list[str], int]]:
    """(lang, words, n) of the patterns of two or more words with n >= least, depth-first.

    ``rows`` are projections in order of lang and words. The open pattern is a path from a
    prefix to its longest extension, with the occurrences found so far at each step; a row
    closes what it doesn't begin with.
    """
    lang, path, counts = None, [], []

    def close(depth: int) -> Iterator[tuple[str, list[str], int]]:
        while len(path) > depth:
            n = counts.pop()
            if n >= least and len(path) > 1:
                yield lang, list(path), n
            path.pop()
            if counts:
                counts[-1] += n

    for of, words, n in rows:
        same = 0
        if of == lang:
            while same < min(len(path), len(words)) and path[same] == words[same]:
                same += 1
        yield from close(same)
        lang = of
        for w in words[same:]:
            path.append(w), counts.append(0)
        counts[-1] += n
    yield from close(0)


def _merged(rows: Iterator[tuple[str, int, list[str], list[int]]]) -> Iterator[tuple[str, list[str], int]]:
    """(lang, words, n): the different projections of each part, added up, in order of their words; ``rows`` are in order of lang and part."""
    for (lang, _), group in groupby(rows, lambda r: r[:2]):
        total: Counter[str] = Counter()
        for _, _, phrases, n in group:
            for phrase, m in zip(phrases, n):
                total[phrase] += m
        yield from ((lang, words, total[" ".join(words)]) for words in sorted(phrase.split(" ") for phrase in total))


def patterns(found: DataFrame, least: int) -> DataFrame:
    """(lang, words, n) of all frequent phrases of two or more words; a part of the prefixes of two words is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        out = []
        for r in grow(_merged(rows), least):
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "words", "n"), x)) for x in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "words", "n"), x)) for x in out], schema)

    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64())])
    return found.repartition(partitions(found.sparkSession), "lang", "part").sortWithinPartitions("lang", "part").mapInArrow(run, "lang string, words array<string>, n long")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) of all phrases of two or more words, at the cut with the lowest score, of equals the first.

    ``phrases`` (lang, words, n) has all frequent phrases, those of one word too; as every
    part of a frequent phrase is frequent, all parts are among them. ``totals`` is (lang,
    total). Numbers are decimals of 38 digits, so products don't overflow.
    """
    own = phrases.filter("size(words) > 1").select("lang", "words", F.col("n").alias("a"))
    cuts = own.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    part = lambda name, n: phrases.select("lang", F.col("words").alias(name), F.col("n").alias(n))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    per = both.join(totals, "lang").withColumn("score", F.expr(f"CAST({FACTOR} AS DECIMAL(5,0)) * {wide('a')} * {wide('total')} div ({wide('l')} * {wide('r')})"))
    least = per.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("x"))
    return least.select("lang", "words", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")


def standing(candidates: DataFrame, within: int) -> DataFrame:
    """The candidates that no longer one replaces: one that contains them and has ``within`` percent or more of their occurrences, whether it stands itself or not."""
    spans = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    inner = candidates.filter("size(words) > 2").select("lang", "a", F.explode(spans).alias("words"))
    longer = inner.groupBy("lang", "words").agg(F.max("a").alias("longest"))
    return candidates.join(longer, ["lang", "words"], "left").filter(f"longest IS NULL OR 100 * longest < {within} * a").drop("longest")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases of up to ``longest`` words with ``least`` occurrences or more, (lang, words, n), and (lang, total).

    A text that is null is empty, a lang that is null ``und``; repeated rows count each
    time; a table without words gives empty tables. Other columns are not read. Both
    tables are written to the shared folder.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text"))
    words = stored(word_counts(texts).filter(f"word IS NULL OR n >= {int(least)}"), "frequent-words")
    single = words.filter("word IS NOT NULL")
    bitmaps = [spark.sparkContext.broadcast(_bitmap(_word_hashes(single)))]
    for _ in range(2):
        runs = stored(_run_counts(texts, list(bitmaps)).filter(f"n >= {int(least)}").select("h"), "frequent-runs")
        bitmaps.append(spark.sparkContext.broadcast(_bitmap(runs)))
        drop_stored(runs)
    found = patterns(projections(texts, bitmaps, longest, SPREAD * partitions(spark)), least)
    phrases = stored(single.select("lang", F.array("word").alias("words"), "n").unionByName(found), "phrases")
    return phrases, words.filter("word IS NULL").select("lang", F.col("n").alias("total"))


def collocations(docs: DataFrame, most: int = MOST, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score; see ``mine`` for odd input.

    By score and a, both descending, then by phrase. The best of PARTS parts of a language
    come first, so no task sorts all of a language that has most rows.
    """
    phrases, totals = mine(docs, longest, least)
    best = stored(standing(scored(phrases, totals), within).withColumn("phrase", F.array_join("words", " ")).drop("words"), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12: the first 2,000 collocations of each language of ``documents``."""
    return collocations(load(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, w[i:i + m - 1] AS words FROM o, range(1, {LONGEST + 1}) AS t(m) WHERE i + m - 1 <= len(w)),
t AS (SELECT lang, count(*) AS n FROM o GROUP BY 1),
f AS (SELECT lang, words, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
c AS (SELECT lang, words, a, k, words[1:k] AS x, words[k + 1:len(words)] AS y FROM f, range(1, {LONGEST}) AS t(k) WHERE k < len(words)),
s AS (SELECT c.lang, c.words, c.a, k, x.a AS l, y.a AS r, t.n, CAST({FACTOR}::HUGEINT * c.a * t.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.words = c.x JOIN f y ON y.lang = c.lang AND y.words = c.y JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
u AS (SELECT lang, words[i:i + m - 1] AS words, max(a) AS longest FROM f, range(2, {LONGEST}) AS t(m), range(1, {LONGEST}) AS v(i) WHERE len(f.words) > m AND i + m - 1 <= len(f.words) GROUP BY 1, 2),
z AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM b LEFT JOIN u USING (lang, words) WHERE longest IS NULL OR 100 * longest < {WITHIN} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= {MOST}"""
