"""Near copies by SimHash at any similarity: several fingerprints per text, balls in each, links verified.

It is operator 5 in its general form, for similarities that one fingerprint of 64 bits can't
tell apart. Each text has TABLES fingerprints of BITS bits over its different shingles of
five words. Each fingerprint emits the variants within half the radius of RADIUS bits, and
texts meet on a shared variant of a table. Two similar texts differ in bits that were close
in both: only bits of the smallest margins between ones and zeros are flipped, FLIPS of a
fingerprint and all of equal margin. Two texts of similarity 0.8 differ in about 15 % of
their bits and meet in one table of ten; more similar ones meet in most. Texts of one
fingerprint are one when variants are made, so a large group of near copies has few. Links
are those of pairs that met whose shingles are at least four fifths the same, counted over
the whole sets.

Fingerprints bring most copies together cheaply; what they miss is found exactly. A pair of
similarity 0.8 has four fifths of each set's shingles in common, so a text with too many
shingles that no other text has is out. Of the others the rarest shared shingles, as many
as may be missing and one more, are held in common by every such pair: texts that aren't
joined yet meet at these, and no pair is left out. So TABLES decides what is found cheaply,
not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import drop_stored, partitions, release, stored, text_or_empty, tune
from mosaiq.llm.components import components
from mosaiq.llm.words import Words, slices

SHINGLE, SEED = 5, 42
#: Similar are texts whose common shingles are at least four fifths of all of theirs.
PART, WHOLE = 4, 5
#: Fingerprints of a text, bits of each and the bits in which two that meet may differ: twice what a ball reaches.
TABLES, BITS, RADIUS = 12, 32, 2
#: Bits of a fingerprint that a variant may flip: those of the least margins, and all that tie with the last of them.
FLIPS = 8
#: Tables whose variants are shuffled together.
WAVE = 4
#: Parts, by hash, of all shingles, and which are counted together: those before HEAD rule out most texts.
PARTS, HEAD = 6, 2
PASSES = ((0, 1), (1, 2), (2, 4), (4, 6))
#: Bytes of text handled at once.
SHARD = 4 << 20
#: Pairs of fingerprints that differ in more of all their bits aren't verified at first: of 384 bits 58 differ at similarity 0.8, 82 is
#: three deviations above that. In small sets ties let more bits differ, so a pair whose
#: smaller set has fewer than SHORT is verified whatever its bits say.
FLOOR, SHORT = 82, 64
#: Nodes that a node is first held against: of all centres it met, those whose fingerprints differ least from its own.
CENTRES = 3
#: Buckets of a shared shingle up to PAIRS members are joined pair by pair; larger ones are compared by blocks of LOCAL in one task each.
PAIRS, LOCAL = 8, 2048

_WORDS = TABLES * BITS // 64
_FLIP = np.random.default_rng(SEED).integers(0, 1 << 64, _WORDS, np.uint64, endpoint=False)


#: A-Z in lower case, all white space as spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted 64-bit hashes of its different shingles; a text of fewer words is one shingle, one without words has none."""
    w = Words([t.encode("utf-8", "surrogatepass") for t in texts], _TABLE)
    h, count = w.hashes(), np.diff(w.first)
    out = [np.zeros(0, np.uint64)] * len(texts)
    for n in sorted({*np.minimum(count, SHINGLE).tolist()} - {0}):
        at, key = w.windows(h, n)
        own = np.minimum(count, SHINGLE)[w.text[at]] == n
        key, text = key[own], w.text[at[own]]
        cuts = np.flatnonzero(np.diff(text)) + 1
        for k, keys in zip(text[np.append(0, cuts)].tolist(), np.split(key, cuts)):
            out[k] = np.unique(keys)
    return out


def node_of(grams: np.ndarray) -> int:
    """A signed 64-bit digest of the set, equal for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def signature(grams: np.ndarray) -> tuple[bytes, bytes]:
    """TABLES fingerprints of a set, one behind another: each bit is set in over half of the shingles' hashes; and, in the same order, which bits a variant may flip."""
    counts = np.zeros(_WORDS * 64, np.int64)
    for at in range(0, len(grams), 255):  # so many that bytes hold the counts
        h = grams[at : at + 255, None] ^ _FLIP
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    margin = np.abs(2 * counts - len(grams)).reshape(TABLES, BITS)
    close = margin <= np.partition(margin, FLIPS - 1, axis=1)[:, FLIPS - 1 : FLIPS]
    return tuple(np.packbits(x, bitorder="little").tobytes() for x in (2 * counts > len(grams), close))


def _of_parts(grams: np.ndarray, first: int, end: int) -> np.ndarray:
    part = grams % np.uint64(PARTS)
    return (part >= first) & (part < end)


def _signed_up(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, sig, close, size, head): the digest of each text's set, its fingerprints and their bits to flip, null where there are no words, how many shingles it has, and how many of them are of the first HEAD parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 2, SHARD)):
            sets = shingles(b.column(2).to_pylist())
            sigs, close = zip(*(signature(g) if len(g) else (None, None) for g in sets))
            columns = [b.column(0), b.column(1), pa.array(map(node_of, sets), pa.int64()), pa.array(sigs, pa.binary()), pa.array(close, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([int(_of_parts(g, 0, HEAD).sum()) for g in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "sig", "close", "size", "head"])

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, t) for c, t in (("th", T.LongType()), ("node", T.LongType()), ("sig", T.BinaryType()), ("close", T.BinaryType()), ("size", T.LongType()), ("head", T.LongType()))]])
    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def _prints(nodes: DataFrame, tables: range) -> DataFrame:
    """(key, node, close): each of the tables' fingerprints, with the table's number on top, and its bits to flip."""
    # Bytes of a fingerprint as a number; which byte comes first doesn't matter.
    value = lambda c, t: F.conv(F.hex(F.substring(c, t * BITS // 8 + 1, BITS // 8)), 16, 10).cast("long")
    keys = F.array(*[F.struct((value("sig", t) + F.lit(t << BITS).cast("long")).alias("key"), value("close", t).alias("close")) for t in tables])
    return nodes.filter("sig IS NOT NULL").select("node", F.explode(keys).alias("x")).select("x.key", "node", "x.close")


def _flipped(prints: DataFrame) -> DataFrame:
    """(key, node, flip): each fingerprint and all that differ in one of its bits to flip, ``flip``."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(BITS)])
    return prints.select("node", "key", "close", F.explode(flips).alias("flip")).filter("(flip & close) = flip").select(F.col("key").bitwiseXOR(F.col("flip")).alias("key"), "node", "flip")


def _variants(nodes: DataFrame, tables: range) -> DataFrame:
    """(key, node, flip) of all nodes."""
    return _flipped(_prints(nodes, tables))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, centre): the least of the nodes that ``node`` meets, at its fingerprint or at a variant.

    Nodes of one fingerprint are held against the least of them, which alone has variants
    and meets others there.
    """
    out = None
    for first in range(0, TABLES, WAVE):
        prints = _prints(nodes, range(first, min(first + WAVE, TABLES)))
        least = F.min(F.struct("node", "close")).alias("x")
        alike = stored(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n"), least).select("key", "n", "x.*"), "prints")
        same = prints.select("key", "node").join(alike.filter("n > 1").select("key", F.col("node").alias("centre")), "key")
        variants = _flipped(alike).select(F.col("key").alias("variant"), "node")
        heads = variants.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre"))
        heads = stored(heads.filter("n > 1").select("variant", "centre"), "heads")
        met = stored(same.select("node", "centre").union(variants.join(heads, "variant").select("node", "centre")).filter("node <> centre"), "buckets")
        drop_stored(heads)
        drop_stored(alike)
        out = met if out is None else out.union(met)
    return out


def _worth(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints ``x``, ``y`` of sets of ``n`` and ``m`` shingles are to be verified."""
    few, many = np.minimum(n, m), np.maximum(n, m)
    return ((np.bitwise_count(x ^ y).sum(axis=-1) <= FLOOR) | (few < SHORT)) & (WHOLE * few >= PART * many)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, bits) of the pairs whose fingerprints differ in FLOOR ``bits`` at most, or that have a short text, and whose sizes allow a similarity of 0.8."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("size").alias(f"{c}_size")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, _WORDS) for c in b.columns[2:4])
            bits = pa.array(np.bitwise_count(x ^ y).sum(axis=-1), pa.int32())
            yield b.select(["a", "b"]).append_column("bits", bits).filter(pa.array(_worth(x, y, *(c.to_numpy() for c in b.columns[4:]))))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_sig", "b_sig", "a_size", "b_size").mapInArrow(run, "a long, b long, bits int")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams): the shingles of the texts of ``wanted`` (doc_id, th, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1, SHARD)):
            grams = pa.array([g.view(np.int64) for g in shingles(b.column(1).to_pylist())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), grams], ["node", "grams"])

    # Dealt out again: few bytes of text that a join puts into few tasks are much work.
    texts = docs.join(wanted, ["doc_id", "th"]).select("node", "text").repartition(partitions(docs.sparkSession))
    one = texts.mapInArrow(run, "node long, grams array<long>")
    return one.groupBy("node").agg(F.first("grams").alias("grams"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_sets(docs, nodes.join(wanted, "node").select("least.*", "node")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(WHOLE * both >= PART * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    out = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "a_grams", "b_grams").mapInArrow(run, "a long, b long"), "near")
    drop_stored(sets)
    return out


def _first_key(x: np.ndarray, y: np.ndarray, open_x: np.ndarray, open_y: np.ndarray) -> np.ndarray:
    """Where nodes of fingerprints ``x`` (one's, by table) and ``y`` (many's), which may flip the bits ``open_x`` and ``open_y``, meet first: of the first table in which they do, the least variant that both have; -1 if nowhere."""
    diff = x ^ y
    low = diff & (~diff + np.uint32(1))
    high = diff ^ low  # none of several: the radius is two bits
    within = np.bitwise_count(diff) <= RADIUS
    # One flips the lower bit and the other the higher one, if there are such bits.
    ways = [(within & (p & ~open_x == 0) & (q & ~open_y == 0), x ^ p) for p, q in ((low, high), (high, low))]
    table = np.argmax(ways[0][0] | ways[1][0], axis=1)
    at = np.arange(len(y)), table
    least = np.minimum(*(np.where(met[at], key[at].astype(np.int64), 1 << BITS) for met, key in ways))
    return np.where(least < 1 << BITS, (table.astype(np.int64) << BITS) + least, -1)


def _shared(texts: DataFrame, first: int, end: int) -> DataFrame:
    """(node, gram, n) of all shingles of some parts that several rows of ``texts`` (node, text) have; n is the same for a shingle wherever it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1, SHARD)):
            sets = [g[_of_parts(g, first, end)] for g in shingles(b.column(1).to_pylist())]
            grams = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), list(map(len, sets)))), pa.array(grams)], ["node", "gram"])

    rows = texts.mapInArrow(run, "node long, gram long")
    heads = stored(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    out = stored(rows.join(heads, "gram").select("node", "gram", "n"), "shared")
    drop_stored(heads)
    return out


def _prefixes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, tokens, prefix) of the nodes that may be similar to another: the shingles that others have too, sorted, and the rarest of them, one of which every similar node has in its own prefix.

    A node needs four fifths of its shingles in another. As soon as more than a fifth are
    its own, it is out; the first parts' shingles show that of most. Rows of one doc_id and
    one text, which come several times, may leave more in, and nothing out.
    """
    release(docs.sparkSession, 0)  # texts were shuffled before, and are again
    least = nodes.filter("size > 0").select("least.doc_id", "least.th", "node")
    texts = stored(docs.join(least, ["doc_id", "th"]).select("node", "text"), "texts")
    head = [_shared(texts, *x) for x in PASSES if x[1] <= HEAD]
    first = reduce(DataFrame.union, head)
    counts = stored(first.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "counts")
    may = nodes.join(counts, "node", "left").filter(f"size > 0 AND {WHOLE} * (coalesce(n, 0) + size - head) >= {PART} * size")
    alive = stored(may.select("node", "size"), "alive")
    rest = stored(texts.join(alive, "node", "left_semi"), "texts")
    drop_stored(texts)
    met = [stored(first.join(alive, "node", "left_semi"), "shared")]
    for done in head:
        drop_stored(done)
    met += [_shared(rest, *x) for x in PASSES if x[0] >= HEAD]
    tokens = stored(reduce(DataFrame.union, met).groupBy("node").agg(F.collect_set(F.struct("n", "gram")).alias("x")), "tokens")
    need = F.expr(f"({PART} * size + {WHOLE - 1}) div {WHOLE}")
    ready = tokens.join(alive, "node").withColumn("need", need).filter("size(x) >= need")
    rare = F.slice(F.sort_array("x"), F.lit(1), (F.size("x") - F.col("need") + 1).cast("int"))
    out = stored(ready.select("node", "size", F.sort_array("x.gram").alias("tokens"), F.transform(rare, lambda x: x["gram"]).alias("prefix")), "prefixes")
    for done in (counts, alive, rest, tokens, *met):
        drop_stored(done)
    return out


def _similar_pairs(pairs: DataFrame, ready: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is 0.8 or more, by the shingles of ``ready``: all that two sets have in common are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y, n, m in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist()):
                both = len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                near.append(WHOLE * both >= PART * (n + m - both))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = (ready.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"), F.col("size").alias(f"{c}_size")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_tokens", "b_tokens", "a_size", "b_size").mapInArrow(run, "a long, b long")


def _block_links(met: DataFrame, ready: DataFrame) -> DataFrame:
    """(a, b): links within large buckets that join what isn't joined yet: every two blocks of a bucket meet in one task, which compares whole sets and gives a tree of links."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["lo"].iat[0], group["hi"].iat[0]
        node, block, size = (group[c].to_numpy() for c in ("node", "block", "size"))
        # Two nodes of different components are never both in the most common one.
        roots, root, count = np.unique(group["root"].to_numpy(), return_inverse=True, return_counts=True)
        common, start = root == np.argmax(count), np.cumsum([0, *map(len, group["tokens"])])[:-1]
        _, flat = np.unique(np.concatenate(list(group["tokens"])), return_inverse=True)
        ends, mark, out = np.append(start, len(flat)), np.zeros(len(flat) + 1, bool), []
        for k in np.flatnonzero(~common):
            few, many = np.minimum(size, size[k]), np.maximum(size, size[k])
            at = (root != root[k]) & (WHOLE * few >= PART * many) & ((block == (j if block[k] == i else i)) if i != j else True)
            if not at.any():
                continue
            own = flat[ends[k] : ends[k + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], start, dtype=np.int64)
            mark[own] = False
            for x in np.flatnonzero(at & (WHOLE * both >= PART * (size + size[k] - both))):
                if root[x] != root[k]:
                    out.append((min(node[k], node[x]), max(node[k], node[x])))
                    root[root == root[x]] = root[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    blocks = F.ceil(F.col("n") / LOCAL).cast("int")
    dealt = met.join(ready.select("node", "tokens"), "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("gram", "node", "root", "tokens", "size", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return dealt.groupBy("gram", "lo", "hi").applyInPandas(run, "a long, b long")


def _missed(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): verified links between the components of ``links``, so that with them all nodes of similarity 0.8 or more are joined."""
    ready = _prefixes(docs, nodes)
    roots = stored(components(links), "roots")
    open_ = stored(ready.join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), F.explode("prefix").alias("gram")), "open")
    # Shingles of one passage are shared by the same nodes: of those one will do. Sets are told apart by two hashes of 64 bits.
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "node")).alias("y")]
    several = open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *same).filter("lo <> hi")
    several = stored(several.groupBy("n", "x", "y").agg(F.min("gram").alias("gram")).select("gram", "n"), "several")
    left = stored(open_.join(several, "gram"), "open")
    few = left.filter(f"n <= {PAIRS}")
    one, other = (few.select("gram", F.col("node").alias(c), F.col("root").alias(f"{c}_root"), F.col("size").alias(f"{c}_size")) for c in "ab")
    pairs = one.join(other, "gram").filter(f"a < b AND a_root <> b_root AND {WHOLE} * least(a_size, b_size) >= {PART} * greatest(a_size, b_size)").select("a", "b").distinct()
    pairs = stored(pairs, "pairs")
    out = stored(_similar_pairs(pairs, ready).union(_block_links(left.filter(f"n > {PAIRS}"), ready)), "missed")
    for done in (ready, roots, open_, several, left, pairs):
        drop_stored(done)
    return out


def _links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): verified links that join up all nodes that are similar.

    The least node of each bucket of fingerprints is the centre of all that meet there. A
    node is held against the CENTRES nearest ones by the bits of their fingerprints. All
    similar nodes that this leaves in several components are found by their shingles.
    """
    met = _buckets(nodes)
    stars = stored(met.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    drop_stored(met)
    # A node has no more centres than variants.
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("bits", "b"))), 1, CENTRES)
    near = stored(_near(stars, nodes).groupBy("a").agg(nearest.alias("x")).select("a", F.explode("x.b").alias("b")), "stars")
    drop_stored(stars)
    links = _verified(near, docs, nodes)
    drop_stored(near)
    return links.union(_missed(docs, nodes, links))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, least, component_id) of the rows with a doc_id: the least doc_id that links of similarity 0.8 or more reach.

    ``th`` is a hash of the text; ``least`` tells the row that stays: the one of the
    component with the least doc_id, and of several the least th. Texts of equal sets, those
    without words among them, are one node from the start. Every join is between written
    tables, so Spark splits it where one node or one component has very many rows.
    """
    tune(docs.sparkSession)
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    of = stored(_signed_up(named), "signatures")
    nodes = of.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("sig").alias("sig"), F.first("close").alias("close"), F.first("size").alias("size"), F.first("head").alias("head"))
    nodes = stored(nodes.repartition(partitions(docs.sparkSession)), "nodes")
    links = _links(named, nodes)
    roots = stored(components(links), "roots")
    joined = stored(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    first = stored(joined.groupBy("root").agg(F.min("least").alias("first")), "first")
    rooted = stored(joined.join(first, "root").select("node", "first"), "rooted")
    out = stored(of.select("doc_id", "th", "node").join(rooted, "node"), "classes")
    for done in (of, nodes, links, roots, joined, first, rooted):
        drop_stored(done)
    return out.select("doc_id", "th", F.expr("doc_id = first.doc_id AND th = first.th").alias("least"), F.col("first.doc_id").alias("component_id"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the least doc_id, of several that with the least hash of its text.

    Rows of one doc_id and one text are copies of each other, and one stays; rows that share
    only their doc_id count as documents of their own. Rows without doc_id all stay, as
    nothing tells which of them is meant. Columns are unchanged.
    """
    kept = near_copies(docs).filter("least").select("doc_id", "th").distinct()
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    rows = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("d"), F.col("doc_id").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"))
    rows = rows.join(kept, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return rows.select(*names).unionByName(docs.filter("doc_id IS NULL"))
