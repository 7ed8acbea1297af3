"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Fingerprints within three bits of each other are linked. Three is odd, so balls of half
the radius don't meet as they stand: of the 64 bits one of three blocks is masked, and
whichever block holds a differing bit, two differing bits at most remain. Balls of radius
one over the remaining bits then meet on a shared variant. Each fingerprint emits 131
variants of 42 or 43 bits, where a ball of radius two over 64 bits would take 2,081.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import drop_stored, load, partitions, stored, text_or_empty, tune
from mosaiq.llm.components import components

#: The contract of the digest query: bits, words in a shingle, seed.
RADIUS, SHINGLE, SEED = 3, 3, 42
#: Blocks of bits, each masked in turn.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Buckets up to PAIRS members are joined pair by pair, up to LOCAL searched in one task, larger ones by full balls.
PAIRS, LOCAL = 8, 4096


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over shingles of words, repeats counted; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # a bounded piece of a long text at a time
        piece = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(piece.view(np.uint8).reshape(len(piece), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null texts count as empty."""
    tune(docs.sparkSession)
    narrow = docs.select("doc_id", text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    schema = T.StructType([narrow.schema["doc_id"], T.StructField("fp", T.LongType(), False)])
    return narrow.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): per block, the other bits of ``fp`` and of all fingerprints that differ in one of them."""
    kinds = []
    for tag, (lo, hi) in enumerate(BLOCKS):
        for bit in [None, *(i for i in range(64) if not lo <= i < hi)]:
            kinds.append((tag, 0 if bit is None else _signed(1 << bit)))
    rows = "array(" + ", ".join(f"named_struct('tag', {t}, 'flip', {f}L)" if f != -(1 << 63) else f"named_struct('tag', {t}, 'flip', shiftleft(1L, 63))" for t, f in kinds) + ")"
    x = F.col("fp").bitwiseXOR(F.col("v.flip"))
    key: Column = F.lit(None)
    for tag, (lo, hi) in reversed(list(enumerate(BLOCKS))):
        # The masked bits are closed up; the block's number goes to the top.
        packed = x.bitwiseAND(F.lit((1 << lo) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(x, 1), hi - 1), lo)).bitwiseOR(F.lit((tag + 1) << 60).cast("long"))
        key = F.when(F.col("v.tag") == tag, packed).otherwise(key)
    return fps.select("fp", F.explode(F.expr(rows)).alias("v")).select(key.alias("key"), "fp")


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def _local_stars(group) -> "object":
    """Links that join up, as a forest, what lies within the radius in one bucket of bounded size."""
    import pandas as pd

    left = group["fp"].to_numpy().view(np.uint64)
    out: list[tuple[int, int]] = []
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            near = np.bitwise_count(left ^ edge[0]) <= RADIUS
            found, left = left[near], left[~near]
            out += [(int(edge[:1].view(np.int64)[0]), x) for x in found.view(np.int64).tolist()]
            edge = np.concatenate([edge[1:], found])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _ball_links(fps: DataFrame) -> DataFrame:
    """Exact links without pairs: at a variant, all within one bit of it are within the radius of all within two.

    So at each variant everything is linked to the least fingerprint within one bit. Used
    for the members of buckets too large for one task; the cost is 2,081 rows each. The
    least ones are written first, so that Spark can split a variant with very many rows.
    """
    one = [1 << i for i in range(64)]
    near = ", ".join(f"{_signed(x)}L" if x < 1 << 63 else "shiftleft(1L, 63)" for x in [0, *one])
    steps = F.expr(f"array({near})")
    balls = fps.select("fp", F.posexplode(steps).alias("i", "x")).select("fp", "i", F.col("fp").bitwiseXOR(F.col("x")).alias("y"))
    # A second flip of a higher bit, or none.
    balls = balls.select("fp", "i", "y", F.posexplode(steps).alias("j", "x")).filter("j = 0 OR (i > 0 AND j > i)")
    balls = balls.select("fp", F.col("y").bitwiseXOR(F.col("x")).alias("key"), (F.col("j") == 0).alias("inner"))
    centre = balls.filter("inner").groupBy("key").agg(F.min("fp").alias("c"))
    return balls.join(stored(centre, "centres"), "key").filter("fp <> c").select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct()


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join up all fingerprints of ``fps`` (distinct) within the radius of each other.

    Every link is verified. All pairs are given in small buckets, a spanning forest in
    larger ones, which has the same components.
    """
    n = partitions(fps.sparkSession)
    met = variants(fps).repartition(n, "key")
    met = met.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    met = stored(met, "buckets")
    few = met.filter(f"n <= {PAIRS}")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")
    some = met.filter(f"n > {PAIRS} AND n <= {LOCAL}").groupBy("key").applyInPandas(_local_stars, "a long, b long")
    links = pairs.union(some).distinct()
    many = met.filter(f"n > {LOCAL}").select("fp").distinct()
    out = stored(links.union(_ball_links(many)), "near")
    drop_stored(met)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the least doc_id that links reach.

    Texts without words have fingerprint zero and are linked like any other. Rows may
    repeat; a null doc_id has no say in component_id, which is null only where a whole
    component has no doc_id. An empty table gives an empty one. Equal fingerprints are one
    node from the start, so groups of exact copies never meet in one task.
    """
    spark = docs.sparkSession
    of = stored(fingerprints(docs, shingle), "fingerprints")
    # Dealt out anew, as a few bytes of fingerprints make very many variants.
    fps = stored(of.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(partitions(spark)), "distinct")
    # Aggregates are written before they are joined, so that Spark can split a component or a fingerprint with very many rows.
    links = near_links(fps.select("fp"))
    roots = stored(components(links), "roots")
    rooted = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    first = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "first")
    classes = stored(rooted.join(first, "root").select("fp", "component_id"), "classes")
    for done in (fps, links, roots, rooted, first):
        drop_stored(done)
    return of.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
