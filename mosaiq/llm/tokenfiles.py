"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents. Layout, little-endian: the header (magic, ids in a block,
documents, ids, blocks), doc ids (int64; the least one stands for null), ids per document (uint32), the blocks, and
the index of block starts (uint32, from the first block). A block of up to 256 ids: its
minimum (uint32), bit width (uint8), ids - 1 (uint8), exceptions (uint16); the low bits of
each id less the minimum, packed at that width; positions (uint8) and whole differences
(uint32) of the exceptions. The width is that of the 90th percentile of the block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm import files
from mosaiq.llm.common import load, partitions, scratch, stored, text_or_empty, tune

MAGIC = b"MQT1"
HEAD = struct.Struct("<4sIQQI")
BLOCK = 256
PERCENTILE = 90
#: Ids in a file, give or take a document.
FILE_IDS = 1 << 20
NULL_ID = -(1 << 63)
END = 1


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids`` (uint32) one after another, and where each starts."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return b"", np.zeros(0, np.uint32)
    full = np.full(rows * BLOCK, ids[-1], np.uint32)  # the last block is filled with its last id, which is cut off again
    full[:n] = ids
    full = full.reshape(rows, BLOCK)
    low = full.min(axis=1)
    delta = full - low[:, None]
    wide = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)  # bits that a difference needs
    k = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.partition(wide, k, axis=1)[:, k]
    odd = wide > width[:, None]
    n_odd = odd.sum(axis=1)
    size = 8 + BLOCK // 8 * width.astype(np.int64) + 5 * n_odd
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    count = np.full(rows, BLOCK - 1, np.uint8)
    count[-1] = (n - 1) % BLOCK
    head = np.zeros(rows, np.dtype([("low", "<u4"), ("width", "u1"), ("n", "u1"), ("odd", "<u2")]))
    head["low"], head["width"], head["n"], head["odd"] = low, width, count, n_odd
    out[starts[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(rows, 8)
    for w in np.unique(width[width > 0]).tolist():
        every = np.flatnonzero(width == w)
        for at in np.split(every, range(256, len(every), 256)):
            bits = (delta[at, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            out[starts[at, None] + 8 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    row, pos = np.nonzero(odd)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_odd)])[row]
        base = starts[row] + 8 + BLOCK // 8 * width[row].astype(np.int64)
        out[base + rank] = pos
        values = delta[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_odd[row] + 4 * rank)[:, None] + np.arange(4)] = values
    return out.tobytes(), starts[:-1].astype(np.uint32)


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` of ``data``, in that order."""
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(8)]).view(np.dtype([("low", "<u4"), ("width", "u1"), ("n", "u1"), ("odd", "<u2")])).ravel()
    full = np.zeros((len(starts), BLOCK), np.uint32)
    width = head["width"].astype(np.int64)
    for w in np.unique(width[width > 0]).tolist():
        every = np.flatnonzero(width == w)
        for at in np.split(every, range(256, len(every), 256)):
            packed = raw[starts[at, None] + 8 + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            whole = np.zeros((len(at), BLOCK), np.uint32)
            for b in range(w):
                whole |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
            full[at] = whole
    n_odd = head["odd"].astype(np.int64)
    row = np.repeat(np.arange(len(starts)), n_odd)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_odd)])[row]
        base = starts[row] + 8 + BLOCK // 8 * width[row]
        values = np.ascontiguousarray(raw[(base + n_odd[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        full[row, raw[base + rank]] = values
    full += head["low"][:, None]
    return full[np.arange(BLOCK) <= head["n"][:, None]]


def to_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks, starts = pack(whole)
    named = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8")
    return HEAD.pack(MAGIC, BLOCK, len(named), len(whole), len(starts)) + named.tobytes() + np.array([len(x) for x in ids], "<u4").tobytes() + blocks + starts.astype("<u4").tobytes()


def _parts(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    magic, block, n_docs, _, n_blocks = HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a file of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    end = len(data) - 4 * n_blocks
    return doc_ids, counts, data[at + 12 * n_docs : end], np.frombuffer(data, "<u4", n_blocks, end)


def from_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc id, ids) of each document of a file, in order."""
    doc_ids, counts, blocks, starts = _parts(data)
    whole = unpack(blocks, starts)
    ends = np.cumsum(counts)
    for d, n, e in zip(doc_ids.tolist(), counts.tolist(), ends.tolist()):
        yield None if d == NULL_ID else d, whole[e - n : e]


def read_range(data: bytes, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a file, of which only the blocks that hold them are unpacked."""
    _, _, blocks, starts = _parts(data)
    first = begin // BLOCK
    return unpack(blocks, starts[first : -(-end // BLOCK)])[begin - first * BLOCK : end - first * BLOCK]


class WordEncoder:
    """A tokenizer of the tokenizers library, asked once for each distinct word.

    Only for vocabularies whose tokens hold no white space: then a text's ids are those of
    its words, one after another. New words are sent together, parted by a special token.
    The memory of words is bounded and starts anew when full. A word of letters below
    U+0100 is sought in lower case and without a full stop or comma at its end, which such
    a tokenizer lowers and parts itself, which is tried with a few words when it is read.
    """

    MOST, LONGEST, TOGETHER = 2_000_000, 100, 500
    STOPS = ".,!?;:"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if not (x.lstrip or x.rstrip or x.single_word or x.normalized)}
        self.known: dict[str, bytes] = {"": b""}
        sample = ["Abc", "ÀÉÞß", "x1", "Z"]
        self.plain = all(self._encode([w + s])[0] == self._encode([w.lower()])[0] + self._encode([s])[0] for w in sample for s in self.STOPS)

    def _stem(self, word: str) -> tuple[str, str] | None:
        """The lower-case word without its stop, and the stop, if the ids are those of the two."""
        stop = word[-1] if word[-1] in self.STOPS and len(word) > 1 else ""
        stem = word[:-1] if stop else word
        if self.plain and stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
            return stem.lower(), stop
        return None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        mark, number = next(iter(self.special.items()), ("", -1))
        for at in range(0, len(words), self.TOGETHER):
            some = words[at : at + self.TOGETHER]
            text = mark.join(some)
            # No special token may occur but those between the words.
            if mark and text.count(mark) == len(some) - 1 and not any(m in text for m in self.special if m != mark):
                ids = np.array(self._encode([text])[0], np.uint32)
                raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == number)).tolist(), 4 * len(ids)]
                if len(ends) == len(some):
                    self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *(e + 4 for e in ends[:-1])], ends))))
                    continue
            self.known.update((w, np.array(ids, np.uint32).tobytes()) for w, ids in zip(some, self._encode(some)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32."""
        parted = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parted).difference(self.known)
        if len(self.known) + 2 * len(new) > self.MOST:
            self.known = {"": b""}
            new = set().union(*parted).difference(self.known)
        known = self.known
        stems = {w: x for w in new if (x := self._stem(w))}
        wanted = {w for w in new if w not in stems} | {p for x in stems.values() for p in x}
        self._learn(list(wanted.difference(known)))
        known.update((w, known[a] + known[b]) for w, (a, b) in stems.items())
        get = known.__getitem__
        out = [b"".join(map(get, ws)) for ws in parted]
        for w in new:
            if len(w) > self.LONGEST:
                del known[w]
                if w in stems:
                    known.pop(stems[w][0], None)
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of a file, read once per Python worker; what it has learned serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents in ranges of doc_id, in order within each; repeated ids in the order of their texts."""
    n = partitions(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


_MANIFEST = "shard long, seq long, file string, n_docs long, n_ids long"


def write_files(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ids of ``docs`` in ascending doc_id order; the manifest of files, with ``base``: ids in the files before it.

    Null texts count as empty: the end id alone. An empty table gives no file. The manifest
    has one row per file, so its running sum is small whatever the number of documents.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode, last = encoder_of(tokenizer), np.array([end], np.uint32).tobytes()
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        total, seq = 0, 0

        def flush() -> pa.RecordBatch:
            uri = files.put(folder, f"{shard:06d}-{seq:06d}.mqt", to_file(doc_ids, ids))
            return pa.RecordBatch.from_pydict({"shard": [shard], "seq": [seq], "file": [uri], "n_docs": [len(ids)], "n_ids": [total]})

        for b in batches:
            for at in range(0, b.num_rows, 100):
                piece = b.slice(at, 100)
                for d, raw in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                    doc_ids.append(d)
                    ids.append(np.frombuffer(raw + last, np.uint32))
                    total += len(ids[-1])
                    if total >= FILE_IDS:
                        yield flush()
                        doc_ids, ids, total, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    manifest = stored(_ordered(docs).mapInArrow(run, _MANIFEST), "manifest")
    # Shards are ranges of doc_id: a row for each is summed up, and files count from their shard's start.
    shards = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0).cast("long")).alias("start"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("seq"))), F.lit(0).cast("long"))
    return manifest.withColumn("inside", inside).join(starts, "shard").withColumn("base", F.col("start") + F.col("inside")).drop("start", "inside")


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document of the files of ``manifest``."""
    tune(manifest.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for d, x in from_file(files.get(file)):
                    rows.append((d, base, len(x), zlib.crc32(x.astype("<u4").tobytes()), *[x] * with_ids))
                    base += len(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows))], names)

    schema = T.StructType([T.StructField(n, T.ArrayType(T.LongType()) if n == "ids" else T.LongType()) for n in names])
    return manifest.select("file", "base").repartition(partitions(manifest.sparkSession)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_files(write_files(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
