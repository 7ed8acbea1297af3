"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Word vectors: every word has a fixed sparse index vector, drawn from its hash; a word's
vector is its own index vector and the sum of those of its neighbours, over all documents.
A document is the mean of its words' vectors, of those of their shapes, and three measures
of its words. The network is fitted in numpy on the driver from a bounded sample of
labelled rows. Documents are read twice, for the sums and for the scores; what is shuffled
of them is a matrix per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import load, text_or_empty, tune

#: Labelled rows that the classifier is fitted on at most: those with the least hash of their doc_id.
SAMPLE = 6000
#: Hash buckets of words, the length of their vectors, entries set in an index vector, neighbours on either side.
BUCKETS, SIZE, ENTRIES, REACH = 1 << 13, 48, 6, 2
HIDDEN, EPOCHS, RATE, DECAY, SEED = 48, 60, 0.01, 1e-4, 7
#: Tasks in which the sums of all tasks are added up; each sends one matrix of 3 MB to the driver.
TASKS = 8
#: Words of a text at a time, and pairs of neighbours counted together.
PIECE, PAIRS = 1 << 15, 1 << 21

#: Letters of one case, digits and the rest of a word become one sign each.
_SHAPE = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 else 57 if 48 <= c <= 57 else 117 if c >= 128 else c for c in range(256))


def index_vectors(size: int = SIZE) -> np.ndarray:
    """The sparse vectors of +1 and -1 of all buckets."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, size), np.float32)
    at = np.argsort(rng.random((BUCKETS, size)), axis=1)[:, :ENTRIES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, ENTRIES)), axis=1)
    return out


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's words and their shapes as buckets; the halves of the buckets are theirs each."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    shapes = raw.translate(_SHAPE).split()
    half = BUCKETS // 2
    a = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % half
    b = np.fromiter((zlib.crc32(s[:1] + s[-3:]) for s in shapes), np.int64, len(shapes)) % half + half
    return a, b


def neighbour_sums(texts: Iterator[str]) -> np.ndarray:
    """Summed index vectors of every bucket's neighbours; whole numbers, so that their order doesn't matter.

    How often buckets meet is counted first, in a table by pairs, and multiplied with the
    index vectors once per PAIRS of them.
    """
    index = index_vectors().astype(np.float64)
    out = np.zeros_like(index)
    pairs: list[np.ndarray] = []
    size = 0

    def add() -> None:
        keys, n = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = keys // BUCKETS, keys % BUCKETS
        for at in range(0, len(keys), PIECE):
            part = slice(at, at + PIECE)
            first = np.flatnonzero(np.append(True, np.diff(a[part]) != 0))
            out[a[part][first]] += np.add.reduceat(index[b[part]] * n[part, None], first, axis=0)

    for t in texts:
        for ids in buckets(t):
            for at in range(0, len(ids), PIECE):
                piece = ids[max(at - REACH, 0) : at + PIECE]
                new = at - max(at - REACH, 0)
                for step in range(1, REACH + 1):
                    # Pairs within what came before this piece were counted with it.
                    left, right = piece[max(new - step, 0) : -step], piece[max(new - step, 0) + step :]
                    pairs += [left * BUCKETS + right, right * BUCKETS + left]
                    size += 2 * len(left)
            if size >= PAIRS:
                add()
                pairs, size = [], 0
    if pairs:
        add()
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Own index vector plus the direction of the neighbours'."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return (index_vectors() / np.sqrt(ENTRIES) + np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)).astype(np.float32)


def features(text: str, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of words and shapes, their lengths, words in all and the share of different ones."""
    a, b = buckets(text)
    n = len(a)
    out = np.zeros(2 * SIZE + 4, np.float64)
    if n:
        for k, ids in enumerate((a, b)):
            total = sum(vectors[ids[at : at + PIECE]].sum(axis=0, dtype=np.float64) for at in range(0, n, PIECE))
            out[k * SIZE : (k + 1) * SIZE] = total / n
            out[2 * SIZE + k] = np.linalg.norm(total / n)
        out[-2] = np.log1p(n) / 5
        out[-1] = len(np.unique(a)) / np.sqrt(n) / 5
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss, classes weighed alike; a fifth of the rows is kept back to set the temperature.

    Without rows of both classes the score is the share of label 1, or one half without rows.
    """
    d = x.shape[1]
    if len(np.unique(y)) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    back, rows = np.split(order, [len(y) // 5])
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    ones = max(y[rows].mean(), 1e-3)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / max(1 - ones, 1e-3))
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
            z = (x[batch] - mean) / scale
            h = np.tanh(z @ p[0] + p[1])
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - y[batch]) / len(batch)
            back_h = np.outer(g, p[2]) * (1 - h * h)
            grads = [z.T @ back_h + DECAY * p[0], back_h.sum(axis=0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    # The weights moved the odds to even ones; they are moved back, then the temperature is set.
    net.b2 += float(np.log(ones / (1 - ones))) if ones < 1 else 0.0
    if len(back):
        z = net.logits(x[back])
        grid = np.exp(np.linspace(np.log(0.25), np.log(16), 60))
        net.temperature = float(grid[int(np.argmin([_loss(z / t, y[back]) for t in grid]))])
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def score_documents(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, score, predicted) per row; null and empty texts get the score of no words."""
        tune(docs.sparkSession)
        sent = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network))  # 3 MB, whatever the input
        kind = dict(docs.select("doc_id").dtypes)["doc_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors, network = sent.value
            for b in batches:
                x = np.array([features(t.as_py(), vectors) for t in b.column(1)]).reshape(b.num_rows, 2 * SIZE + 4)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(x))], ["doc_id", "score"])

        out = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
        return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """A classifier from ``sample`` labelled rows at most that are not held out.

    A document with several labels counts with each; labels of null and labels without a
    document are left out.
    """
    spark = docs.sparkSession
    tune(spark)
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # At most ``sample`` rows of 12 bytes are broadcast. Documents may repeat a doc_id: of all rows that it finds, as many stay.
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("th", F.xxhash64("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "th").limit(sample).select("text", "y").repartition(TASKS).persist()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"m": [neighbour_sums(t.as_py() for b in batches for t in b.column(0)).tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, SIZE))
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py(), np.float64).reshape(BUCKETS, SIZE)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = texts.select("text").mapInArrow(sums, "m binary").repartition(TASKS).mapInArrow(added, "m binary").toLocalIterator()
    vectors = word_vectors(sum((np.frombuffer(r.m, np.float64).reshape(BUCKETS, SIZE) for r in parts), np.zeros((BUCKETS, SIZE))))
    sent = spark.sparkContext.broadcast(vectors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py(), sent.value).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column(1)], ["x", "y"])

    found = rows.mapInArrow(measure, "x binary, y int").collect()  # ``sample`` rows of 800 bytes
    rows.unpersist()
    # Sorted, so that the fit doesn't depend on the order in which tasks end.
    found.sort(key=lambda r: (bytes(r.x), r.y))
    x = np.array([np.frombuffer(r.x, np.float64) for r in found]).reshape(len(found), 2 * SIZE + 4)
    return Classifier(vectors, fit(x, np.array([r.y for r in found], np.float64)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return train(docs, load(spark, sf_dir, "labels")).score_documents(docs)
