"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Totals are additive, so a document that comes, goes or is counted anew is a row of +1, -1
or both. A batch of changes is summed to one row per group and written under its id; a
batch that is there already is not written again, so it can be repeated after any failure.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import load, scratch, stored, text_or_empty, tune

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")


def count_words(docs: DataFrame) -> DataFrame:
    """``docs`` counted by runs of anything but ASCII white space, by SQL functions alone."""
    n = F.size(F.regexp_extract_all(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), n.cast("long").alias("n_tokens"), F.length(text_or_empty()).cast("long").alias("n_chars"))


def count_tokens(docs: DataFrame, path: str, version: str) -> DataFrame:
    """``docs`` counted by a tokenizer of the tokenizers library; null texts have no tokens."""
    from mosaiq.llm.tokenfiles import encoder_of

    tune(docs.sparkSession)
    narrow = docs.select("doc_id", "source", "lang", text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                texts = b.column(3).to_pylist()
                n = [len(x) // 4 for x in encode(texts)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([version] * len(n)), pa.array(n, pa.int64()), pa.array(map(len, texts), pa.int64())], schema.names)

    schema = T.StructType([*narrow.schema.fields[:3], T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType())])
    return narrow.mapInArrow(run, schema)


def inserted(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def undone(deltas: DataFrame) -> DataFrame:
    """Signed rows, summed or not, with all signs turned."""
    return deltas.select(*GROUP, *[(-F.col(c)).alias(c) for c in SUMS])


def deleted(counted: DataFrame) -> DataFrame:
    """``counted`` as it was when it was inserted."""
    return undone(inserted(counted))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows counted anew, perhaps by another tokenizer, or under another source or language."""
    return deleted(before).unionByName(inserted(after))


def _sums() -> list:
    return [F.sum(c).alias(c) for c in SUMS]


class Rollup:
    """Totals in a folder that all machines share: a table per committed batch, and snapshots of many.

    Spark's writer marks a whole table with ``_SUCCESS``; only marked ones count. Two
    writers may not commit the same batch at once; different batches don't meet.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _whole(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{kind}")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if self.has(kind, n)]

    def has(self, kind: str, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{kind}/{name}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False, and nothing done, if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError("a batch is named by letters, digits, dots and hyphens")
        if batch in self.committed():
            return False
        totals = deltas.groupBy(*GROUP).agg(*_sums())
        totals.write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")
        return True

    def _state(self) -> tuple[list[str], str | None, list[str]]:
        """Whole batches, the last snapshot, and the batches inside it.

        Batches are listed first: one that a compaction folds meanwhile is then inside the
        snapshot that is read after it, and in neither list never.
        """
        batches = self._whole("batches")
        found = self._whole("snapshots")
        if not found:
            return batches, None, []
        inside = self.spark.read.parquet(f"{self.root}/contents/{found[-1]}")
        return batches, f"{self.root}/snapshots/{found[-1]}", [r.batch for r in inside.collect()]

    def committed(self) -> list[str]:
        batches, _, inside = self._state()
        return sorted({*batches, *inside})

    def totals(self) -> DataFrame:
        """The sums of all committed batches; groups whose sums are all zero are left out.

        The table may be read until the second compaction after this call.
        """
        batches, at, inside = self._state()
        paths = [*([at] if at else []), *(f"{self.root}/batches/{b}" for b in batches if b not in inside)]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        return self._sum(paths)

    def _sum(self, paths: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, (self.spark.read.parquet(p) for p in paths))
        return rows.groupBy(*GROUP).agg(*_sums()).filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold the batches committed so far into a snapshot, so that reading doesn't slow down with their number.

        What is folded is what was listed at the start, and the list is written with it: a
        batch committed meanwhile stays a batch. A snapshot that wasn't finished is passed
        over, and of two made at once one counts, by its own list. Files go when the
        snapshot before has what was in them, so who has just begun to read them can end.
        """
        batches, at, inside = self._state()
        names = [n for n in batches if n not in inside]
        if not names:
            return
        name = f"{int(at.rsplit('/', 1)[1].split('-')[0]) + 1 if at else 0:09d}-{uuid.uuid4().hex}"
        rows = self._sum([*([at] if at else []), *(f"{self.root}/batches/{n}" for n in names)])
        contents = self.spark.createDataFrame([(n,) for n in sorted({*inside, *names})], "batch string")
        contents.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/contents/{name}")
        rows.write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")
        for n in set(batches) & set(inside):
            fs, p = self._fs(f"{self.root}/batches/{n}")
            fs.delete(p, True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by words come, are revised to counts by a public tokenizer, come again, and documents without words go.

    Texts are read and counted once, each version by itself; the batches are sums of those
    counts. One batch is sent twice and counts once, and batches are folded half way.
    """
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    empty = F.regexp_instr(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]")) == 0
    parts = {}
    for there, some in ((True, docs.filter(~empty)), (False, docs.filter(empty))):
        parts["words", there] = count_words(some)
        parts["tokens", there] = count_tokens(some, public_tokenizers.path("word_bpe_49k.json"), "word_bpe_49k")
    sums = [inserted(x).groupBy(*GROUP).agg(*_sums()).select(F.lit(k).alias("k"), F.lit(there).alias("there"), *GROUP, *SUMS) for (k, there), x in parts.items()]
    deltas = stored(reduce(DataFrame.unionByName, sums), "deltas")
    words, tokens = (deltas.filter(F.col("k") == k).drop("k") for k in ("words", "tokens"))
    book = Rollup(spark, scratch(spark, "rollup"))
    book.commit("words", words)
    book.commit("revised", undone(words).unionByName(tokens.drop("there")))
    book.commit("revised", undone(words).unionByName(tokens.drop("there")))
    book.compact()
    book.commit("words-again", words)
    book.commit("without-words", undone(deltas.filter("NOT there")))
    return book.totals()


def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Rollup(spark, scratch(spark, "rollup"))
    book.commit("documents", inserted(count_words(load(spark, sf_dir, "documents"))))
    return book.totals()


ORACLE_WORDS = r"""
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens,
    CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars
FROM documents GROUP BY ALL"""
