"""WARC archives: written as one gzip stream each, then normalised to a member per record.

A monolithic ``.warc.gz`` can only be read from its start. The normaliser inflates it once,
piece by piece, writes every record again as a gzip member of its own, and a sidecar index
of their offsets, so that any record can be read by itself.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import files
from mosaiq.llm.common import load, partitions, scratch, stored, tune

#: Payloads from this size on are written once.
LEAST = 100
#: Bytes of records in an archive, give or take a record.
ARCHIVE = 8 << 20
LEVEL = 1
#: Parts in which archives are normalised, one after another.
WAVES = 4
#: Every record bears this date, so that archives don't differ between runs.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _safe(url: str) -> str:
    """A URL as a header can hold it: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names the page with the same payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {kind} {digest}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)} | {"": lines[0]}


def inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one member or several, in bounded pieces.

    A stream that ends within a member, or holds none, is an error.
    """
    z, begun = zlib.decompressobj(31), True
    for piece in pieces:
        while piece:
            begun = True
            yield z.decompress(piece, 1 << 20)
            piece = z.unconsumed_tail
            if z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
    while begun and not z.eof:  # what the last piece still holds
        left = z.decompress(z.unconsumed_tail, 1 << 20)
        if not left:
            raise ValueError("the gzip stream ends within a member")
        yield left


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of WARC bytes, one in memory at a time."""
    have = bytearray()
    need = -1
    for piece in stream:
        have += piece
        while True:
            if need < 0:
                end = have.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 8 + int(headers(bytes(have[:end]))["content-length"])
            if len(have) < need:
                break
            yield bytes(have[:need])
            del have[:need]
            need = -1
    if have:
        raise ValueError("the archive ends within a record")


def normalise(pieces: Iterator[bytes], out: BinaryIO, index: BinaryIO) -> int:
    """Write a member per record to ``out`` and a JSON line with its offset, length, type and page to ``index``; the number of records.

    One record is in memory at a time, however long the archive is.
    """
    n = offset = 0
    for r in split_records(inflate(pieces)):
        h = headers(r[: r.index(b"\r\n\r\n")])
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(r) + z.flush()
        index.write(json.dumps({"offset": offset, "length": len(member), "type": h["warc-type"], "page": h.get("x-page-id"), "uri": h.get("warc-target-uri")}).encode() + b"\n")
        out.write(member)
        n, offset = n + 1, offset + len(member)
    return n


def read_record(r: bytes) -> dict:
    """Fields of one record; a response's digest is computed anew and held against its header."""
    end = r.index(b"\r\n\r\n")
    h = headers(r[:end])
    block = r[end + 4 : end + 4 + int(h["content-length"])]
    cut = block.index(b"\r\n\r\n")
    digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(headers(block[:cut])["content-length"])
    if h["warc-type"] == "response" and (hashlib.sha256(block[cut + 4 :]).hexdigest() != digest or len(block) - cut - 4 != size):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": number("x-refers-to-page")}


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): null html is empty; refers_to is null for responses.

    Of equal payloads only the digest and the least page_id are gathered, summed before the
    shuffle, and only payloads that come again are joined back. They are written first, so
    that Spark can split a payload with very many pages, whose html would be one task.
    """
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    df = df.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    again = df.filter(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    df = df.join(stored(again, "again"), "digest", "left")
    return df.select("page_id", "url", "html", "digest", F.expr("CASE WHEN page_id IS NULL OR page_id <> first THEN first END").alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write monolithic archives; (file, n_records) per archive. An empty table writes none."""
    spark = pages.sparkSession
    tune(spark)
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, out, n, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), bytearray(), 0, 0
        part = TaskContext.get().partitionId()
        for b in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                r = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out += z.compress(r)
                n, size = n + 1, size + len(r)
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_pydict({"file": [files.put(folder, f"{part:06d}.warc.gz", bytes(out + z.flush()))], "n_records": [n]})
                    z, out, n, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), bytearray(), 0, 0
        if n:
            yield pa.RecordBatch.from_pydict({"file": [files.put(folder, f"{part:06d}.warc.gz", bytes(out + z.flush()))], "n_records": [n]})

    return stored(pages.mapInArrow(run, "file string, n_records long"), "archives")


def _normalise_some(archives: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.new(folder, "records.warc.gz") as (data, out), files.new(folder, "records.idx") as (index, lines):
                    if normalise(files.pieces(f), out, lines) != n:
                        raise ValueError(f"{f} doesn't hold the {n} records written to it")
                yield pa.RecordBatch.from_pydict({"file": [data], "index": [index], "n_records": [n]})

    return archives.repartition(partitions(archives.sparkSession)).mapInArrow(run, "file string, index string, n_records long")


def _remove(archives: DataFrame) -> None:
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column(0).to_pylist():
                files.remove(f)
            yield b

    archives.select("file").mapInArrow(drop, "file string").write.format("noop").mode("overwrite").save()


def normalise_archives(archives: DataFrame, keep: bool = False) -> DataFrame:
    """(file, index, n_records) of the archives with a member per record; the monolithic ones go unless ``keep``.

    It works in WAVES. The archives of a wave are deleted once the table of their new files
    is written, so both forms of a wave at most lie on the disk together. A repeated
    deletion finds nothing and passes.
    """
    spark = archives.sparkSession
    folder = scratch(spark, "records")
    done = []
    for wave in range(WAVES):
        some = archives.filter(F.pmod(F.xxhash64("file"), F.lit(WAVES)) == wave).select("file", "n_records")
        done.append(stored(_normalise_some(some, folder), "records"))
        if not keep:
            _remove(some)
    return functools.reduce(DataFrame.union, done)


def read_archives(archives: DataFrame) -> DataFrame:
    """Fields of every record of normalised archives, each found through the index and inflated by itself."""
    tune(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = ((p["offset"], p["length"]) for p in map(json.loads, files.lines(index)))
                members = files.spans(f, places)
                while rows := [read_record(zlib.decompress(m, 31)) for m in itertools.islice(members, 1000)]:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("file", "index").repartition(partitions(archives.sparkSession)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(normalise_archives(write_archives(with_originals(load(spark, sf_dir, "pages")))))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to FROM f"""
