"""Words of many texts at once, as arrays of places and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX, _TURN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
#: Words beyond this size are hashed one by one.
_LONG = 64


class Words:
    """The words of several texts: stretches of anything but spaces, after each byte has become what ``table`` says."""

    def __init__(self, texts: list[bytes], table: bytes):
        parts = [t.translate(table) for t in texts]
        self.flat = b" ".join(parts) + b" " * 8
        inside = np.frombuffer(self.flat, np.uint8) != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        self.start, self.end = edge[::2].astype(np.int32), edge[1::2].astype(np.int32)
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        #: Where each text's words begin, and the end of the last one's.
        self.first = np.searchsorted(self.start, begin)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        words = np.ndarray((len(self.flat) - 7,), "<u8", self.flat, strides=(1,))
        h = size.astype(np.uint64)
        open_, at = np.arange(len(size)), 0
        open_ = open_[size <= _LONG]
        while len(open_):
            left = np.minimum(size[open_] - at, 8).astype(np.uint64)
            x = words[self.start[open_] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            x = (h[open_] ^ x) * _MIX
            h[open_] = (x ^ (x >> np.uint64(32))) * _TURN
            at += 8
            open_ = open_[size[open_] > at]
        for k in np.flatnonzero(size > _LONG).tolist():
            h[k] = xxhash.xxh3_64_intdigest(self.word(k))
        return h ^ (h >> np.uint64(29))

    def word(self, k: int) -> bytes:
        return self.flat[self.start[k] : self.end[k]]

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of all windows of ``n`` words, none over two texts, and their hashes."""
        left = self.first[self.text + 1] - np.arange(len(h))
        at = np.flatnonzero(left >= n)
        total = np.full(len(at), n, np.uint64)
        for j in range(n):
            total = total * _TURN + h[at + j]
        total *= _MIX
        return at, total ^ (total >> np.uint64(31))

    def runs(self, at: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
        """The stretches of words under windows of ``n`` words at ``at``, (start, end), none over two texts."""
        order = np.argsort(at)
        at, end = at[order], (at + n)[order]
        reach = np.maximum.accumulate(end)
        cut = np.flatnonzero(np.append(True, (at[1:] > reach[:-1]) | (self.text[at[1:]] != self.text[at[:-1]])))
        return list(zip(at[cut].tolist(), reach[np.append(cut[1:], len(at)) - 1].tolist()))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text each, a longer text by itself."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
