"""Suffix arrays of several texts at once, by doubling."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """Suffixes of several texts, none of which runs on into the next, in order.

    A suffix is named by its start among the texts, put one behind another with a mark of
    its own behind each. ``ranks[k]`` is the order of all starts as far as ``2**k`` symbols.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        """``symbols``: those of all texts, none negative; ``sizes``: how many each text has."""
        many = len(sizes)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.empty(len(symbols) + many, np.int64)
        marks = self.begin + sizes
        plain = np.ones(len(text), bool)
        plain[marks] = False
        text[plain] = symbols
        text[marks] = int(symbols.max(initial=0)) + 1 + np.arange(many)
        self.longest = int(sizes.max(initial=0)) + 1
        self.ranks = [text]
        while 1 << (len(self.ranks) - 1) < self.longest:
            self.ranks.append(self._doubled(self.ranks[-1], 1 << (len(self.ranks) - 1)))

    @staticmethod
    def _doubled(rank: np.ndarray, width: int) -> np.ndarray:
        """The order by twice as many symbols; beyond the last mark all is least."""
        key = (rank + 1) << 32
        key[: len(rank) - width] |= rank[width:] + 1
        order = np.argsort(key)
        out = np.empty(len(rank), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        return out

    def order(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in the order of their suffixes: their suffix array."""
        return starts[np.argsort(self.ranks[-1][starts])]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of suffixes that begin at ``a`` and ``b``, two by two."""
        a, b = a.copy(), b.copy()
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            # Equal symbols never reach beyond a mark, so a step that would leave the text never counts.
            step = (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)]) & (a != b)
            step = np.where(step, 1 << k, 0)
            a, b, done = a + step, b + step, done + step
        return done


def of_bytes(parts: list[bytes]) -> Suffixes:
    return Suffixes(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))
