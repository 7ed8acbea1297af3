"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice is the usual one: a node per boundary between characters, an edge per piece,
at each node the one surviving path with its backpointer. The public model is of the BPE
kind, whose result is not the path of the highest score. It is, though, the only path on
which every two neighbouring pieces, put together and merged by themselves, stay as they
are: a merge across their boundary would have come about between the two as well. So a
path survives at a node if its last two pieces pass that test. For models of the unigram
kind the survivor is the path with the highest score.

Only the nodes within the longest piece of the front can lie on a later path. When the
backpointers of all of them lead through one boundary, everything before it is final, and
its ids are given out. One search does this for every text: parts of texts stand side by
side as columns of numpy arrays, their fronts move together, node by node, and after every
window of nodes each column gives out what has become final and keeps the rest. So a part
of any length takes a window of nodes, not a node per character.

A text goes through the search in parts that end where every path has to pass: no piece
holds a space behind another character, nor a character that is in no piece. What such a
part gave out is final, so it can be remembered for when the same part comes again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import load, text_or_empty, tune

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


class Pieces:
    """A model's pieces, and the search over them."""

    #: Parts whose final ids are remembered, anew when full, and the longest of them.
    MOST, LONGEST = 500_000, 48
    #: Nodes after which columns give out what is final; characters searched side by side; characters of texts encoded together.
    WINDOW, SIDE, CHUNK = 32, 1 << 16, 1 << 18
    #: Of the hash of a piece, a polynomial in its code points modulo 2**64.
    BASE = 0x5851F42D4C957F2D

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without normalisation of characters are supported")
        self.kind = model.trainer_spec.model_type
        self.prefix = norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type in (NORMAL, USER)}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.width = max(map(len, self.score))
        #: No piece holds a space behind anything else: then words can be encoded one by one.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score)
        bytes_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [bytes_of.get(i, b"" if p.type == 3 else p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(model.pieces)]
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.names = {i: p for p, i in self.id.items()}
        self.out = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.out_size = np.array(list(map(len, self.bytes)), np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.words: dict[str, bytes] = {}
        self.edges: dict[str, tuple] = {}
        self.whole: dict[str, bool] = {}
        # A character of no piece is an edge by itself, so it parts words as a space does.
        inner = "".join(sorted(map(re.escape, {c for p in self.score for c in p} - {SPACE})))
        self.word = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]")
        if self.kind == BPE:
            self._tables()

    def merge(self, text: str) -> list[str]:
        """A short text's pieces by merging, the best pair first, of equals the first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays(self, piece: str) -> bool:
        if len(piece) > 1 and piece not in self.score:
            return False
        known = self.whole.get(piece)
        if known is None:
            known = self.merge(piece) == [piece]
            if piece in self.score:
                self.whole[piece] = known
        return known

    def _edges(self, piece: str) -> tuple[list[tuple[float | None, str]], list[tuple[float | None, str]]]:
        """A piece's first and its last part before each of its merges, with that merge's score; the whole piece at the end."""
        known = self.edges.get(piece)
        if known is None:
            parts, first, last = list(piece), [], []
            while len(parts) > 1:
                s, at = max((self.score.get(parts[i] + parts[i + 1], -np.inf), -i) for i in range(len(parts) - 1))
                first.append((s, parts[0]))
                last.append((s, parts[-1]))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            known = [*first, (None, piece)], [*last, (None, piece)]
            if piece in self.score:
                self.edges[piece] = known
        return known

    def _fits(self, a: str, b: str) -> bool:
        """No merge across their boundary comes before the merges that make up the two pieces.

        The merges of both are replayed, the better first, of equals the left one; at each
        step the parts that touch may not be a better merge than the next on either side.
        """
        left, right, i, j = self._edges(a)[1], self._edges(b)[0], 0, 0
        while True:
            (sa, x), (sb, y) = left[i], right[j]
            across = self.score.get(x + y)
            if across is not None and (sa is None or across > sa) and (sb is None or across >= sb):
                return False
            if sa is None and sb is None:
                return True
            if sb is None or (sa is not None and sa >= sb):
                i += 1
            else:
                j += 1

    def _tables(self) -> None:
        """What the search over many words at once looks up: pieces by hash, powers, and a memory of pairs."""
        #: Powers of BASE and of its inverse for as many characters as are hashed at once.
        n = 2 * self.SIDE + self.width + self.WINDOW
        self.power, self.inverse = _powers(self.BASE, n), _powers(pow(self.BASE, -1, 1 << 64), n)
        self.length = np.array([len(self.names.get(i, "")) for i in range(len(self.bytes))], np.int64)
        self.codes = np.frombuffer("".join(self.names.get(i, "") for i in range(len(self.bytes))).encode("utf-32-le"), "<u4")
        self.codes_at = np.cumsum(self.length) - self.length
        self.keeps = np.full(len(self.bytes), -1, np.int8)
        left = {}
        for i, p in self.names.items():
            h = 0
            for c in p:
                h = (h * self.BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
            left[h] = i
        if len(left) != len(self.names):
            raise ValueError("two pieces have one hash")
        #: Slots that some piece falls into; most hashes that are no piece's fall into others.
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[[h * 0xD6E8FEB86659FD93 % (1 << 64) >> 43 for h in left]] = True
        #: Tables of slots; what finds its slot taken goes to the next table.
        self.levels = []
        for shift, factor in ((45, 0x9E3779B97F4A7C15), (50, 0xC2B2AE3D27D4EB4F), (50, 0x165667B19E3779F9), (50, 0x27D4EB2F165667C5)):
            keys, ids, over = np.zeros(1 << (64 - shift), np.uint64), np.full(1 << (64 - shift), -1, np.int32), {}
            for h, i in left.items():
                slot = (h * factor & 0xFFFFFFFFFFFFFFFF) >> shift
                if ids[slot] >= 0:
                    over[h] = i
                else:
                    keys[slot], ids[slot] = h, i
            self.levels.append((np.uint64(factor), np.uint64(shift), keys, ids))
            left = over
        if left:
            raise ValueError("the tables of pieces are too small")
        self.pair_key = np.full(1 << 21, -1, np.int64)
        self.pair_fits = np.zeros(1 << 21, bool)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)])
        h = h[at]
        for factor, shift, keys, ids in self.levels:
            slot = (h * factor) >> shift
            hit = (keys[slot] == h) & (ids[slot] >= 0)
            out[at[hit]] = ids[slot[hit]]
            at, h = at[~hit], h[~hit]
        return out

    def _kept(self, ids: np.ndarray) -> np.ndarray:
        for i in np.unique(ids[self.keeps[ids] < 0]).tolist():
            self.keeps[i] = self._stays(self.names[i])
        return self.keeps[ids] == 1

    def _fitting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.bytes) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        known = self.pair_key[slot] == key
        out = self.pair_fits[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            n = len(self.bytes)
            fits = np.array([self._fits(self.names[k // n], self.names[k % n]) for k in new.tolist()], bool)
            out[~known] = fits[back]
            at = slot[~known]
            self.pair_key[at], self.pair_fits[at] = key[~known], fits[back]
            # Of two new pairs with one slot the last is kept; it must be kept whole.
            self.pair_fits[at] = np.where(self.pair_key[at] == key[~known], fits[back], self.pair_fits[at])
        return out

    def _candidates(self, parts: list[str], left: int, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """(width, nodes): the piece of each length that ends at each node of a window, or -1.

        ``parts`` are what the columns have in the window, behind ``left`` characters before
        it. Nodes come step by step: those of all columns that reach the first, and so on;
        ``sizes`` are the columns' nodes in the window, never rising, ``begins`` where each step begins.
        """
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.inverse[:n], out=total[1:])
        lengths = sizes + left
        first = np.cumsum(lengths) - lengths + left
        step = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        end = first[np.arange(begins[-1]) - begins[step]] + step + 1
        out = np.full((self.width, begins[-1]), -1, np.int32)
        tail, scale = total[end], self.power[end - 1]
        for k in range(1, self.width + 1):
            # Within the column only: the window's first nodes have fewer characters before them.
            at = slice(begins[min(max(k - left - 1, 0), len(begins) - 1)], None)
            if len(end[at]):
                out[k - 1, at] = self._lookup((tail[at] - total[end[at] - k]) * scale[at])
        at = np.flatnonzero(out.ravel() >= 0)
        out.ravel()[at[~self._kept(out.ravel()[at])]] = -1
        return out

    def search_parts(self, parts: list[str]) -> list[bytes]:
        """Ids (as bytes of uint32) of each of ``parts``, a text's stretches of known characters, none of them empty."""
        out: list[bytes] = []
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= self.SIDE):
                size += len(parts[end])
                end += 1
            out += self._search_side(parts[begin:end])
            begin = end
        return out

    def _search_side(self, words: list[str]) -> list[bytes]:
        """The search over columns side by side."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        size = np.array([len(words[k]) for k in order], np.int64)
        width, none, start = self.width, -1, -2
        #: Row ``i - low`` of ``last`` has for each column the piece with which the path that survives at node i ends.
        low, done = 0, 0
        last = np.full((1, len(words)), start, np.int32)
        base = np.zeros(len(words), np.int64)
        given: list[tuple[np.ndarray, np.ndarray]] = []
        while len(size):
            steps = min(self.WINDOW, int(size[0]) - done)
            left = min(done, width)
            at = np.clip(size - done, 0, steps)
            begins = np.concatenate([[0], np.cumsum(np.searchsorted(-at, -np.arange(1, steps + 1), "right"))])
            candidates = self._candidates([words[order[k]][done - left : done + steps] for k in range(len(size))], left, at, begins)
            last = np.concatenate([last, np.full((steps, len(size)), none, np.int32)])
            for i in range(steps):
                here, count = candidates[:, begins[i] : begins[i + 1]], begins[i + 1] - begins[i]
                node = done + i + 1
                # Paths that survive at the nodes 1, 2, ... before; those before ``low`` are given out.
                back = last[max(node - width - low, 0) : node - low, :count][::-1]
                ok = (here[: len(back)] >= 0) & (back != none)
                open_ = np.flatnonzero(ok.any(axis=0))
                while len(open_):
                    k = len(back) - 1 - np.argmax(ok[::-1, open_], axis=0)
                    ids, before = here[k, open_], back[k, open_]
                    fits = before == start
                    fits[~fits] = self._fitting(before[~fits], ids[~fits])
                    last[node - low, open_[fits]] = ids[fits]
                    k, open_ = k[~fits], open_[~fits]
                    ok[k, open_] = False
                    open_ = open_[ok[:, open_].any(axis=0)]
            done += steps
            ends = np.minimum(size, done)
            more = np.flatnonzero(size > done)
            if len(more):
                ends[more] = self._meeting(last[:, more], low, done)
            given.append(self._backwards(last, low, base, ends))
            base = ends
            keep = more  # columns are in order of size, so these are the first ones
            size, base, last = size[keep], base[keep], last[:, keep]
            cut = int(base.min()) - low if len(keep) else 0
            low, last = low + cut, last[cut:]
        return self._collected(words, order, given)

    def _meeting(self, last: np.ndarray, low: int, front: int) -> np.ndarray:
        """Per column the last node through which the paths of all nodes within reach of the front lead."""
        ends = np.arange(max(front - self.width + 1, low), front + 1)[:, None] * np.ones((1, last.shape[1]), np.int64)
        ends[last[ends[:, 0] - low] == -1] = -1
        top = ends.max(axis=0)
        while True:
            least = np.where(ends < 0, top, ends).min(axis=0)
            open_ = np.flatnonzero(least < top)
            if not len(open_):
                return top
            piece = last[top[open_] - low, open_]
            moved = np.where(ends[:, open_] == top[open_], top[open_] - self.length[piece], ends[:, open_])
            ends[:, open_], top[open_] = moved, moved.max(axis=0)

    def _backwards(self, last: np.ndarray, low: int, base: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, pieces) of the paths from ``base`` to ``ends``, column by column; found from their ends."""
        at, steps = ends.copy(), []
        live = np.flatnonzero(at > base)
        while len(live):
            ids = last[at[live] - low, live]
            if (ids < 0).any():
                raise ValueError("a character in none of the model's pieces")
            steps.append((live, ids))
            at[live] -= self.length[ids]
            live = live[at[live] > base[live]]
        columns, ids = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in ([c for c, _ in steps], [i for _, i in steps]))
        by = np.argsort(columns, kind="stable")
        return columns[by].astype(np.int32), ids[by].astype(np.int32)

    def _collected(self, words: list[str], order: list[int], given: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """The ids of each word, from what was given out window by window."""
        column, ids = (np.concatenate(x) for x in zip(*given))
        to = np.array(order, np.int32)[column]
        by = np.argsort(to, kind="stable")
        ids, to = ids[by], to[by]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(words)))]).tolist()
        # Hashes name the pieces; what they spell must be the text.
        text, at = "".join(words), 0
        for k in range(0, len(ids), self.SIDE):
            spelt = self._spread(ids[k : k + self.SIDE], self.codes, self.codes_at, self.length)
            if (spelt != np.frombuffer(text[at : at + len(spelt)].encode("utf-32-le", "surrogatepass"), "<u4")).any():
                return [self._pack([i for p in self.search(w) for i in self._ids(p)]) for w in words]
            at += len(spelt)
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _spread(ids: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What ``flat`` has for each of ``ids``, one behind another."""
        n = sizes[ids]
        return flat[np.repeat(at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def search(self, text: str) -> Iterator[str]:
        """The pieces of ``text``, each given out once it is final.

        ``last[i - base]`` is the piece with which the surviving path to node i ends, None
        for a node that no path reaches.
        """
        width, bpe = self.width, self.kind == BPE
        floor = min(self.score.values(), default=0.0) - 10.0
        last: list[str | None] = [None]
        value = [0.0]
        base, n = 0, len(text)
        for i in range(1, n + 1):
            found, best = None, 0.0
            for j in range(max(base, i - width), i):
                before = last[j - base]
                if before is None and j > 0:
                    continue
                piece = text[j:i]
                if bpe:
                    if self._stays(piece) and (j == 0 or self._fits(before, piece)):
                        found = piece
                        break
                else:
                    s = self.score.get(piece, floor if i - j == 1 else None)
                    if s is not None and (found is None or value[j - base] + s > best):
                        found, best = piece, value[j - base] + s
            last.append(found)
            value.append(best)
            if i - base >= 4 * width or i == n:
                # Follow every survivor within reach back to where all of them meet.
                ends = [k for k in range(max(base, i - width + 1), i + 1) if last[k - base] is not None or k == base] if i < n else [n]
                while len(set(ends)) > 1:
                    top = max(ends)
                    ends = [k - len(last[k - base]) if k == top else k for k in ends]
                done, at = [], ends[0]
                while at > base:
                    done.append(last[at - base])
                    at -= len(done[-1])
                if done:
                    yield from reversed(done)
                    last, value = last[ends[0] - base :], value[ends[0] - base :]
                    base = ends[0]

    def normal(self, text: str, begins: bool = True) -> str:
        """A text, or a part of it that doesn't begin it, with the model's sign for spaces."""
        return (SPACE if self.prefix and begins and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_all([text])[0].tolist()

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def chunks(self, text: str) -> Iterator[str]:
        """``text`` in parts of about CHUNK characters that begin with a space behind another character, where every path passes."""
        at = 0
        while self.by_word and len(text) - at > self.CHUNK:
            cut = at + self.CHUNK
            while True:
                cut = text.rfind(" ", at + 1, cut)
                if cut < 0 or text[cut - 1] not in (" ", SPACE):
                    break
            if cut < 0:
                found = re.compile(f"(?<=[^ {SPACE}]) ").search(text, at + self.CHUNK)
                cut = found.start() if found else len(text)
            if cut < len(text):
                yield text[at:cut]
            else:
                break
            at = cut
        if at < len(text):
            yield text[at:]

    def encode_stream(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
        """(number of a text, a part of it, the part's ids) in order, a bounded number of characters at a time.

        A part is longer than CHUNK only if no space lets it be parted; texts without characters have none.
        """
        group: list[tuple[int, str, bool]] = []
        size = 0
        for k, text in enumerate(texts):
            for first, part in zip(chain([True], repeat(False)), self.chunks(text)):
                group.append((k, part, first))
                size += len(part)
                if size >= self.CHUNK:
                    yield from self._encode_group(group)
                    group, size = [], 0
        if group:
            yield from self._encode_group(group)

    def _encode_group(self, group: list[tuple[int, str, bool]]) -> Iterator[tuple[int, str, np.ndarray]]:
        alone = lambda t: self._pack([i for p in self.search(t) for i in self._ids(p)])
        if not self.by_word:
            for k, part, first in group:
                yield k, part, np.frombuffer(alone(self.normal(part, first)), np.uint32)
            return
        parted = [self.word.findall(self.normal(part, first)) for _, part, first in group]
        new = set().union(*parted).difference(self.words)
        if len(self.words) + len(new) > self.MOST:
            self.words = {}
            new = set().union(*parted)
        words = self.words
        if self.kind == BPE:
            known = [w for w in new if len(w) > 1 or w in self.id]
            words.update(zip(known, self.search_parts(known)))
        words.update((w, alone(w)) for w in new if w not in words)
        get = words.__getitem__
        for (k, part, _), ws in zip(group, parted):
            yield k, part, np.frombuffer(b"".join(map(get, ws)), np.uint32)
        for w in new:
            if len(w) > self.LONGEST:
                del words[w]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of whole texts."""
        parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in texts]
        for k, _, ids in self.encode_stream(texts):
            parts[k].append(ids)
        return [np.concatenate(x) for x in parts]

    def decode(self, ids: list[int] | np.ndarray, begins: bool = True) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.asarray(ids, np.int64)
        text = self._spread(ids, self.out, self.out_at, self.out_size).tobytes().decode("utf-8", "replace")
        return text[1:] if begins and self.prefix and text.startswith(" ") else text


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The model of a file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Per row: ``keep``, n_ids, ids_crc32 (of the ids as little-endian uint32), decoded_sha256, round_trip[, ids].

    ``round_trip`` says that the ids decode to the text again; it is false only for texts
    that hold the model's own sign for a space. Null texts count as empty and have no ids.
    Rows may repeat; other columns are ignored. Nothing is shuffled.
    """
    tune(docs.sparkSession)
    narrow = docs.select(*keep, text_or_empty().alias("__text"))
    added = [T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                texts = b.column(len(keep)).to_pylist()
                n, crc, same = np.zeros(len(texts), np.int64), [0] * len(texts), np.ones(len(texts), bool)
                sha = [hashlib.sha256() for _ in texts]
                all_ids: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] for _ in texts]
                for k, part, ids in coder.encode_stream(texts):
                    back = coder.decode(ids, begins=not n[k])
                    n[k] += len(ids)
                    crc[k] = zlib.crc32(ids, crc[k])
                    sha[k].update(back.encode("utf-8", "surrogatepass"))
                    same[k] &= back == part
                    if with_ids:
                        all_ids[k].append(ids)
                out = [*b.columns[: len(keep)], pa.array(n), pa.array(crc, pa.int64()), pa.array([x.hexdigest() for x in sha]), pa.array(same)]
                if with_ids:
                    out.append(pa.array([np.concatenate(x).view(np.int32) for x in all_ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, [*keep, *[f.name for f in added]])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
