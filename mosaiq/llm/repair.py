"""Conversation structure repair: the cheapest edits that make turns alternate, by tight arcs of a graph.

A conversation is a graph of layers, one before each row and one at the end, with a node for
each state in which the repaired roles so far can be: nothing yet, system, user, assistant.
Arcs keep, rerole or delete a row or insert one. Least costs from the start and to the end
tell the arcs that lie on any cheapest path; a walk along these takes the least letter at
each step, with all nodes that the letters so far lead to.

A conversation passes its task as a stream in order: of each row the first pass holds one
byte, the second nothing but the edits. So one conversation may have very many rows;
they are dealt to one task as one text of repaired rows needs them in order, but never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mosaiq.llm.common import SPACE, load, partitions, stored, tune

#: States of the repaired roles so far, and what an inserted or reroled row makes of each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: First faults of a row; a row's code is its fault times four and its role's initial (s, u, a or another).
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs by the contract.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Layers whose costs are held at once.
BLOCK = 1 << 16

Costs = tuple[int, int, int, int]
_FAR = 1 << 60


def _arcs() -> list[list[list[tuple[str, int, int]]]]:
    """By code and state the arcs (letter, state, cost) that take in a row."""
    out = []
    for code in range(16):
        fault, initial = divmod(code, 4)
        extra = CUT if fault == TRUNCATED else 0
        per = []
        for q in range(4):
            arcs = [("D", q, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                arcs.append(("R", NEXT[q], REROLE + extra))
                kept = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(initial)
                if kept is not None and (kept == NEXT[q] or (kept == SYSTEM and q == START)):
                    arcs.append(("K", kept, KEEP + extra))
            per.append(arcs)
        out.append(per)
    return out


ARCS = _arcs()


def _forward(at: Costs, code: int) -> Costs:
    """Least costs at the next layer, rows inserted there included."""
    out = [_FAR] * 4
    for q, arcs in enumerate(ARCS[code]):
        for _, v, c in arcs:
            out[v] = min(out[v], at[q] + c)
    return _inserted(out)


def _inserted(f: list[int]) -> Costs:
    f[USER] = min(f[USER], min(f[START], f[SYSTEM], f[ASSISTANT]) + INSERT)
    f[ASSISTANT] = min(f[ASSISTANT], f[USER] + INSERT)
    return tuple(f)


def _backward(after: Costs, code: int) -> Costs:
    """Least costs to the end from the layer before a row."""
    return _inserting([min(c + after[v] for _, v, c in arcs) for arcs in ARCS[code]])


def _inserting(b: list[int]) -> Costs:
    b[ASSISTANT] = min(b[ASSISTANT], b[USER] + INSERT)
    b[USER] = min(b[USER], b[ASSISTANT] + INSERT)
    b[ASSISTANT] = min(b[ASSISTANT], b[USER] + INSERT)
    for q in (START, SYSTEM):
        b[q] = min(b[q], b[USER] + INSERT)
    return tuple(b)


#: Nothing at all and an assistant's row may be the end.
_END = _inserting([0, _FAR, _FAR, 0])
_BEGIN = _inserted([0, _FAR, _FAR, _FAR])


def edits(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation and the least string of letters of all edits that cost it.

    Costs are kept for the layers of one block at a time and found again from its ends.
    """
    ahead, behind = [_BEGIN], [_END]
    for k in range(0, len(codes), BLOCK):
        f = ahead[-1]
        for code in codes[k : k + BLOCK]:
            f = _forward(f, code)
        ahead.append(f)
    for k in reversed(range(0, len(codes), BLOCK)):
        b = behind[-1]
        for code in reversed(codes[k : k + BLOCK]):
            b = _backward(b, code)
        behind.append(b)
    behind.reverse()
    total, out, frontier = behind[0][START], [], {START}
    for block, k in enumerate(range(0, len(codes), BLOCK)):
        part = codes[k : k + BLOCK]
        to_end = [behind[block + 1]]
        for code in reversed(part):
            to_end.append(_backward(to_end[-1], code))
        to_end.reverse()
        f, letters = ahead[block], []
        for i, code in enumerate(part):
            frontier = _step(frontier, f, to_end[i], to_end[i + 1], code, total, letters)
            f = _forward(f, code)
        out.append("".join(letters))
    letters = []
    while not any(q in (START, ASSISTANT) and ahead[-1][q] == total for q in frontier):
        letters.append("I")
        frontier = {NEXT[q] for q in frontier if ahead[-1][q] + INSERT + _END[NEXT[q]] == total}
    return total, "".join([*out, *letters])


def _step(frontier: set[int], f: Costs, here: Costs, after: Costs, code: int, total: int, letters: list[str]) -> set[int]:
    """Go on along tight arcs, by the least letter each time, until a row is taken in."""
    while True:
        tight: dict[str, set[int]] = {}
        for q in frontier:
            for letter, v, c in ARCS[code][q]:
                if f[q] + c + after[v] == total:
                    tight.setdefault(letter, set()).add(v)
            if f[q] + INSERT + here[NEXT[q]] == total:
                tight.setdefault("I", set()).add(NEXT[q])
        letter = min(tight)
        letters.append(letter)
        frontier = tight[letter]
        if letter != "I":
            return frontier


#: Short conversations are much alike.
_known = lru_cache(1 << 16)(edits)


def has_words(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def ends(text: Column) -> Column:
    """The last character that isn't a space ends a sentence."""
    return text.rlike(rf"[.!?]{SPACE}*\z")


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): roles and texts that are null are one space, as the contract has it; turn is a long or null."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``plain`` with the contract's damage: by a checksum of conversation and turn some are dropped, emptied, cut, repeated or given to the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    df = plain(conversations).withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"known": F.col("turn").isNotNull(), "th": F.unhex(F.sha2("text", 256))})


def _in_order(df: DataFrame) -> DataFrame:
    """Each conversation in one task, its head first, then its rows by turn, null turns first; rows of one turn by role and a digest of their text."""
    return df.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "head", "known", "turn", "role", "th")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, known, turn, role, th, n, code, again): different rows, how many copies each has, the code of the first copy and of the others.

    Only digests of texts move. The first row of a role and text is found by an aggregate
    that is written before the join, which Spark then splits where one key has most rows.
    """
    initial = F.substring("role", 1, 1)
    own = _digested(rows).withColumns({
        "fault": F.when(~has_words(F.col("text")), BLANK).when(~ends(F.col("text")), TRUNCATED).otherwise(NONE),
        "initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
    })
    kinds = stored(own.groupBy("conv_id", "known", "turn", "role", "th").agg(F.count(F.lit(1)).alias("n"), F.first("fault").alias("fault"), F.first("initial").alias("initial")), "turns")
    first = stored(kinds.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("th").alias("h")).agg(F.min(F.struct("known", "turn")).alias("first")), "first-turns")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("th") == F.col("h"))
    later = ~F.struct("known", "turn").eqNullSafe(F.col("first"))
    fault = F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault"))
    again = F.when(F.col("fault") != BLANK, DUPLICATE).otherwise(BLANK)
    df = kinds.join(first, same)
    return df.select("conv_id", "known", "turn", "role", "th", "n", (fault * 4 + F.col("initial")).alias("code"), (again * 4 + F.col("initial")).alias("again"))


_AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Neighbours of initials that are no fault.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class _Conversation:
    """What a pass over a conversation's rows has found so far."""

    def __init__(self, conv_id: Any):
        self.conv_id, self.codes = conv_id, bytearray()
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, n: int, code: int, again: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.codes.append(code)
        self.codes += bytes([again]) * (n - 1)

    def row(self) -> dict[str, Any]:
        codes = bytes(self.codes)
        cost, letters = (_known if len(codes) <= 64 else edits)(codes)
        faults, initials = [c // 4 for c in codes], codes.translate(bytes(i % 4 for i in range(256)))
        found = {name: faults.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **found, "illegal": sum(p not in _LEGAL for p in zip(initials, initials[1:])), "cost": cost, "audit": letters}


def audits(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conv_id of ``conversations`` from its ``rows``; without rows all are zero or empty."""
    heads = conversations.select("conv_id").distinct().withColumns({"head": F.lit(0), "known": F.lit(None).cast("boolean"), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "th": F.lit(None).cast("binary"), "n": F.lit(0).cast("long"), "code": F.lit(0), "again": F.lit(0)})
    df = heads.unionByName(_faults(rows).withColumn("head", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for conv, head, turn, n, code, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "head", "turn", "n", "code", "again"))):
                if head == 0:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv)
                else:
                    now.add(turn, n, code, again)
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out + ([now.row()] if now is not None else []), kinds)

    schema = T.StructType([conversations.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in _AUDIT], T.StructField("audit", T.StringType())])
    kinds = to_arrow_schema(schema)
    return _in_order(df).select("conv_id", "head", "turn", "n", "code", "again").mapInArrow(run, schema)


class _Repair:
    """Follows a conversation's edits as its rows come by."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state, self.made = letters, 0, START, 0

    def _to(self, role: str, text: str, state: int) -> tuple[int, str, str]:
        self.state, self.made = state, self.made + 1
        return self.made, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._to(ROLES[NEXT[self.state]], "", NEXT[self.state])

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "K":
            yield self._to(role, text, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
        elif letter == "R":
            yield self._to(ROLES[NEXT[self.state]], text, NEXT[self.state])


def _lists(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], schema=kinds)


def _applied(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per conversation a row (conv_id, at 0) with its audit, then its repaired rows (conv_id, at, role, text), in order within a task."""
    empty = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    body = _digested(rows).select("conv_id", F.lit(1).alias("head"), "known", "turn", "role", "th", "text", *empty("long", *_AUDIT), *empty("string", "audit"))
    heads = found.select("conv_id", F.lit(0).alias("head"), *empty("boolean", "known"), *empty("long", "turn"), *empty("string", "role"), *empty("binary", "th"), *empty("string", "text"), *_AUDIT, "audit")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in _AUDIT], T.StructField("audit", T.StringType())])
    kinds, none = to_arrow_schema(schema), (None,) * (len(_AUDIT) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of = None, None
        for b in batches:
            out = []
            for conv, head, role, text, *stats in zip(*(c.to_pylist() for c in b.columns)):
                if head == 0:
                    out += [(of, *r, *none) for r in now.inserted()] if now else []
                    now, of = _Repair(stats[-1]), conv
                    out.append((conv, 0, None, None, *stats))
                else:
                    out += [(conv, *r, *none) for r in now.row(role, text)]
            yield _lists(out, kinds)
        yield _lists([(of, *r, *none) for r in now.inserted()] if now else [], kinds)

    return _in_order(heads.unionByName(body)).select("conv_id", "head", "role", "text", *_AUDIT, "audit").mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, audits): repaired conversations as (conv_id, at, role, text), at from 1, and what ``audits`` says of each.

    Roles and texts that are null count as one space. Rows of a null conv_id are a
    conversation of their own. Rows of one turn come by role and a digest of their text, so
    equal rows are neighbours. Other columns are not read; an empty table gives empty ones.
    """
    tune(conversations.sparkSession)
    rows = plain(conversations)
    found = stored(audits(rows, conversations), "audits")
    return _applied(rows, found).filter("at > 0").select("conv_id", "at", "role", "text"), found


def digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``audits`` with the digest of each conversation's repaired rows, hashed as they come by."""
    found = stored(audits(rows, conversations), "audits")
    schema = T.StructType([*found.schema, T.StructField("repaired_sha256", T.StringType()), T.StructField("n_repaired", T.LongType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, lambda x: (x[0], *x[1], x[2].hexdigest(), x[3])
        for b in batches:
            out = []
            for conv, at, role, text, *stats in zip(*(c.to_pylist() for c in b.columns)):
                if at == 0:
                    out += [done(now)] if now else []
                    now = [conv, stats, hashlib.sha256(), 0]
                else:
                    now[2].update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    now[3] = at
            yield _lists(out, kinds)
        yield _lists([done(now)] if now else [], kinds)

    return _applied(rows, found).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11 over all of ``conversations``, damaged as it says."""
    conversations = load(spark, sf_dir, "conversations")
    tune(spark)
    return digests(damaged(conversations), conversations)
