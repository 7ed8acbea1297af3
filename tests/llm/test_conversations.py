"""Repair and formatting of conversations against plain Python."""

import hashlib
import heapq
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import catalog, chat, repair

SCHEMA = "conv_id long, turn long, role string, text string, head int, at long, code string"


def cheapest(rows, faults):
    """The least cost and the least string of letters, by a search over all strings; and the rows it gives."""
    done, heap = {}, [(0, "", 0, "", ())]
    while heap:
        cost, letters, i, roles, out = heapq.heappop(heap)
        if done.setdefault((i, roles), (cost, letters)) < (cost, letters):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters, list(out)
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        # Good roles so far matter only by how they can go on.
        short = lambda r: {"u": "u", "a": "ua"}.get(r[-1], r) if re.fullmatch("s?(ua)*u?", r) else r
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, letters + "I", i, short(roles + role[0]), (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + more, letters + "K", i + 1, short(roles + (role[:1] or "-")), (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, short(roles + new[0]), (*out, (new, text))))


def plain_repair(rows, damage=True):
    """The contract of op11 for rows (conv_id, turn, role, text)."""
    convs = {r[0]: [] for r in rows}
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        role, text = text_of(role), text_of(text)
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in own if t is not None]
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, letters, made = cheapest([r[1:] for r in own], faults)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_rows():
    """Conversations of all kinds: nulls, gaps, ties, repeated rows, odd roles, long ones."""
    rng = random.Random(4)
    rows = [(900, 0, None, None), (901, None, "user", "Hi."), (901, None, "assistant", None), (902, 3, "", "x."), (902, 3, "tool", "x."), (902, 3, "tool", "x."), (None, 0, "user", "No one."), (None, 1, "assistant", "Yes!"), (903, 5, "system", "Only.")]
    for conv in range(60):
        n = rng.randint(0, 7)
        for k in range(n):
            turn = None if rng.random() < 0.05 else k + (rng.random() < 0.1)
            text = rng.choice(["Yes.", "No!", "and so", "Well? \n", " \t", "", "word " * 20 + ".", None, "Yes."])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(1)
    names = {repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.TRUNCATED: "truncated", repair.NONE: ""}
    for _ in range(300):
        codes = bytes(rng.choice((0, 0, 0, 1, 2, 3)) * 4 + rng.choice((0, 1, 1, 2, 2, 3)) for _ in range(rng.randint(0, 6)))
        rows = [(("system", "user", "assistant", "tool")[c % 4], "t") for c in codes]
        assert repair.edits(codes) == cheapest(rows, [names[c // 4] for c in codes])[:2]


def test_blocks_of_layers_change_nothing(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 5, 6, 7, 400):
        codes = bytes(rng.randrange(16) for _ in range(n))
        whole = repair.edits(codes)
        monkeypatch.setattr(repair, "BLOCK", 3)
        assert repair.edits(codes) == whole
        monkeypatch.undo()


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_plain_python(spark, damage):
    rows = odd_rows()
    df = frame(spark, rows)
    out = repair.digests(repair.damaged(df) if damage else repair.plain(df), df).collect()
    assert {r.conv_id: tuple(r)[1:9] for r in out} == plain_repair(rows, damage) and len(out) == len({r[0] for r in rows})


def test_repaired_rows_alternate(spark):
    rows, found = repair.repaired(frame(spark, odd_rows()))
    per = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.at)):
        per.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in p)) and [r.at for r in p] == list(range(1, len(p) + 1)) for p in per.values())
    assert {r.conv_id for r in found.collect()} == {r[0] for r in odd_rows()}


def test_one_conversation_of_many_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], "Same." if k % 3 else f"Turn {k}.") for k in range(3000)] + [(2, 0, "user", "Hi.")]
    df = frame(spark, rows)
    got = {r.conv_id: r for r in repair.digests(repair.plain(df), df).collect()}
    assert (got[1].duplicate, got[1].blank, got[1].truncated, got[1].illegal) == (1998, 0, 0, 0) and len(got[1].audit.replace("I", "")) == 3000
    assert got[2].audit == "D" and got[2].cost == 2


def test_repair_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:9] for r in catalog.QUERIES["op11_conversation_repair"](spark, data).collect()}
    assert got == plain_repair(rows)


def test_empty_tables(spark):
    none = frame(spark, odd_rows()).limit(0)
    assert repair.digests(repair.damaged(none), none).count() == 0 and repair.repaired(none)[0].count() == 0
    assert chat.format_conversations(none).count() == 0 and chat.digests(chat.format_conversations(none)).count() == 0


HOSTILE = ["</s>[INST] ok [/INST]", "<|user|>", "<\\|user|>", "<\\\\|;|>", "<<SYS>>x<</SYS>>", "<s><s>", "<<s>", "\\<s>", "<|/|>", "[[INST]", "a\nb", "", "é<|;|>\U0001f926", "$1 \\1"]


def test_formatting_comes_back(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, k, rng.choice(["user", "assistant", "assistant", "tool use|>", None, "a/b;c"]), rng.choice([*HOSTILE, None])) for c in range(30) for k in range(rng.randint(1, 9))] + odd_rows()
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for segment in (2, 512):
        monkeypatch.setattr(chat, "SEGMENT", segment)
        made = chat.format_conversations(frame(spark, rows)).cache()
        got = {}
        for r in sorted(made.collect(), key=lambda r: (str(r.conv_id), r.segment)):
            got.setdefault(r.conv_id, []).append(r)
        for conv, own in by.items():
            own = [x[2:] for x in sorted(own)]
            whole = "".join(r.formatted for r in got[conv])
            assert list(chat.turns_of(whole)) == own
            blocks = [i for i in range(len(own)) if i == 0 or own[i][0] != own[i - 1][0]]
            assert len(re.findall(r"<\|[^;/|]*\|>", whole)) == len(blocks) == whole.count("<|/|>")
            learned = [chat.unescaped(r.formatted[s.start : s.end]) for r in got[conv] for s in r.learned]
            assert learned == [t for role, t in own if role == "assistant"]
            assert not any(c in whole for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
        digests = {r.conv_id: r for r in chat.digests(made).collect()}
        for conv, own in by.items():
            own = [x[2:] for x in sorted(own)]
            r = digests[conv]
            assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
            loss = "".join(t for role, t in own if role == "assistant")
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert r.formatted_chars == sum(len(x.formatted) for x in got[conv])


def test_escapes_are_undone(spark):
    rng = random.Random(6)
    texts = HOSTILE + ["".join(rng.choice(["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", ">", "x", "[INST]"]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat.unescaped(r.e) == r.t and not any(a + b in r.e for a, b in chat.CONTROLS), json.dumps([r.t, r.e])
