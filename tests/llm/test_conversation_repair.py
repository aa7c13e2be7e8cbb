"""Conversation repair against a search over all edits and against hand-written cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.llm import conversation_repair as CR

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile(r"\A(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"]


def faults(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        core = text.strip(WHITE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(rows, edits):
    """Repaired rows, or None where the edits cannot be."""
    out, at = [], 0
    nxt = lambda: "user" if len([r for r in out if r[0][:1] != "s"]) % 2 == 0 else "assistant"
    for e in edits:
        if e == "I":
            out.append((nxt(), ""))
            continue
        role, text = rows[at]
        at += 1
        if e == "K":
            out.append((role, text))
        elif e == "R":
            out.append((nxt(), text))
    return out if at == len(rows) and SHAPE.match("".join(r[0][:1] or "?" for r in out)) else None


def price(rows, edits):
    at, total, bad = 0, 0, faults(rows)
    for e in edits:
        if e == "I":
            total += 5
            continue
        if bad[at] in ("blank", "duplicate") and e != "D":
            return None
        total += {"K": 0, "R": 1, "D": 2}[e] + (5 if bad[at] == "truncated" and e != "D" else 0)
        at += 1
    return total


def search(rows):
    """Cheapest edits, ASCII-least, out of all with up to two inserts in a gap."""
    best = None
    for ops in product("DKR", repeat=len(rows)):
        for gaps in product(("", "I", "II"), repeat=len(rows) + 1):
            edits = "".join(g + o for g, o in zip(gaps, (*ops, "")))
            cost = price(rows, edits)
            if cost is not None and (best is None or (cost, edits) < best) and apply(rows, edits) is not None:
                best = (cost, edits)
    return best


def expected(turns):
    """Result of one conversation's ``(turn, role, text)`` in order; the edits by :func:`search`."""
    rows = [(r, t) for _, r, t in turns]
    known = [t for t, _, _ in turns if t is not None]
    bad = faults(rows)
    illegal = sum((a[0][:1], b[0][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    cost, audit = search(rows)
    text = "\n".join(f"{r}:{t}" for r, t in apply(rows, audit))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some(n, seed, longest=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what", " ", "", "so?\n", "Über 🙂.", "x\t", "..."]
    roles = ["user", "assistant", "system", "tool", "", "User", "assistant", "user"]
    out = {}
    for c in range(n):
        turns = sorted(rng.sample(range(-3, 40), rng.randint(0, longest)))
        out[c] = [(t, rng.choice(roles), rng.choice(texts)) for t in turns]
    return out


def rows_of(convs):
    return [(c, *t) for c, turns in convs.items() for t in turns]


def results(df):
    found = df.collect()
    assert len({r.conv for r in found}) == len(found)
    return {r.conv: tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 1}, {"block_rows": 3, "block_bytes": 9}])
def test_repair_equals_search_over_all_edits(spark, bounds):
    convs = {c: turns for c, turns in some(150, 1).items() if turns}
    got = results(CR.repair(spark.createDataFrame(rows_of(convs), SCHEMA).repartition(5), **bounds))
    assert got == {c: expected(turns) for c, turns in convs.items()}


def test_many_steps_equal_a_programme_with_whole_strings():
    """Fronts and ranks against states that carry their whole edit strings."""
    rng = random.Random(5)
    for _ in range(400):
        kinds = [(rng.choice(["s", "u", "a", ""]), d := rng.random() < 0.2, not d and rng.random() < 0.3) for _ in range(rng.randint(0, 25))]
        whole, front, total, pointers = {CR.START: (0, "")}, ((CR.START, 0),), 0, []
        for initial, must, late in kinds:
            new = {}
            for s, (cost, text) in whole.items():
                for k in range(4):
                    options = [("D", s, 2)]
                    if not must:
                        options += [("R", CR.FOLLOWS[s], 1 + 5 * late)] + [("K", to, 5 * late) for (at, i), to in CR.KEEPS.items() if (at, i) == (s, initial)]
                    for op, to, more in options:
                        new[to] = min(new.get(to, (9e9, "")), (cost + 5 * k + more, text + "I" * k + op))
                    s = CR.FOLLOWS[s]
            whole = new
            front, grown, p = CR.advance(front, initial, must, late)
            total += grown
            pointers.append(p)
        assert {s: total + c for s, c in front}.items() <= {s: c for s, (c, _) in whole.items()}.items()
        assert [s for s, _ in front] == sorted(dict(front), key=lambda s: whole[s][1])
        for s, _ in front:
            edits, start = CR.trace(np.array(pointers, dtype="<u4"), s)
            assert ("".join(edits), start) == (whole[s][1], CR.START)
        ends = []
        for s, (cost, text) in whole.items():
            for k in range(4):
                ends += [(cost + 5 * k, text + "I" * k)] * (s in (CR.START, CR.ASSISTANT))
                s = CR.FOLLOWS[s]
        s, inserts, extra = CR.finish(front)
        assert (total + extra, whole[s][1] + "I" * inserts) == min(ends)


def test_fronts_are_few():
    """A long stream of every kind of row needs few different look-ups."""
    CR.advance.cache_clear()
    rng, front = random.Random(2), ((CR.START, 0),)
    for _ in range(50_000):
        front = CR.advance(front, rng.choice(["s", "u", "a", ""]), rng.random() < 0.3, rng.random() < 0.3)[0]
    assert CR.advance.cache_info().currsize < 5000


def test_ties_repeats_nulls_and_clashing_columns(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 5, "user", "Hi."),
        (2, None, "user", "a."), (2, None, "user", "b."), (2, 3, "assistant", "c."), (2, 4, "user", "a."),
        (None, 1, None, None), (None, 2, "user", "q?"), (None, 2**62, "assistant", "r."), (None, -(2**63), "x", "y."),
        (2**62 + 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ["conv", "no", "audit", "kind", "live", "h1"]})
    got = results(CR.repair(df))
    assert set(got) == {1, 2, None, 2**62 + 1}
    assert got[1][:5] == (3, 0, 2, 0, 1 + 0) and got[1][6] == "KDKD"
    assert got[2][:4] == (0, 0, 1, 0) and got[2][5] == 4
    assert got[None][0] == 2**63 - 1 and got[None][1] == 1
    assert got[2**62 + 1][:7] == (0, 1, 0, 0, 0, 2, "D") and got[2**62 + 1][7] == hashlib.sha256(b"").hexdigest()
    assert CR.repair(df.limit(0)).count() == 0 and CR.repair(df.limit(0), turns=True).count() == 0


def test_giant_conversation_and_long_texts_in_blocks(spark):
    long = "word " * 200_000
    rows = [(7, i, ["user", "assistant", "system"][i % 3], f"turn {i // 50 if i % 50 == 3 else i}" + ".!x?"[i % 4]) for i in range(9000)]
    rows += [(8, 0, "user", long + "?"), (8, 1, "assistant", long), (8, 2, "assistant", long + ".")]
    rows += [(9, i, "user", "same.") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole = results(CR.repair(df, block_rows=10**9, block_bytes=10**9))
    assert results(CR.repair(df, block_rows=100)) == whole and results(CR.repair(df)) == whole
    assert whole[8][6] == "KDK" and whole[9][6] in ("K" + "D" * 2999 + "I", "D" * 3000) and whole[9][2] == 2999
    turns = sorted((r.no, r.role, r.text, r.edit) for r in CR.repair(df, turns=True, block_rows=64).where("conv = 7").collect())
    text = "\n".join(f"{role}:{text}" for _, role, text, _ in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == whole[7][7] and [t[0] for t in turns] == list(range(len(turns)))
    assert SHAPE.match("".join(t[1][0] for t in turns)) and "".join(t[3] for t in turns) == whole[7][6].replace("D", "")


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    from voltframe.llm.queries import QUERIES

    convs = some(400, 9, 3)
    rows = rows_of(convs) + [(None, 3, "user", None), (900, None, None, "a.b"), (901, 901, "user", "x.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    after = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        after.setdefault(conv, []).extend([(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == set(after) and any(not t for t in after.values())
    for conv, turns in after.items():
        want = expected(turns) if turns else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got[conv] == want, (conv, turns)
