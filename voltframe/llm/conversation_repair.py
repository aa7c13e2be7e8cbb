"""Repair of conversation structure: the cheapest edits that make every conversation a
``system`` turn at most, followed by pairs of ``user`` and ``assistant`` turns.

Faults of a row, the first of which counts: *blank* (no character outside
``[\\x20\\x09-\\x0D]``), *duplicate* (role and text stand earlier in the conversation),
*truncated* (its last such character is none of ``.!?``). Edits: Keep costs 0, Rerole to
user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert of an empty
turn of user or assistant 5, anywhere; a truncated row that is not deleted adds 5. The
initials of the roles must come to match ``(s?(ua)+)?``. Of the cheapest edits those win
whose initials, in order, are least in ASCII.

Method: secondary-sorted streaming. Rows are dealt out by conversation and sorted by turn
inside a task; ``mapInPandas`` carries the dynamic programme across Arrow batches. Its
state is small: the pattern's four states, each with the cost of its best edits so far,
in the order of their initials as strings. Two facts make that enough. In every state only
one of user and assistant may follow, so initials determine the repaired roles; and edits
that consumed the same rows end with a row's own edit, so none of their strings is a prefix
of another and their order never changes later. A row thus costs one look-up of
(states, kind of row), and its backpointers fit in 24 bits.

A conversation of more than ``block_rows`` rows or ``block_bytes`` of text is not held: it
leaves the task in blocks of rows with their backpointers (written to the shared folder,
so a lost executor repeats a task and no more). A second stream reads its backpointers
from the last block to the first and turns them into edits, a third reads blocks and edits
in order and writes the result. Memory is bounded by a block, apart from the string of
edit initials, a byte a row, that the result itself carries.

What is found before the stream: which turn holds the first row of each (conversation,
role, text), by an aggregation on 128-bit hashes with map-side combining. These markers
join the stream, each just before the rows it means, so duplicates need no set of seen
texts. One conversation is one stream, as digests of its text in order require; its texts
move once (a giant's a second time), and hashing, damage and marking run before, spread
over all tasks.

Edge cases: a null role or text is one space, a null conversation id is a conversation of
its own, null turns come first. Rows of one turn are ordered by role, then by the text's
hash (equal rows adjoin). A conversation without rows has no edits and empty text. Turns
of any distance are counted; ``gaps`` stops at 2^63 - 1. An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.session import materialize

WHITE = " \t\n\x0b\x0c\r"
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
OUT_ROWS = 2048
START, SYSTEM, USER, ASSISTANT = range(4)  # last turn so far
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
MAX_INSERTS = 3  # in a row; two reach every state
# What going on from one state (row) as if from another (column) can cost more: inserts on the way, or
# deleting a system turn that only an empty start may keep. A state that costs more than that above another
# is in no cheapest edits, so costs in a front stay within bounds.
MIMIC = ((0, 0, 5, 10), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
OPS = "DKR"
Front = tuple[tuple[int, int], ...]  # (state, cost above the least), least edit string first


@lru_cache(maxsize=None)
def advance(front: Front, initial: str, must_delete: bool, truncated: bool) -> tuple[Front, int, int]:
    """The front after one more row, the growth of its least cost, and the row's backpointers
    (six bits a state: previous state, inserts before the row, edit of the row)."""
    best: dict[int, tuple] = {}
    for rank, (origin, cost) in enumerate(front):
        state = origin
        for inserts in range(MAX_INSERTS + 1):
            moves = [("D", state, 2)]
            if not must_delete:
                late = 5 if truncated else 0
                if (state, initial) in KEEPS:
                    moves.append(("K", KEEPS[state, initial], late))
                moves.append(("R", FOLLOWS[state], 1 + late))
            for op, target, price in moves:
                found = (cost + 5 * inserts + price, rank, "I" * inserts + op, origin)
                if target not in best or found < best[target]:
                    best[target] = found
            state = FOLLOWS[state]
    best = {s: b for s, b in best.items() if all(b[0] <= other[0] + MIMIC[p][s] for p, other in best.items())}
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    pointers = 0
    for state, (_, _, edits, origin) in best.items():
        pointers |= (origin | (len(edits) - 1) << 2 | OPS.index(edits[-1]) << 4) << 6 * state
    return tuple((s, best[s][0] - least) for s in order), least, pointers


def finish(front: Front) -> tuple[int, int, int]:
    """Last state, inserts after the last row, and cost above the least of the front."""
    ends = []
    for rank, (origin, cost) in enumerate(front):
        state = origin
        for inserts in range(MAX_INSERTS + 1):
            if state in (START, ASSISTANT):
                ends.append((cost + 5 * inserts, rank, inserts, origin))
            state = FOLLOWS[state]
    cost, _, inserts, origin = min(ends)
    return origin, inserts, cost


def trace(pointers: np.ndarray, state: int) -> tuple[list[str], int]:
    """Edits of each row that lead to ``state`` after the last, and the state before the first."""
    edits = []
    for p in pointers[::-1].tolist():
        p = p >> 6 * state & 63
        edits.append("I" * (p >> 2 & 3) + OPS[p >> 4])
        state = p & 3
    return edits[::-1], state


class Repaired:
    """Applies edits in order: counts, digests and, if wanted, passes on the repaired turns."""

    def __init__(self) -> None:
        self.state, self.digest, self.turns = START, hashlib.sha256(), 0

    def _turn(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(("\n" * (self.turns > 0) + role + ":" + text).encode("utf-8", "replace"))
        self.turns += 1
        return self.turns - 1, role, text, edit

    def apply(self, edits: str, role: str = "", text: str = "") -> Iterator[tuple]:
        """Turns that the edits of one row give: inserted ones, then the row's own."""
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K":
                self.state = KEEPS[self.state, role[:1]]
                yield self._turn(role, text, edit)
            else:
                self.state = FOLLOWS[self.state]
                yield self._turn(ROLE[self.state], text if edit == "R" else "", edit)


class Conversation:
    """One conversation's stream: statistics, front and the rows not yet spilled."""

    def __init__(self, conv: str | None) -> None:
        self.conv = conv
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.low: int | None = None
        self.high: int | None = None
        self.distinct = 0
        self.initial: str | None = None
        self.last: tuple | None = None  # role and hashes of the row before, if it is of the same turn
        self.turn: str | None = None
        self.front: Front = ((START, 0),)
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.pointers: list[int] = []
        self.bytes = self.blocks = 0

    def add(self, turn: str | None, role: str, text: str, key: tuple, first_seen: bool) -> None:
        core = text.rstrip(WHITE)
        if turn is not None:
            at = int(turn)
            if self.high is None or at != self.high:
                self.distinct += 1
            self.low, self.high = at if self.low is None else self.low, at
        again = not first_seen or self.last == (turn, key)
        self.last = (turn, key)
        blank, duplicate, truncated = not core, bool(core) and again, bool(core) and not again and core[-1] not in ".!?"
        self.n["blank"] += blank
        self.n["duplicate"] += duplicate
        self.n["truncated"] += truncated
        if self.initial is not None:
            self.n["illegal"] += (self.initial, role[:1]) not in LEGAL
        self.initial = role[:1]
        kind = self.initial if self.initial in ("s", "u", "a") else ""
        self.front, grown, pointers = advance(self.front, kind, blank or duplicate, truncated)
        self.n["cost"] += grown
        self.roles.append(role)
        self.texts.append(text)
        self.pointers.append(pointers)
        self.bytes += len(text) + len(role)

    def packed(self) -> np.ndarray:
        return np.array(self.pointers, dtype="<u4")

    def spill(self) -> dict:
        """The held rows as a block, which are held no longer."""
        out = {"conv": self.conv, "no": self.blocks, "roles": self.roles, "texts": self.texts, "pointers": self.packed().tobytes()}
        self.roles, self.texts, self.pointers, self.bytes = [], [], [], 0
        self.blocks += 1
        return out

    def summary(self) -> dict:
        gaps = 0 if self.low is None or self.high is None else self.high - self.low + 1 - self.distinct
        return {"conv": self.conv, "gaps": min(gaps, 2**63 - 1), **self.n}


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_OUT = f"conv string, no long, role string, text string, edit string, {_COUNTS}, audit string, digest string"
_SPILLED = "roles array<string>, texts array<string>, pointers binary, state int, inserts int"
_NAMES = [c.split()[0] for c in f"{_OUT}, {_SPILLED}".split(", ")]


def _frames(rows: Iterator[dict], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows (the absent columns null) in frames of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("text") or "") + len(row.get("pointers") or b"") * 256 + len(row.get("audit") or "")
        if len(held) >= OUT_ROWS or size >= BLOCK_BYTES:
            yield _frame(held, names)
            held, size = [], 0
    if held:
        yield _frame(held, names)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    numbers = {"no", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "state", "inserts"}
    return pd.DataFrame({c: pd.array([r.get(c) for r in rows], dtype="Int64") if c in numbers else pd.Series([r.get(c) for r in rows], dtype=object) for c in names})


def _stream(frames: Iterator[pd.DataFrame], turns: bool, block_rows: int, block_bytes: int) -> Iterator[dict]:
    """Rows of finished conversations, blocks of giant ones; ``frames`` come sorted."""
    now: Conversation | None = None
    first: tuple | None = None  # (turn, key) whose first row is due

    def close(c: Conversation) -> Iterator[dict]:
        state, inserts, extra = finish(c.front)
        c.n["cost"] += extra
        if c.blocks:
            yield {**c.spill(), "state": state, "inserts": inserts, **c.summary()}
            return
        edits, _ = trace(c.packed(), state)
        done = Repaired()
        for e, role, text in zip([*edits, "I" * inserts], [*c.roles, ""], [*c.texts, ""]):
            for no, r, t, edit in done.apply(e, role, text):
                if turns:
                    yield {"conv": c.conv, "no": no, "role": r, "text": t, "edit": edit}
        yield {**c.summary(), "audit": "".join(edits) + "I" * inserts, "digest": done.digest.hexdigest()}

    for frame in frames:
        for conv, kind, turn, role, h1, h2, text in zip(*(frame[c] for c in ("conv", "kind", "turn", "role", "h1", "h2", "text"))):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from close(now)
                now, first = Conversation(conv), None
            if kind == "first":
                first = (turn, (role, h1, h2))
            elif kind == "row":
                key = (role, h1, h2)
                now.add(turn, role, text, key, first == (turn, key))
                if len(now.roles) >= block_rows or now.bytes >= block_bytes:
                    yield now.spill()
    if now is not None:
        yield from close(now)


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with each conversation in one task, in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    return df.repartition(n, "conv").sortWithinPartitions("conv", *order)


def prepared(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             live_col: str | None = None) -> DataFrame:
    """The sorted stream: every row, and a marker before the first row of each role and text.

    Rows whose ``live_col`` is false only say that their conversation exists."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    live = F.lit(True) if live_col is None else F.coalesce(F.col(live_col), F.lit(False))
    base = rows.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("decimal(38,0)").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), live.alias("live"),
    ).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.concat(F.lit("\n"), "text")).alias("h2"))
    own = base.where("live").select("conv", F.lit("row").alias("kind"), "turn", "role", "h1", "h2", "text")
    gone = base.where(~F.col("live")).select("conv").groupBy("conv").agg(F.lit("gone").alias("kind"))
    null = lambda t: F.lit(None).cast(t)
    gone = gone.select("conv", "kind", null("decimal(38,0)").alias("turn"), null("string").alias("role"), null("long").alias("h1"), null("long").alias("h2"), null("string").alias("text"))
    firsts = (
        own.groupBy("conv", "role", "h1", "h2").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("some_null"))
        .select("conv", F.lit("first").alias("kind"), F.when(~F.col("some_null"), F.col("least")).alias("turn"), "role", "h1", "h2", null("string").alias("text"))
    )
    stream = _dealt(own.unionByName(firsts).unionByName(gone), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2"), F.col("kind"))
    # As text, because pandas turns whole numbers with nulls into floating point.
    return stream.select("conv", "kind", F.col("turn").cast("string").alias("turn"), "role", "h1", "h2", "text")


def repair_stream(stream: DataFrame, turns: bool = False, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Results of the conversations of ``stream`` (:func:`prepared`): one row each with ``audit``
    set, and its repaired turns (``edit`` set) if ``turns``."""
    n_out = _OUT.count(", ") + 1

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(_stream(frames, turns, block_rows, block_bytes), _NAMES)

    def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run() -> Iterator[dict]:
            state = START
            for frame in frames:
                for conv, no, pointers, end in zip(frame["conv"], frame["no"], frame["pointers"], frame["end"]):
                    edits, state = trace(np.frombuffer(pointers, dtype="<u4"), int(end) if end is not None else state)
                    yield {"conv": conv, "no": no, "audit": ",".join(edits)}

        yield from _frames(run(), ["conv", "no", "audit"])

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def run() -> Iterator[dict]:
            done, audit = Repaired(), []
            for frame in frames:
                for r in frame.itertuples(index=False):
                    if int(r.no) == 0:
                        done, audit = Repaired(), []
                    last = r.inserts is not None
                    edits = r.edits.split(",") if len(r.roles) else []
                    tail = ["I" * int(r.inserts)] if last else []
                    for e, role, text in zip([*edits, *tail], [*r.roles, ""], [*r.texts, ""]):
                        for no, new, t, edit in done.apply(e, role, text):
                            if turns:
                                yield {"conv": r.conv, "no": no, "role": new, "text": t, "edit": edit}
                    audit.append("".join(edits) + "".join(tail))
                    if last:
                        counts = {c.split()[0]: int(getattr(r, c.split()[0])) for c in _COUNTS.split(", ")}
                        yield {"conv": r.conv, **counts, "audit": "".join(audit), "digest": done.digest.hexdigest()}

        yield from _frames(run(), _NAMES[:n_out])

    found = materialize(stream.mapInPandas(forward, f"{_OUT}, {_SPILLED}"), "conversation-repair")
    whole = found.where(F.col("pointers").isNull()).select(*_NAMES[:n_out])
    blocks = found.where(F.col("pointers").isNotNull())
    text = lambda c: F.col(c).cast("string").alias(c)
    edits = (
        _dealt(blocks.select("conv", "no", "pointers", "state"), F.col("no").desc())
        .select("conv", "no", "pointers", F.col("state").cast("string").alias("end"))
        .mapInPandas(backward, "conv string, no long, audit string").select(F.col("conv").alias("__conv"), F.col("no").alias("__no"), F.col("audit").alias("edits"))
    )
    met = blocks.join(edits, blocks["conv"].eqNullSafe(edits["__conv"]) & (F.col("no") == F.col("__no")))
    counts = [text(c.split()[0]) for c in _COUNTS.split(", ")]
    giants = _dealt(met, F.col("no")).select("conv", "no", "roles", "texts", "edits", text("inserts"), *counts).mapInPandas(apply, _OUT)
    return whole.unionByName(giants)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live_col: str | None = None, turns: bool = False, **bounds: int) -> DataFrame:
    """Repaired conversations.

    With ``turns``: a row ``conv, no, role, text, edit`` for every repaired turn. Otherwise a row for
    every conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest``
    (lowercase hex SHA-256 of ``role:text`` joined by newlines). ``conv`` has the type of ``conv_col``.
    """
    found = repair_stream(prepared(rows, conv_col, turn_col, role_col, text_col, live_col), turns, **bounds)
    conv = F.col("conv").cast(rows.schema[conv_col].dataType).alias("conv")
    if turns:
        return found.where(F.col("edit").isNotNull()).select(conv, "no", "role", "text", "edit")
    return found.where(F.col("audit").isNotNull()).select(conv, *[c.split()[0] for c in _COUNTS.split(", ")], "audit", "digest")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, live`` after damage by ``crc32("conv_id:turn") % 20``: 0 drops
    the row (``live`` false), 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the
    user's. Nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    hit = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), code.alias("code"), space(role_col).alias("role"), space(text_col).alias("text"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") != 0).alias("live"), copies.alias("copy")).drop("copy")


def _oracle() -> str:
    """The damage, the statistics and the cheapest edits in DuckDB SQL; the programme carries whole edit strings.

    Rows of one turn are ordered by role and text here."""
    inserts = []
    for start in range(4):
        state = start
        for k in range(MAX_INSERTS + 1):
            inserts.append(f"({start}, {k}, {state})")
            state = FOLLOWS[state]
    moves = [f"({q}, 'D', NULL, {q}, 2)" for q in range(4)] + [f"({q}, 'R', NULL, {to}, 1)" for q, to in FOLLOWS.items()]
    moves += [f"({q}, 'K', '{i}', {to}, 0)" for (q, i), to in KEEPS.items()]
    white = "[\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE tab AS (
    SELECT list(v ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM (SELECT range AS n FROM range(256)))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
coded AS (SELECT conv_id, turn, role, text,
                 xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::BIGINT, 1))::BIGINT)),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
          FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
                   CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, regexp_replace(text, '{white}+$', '') AS core,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
f AS (SELECT *, core = '' AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
             lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM numbered),
rows AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
ins(q, k, mid) AS (VALUES {", ".join(inserts)}),
moves(q, op, initial, dest, price) AS (VALUES {", ".join(moves)}),
s AS (
    SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS edits FROM rows
    UNION ALL
    SELECT c, i, q, best.cost, best.edits FROM (
        SELECT s.c, s.i + 1 AS i, moves.dest AS q,
               min({{'cost': s.cost + 5 * ins.k + price + CASE WHEN op <> 'D' AND truncated THEN 5 ELSE 0 END, 'edits': s.edits || repeat('I', ins.k) || op}}) AS best
        FROM s JOIN rows ON rows.c = s.c AND rows.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN moves ON moves.q = ins.mid
        WHERE (op = 'D' OR NOT (blank OR duplicate)) AND (op <> 'K' OR moves.initial = left(role, 1))
        GROUP BY s.c, s.i, moves.dest)),
size AS (SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
                count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
ends AS (SELECT s.c, min({{'cost': s.cost + 5 * ins.k, 'edits': s.edits || repeat('I', ins.k)}}) AS best
         FROM s JOIN size ON size.c = s.c AND size.n = s.i JOIN ins ON ins.q = s.q WHERE ins.mid IN (0, 3) GROUP BY s.c),
letters AS (SELECT c, unnest(string_split(best.edits, '')) AS op, unnest(range(1, length(best.edits) + 1)) AS p FROM ends WHERE best.edits <> ''),
placed AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS j FROM letters
           WINDOW w AS (PARTITION BY c ORDER BY p)),
turns AS (SELECT x.*, rows.role, rows.text, max(CASE WHEN j = 1 AND op = 'K' AND left(rows.role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.c) AS led
          FROM placed x LEFT JOIN rows ON rows.c = x.c AND rows.i = x.i AND x.op <> 'I' WHERE op <> 'D'),
made AS (SELECT c, string_agg(CASE WHEN op = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END,
                              chr(10) ORDER BY p) AS text FROM turns GROUP BY c),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.edits, '') AS audit, sha256(coalesce(made.text, '')) AS repaired_sha256
FROM every LEFT JOIN size ON size.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN ends ON ends.c = size.c LEFT JOIN made ON made.c = size.c
"""


ORACLE_SQL = _oracle()
