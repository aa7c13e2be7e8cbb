"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

Spark partitions the documents; every Arrow batch is split by the vocabulary's pattern,
and the pieces that the worker has not met yet go to an in-process DuckDB as
token-position rows ``(word, pos, tok)``. A recursive query joins neighbouring rows with
the merge table and contracts each word's leftmost pair of minimum rank until no pair of
any word is in the table. Decoding joins ids with the vocabulary and concatenates the
bytes with an ordered aggregation.

Rules (those of a rank file): a piece that is itself in the vocabulary is one token; else
its bytes are merged, always the pair whose joined bytes have the lowest rank, leftmost
first. The merge table therefore holds every split of every vocabulary entry into two
entries, not only the split it was trained with.

Equal pairs of one word are contracted in the same round, left to right without overlap.
That equals one contraction at a time unless joining the new token with a neighbour could
outrank the pair itself; the few ids for which the vocabulary holds such an entry are
marked ``solo`` and contracted one at a time.

Memory: a worker remembers the ids of about twice ``MEMO_STRINGS`` strings (bounded
memory only; a forgotten string is encoded again). A recursive query runs at most ``rounds``
rounds, chosen from the number of rows, and the state it ends with starts the next one, so
a text that is one single word of any length needs memory in proportion to its length.
The vocabulary travels as a broadcast of the rank file's bytes (about 1 MB; the file's
size is checked against ``MAX_VOCAB_BYTES``). Tasks hold no state that a retry needs.

Edge cases: a null text encodes like an empty one: no ids, decoded bytes empty. Extra
columns pass through; columns named like a result column are dropped from the input.
Repeated rows are encoded each. An empty table gives an empty result. Ids outside the
vocabulary make decoding fail with a clear error.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the split pattern of the rank files, in which a blank belongs to what follows.
BLANK_LED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO_STRINGS = 300_000  # strings remembered, and as many of the time before
MAX_VOCAB_BYTES = 64 * 1024 * 1024
ROWS_PER_QUERY = 4_000_000  # token-position rows that one recursive query may hold
WORDS_PER_QUERY = 20_000
LONG_PIECE = 64  # characters; longer pieces are contracted alone, all equal pairs of a round at once
BYTES_PER_STEP = 3_000_000  # text bytes of a batch that are encoded and decoded together
DUCK_MEMORY = "250MB"

# One contraction per word and round. Every row knows its right neighbour, so a round is
# hash joins only: ``npos``/``ntok`` are the position and token to the right (-1: none).
_CONTRACT_ONE = """
WITH RECURSIVE state(round, w, pos, tok, npos, ntok) AS (
    SELECT 0, w, pos, tok, npos, ntok FROM piece_tokens
  UNION ALL
    (WITH ranked AS (
        SELECT s.w, s.npos, m.merged * 4294967296 + s.pos AS place
        FROM state s JOIN merges m ON m.pair = s.tok * 4294967296 + s.ntok),
    best AS (
        SELECT w, min(place) AS place, arg_min(npos, place) AS npos FROM ranked GROUP BY w),
    taken AS (
        SELECT b.w, b.place % 4294967296 AS pos, b.place // 4294967296 AS merged, b.npos, n.npos AS after, n.ntok AS after_tok
        FROM best b JOIN state n ON n.pos = b.npos)
    SELECT s.round + 1, s.w, s.pos,
           CASE WHEN s.pos = t.pos THEN t.merged ELSE s.tok END,
           CASE WHEN s.pos = t.pos THEN t.after ELSE s.npos END,
           CASE WHEN s.pos = t.pos THEN t.after_tok WHEN s.npos = t.pos THEN t.merged ELSE s.ntok END
    FROM state s JOIN taken t ON t.w = s.w
    WHERE s.pos <> t.npos AND s.round < $rounds)
)
SELECT s.w, s.pos, s.tok, s.round = $rounds AS open
FROM state s JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) USING (w, round)
"""

# All equal pairs of a word in one round (see the module's text), for long pieces.
_CONTRACT_RUNS = """
WITH RECURSIVE state(round, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM piece_tokens
  UNION ALL
    (WITH pairs AS (
        SELECT round, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next_tok FROM state),
    ranked AS (
        SELECT p.*, m.merged, m.solo, min(m.merged) OVER (PARTITION BY p.w) AS best
        FROM pairs p LEFT JOIN merges m ON m.pair = p.tok * 4294967296 + p.next_tok),
    live AS (
        SELECT *, coalesce(merged = best, false) AS hit, row_number() OVER (PARTITION BY w ORDER BY pos) AS i
        FROM ranked WHERE best IS NOT NULL),
    hits AS (
        SELECT w, i, merged, solo, row_number() OVER (PARTITION BY w ORDER BY i) AS nth FROM live WHERE hit),
    taken AS (
        SELECT w, i, merged FROM (
            SELECT *, (i - min(i) OVER (PARTITION BY w, i - nth)) % 2 = 0 AS free FROM hits)
        WHERE CASE WHEN solo THEN nth = 1 ELSE free END)
    SELECT live.round + 1, live.w, live.pos, coalesce(t.merged, live.tok)
    FROM live LEFT JOIN taken t ON t.w = live.w AND t.i = live.i
              LEFT JOIN taken gone ON gone.w = live.w AND gone.i = live.i - 1
    WHERE gone.i IS NULL AND live.round < $rounds)
)
SELECT s.w, s.pos, s.tok, s.round = $rounds AS open
FROM state s JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) USING (w, round)
"""

_DECODE = """
SELECT i.doc, array_to_string(list(v.chars ORDER BY i.pos), '') AS chars
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY i.doc
"""


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """``token bytes -> rank`` from a rank file (``base64 rank`` lines)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def read_vocabulary(path: str) -> bytes:
    """The rank file's bytes, for :func:`encode` and :func:`decode`."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes; it would be too large to broadcast")
    return raw


def _merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int], list[bool]]:
    """All ``(left id, right id, merged id, solo)``."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    # A merged id is solo when some entry that has it as a half ranks below it.
    alone = {half for a, b, m in zip(left, right, merged) for half in (a, b) if m < half}
    return left, right, merged, [m in alone for m in merged]


class Codec:
    """Encoder and decoder of one worker: a DuckDB connection and the pieces met so far."""

    def __init__(self, raw: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(raw)
        self.split = regex.compile(pattern).findall
        self.duck = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCK_MEMORY})
        left, right, merged, solo = _merge_rows(self.ranks)
        pair = np.array(left, dtype=np.int64) * 2**32 + np.array(right, dtype=np.int64)
        rows = pa.table({"pair": pair, "merged": pa.array(merged, pa.int64()), "solo": pa.array(solo, pa.bool_())})
        # A token's bytes as characters of the same numbers: DuckDB then concatenates text.
        words = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()),
                          "chars": pa.array([t.decode("latin-1") for t in self.ranks])})
        for name, table in (("merges", rows), ("vocab", words)):
            self.duck.register("incoming", table)
            self.duck.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.duck.unregister("incoming")
        self.names = [b"%d" % i for i in range(max(self.ranks.values(), default=-1) + 1)]
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        # Texts that must not be cut before blanks: all of them under any other pattern.
        self.whole = regex.compile(r"\s (?:\s|$)" if pattern == BLANK_LED_PATTERN else "").search
        # Strings met -> their ids as int32 bytes: ``led`` has those that a blank leads, without
        # the blank, ``bare`` the others.
        self.led: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.long: list[tuple[dict[str, bytes], str]] = []

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Token ids of every text.

        Under the blank-led pattern a text is cut before each blank first, and the ids of a
        cut part are remembered: no match of that pattern goes over such a cut unless the
        blank stands within a run of white space; a text with such a run is cut into the
        pattern's matches instead.
        """
        if len(self.led) + len(self.bare) > MEMO_STRINGS:
            self.older, self.led, self.bare = (self.led, self.bare), {}, {}
        heads, tails, seen = [], [], set()
        for t in texts:
            if not t:
                heads.append(())
                tails.append(())
            elif self.whole(t):
                heads.append(self.split(t))
                tails.append(())
            else:
                first, *rest = t.split(" ")
                heads.append((first,) if first else ())
                tails.append(rest)
                seen.update(rest)
        self._learn(seen, set(chain.from_iterable(heads)))
        led, bare = self.led.__getitem__, self.bare.__getitem__
        out = [np.frombuffer(b"".join(chain(map(bare, h), map(led, t))), dtype=np.int32) for h, t in zip(heads, tails)]
        for memo, key in self.long:  # long strings are not worth remembering
            memo.pop(key, None)
        self.long = []
        return out

    def _missing(self, strings: set[str], memo: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
        """Those not remembered; what only the older half of the memo holds moves up."""
        out = []
        for s in strings.difference(memo):
            ids = older.get(s)
            if ids is None:
                out.append(s)
                if len(s) > LONG_PIECE:
                    self.long.append((memo, s))
            else:
                memo[s] = ids
        return out

    def _learn(self, led: set[str], bare: set[str]) -> None:
        """Remember the ids of `` `` + each of ``led`` and of each of ``bare``."""
        split = self.split
        todo: list[tuple[dict[str, bytes], str, list[str]]] = []
        pieces_led, pieces_bare = set(), set()
        for key in self._missing(led, self.led, self.older[0]):
            # A blank and letters are one match; anything else is left to the pattern.
            if key.isascii() and key.isalpha():
                pieces_led.add(key)
                continue
            todo.append((self.led, key, split(" " + key)))
        todo += [(self.bare, key, split(key)) for key in self._missing(bare, self.bare, self.older[1])]
        for _, _, pieces in todo:
            for p in pieces:
                if p[0] == " ":
                    pieces_led.add(p[1:])
                else:
                    pieces_bare.add(p)
        new = [(self.led, p, " " + p) for p in self._missing(pieces_led, self.led, self.older[0])]
        new += [(self.bare, p, p) for p in self._missing(pieces_bare, self.bare, self.older[1])]
        short = [x for x in new if len(x[2]) <= LONG_PIECE]
        for at in range(0, len(short), WORDS_PER_QUERY):
            self._learn_pieces(short[at:at + WORDS_PER_QUERY], self._one)
        for x in new:
            if len(x[2]) > LONG_PIECE:
                self._learn_pieces([x], self._runs)
        ids = lambda p: self.led[p[1:]] if p[0] == " " else self.bare[p]
        for memo, key, pieces in todo:
            memo[key] = b"".join(map(ids, pieces))

    def _learn_pieces(self, pieces: list[tuple[dict[str, bytes], str, str]], contract) -> None:
        """Remember the ids of matches of the pattern, given as (memo, key, match)."""
        todo = []
        for memo, key, p in pieces:
            data = p.encode("utf-8")
            whole = self.ranks.get(data)
            if whole is not None:
                memo[key] = whole.to_bytes(4, sys.byteorder)
            else:
                todo.append((memo, key, data))
        if not todo:
            return
        data = np.frombuffer(b"".join(d for _, _, d in todo), dtype=np.uint8)
        tok = self.byte_ids[data]
        if (tok < 0).any():
            raise ValueError("the vocabulary has no token for some byte")
        w = np.repeat(np.arange(len(todo), dtype=np.int32), [len(d) for _, _, d in todo])
        pos = np.arange(len(data), dtype=np.int32)
        while len(w):
            rounds = int(max(4, min(64, ROWS_PER_QUERY // len(w))))
            out = contract(w, pos, tok, rounds)
            done = ~out["open"]
            words, ids = out["w"][done], out["tok"][done].astype(np.int32).tobytes()
            cuts = np.flatnonzero(np.diff(words, prepend=-1))
            ends = np.append(cuts[1:], len(words)) * 4
            for i, start, end in zip(words[cuts].tolist(), (cuts * 4).tolist(), ends.tolist()):
                memo, key, _ = todo[i]
                memo[key] = ids[start:end]
            w, pos, tok = (out[k][out["open"]].astype(np.int32) for k in ("w", "pos", "tok"))

    def _one(self, w, pos, tok, rounds):
        same = np.append(w[1:] == w[:-1], False)
        right = {"npos": np.where(same, np.append(pos[1:], -1), -1).astype(np.int32),
                 "ntok": np.where(same, np.append(tok[1:], -1), -1).astype(np.int64)}
        return self._query(_CONTRACT_ONE, {"w": w, "pos": pos.astype(np.int64), "tok": tok.astype(np.int64)} | right, rounds)

    def _runs(self, w, pos, tok, rounds):
        return self._query(_CONTRACT_RUNS, {"w": w, "pos": pos, "tok": tok.astype(np.int64)}, rounds)

    def _query(self, sql: str, rows: dict, rounds: int):
        self.duck.register("piece_tokens", pa.table(rows))
        out = self.duck.execute(sql, {"rounds": rounds}).fetchnumpy()
        self.duck.unregister("piece_tokens")
        order = np.argsort(out["pos"], kind="stable")
        return {k: np.asarray(v)[order] for k, v in out.items()}

    def decode_batch(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every id sequence."""
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids).astype(np.int32) if sizes.sum() else np.zeros(0, dtype=np.int32)
        out = [b""] * len(ids)
        self.duck.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
                                           "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        missing = self.duck.execute("SELECT count(*) FROM ids ANTI JOIN vocab USING (id)").fetchone()[0]
        if missing:
            raise ValueError(f"{missing} ids are not in the vocabulary")
        for doc, text in self.duck.execute(_DECODE).fetchall():
            out[doc] = text.encode("latin-1")
        self.duck.unregister("ids")
        return out


_CODECS: dict[str, Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary (built once for each Python worker)."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _steps(batch: pa.RecordBatch, column: str, width: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about BYTES_PER_STEP, one row at least."""
    values = batch.column(column)
    sizes = np.asarray(pa.compute.binary_length(values) if width == 1 else pa.compute.list_value_length(values).cast(pa.int64()))
    sizes = np.nan_to_num(np.asarray(sizes, dtype=float)) * width
    total, start = 0.0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BYTES_PER_STEP:
            yield batch.slice(start, i - start)
            start, total = i, 0.0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def _mapped(df: DataFrame, drop: list[str], add: T.StructType, work) -> DataFrame:
    """``df`` without ``drop`` and the columns of ``add``, plus ``add`` as ``work`` makes them."""
    new = {f.name.lower() for f in add}
    keep = [f for f in df.schema if f.name not in drop and f.name.lower() not in new]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in work(batch):
                piece, columns = part
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in names] + columns, names=names + add.names)
            del batch
            pa.default_memory_pool().release_unused()  # workers stay; a large batch's memory should not

    return df.mapInArrow(run, T.StructType(keep + list(add)))


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def encode(df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array of int) and ``n_tokens`` (long) of ``text_col``."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch):
        codec = _codec(sent.value, pattern)
        for part in _steps(batch, text_col, 1):
            ids = codec.encode_batch(part.column(text_col).to_pylist())
            yield part, [_ids_array(ids), pa.array([len(x) for x in ids], pa.int64())]

    add = T.StructType().add(ids_col, T.ArrayType(T.IntegerType(), False)).add("n_tokens", T.LongType())
    return _mapped(df, [], add, work)


def decode(df: DataFrame, vocabulary: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` (binary): the bytes of the ids; null ids decode to no bytes."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch):
        codec = _codec(sent.value, pattern)
        for part in _steps(batch, ids_col, 4):
            ids = [np.asarray(x if x is not None else [], dtype=np.int32) for x in part.column(ids_col).to_pylist()]
            yield part, [pa.array(codec.decode_batch(ids), pa.binary())]

    return _mapped(df, [], T.StructType().add(bytes_col, T.BinaryType()), work)


def round_trip(df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``
    (and ``ids``) in place of the text, so that ids need not travel between two passes.

    ``ids_sha256`` is the digest of the decimal ids joined by one space.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batch):
        codec = _codec(sent.value, pattern)
        for part in _steps(batch, text_col, 1):
            ids = codec.encode_batch(part.column(text_col).to_pylist())
            back = codec.decode_batch(ids)
            yield part, [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(map(codec.names.__getitem__, x.tolist()))).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            ] + ([_ids_array(ids)] if keep_ids else [])

    add = T.StructType().add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    if keep_ids:
        add = add.add("ids", T.ArrayType(T.IntegerType(), False))
    return _mapped(df, [text_col], add, work)
