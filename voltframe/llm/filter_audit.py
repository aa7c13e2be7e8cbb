"""Interaction of five document filters: what each removes in every order of application.

Every document gets a bit mask of the filters that it fails. The audit needs no more than
the number of documents in each cell (part, mask), so the documents are counted into at
most 32 cells a part, and everything after that works on those.

Per part, a Gray-code walk visits all 32 subsets of the filters and toggles one filter at
a time. Every cell has a counter of the active filters that it fails; where a toggle
raises a counter from 0 or lowers it to 0, the cell leaves or joins the running
survivors. The 32 states are stored, and a step of an order (a filter that joins the
subset before it) is the difference of two states.

The failure conditions (:data:`LETTERS`), over words ``[^\\x20\\x09-\\x0D]+``: A under 200
words; B fewer distinct words than half the words; C more than 3 % capitals A-Z; D any
character of ``#$%&*|``; E text identical to that of a smaller id, whatever else removes
either.

Plan: texts are read once, in tasks, a megabyte of words at a time; what leaves a task is
``id, part, mask, 128-bit digest``. Copies are counted before they meet: rows are summed
by (digest, id, part), labels join by id, and the smallest id of a digest is found among
sums by (digest, part, labels), so neither a text that a third of all documents share nor
an id that they share meets in one task. The walk runs per part on its cells.

Edge cases: a null text is empty; a null part is the empty string; a row without an id has
no labels, fails E never and makes no other row fail it; rows that repeat an id are
documents each, with the labels of that id, and do not fail E because of each other; an id
labelled more than once is good or toxic if any of its labels says so; labels of unknown
ids count nothing. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.session import materialize

LETTERS = "ABCDE"
PIECE_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL = re.compile(rb"[#$%&*|]")
COUNTS = ["n", "good", "toxic"]
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def pieces(raw: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that are cut at white space only."""
    at = 0
    while len(raw) - at > size:
        blank = _BLANK.search(raw, at + size)
        if blank is None:
            break
        yield raw[at:blank.start()]
        at = blank.start()
    yield raw[at:] if at else raw


def text_mask(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text of ``n_chars`` code points fails (A is 1)."""
    n_words, distinct = 0, set()
    for piece in pieces(raw):
        words = piece.split()  # at ASCII white space: the words of the contract
        n_words += len(words)
        distinct.update(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (n_words < 200) + 2 * (100 * len(distinct) < 50 * n_words) + 4 * (100 * capitals > 3 * n_chars) + 8 * (_SYMBOL.search(raw) is not None)


def with_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask, digest`` of every document; ``mask`` has the filters A to D."""
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            sizes = pc.utf8_length(text)
            masks, digests = [], []
            for i in range(batch.num_rows):
                raw = text[i].as_buffer().to_pybytes()
                masks.append(text_mask(raw, sizes[i].as_py()))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    return wanted.mapInArrow(run, f"id {wanted.schema['id'].dataType.simpleString()}, part string, mask int, digest binary")


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by failure mask: ``part, mask, n, good, toxic``, at most 32 rows a part."""
    marked = materialize(with_masks(docs, id_col, text_col, part_col), "filter-masks")  # read for rows with and without an id
    marked = marked.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("q"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("t"))
    )
    named = marked.where(F.col("id").isNotNull()).join(known, "id", "left").na.fill(0, ["q", "t"])
    # Of a text's documents in one part and with one pair of labels: how many, and the smallest id with its rows.
    sums = named.groupBy("digest", "part", "mask", "q", "t").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    smallest = sums.groupBy("digest").agg(F.min("least.id").alias("first"))
    first_rows = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    sums = sums.join(smallest, "digest").select("part", "mask", "q", "t", first_rows.alias("firsts"), (F.col("n") - first_rows).alias("copies"))
    split = sums.select("part", "q", "t", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))))
    nameless = marked.where(F.col("id").isNull()).select("part", F.lit(0).alias("q"), F.lit(0).alias("t"), "mask", "n")
    return (
        split.where(F.col("n") > 0).unionByName(nameless).groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))
    )


def subset_states(cells: dict[int, tuple[int, ...]], n_filters: int = len(LETTERS)) -> list[tuple[int, ...]]:
    """Survivors of every subset of the filters, by a Gray-code walk; ``cells`` has the counts of each mask."""
    width = len(next(iter(cells.values()), COUNTS))
    active = dict.fromkeys(cells, 0)
    alive = [sum(c[i] for c in cells.values()) for i in range(width)]
    states: list[tuple[int, ...]] = [()] * (1 << n_filters)
    states[0] = tuple(alive)
    subset = 0
    for step in range(1, 1 << n_filters):
        bit = step & -step  # the bit in which neighbouring Gray codes differ
        subset ^= bit
        turn = 1 if subset & bit else -1
        for mask in cells:
            if mask & bit:
                active[mask] += turn
                if active[mask] == (turn > 0):  # from none to one, or from one to none
                    alive = [a - turn * c for a, c in zip(alive, cells[mask])]
        states[subset] = tuple(alive)
    return states


def order_steps(cells: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """Rows ``filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley`` of all orders of ``letters`` (bit 0 of a mask is the first)."""
    states = subset_states(cells, len(letters))
    fails = [sum(c[0] for m, c in cells.items() if m >> i & 1) for i in range(len(letters))]
    alone = [cells.get(1 << i, (0,))[0] for i in range(len(letters))]
    steps, total = [], [0] * len(letters)
    for order in permutations(range(len(letters))):
        subset = 0
        for k, f in enumerate(order, 1):
            before, after = states[subset], states[subset | 1 << f]
            removed, good, toxic = (b - a for b, a in zip(before, after))
            total[f] += removed
            steps.append((order, k, f, after[0], removed, good, toxic))
            subset |= 1 << f
    return [("".join(letters[i] for i in order), k, kept, removed, fails[f] - removed, alone[f], good, toxic, total[f])
            for order, k, f, kept, removed, good, toxic in steps]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step (:data:`RESULT`)."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        cells = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in group.itertuples(index=False)}
        rows = [(key[0], *r) for r in order_steps(cells)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return mask_cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(run, RESULT)  # at most 32 rows a part


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS t FROM labels GROUP BY doc_id),
m AS (
    SELECT d.part, coalesce(l.q, 0) AS q, coalesce(l.t, 0) AS t,
           (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
states AS (
    SELECT part, s.range AS state, count(*) FILTER (mask & s.range = 0) AS n,
           coalesce(sum(q) FILTER (mask & s.range = 0), 0) AS good, coalesce(sum(t) FILTER (mask & s.range = 0), 0) AS toxic
    FROM m, range(32) s GROUP BY part, s.range),
filters AS (SELECT r.range AS bit, substr('ABCDE', r.range::INT + 1, 1) AS letter FROM range(5) r),
fails AS (
    SELECT m.part, f.bit, count(*) FILTER (mask & (1 << f.bit) > 0) AS n, count(*) FILTER (mask = (1 << f.bit)) AS alone
    FROM m, filters f GROUP BY m.part, f.bit),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
           [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM filters a JOIN filters b ON b.bit <> a.bit JOIN filters c ON c.bit NOT IN (a.bit, b.bit)
    JOIN filters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN filters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
    SELECT filter_order, k.range + 1 AS step, bits[k.range + 1] AS bit,
           coalesce(list_sum([1 << b FOR b IN bits[1:k.range]]), 0)::BIGINT AS before
    FROM orders, range(5) k),
r AS (
    SELECT x.part, s.filter_order, s.step, s.bit, y.n AS kept, x.n - y.n AS removed,
           x.good - y.good AS good_lost, x.toxic - y.toxic AS toxic_lost
    FROM steps s JOIN states x ON x.state = s.before JOIN states y ON y.part = x.part AND y.state = s.before + (1 << s.bit))
SELECT r.part, r.filter_order, r.step::INT AS step, r.kept::BIGINT AS kept, r.removed::BIGINT AS removed,
       (f.n - r.removed)::BIGINT AS redundant, f.alone::BIGINT AS unique_fails, r.good_lost::BIGINT AS good_lost,
       r.toxic_lost::BIGINT AS toxic_lost, (sum(r.removed) OVER (PARTITION BY r.part, r.bit))::BIGINT AS shapley
FROM r JOIN fails f ON f.part = r.part AND f.bit = r.bit
"""
