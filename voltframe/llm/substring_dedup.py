"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one text. Each window has a minimiser, the
smallest hash among its runs of ``k`` words, which depends on the window's words alone;
so equal windows have equal minimisers. Consecutive windows of a text mostly share one:
such a run of windows (a super-k-mer) travels as one packed string of its words to the
bucket of its minimiser instead of as one string per window. In the bucket the windows of
a minimiser are sorted, and equal neighbours are the windows that occur more than once.
The words they cover are removed.

Steps and what moves:

1. Every text is cut into super-k-mers; only ``(minimiser, text key, start, windows)`` is
   written, about one row for every fifteen words.
2. Minimisers are counted (map-side first). Equal windows have the minimiser at equal
   places, so one that occurs once in the whole corpus has no repeated window, and its
   super-k-mer stops here. (A very long super-k-mer, which a periodic text makes, counts
   as more, so that it is treated as hot.)
3. The others are gathered per text (bounded by the text's length), meet the texts in a
   join, and leave as packed strings for their buckets. Equal texts share a key and travel
   once, with their number as weight, so a group of exact copies is one text here.
4. In the bucket: if all strings of a minimiser are equal, every window in them repeats;
   else the windows are sorted. The spans found go back to the texts; both joins with the
   texts use one shuffle of them.

Hot minimisers: one that occurs more than ``hot_limit`` times (a passage that a large part
of the corpus shares) is not gathered in one bucket. Its packed strings are summed up by an
aggregation with a map-side part, which no key can make hot; the distinct ones are cut into
windows that are counted likewise by 128-bit digests, and the repeated ones are joined back
(adaptive execution splits those joins).

Text keys are two 64-bit hashes of the text. Words are maximal runs of characters other
than blank, tab, line feed, vertical tab, form feed and carriage return, unchanged.

Edge cases: a null text counts as empty; texts with fewer words than a window keep all.
A window repeated within one text counts as repeated, overlapping or not. Rows that repeat
a text lose all words that windows cover. An empty table gives no rows. Input columns named
``n_words`` or ``n_removed`` are replaced; others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.session import materialize

WINDOW = 35
K = 16  # longer than most lines that pages share, so that those do not draw windows together
HOT_LIMIT = 4_096
STEP_BYTES = 2_000_000  # text bytes cut together
KEY = ["__k1", "__k2"]  # of the texts; elsewhere k1, k2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (one for each start that has them)."""
    reach, low = 1, x
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def super_kmers(texts: list[list[bytes]], window: int, k: int) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, times, minimiser)`` of all super-k-mers of the texts' words.

    ``times`` is 2 if the minimiser occurs in the super-k-mer more than once, else 1.
    """
    none = (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),)
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    total = int(sizes.sum())
    if total < window:
        return none
    word = _mixed(np.fromiter((c for w in texts for c in map(zlib.crc32, w)), dtype=np.uint32, count=total))
    run = word[:total - k + 1].copy()
    for j in range(1, k):
        run = run * np.uint64(0x100000001B3) + word[j:total - k + 1 + j]
    run = _mixed(run)
    low = _sliding_min(run, window - k + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(low)]
    place = np.arange(len(low)) - (np.cumsum(sizes) - sizes)[text]
    valid = place + window <= sizes[text]
    at = np.flatnonzero(valid)
    text, place, low = text[valid], place[valid], low[valid]
    if not len(low):
        return none
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] != low[:-1])]))
    n, at, mini = np.diff(np.append(first, len(low))), at[first], low[first]
    # The second place of the minimiser at or after the super-k-mer's start, if there is one.
    order = np.argsort(run, kind="stable")
    values = run[order]
    begin, end = np.searchsorted(values, mini), np.searchsorted(values, mini, side="right")
    times = np.ones(len(mini), dtype=np.int64)
    for i in np.flatnonzero(end - begin > 1):
        places = order[begin[i]:end[i]]
        j = int(np.searchsorted(places, at[i]))
        times[i] += j + 1 < len(places) and places[j + 1] <= at[i] + n[i] - 1 + window - k
    return text[first], place[first], n, times, mini


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i in range(batch.num_rows):
        n = len(batch.column(column)[i].as_py() or "")
        if i > start and held + n > STEP_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def cut(texts: DataFrame, window: int, k: int) -> DataFrame:
    """``mini, k1, k2, start, n, times`` of every super-k-mer of ``texts`` (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                at, start, n, times, low = super_kmers([_words(t.as_py()) for t in part.column("text")], window, k)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), part.column("k1").take(at), part.column("k2").take(at),
                     pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(times, pa.int32())],
                    names=["mini", "k1", "k2", "start", "n", "times"])

    return texts.mapInArrow(run, "mini long, k1 long, k2 long, start int, n int, times int")


def _bounds(words: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """The words joined by one space, and where each begins and ends."""
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return b" ".join(words), np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist()


def _each_text(batches: Iterator[pa.RecordBatch], text_col: str):
    """Rows of texts with runs, once for each key (equal keys are neighbours or in other tasks)."""
    before = None
    for batch in batches:
        for i in range(batch.num_rows):
            key = tuple(batch.column(c)[i].as_py() for c in KEY)
            if key != before:
                before = key
                weight, runs, text = (batch.column(c)[i].as_py() for c in ("__weight", "__runs", text_col))
                yield key, weight, runs, _words(text)


def pack(texts: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """Packed strings ``mini, k1, k2, start, weight, packed`` of texts with their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        names = ["mini", "k1", "k2", "start", "weight", "packed"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for (k1, k2), weight, runs, words in _each_text(batches, text_col):
            joined, starts, ends = _bounds(words)
            for r in runs:
                packed = joined[starts[r["start"]]:ends[r["start"] + r["n"] + window - 2]]
                rows.append((r["mini"], k1, k2, r["start"], weight, packed.decode("utf-8")))
                held += len(packed)
            if held > STEP_BYTES:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return texts.mapInArrow(run, "mini long, k1 long, k2 long, start int, weight long, packed string")


def repeated_in_group(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(k1, k2, first word, end)`` spans of the repeated windows of one minimiser.

    ``rows`` are ``(k1, k2, start, weight, packed)``; equal windows of other minimisers
    cannot exist.
    """
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())  # a text may have come twice
    if sum(r[3] for r in rows) > 1 and all(r[4] == rows[0][4] for r in rows):
        for k1, k2, start, _, packed in rows:
            yield k1, k2, start, start + packed.count(" ") + 1
        return
    windows = []
    for number, r in enumerate(rows):
        joined, starts, ends = _bounds(r[4].encode("utf-8").split(b" "))
        windows += [(joined[starts[i]:ends[i + window - 1]], number, i) for i in range(len(starts) - window + 1)]
    windows.sort()
    found: dict[int, list[int]] = {}
    for _, same in groupby(windows, key=lambda w: w[0]):
        same = list(same)
        if sum(rows[number][3] for _, number, _ in same) > 1:
            for _, number, i in same:
                found.setdefault(number, []).append(i)
    for number, own in found.items():
        k1, k2, start = rows[number][:3]
        for a, b in _runs_of(sorted(own)):
            yield k1, k2, start + a, start + b + window


def _runs_of(places: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    first = last = places[0]
    for p in places[1:]:
        if p != last + 1:
            yield first, last
            first = p
        last = p
    yield first, last


def _spans_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["k1", "k2", "a", "b"])


def bucket_spans(packed: DataFrame, window: int) -> DataFrame:
    """Spans ``k1, k2, a, b`` found by sorting the windows of each minimiser's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        mini = None
        out: list[tuple] = []
        for batch in batches:
            for m, *row in zip(*(batch.column(c).to_pylist() for c in ("mini", "k1", "k2", "start", "weight", "packed"))):
                if m != mini:
                    if group:
                        out += repeated_in_group(group, window)
                    group, mini = [], m
                group.append(tuple(row))
            if len(out) > 20_000:
                yield _spans_batch(out)
                out = []
        if group:
            out += repeated_in_group(group, window)
        if out:
            yield _spans_batch(out)

    return packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "k1 long, k2 long, a int, b int")


def string_windows(strings: DataFrame, window: int) -> DataFrame:
    """``s1, s2, n, weight, i, w1, w2`` of every window of ``strings`` (s1, s2, weight, packed): its
    place in the string and its digest; ``n`` is the string's number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["s1", "s2", "n", "weight", "i", "w1", "w2"]
        for batch in batches:
            for part in _slices(batch, "packed"):
                at, i, n, digests = [], [], [], []
                for row, packed in enumerate(part.column("packed").to_pylist()):
                    joined, starts, ends = _bounds(packed.encode("utf-8").split(b" "))
                    count = len(starts) - window + 1
                    digests += [xxhash.xxh3_128_digest(joined[starts[j]:ends[j + window - 1]]) for j in range(count)]
                    at += [row] * count
                    i += range(count)
                    n += [count] * count
                halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                own = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("s1").take(own), part.column("s2").take(own), pa.array(n, pa.int32()), part.column("weight").take(own),
                     pa.array(i, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=names)

    return strings.mapInArrow(run, "s1 long, s2 long, n int, weight long, i int, w1 long, w2 long")


def hot_spans(texts: DataFrame, window: int, text_col: str = "text") -> DataFrame:
    """Spans of hot minimisers.

    Equal packed strings are summed up first, map-side, so what a large part of the corpus
    shares is one row; only the distinct strings are cut into windows, whose digests are
    counted by another such aggregation; the places found go back by the strings' keys.

    A text that came from two tasks stands in two rows at least, so counting it twice finds
    nothing that does not repeat.
    """
    ids = {"s1": F.xxhash64("packed"), "s2": F.xxhash64(F.concat(F.lit("\n"), F.col("packed")))}
    packed = materialize(pack(texts, window, text_col).drop("mini"), "hot-strings")
    strings = packed.groupBy("packed").agg(F.sum("weight").alias("weight")).withColumns(ids)
    windows = materialize(string_windows(strings.select("s1", "s2", "weight", "packed"), window), "hot-windows")
    often = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("seen")).where(F.col("seen") > 1).select("w1", "w2")
    places = windows.join(often, ["w1", "w2"], "left_semi").groupBy("s1", "s2", "n").agg(F.collect_list("i").alias("places"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).alias("b")))
    each = F.transform("places", lambda i: F.struct(i.alias("a"), (i + window).alias("b")))
    found = places.select("s1", "s2", F.when(F.size("places") == F.col("n"), whole).otherwise(each).alias("spans"))
    return (
        packed.withColumns(ids).select("s1", "s2", "k1", "k2", "start").join(found, ["s1", "s2"])
        .select("k1", "k2", "start", F.inline("spans"))
        .select("k1", "k2", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    )


def without_spans(texts: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with the words in ``__spans`` (array of (a, b)) removed from the text."""
    kept = [f for f in texts.schema if f.name not in ("__spans", *KEY)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text_col):
                text, n_words, n_removed = [], [], []
                for t, spans in zip(part.column(text_col).to_pylist(), part.column("__spans").to_pylist()):
                    words = _words(t)
                    gone = np.zeros(len(words) + 1, dtype=np.int32)
                    for s in spans or ():
                        gone[s["a"]] += 1
                        gone[s["b"]] -= 1
                    stays = np.cumsum(gone)[:-1] == 0
                    text.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s).decode("utf-8") if spans else b" ".join(words).decode("utf-8"))
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(stays.sum()))
                columns = {c: part.column(c) for c in names} | {text_col: pa.array(text, pa.string())}
                yield pa.RecordBatch.from_arrays(
                    [columns[c] for c in names] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                    names=[*names, "n_words", "n_removed"])

    return texts.mapInArrow(run, T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, k: int = K, hot_limit: int = HOT_LIMIT) -> DataFrame:
    """``docs`` with ``text_col`` less every word that a repeated window covers (the kept words
    joined by one space), ``n_words`` and ``n_removed`` (long)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns(dict(zip(KEY, (F.xxhash64(text), F.xxhash64(F.concat(F.lit("\n"), text))))))
    by_key = lambda df, *more: df.select(*(F.col(a).alias(b) for a, b in zip(("k1", "k2"), KEY)), *more)
    cuts = materialize(cut(keyed.select(*(F.col(b).alias(a) for a, b in zip(("k1", "k2"), KEY)), F.col(text_col).alias("text")), window, k), "super-kmers")
    shared = materialize(
        cuts.groupBy("mini").agg(F.sum(F.greatest("times", F.floor(F.col("n") / 64))).alias("often")).where(F.col("often") > 1), "minimisers")

    weights = by_key(cuts.where(F.col("start") == 0).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("weight")), F.col("weight").alias("__weight"))
    found = (
        cuts.join(shared.select("mini", (F.col("often") > hot_limit).alias("hot")), "mini")
        .groupBy("k1", "k2", "hot").agg(F.collect_set(F.struct("mini", "start", "n")).alias("runs"))
    )
    with_runs = lambda hot: keyed.join(by_key(found.where(F.col("hot") == hot), F.col("runs").alias("__runs")).join(weights, KEY), KEY)
    spans = bucket_spans(pack(with_runs(False), window, text_col), window)
    if shared.where(F.col("often") > hot_limit).limit(1).count():
        spans = spans.unionByName(hot_spans(with_runs(True), window, text_col))
    gathered = by_key(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), F.col("spans").alias("__spans"))
    return without_spans(keyed.join(gathered, KEY, "left"), text_col)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k.range AS pos FROM win JOIN again USING (h), range(35) k),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.pos) AS text, count(*) AS n
         FROM words LEFT JOIN gone ON gone.r = words.r AND gone.pos = words.pos WHERE gone.r IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
