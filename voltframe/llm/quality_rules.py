"""Quality rules whose thresholds adapt to each language and source.

Features of every document are counted first (one row per document, no text). Each metric
of each (language, source) group is summarised by a mergeable quantile sketch, thresholds
are read off the sketches, and the documents meet their group's thresholds in a join.

The sketch is DDSketch (Masson et al., 2019) as a table: a value v > 0 falls into bucket
``ceil(log_gamma v)``, zero into a bucket of its own, and a sketch is the counts of its
buckets. Two sketches merge by adding counts, so a group is summarised map-side first and
a hot source sends one row per bucket from each task; any quantile is within 0.2 % of its
value, and equal input gives equal thresholds whatever the partitioning. Groups with fewer
than ``min_group`` documents use their language's sketch, and languages with fewer the
sketch of all documents; both are merged from the groups' sketches.

Thresholds (replacing fixed cutoffs) come from the sketch alone: with the median q50 and a quantile
qt of the metric in the group, a document fails above ``(q50 + reach * (qt - q50)) * GAMMA`` or, for
the mean word length, below ``(q50 - reach * (q50 - qt)) / GAMMA``; the factor is one bucket of the
sketch. ``qt`` is a quartile where ordinary documents hardly differ (symbols, word length), which
junk does not move while it is less than a quarter of the group, and the 99th percentile where few
ordinary documents have any (repeated lines and words). What a group does not have at all, such as
symbols in prose, is rejected there and kept where it is usual.

Base rule, independent of the group: fewer than ``min_words`` words, or more than 20 % of
the words in a five-word window that the text holds twice. What fails it is not summarised.

Edge cases: a null or empty text has no words, all counts 0 and fails the base rule. Null
language or source is a value like any other. Repeated rows are rows of their own. An
empty table gives no rows. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.session import materialize

ALPHA = 0.002
GAMMA = (1 + ALPHA) / (1 - ALPHA)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: metric -> (numerator, denominator, quantile above the median, quantile below it or None, reach)
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 0.75, None, 3.0),
    "dup_line_share": ("n_dup_lines", "n_lines", 0.99, None, 2.0),
    "repeat_share": ("n_repeat_words", "n_words", 0.99, None, 1.5),
    "word_length": ("word_chars", "n_words", 0.75, 0.25, 10.0),
}
QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
NAMED = {v: k for k, v in QUANTILES.items()}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_BLANKS = (" ", "\t", "\n", "\v", "\f", "\r")


def _repeated(ids: np.ndarray) -> int:
    """Words covered by windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    kinds = int(ids.max()) + 1
    if kinds < 6208:  # five ids fit into 63 bits
        key = np.zeros(n, dtype=np.int64)
        for k in range(WINDOW):
            key = key * kinds + ids[k:k + n]
    else:  # number the pairs, then the pairs of pairs, then add the fifth word
        two = np.unique(ids[:-1].astype(np.int64) * kinds + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2].astype(np.int64) * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
        key = four[:n].astype(np.int64) * kinds + ids[WINDOW - 1:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(WINDOW):
        covered[k:k + n] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """:data:`COUNTS` of one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split on exactly the six blanks
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids) if len(ids) else 0,
        len(lines),
    )


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, plus :data:`COUNTS` (long)."""
    kept = [f for f in docs.schema if f.name != text_col and f.name.lower() not in COUNTS]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_counts(t.as_py()) for t in batch.column(text_col)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(c) for c in rows.T], names=names + COUNTS)

    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def _share(metric: str) -> Column:
    top, under, *_ = METRICS[metric]
    return F.when(F.col(under) > 0, F.col(top) / F.col(under)).otherwise(F.lit(0.0))


def sketches(counted: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row per bucket: ``lang, source, metric, bucket`` (null: the value 0), ``n``, of the documents that
    pass the base rule (``base_failed``)."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _share(m).alias("value")) for m in METRICS])).alias("m")
    return (
        counted.where((F.col("n_words") > 0) & ~F.col("base_failed")).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), values)
        .select("lang", "source", "m.metric", F.when(F.col("m.value") > 0, F.ceil(F.ln("m.value") / F.lit(math.log(GAMMA)))).cast("int").alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """``by, metric, total`` and the :data:`QUANTILES` of sketches merged to ``by``."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    upto = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.lit(2 / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket")))
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group)).withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("upto") > q * (F.col("total") - 1), F.col("value")))
    return ranked.groupBy(*by, "metric", "total").agg(*[at(q).alias(name) for name, q in QUANTILES.items()])


def thresholds(sketch: DataFrame, min_group: int = 50) -> DataFrame:
    """One row per group: ``lang, source`` and ``<metric>_max`` (and ``word_length_min``)."""
    own, by_lang, of_all = (quantiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    named = lambda df, tag: df.select(*[c for c in df.columns if c not in ("total", *QUANTILES)], *[F.col(c).alias(f"{tag}_{c}") for c in ("total", *QUANTILES)])
    a, b, c = named(own, "g").alias("a"), named(by_lang, "l").alias("b"), named(of_all, "t")
    rows = a.join(b, F.expr("a.lang <=> b.lang AND a.metric = b.metric")).select("a.*", *[f"b.l_{q}" for q in ("total", *QUANTILES)]).join(c, "metric")
    pick = lambda q: F.when(F.col("g_total") >= min_group, F.col(f"g_{q}")).when(F.col("l_total") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"t_{q}"))
    rows = rows.select("lang", "source", "metric", *[pick(q).alias(q) for q in QUANTILES])
    out = []
    for m, (_, _, above, below, reach) in METRICS.items():
        high = (F.col("q50") + reach * (F.col(NAMED[above]) - F.col("q50"))) * GAMMA
        out.append(F.max(F.when(F.col("metric") == m, high)).alias(f"{m}_max"))
        if below is not None:
            low = (F.col("q50") - reach * (F.col("q50") - F.col(NAMED[below]))) / GAMMA
            out.append(F.max(F.when(F.col("metric") == m, low)).alias(f"{m}_min"))
    return rows.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 10,
          min_group: int = 50) -> DataFrame:
    """``docs`` without the text, plus the counts, the group's thresholds, ``base_failed`` and
    ``kept``."""
    added = {"base_failed", "kept", *(f"{m}_{s}" for m in METRICS for s in ("max", "min"))}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = materialize(features(docs, text_col).withColumn("base_failed", base), "quality-counts")
    limits = thresholds(sketches(counted, lang_col, source_col), min_group).withColumnsRenamed({"lang": "__l", "source": "__s"})
    joined = counted.join(limits, counted[lang_col].eqNullSafe(F.col("__l")) & counted[source_col].eqNullSafe(F.col("__s")), "left").drop("__l", "__s")
    good = F.lit(True)
    for m, (_, _, _, below, _) in METRICS.items():
        good = good & (_share(m) <= F.col(f"{m}_max"))
        if below is not None:
            good = good & (_share(m) >= F.col(f"{m}_min"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False)))


def _oracle() -> str:
    """The same rules in DuckDB SQL."""
    fences, checks = [], []
    for m, (_, _, above, below, reach) in METRICS.items():
        fences.append(f"max(CASE WHEN metric = '{m}' THEN (q50 + {reach} * ({NAMED[above]} - q50)) * {GAMMA!r}::DOUBLE END) AS {m}_max")
        checks.append(f"{m} <= {m}_max")
        if below is not None:
            fences.append(f"max(CASE WHEN metric = '{m}' THEN (q50 - {reach} * (q50 - {NAMED[below]})) / {GAMMA!r}::DOUBLE END) AS {m}_min")
            checks.append(f"{m} >= {m}_min")
    shares = ", ".join(f"CASE WHEN {u} > 0 THEN {t}::DOUBLE / {u} ELSE 0 END AS {m}" for m, (t, u, *_) in METRICS.items())
    unpivot = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS value FROM s WHERE n_words >= 10 AND NOT 100 * n_repeat_words > 20 * n_words" for m in METRICS)
    at = ", ".join(f"min(CASE WHEN upto > {q} * (total - 1) THEN value END) AS {name}" for name, q in QUANTILES.items())
    quart = lambda by: f"""SELECT {by} metric, any_value(total) AS total, {at}
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by} metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by} metric) AS total,
                     CASE WHEN bucket IS NULL THEN 0 ELSE {2 / (GAMMA + 1)!r}::DOUBLE * pow({GAMMA!r}::DOUBLE, bucket) END AS value
              FROM (SELECT {by} metric, bucket, sum(n) AS n FROM k GROUP BY ALL))
        GROUP BY {by} metric"""  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, u.word, u.pos FROM d, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) WITH ORDINALITY AS u(word, pos)),
g AS (SELECT r, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram
      FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
t AS (SELECT r, pos FROM (SELECT r, pos, gram, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT pos + i) AS n_repeat_words FROM t, range(5) AS x(i) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
f AS (SELECT d.r, d.doc_id, d.lang, d.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN wc USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
s AS (SELECT *, {shares} FROM f),
k AS (SELECT lang, source, metric, CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(GAMMA)!r}::DOUBLE)::INT END AS bucket, count(*) AS n
      FROM ({unpivot}) GROUP BY ALL),
q3 AS ({quart("lang, source,")}), q2 AS ({quart("lang,")}), q1 AS ({quart("")}),
p AS (SELECT q3.lang, q3.source, q3.metric,
             {", ".join(f"CASE WHEN q3.total >= 50 THEN q3.{q} WHEN q2.total >= 50 THEN q2.{q} ELSE q1.{q} END AS {q}" for q in QUANTILES)}
      FROM q3 JOIN q2 ON q3.lang IS NOT DISTINCT FROM q2.lang AND q3.metric = q2.metric JOIN q1 ON q1.metric = q3.metric),
lim AS (SELECT lang, source, {", ".join(fences)} FROM p GROUP BY lang, source)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce({" AND ".join(checks)}, false) AS kept
FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source
"""


ORACLE_SQL = _oracle()
