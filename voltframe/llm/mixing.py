"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source every document has the same expected number of copies ``f`` = target /
source size. The documents are put in one order, their expected copies are prefix-summed,
one random offset in [0, 1) is added for the source, and a document is taken once for
every integer its stretch of the sum crosses. Since the order is by size first, each part
of the size range gives its share and the words taken come near the target.

Targets: sources in code-point order (null last) get the weights 5, 2, 1 in turn; a
source's target is its weight's share of all words, but never above ``max_repeat`` times
its own size; what that cuts off is shared again by weight among the others until no
target is above its bound (integer sums throughout, so every run agrees).

How a hot source is split: the rank of a document is the sum of three counts, none of
which needs a source in one task: documents of smaller size in the source (a window over
one row per size), documents of the same size with a smaller prefix of the id's digest
(a window over the prefixes; their length grows with the number of documents, so that a
prefix holds about ``rows_per_bucket`` of them), and the row number within that prefix.
The documents are shuffled once, on (source, size, prefix).

Edge cases: a null or empty text has size 0, takes part, and takes 0 words. A null source
is a source of its own, after all others. Rows that repeat an id count each on their own;
which of them gets a copy more is open only between rows that agree in source, size and
id. Sources without words have target 0 and no copies. An empty table gives no rows.
Input columns named like a result column are dropped; others pass through.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltframe.operators.ordinal import row_number_in_group
from voltframe.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str):
    """Words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, size_col: str, source_col: str, weights=WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row per source: ``source_col, n_docs, source_size, weight, target``."""
    sizes = docs.groupBy(F.col(source_col).alias("__src")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(size_col).alias("source_size"))
    # The position of a source in the order, without sorting all sources in one task.
    keyed = sizes.withColumn("__all", F.lit(1)).withColumn("__none", F.col("__src").isNull()).withColumn("__key", F.coalesce("__src", F.lit("")))
    prefix = F.concat(F.col("__none").cast("string"), F.lit(":"), F.substring("__key", 1, 3))
    ranked = row_number_in_group(keyed, ["__all"], prefix, ["__none", "__key"], "__nth")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("__nth") - 1) % len(weights) + 1).cast("int"))
    table = materialize(
        ranked.select(F.col("__src").alias(source_col), "n_docs", "source_size", weight.cast("long").alias("weight")), "mix-sources")

    number = "decimal(38,0)"
    total, all_weight = table.agg(F.sum(F.col("source_size").cast(number)), F.sum("weight")).first()
    total, all_weight = int(total or 0), int(all_weight or 0)
    room, share = total, all_weight  # words for the sources below their bound, and their weights
    while True:
        # over: max_repeat * size < room * weight / share, in whole numbers
        over = (F.col("source_size").cast(number) * F.lit(Decimal(max_repeat * max(share, 1))).cast(number)
                < F.col("weight").cast(number) * F.lit(Decimal(room)).cast(number)) if share else F.lit(True)
        cut, left = table.agg(
            F.sum(F.when(over, F.col("source_size").cast(number) * max_repeat)), F.sum(F.when(~over, F.col("weight")))).first()
        cut, left = int(cut or 0), int(left or 0)
        if (total - cut, left) == (room, share):
            break
        room, share = total - cut, left
    shared = F.lit(float(room)) * F.col("weight") / F.lit(float(max(share, 1)))
    return table.withColumn("target", F.when(over, (F.col("source_size") * max_repeat).cast("double")).otherwise(shared))


def mix(docs: DataFrame, size_col: str, source_col: str = "source", id_col: str = "doc_id", weights=WEIGHTS,
        max_repeat: int = 3, seed: int = 20240601, rows_per_bucket: int = 4096) -> DataFrame:
    """``docs`` with ``size, source_size, target`` (double), ``copies`` (int) and ``taken`` = copies * size.

    ``size_col`` (words of the document) becomes ``size``.
    """
    clash = [c for c in docs.columns if c.lower() in RESULT and c != size_col]
    docs = docs.drop(*clash).withColumnRenamed(size_col, "__mix_size")
    targets = source_targets(docs, "__mix_size", source_col, weights, max_repeat)
    n_docs = targets.agg(F.sum("n_docs")).first()[0] or 0
    digits = 0
    while 16**digits * rows_per_bucket < n_docs:
        digits += 1

    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = (
        docs.withColumn("__mix_none", F.col(source_col).isNull())
        .withColumn("__mix_src", F.coalesce(F.col(source_col), F.lit("")))
        .withColumn("__mix_sub", F.substring(digest, 1, digits) if digits else F.lit(""))
    )
    source = ["__mix_none", "__mix_src"]
    size, sub = [*source, "__mix_size"], [*source, "__mix_size", "__mix_sub"]
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    by_sub = rows.groupBy(*sub).agg(F.count(F.lit(1)).alias("__n"))
    by_size = by_sub.groupBy(*size).agg(F.sum("__n").alias("__m"))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__mix_src"), F.col("__mix_none").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    plan = targets.select(
        F.col(source_col).isNull().alias("__mix_none"), F.coalesce(F.col(source_col), F.lit("")).alias("__mix_src"),
        "source_size", "target")
    by_size = (
        by_size.withColumn("__below", F.coalesce(F.sum("__m").over(before(source, "__mix_size")), F.lit(0)))
        .join(plan, source)
        .select(*size, "__below", "source_size", "target", unit.alias("__offset"),
                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__f"))
    )
    offsets = (
        by_sub.withColumn("__left", F.coalesce(F.sum("__n").over(before(size, "__mix_sub")), F.lit(0)))
        .join(by_size, size)
        .select(*sub, (F.col("__below") + F.col("__left")).alias("__start"), "source_size", "target", "__offset", "__f")
    )
    within = Window.partitionBy(*sub).orderBy(digest, F.col(id_col))
    ranked = rows.withColumn("__nth", F.row_number().over(within)).join(offsets, sub)
    k = F.col("__start") + F.col("__nth")
    crossed = F.floor(F.col("__f") * k + F.col("__offset")) - F.floor(F.col("__f") * (k - 1) + F.col("__offset"))
    return (
        ranked.withColumn("copies", F.least(crossed, F.lit(max_repeat)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("__mix_size"))
        .drop(*source, "__mix_sub", "__start", "__nth", "__offset", "__f")
        .withColumnRenamed("__mix_size", "size")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix` as often as it has copies, without the columns mix added."""
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("__copy", *RESULT)


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
    SELECT source, sum(size)::HUGEINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM d GROUP BY source),
o AS (
    SELECT *, sum(source_size) OVER () AS total,
           row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS nth,
           sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share,
           sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
    FROM s),
c AS (SELECT *, min(CASE WHEN NOT 3 * source_size * share < room * weight THEN nth END) OVER () AS free FROM o),
t AS (
    SELECT source, source_size,
           CASE WHEN nth < coalesce(free, 1 << 60) THEN (3 * source_size)::DOUBLE
                ELSE (max(CASE WHEN nth = free THEN room END) OVER ())::DOUBLE * weight
                     / (max(CASE WHEN nth = free THEN share END) OVER ())::DOUBLE END AS target
    FROM c),
k AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS f,
           ('0x' || substr(md5('20240601:' || coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END), 1, 8))::BIGINT / 4294967296.0 AS u,
           row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS k
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (least(floor(f * k + u) - floor(f * (k - 1) + u), 3) * size)::BIGINT AS taken
FROM k
"""
