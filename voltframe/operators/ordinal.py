"""Per-group row numbering that never puts one whole group into one task.

A plain ``row_number() over (partition by g order by k)`` sorts each group ``g`` inside a
single task; one hot group holding a third of the rows then serialises a third of the
job. Here the order key is cut into buckets first:

1. count rows per ``(g, bucket)`` (partial aggregation, tiny output);
2. running sum of those counts per ``g`` over buckets (a window over the count table,
   whose size is rows / bucket width, not rows);
3. ``row_number`` inside each ``(g, bucket)`` plus the bucket's offset.

Step 3 partitions by ``(g, bucket)``, so a hot ``g`` is spread over many tasks. The
join of step 3 is an equi-join against the count table: adaptive execution broadcasts
it when it is small and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_number_in_group(
    df: DataFrame,
    group_cols: Sequence[str],
    bucket: Column,
    order_cols: Sequence[str | Column],
    out_col: str,
) -> DataFrame:
    """Add ``out_col`` = 1-based position of the row within its group.

    ``bucket`` must be monotone in the order: every row of a lower bucket sorts before
    every row of a higher bucket (e.g. ``floor(id / 4096)`` for order ``id``). Ties in
    ``order_cols`` are broken arbitrarily, as with ``row_number``.
    """
    return numbered_with_group_sizes(df, group_cols, bucket, order_cols, out_col)[0]


def numbered_with_group_sizes(
    df: DataFrame,
    group_cols: Sequence[str],
    bucket: Column,
    order_cols: Sequence[str | Column],
    out_col: str,
    size_col: str = "group_size",
) -> tuple[DataFrame, DataFrame]:
    """:func:`row_number_in_group` plus ``(group_cols, size_col)``: rows per group, summed
    from the per-bucket counts the numbering needs anyway (no second pass over ``df``)."""
    b, n, off = "__vf_bucket", "__vf_n", "__vf_off"
    keyed = df.withColumn(b, bucket)
    counts = keyed.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, b, F.coalesce(F.sum(n).over(running), F.lit(0)).alias(off))
    inner = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
    numbered = (
        keyed.join(offsets, [*group_cols, b])
        .withColumn(out_col, (F.col(off) + F.row_number().over(inner)).cast("long"))
        .drop(b, off)
    )
    sizes = counts.groupBy(*group_cols).agg(F.sum(n).alias(size_col))
    return numbered, sizes
