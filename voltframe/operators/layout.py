"""Partition-layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work over a small scan at least one partition per core.

    A small input file is a single scan split, so regex-heavy text work would run in one
    task. Where the planner's size estimate (file sizes; nothing is executed to get it)
    is below one full scan split per core, the rows are dealt out round-robin
    (deterministic on retry, and immune to hot keys); larger inputs have enough splits
    and pass through without a shuffle.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(target) if int(str(estimate)) < target * split else df
