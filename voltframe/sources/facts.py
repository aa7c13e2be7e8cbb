"""Fact tables: range selection (the API's request predicates) and the Parquet sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.constants import GENERATION_COLUMNS, REGION_COLUMNS, REGION_TYPES
from voltframe.schema import GENERATION, REGION


def select_range(
    facts: DataFrame,
    region: str,
    start: dt.date | str,
    end: dt.date | str,
    types: list[str] | None = None,
    sort: bool = True,
) -> DataFrame:
    """Facts of one respondent from ``start`` 00:00 to the end of day ``end``.

    The predicates are plain column comparisons, so on Parquet they are pushed into the
    scan (and prune ``respondent``/``day`` partitions of :func:`write_facts` output).
    ``types`` is the region-data type facet. The sort is the frame order of the source
    (period, then fuel or type); it is a global sort, so leave it off for large outputs.
    """
    lo = F.lit(str(start)).cast("date").cast("timestamp_ntz")
    hi = F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz")
    out = facts.where((F.col("respondent") == region) & (F.col("period") >= lo) & (F.col("period") < hi))
    kind = "type" if "type" in facts.columns else "fueltype"
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    cols = REGION_COLUMNS if kind == "type" else GENERATION_COLUMNS
    out = out.select(*cols)
    return out.orderBy("period", kind) if sort else out


def region_facet(region_facts: DataFrame, types: list[str] = REGION_TYPES) -> DataFrame:
    """The region-data type facet (D, NG, TI by default)."""
    return region_facts.where(F.col("type").isin(*types)).select(*REGION_COLUMNS)


def write_facts(facts: DataFrame, path: str, partition_overwrite: bool = True) -> bool:
    """Write facts as Parquet partitioned by ``respondent`` and ``day``.

    Returns False and writes nothing when the frame is empty (checked with a one-row
    probe, not a count). Rows are clustered by (respondent, day) with a ``rebalance`` hint,
    so each task writes few files while adaptive execution splits a hot (respondent, day)
    across several tasks; inside a file rows are sorted by period. With dynamic partition
    overwrite only the partitions present in ``facts`` are replaced.
    """
    if facts.isEmpty():
        return False
    kind = "type" if "type" in facts.columns else "fueltype"
    (
        facts.withColumn("day", F.to_date("period"))
        .hint("rebalance", "respondent", "day")
        .sortWithinPartitions("period", kind)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if partition_overwrite else "static")
        .partitionBy("respondent", "day")
        .parquet(path)
    )
    return True


def read_facts(spark: SparkSession, path: str, kind: str = "generation") -> DataFrame:
    """Read facts written by :func:`write_facts` with the declared schema (partition values
    are read as declared too, never inferred)."""
    schema = GENERATION if kind == "generation" else REGION
    declared = T.StructType([*schema.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(declared).parquet(path).select(*[f.name for f in schema.fields])
