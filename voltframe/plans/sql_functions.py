"""The two tools as SQL table functions (callable from Spark SQL, also with LATERAL).

``get_generation(region, start, end)`` and ``get_demand_and_interchange(region, start,
end)`` read the fact views given at registration. They suit ad-hoc SQL and a handful of
requests, as each call filters the facts. For whole request tables there is a function with
a table argument, ``generation_of_ranges`` (:func:`register_range_function`), and
:mod:`voltframe.operators.tools`.

Both aggregate first and run their windows per region over the few rows that are left; no
window is without a partition. The net position follows the total as reported (one
decimal), like :func:`voltframe.operators.summaries.position`.
"""

from __future__ import annotations

from bisect import bisect_right
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.constants import (
    NAME_TO_CODE,
    POSITION_BALANCED,
    POSITION_EXPORTER,
    POSITION_IMPORTER,
    REGION_TYPES,
    SERIES_LABELS,
    VALUE_DECIMAL,
)
from voltframe.operators.tools import TOOL_GENERATION, TOOL_INTERCHANGE, prefix_sums, valid_ranges


def _map_sql(d: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for kv in d.items() for k, v in [kv]) + ")"


def _code(arg: str) -> str:
    return f"coalesce(try_element_at({_map_sql(NAME_TO_CODE)}, upper({arg})), upper({arg}))"


def _range(fn: str) -> str:
    return (f"period >= CAST(try_to_date({fn}.start_date, 'yyyy-MM-dd') AS TIMESTAMP_NTZ) "
            f"AND period < CAST(date_add(try_to_date({fn}.end_date, 'yyyy-MM-dd'), 1) AS TIMESTAMP_NTZ)")


def register_tool_functions(spark: SparkSession, generation: DataFrame, region_facts: DataFrame) -> list[str]:
    """Register both tools over the given fact tables; returns the function names."""
    generation.createOrReplaceTempView("__vf_generation_facts")
    region_facts.createOrReplaceTempView("__vf_region_facts")
    g = TOOL_GENERATION
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {g}(region STRING, start_date STRING, end_date STRING)
RETURNS TABLE (region STRING, rows BIGINT, period_start STRING, period_end STRING, type_name STRING,
               fuel_rank INT, mwh DOUBLE)
RETURN
  WITH sel AS (SELECT * FROM __vf_generation_facts
               WHERE respondent = {_code(f'{g}.region')} AND {_range(g)}),
  per AS (SELECT respondent, type_name, coalesce(sum(try_cast(value AS {VALUE_DECIMAL})), 0) AS total, count(*) AS n,
                 min(period) AS lo, max(period) AS hi FROM sel GROUP BY respondent, type_name)
  SELECT {_code(f'{g}.region')} AS region, sum(n) OVER (PARTITION BY respondent) AS rows,
         date_format(min(lo) OVER (PARTITION BY respondent), 'yyyy-MM-dd HH:mm:ss') AS period_start,
         date_format(max(hi) OVER (PARTITION BY respondent), 'yyyy-MM-dd HH:mm:ss') AS period_end,
         type_name, CAST(row_number() OVER (PARTITION BY respondent ORDER BY total DESC, type_name) AS INT) AS fuel_rank,
         CAST(round(total, 1) AS DOUBLE) AS mwh
  FROM per
""")
    i = TOOL_INTERCHANGE
    types = ", ".join(f"'{t}'" for t in REGION_TYPES)
    spark.sql(f"""
CREATE OR REPLACE TEMPORARY FUNCTION {i}(region STRING, start_date STRING, end_date STRING)
RETURNS TABLE (region STRING, rows BIGINT, type STRING, series STRING, total_mwh DOUBLE, position STRING)
RETURN
  WITH sel AS (SELECT * FROM __vf_region_facts
               WHERE respondent = {_code(f'{i}.region')} AND type IN ({types}) AND {_range(i)}),
  per AS (SELECT respondent, type, CAST(round(coalesce(sum(try_cast(value AS {VALUE_DECIMAL})), 0), 1) AS DOUBLE) AS total,
                 count(*) AS n
          FROM sel GROUP BY respondent, type),
  pos AS (SELECT *, max(CASE WHEN type = 'TI' THEN total END) OVER (PARTITION BY respondent) AS ti,
                 sum(n) OVER (PARTITION BY respondent) AS rows FROM per)
  SELECT {_code(f'{i}.region')} AS region, rows, type,
         coalesce(try_element_at({_map_sql(SERIES_LABELS)}, type), type) AS series,
         total AS total_mwh,
         CASE WHEN ti > 0 THEN '{POSITION_EXPORTER}' WHEN ti < 0 THEN '{POSITION_IMPORTER}'
              WHEN ti = 0 THEN '{POSITION_BALANCED}' END AS position
  FROM pos
""")
    return [g, i]


def tool_registry(spark: SparkSession) -> DataFrame:
    """Registered tool names (the dispatch table as a catalog lookup)."""
    names = [TOOL_GENERATION, TOOL_INTERCHANGE]
    rows = [(n, spark.catalog.functionExists(n)) for n in names]
    return spark.createDataFrame(rows, "tool string, registered boolean")


RANGE_EVENTS = "generation_range_events"
RANGE_FUNCTION = "generation_of_ranges"
RANGE_ROWS = "region string, start date, end date, rows long, period_start string, period_end string, type_name string, fuel_rank int, mwh double"


class RangesOfRegion:
    """Answers the ranges of one region from its running totals, which come first.

    Held are the region's days with facts (a running total per key and day, one first and last period per day),
    whatever the facts and requests hold; every range is two binary searches per key."""

    def __init__(self) -> None:
        self.days: dict[str | None, list] = {}  # key -> days, running totals, running counts
        self.seen: list = []
        self.periods: list[list] = []

    def eval(self, row):  # noqa: A003
        if row["is_total"]:
            days, sums, counts = self.days.setdefault(row["type_name"], ([], [], []))
            days.append(row["day"])
            sums.append(row["until_dec"])
            counts.append(row["until_n"])
            if self.seen and self.seen[-1] == row["day"]:
                last = self.periods[-1]
                last[0], last[1] = min(last[0], row["first_period"]), max(last[1], row["last_period"])
            else:
                self.seen.append(row["day"])
                self.periods.append([row["first_period"], row["last_period"]])
            return
        start, end = row["start"], row["end"]
        found = []
        for key, (days, sums, counts) in self.days.items():
            lo, hi = bisect_right(days, row["before"]), bisect_right(days, end)
            if hi > lo:
                below = (sums[lo - 1], counts[lo - 1]) if lo else (Decimal(0), 0)
                found.append((sums[hi - 1] - below[0], key, counts[hi - 1] - below[1]))
        if not found:
            return
        first, last = self.periods[bisect_right(self.seen, row["before"])][0], self.periods[bisect_right(self.seen, end) - 1][1]
        total = sum(n for _, _, n in found)
        found.sort(key=lambda f: (-f[0], f[1] is not None, f[1]))
        for rank, (mwh, key, _) in enumerate(found, 1):
            yield (row["region"], start, end, total, f"{first:%Y-%m-%d %H:%M:%S}", f"{last:%Y-%m-%d %H:%M:%S}", key, rank,
                   float(mwh.quantize(Decimal("0.1"), ROUND_HALF_UP)))


def register_range_function(spark: SparkSession, parsed: DataFrame, generation: DataFrame) -> str:
    """Register the table function over the ranges of ``parsed`` requests, and the view it takes.

    ``SELECT * FROM generation_of_ranges(TABLE(generation_range_events) PARTITION BY region ORDER BY (is_total DESC, day))``
    has a row for each distinct range and fuel (:data:`RANGE_ROWS`). The view is the facts' running totals, from one
    scan of them, and the distinct ranges asked for; requests join the result on (region, start, end).
    """
    totals = prefix_sums(generation, "type_name").withColumn("is_total", F.lit(True))
    ranges = valid_ranges(parsed).withColumns({"before": F.date_sub("start", 1), "is_total": F.lit(False)})
    totals.unionByName(ranges, allowMissingColumns=True).createOrReplaceTempView(RANGE_EVENTS)
    spark.udtf.register(RANGE_FUNCTION, F.udtf(RangesOfRegion, returnType=RANGE_ROWS))
    return RANGE_FUNCTION
