"""The two analyst tools, run for whole tables of requests at once.

A request is ``(request_id, tool, args)`` with ``args`` a JSON object
``{"region", "start", "end"}``. Each tool selects the facts of one region over an
inclusive day range and summarises them. Done per request this is a range join of
requests against facts: skewed (a handful of regions) and quadratic. Because ranges are
whole days and every aggregate is a difference of running totals (exact decimals, counts)
or the first or last period, facts are reduced to running totals per region, key and day,
and a request looks up two of them, at its end and before its start: two equi-joins on
(region, day), whose rows do not grow with the length of the range. Ranges that several
requests share are computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltframe.constants import (
    INTERCHANGE_CONVENTION,
    NAME_TO_CODE,
    NOTE_NO_DATA,
    NOTE_NO_DATA_RETURNED,
    REGION_CODES,
    REGION_TYPES,
)
from voltframe.functions.parse import parse_iso_date, timestamp_text
from voltframe.operators.summaries import DEC, series_label, to_double
from voltframe.session import materialize

TOOL_GENERATION = "get_generation"
TOOL_INTERCHANGE = "get_demand_and_interchange"
KNOWN_TOOLS = [TOOL_GENERATION, TOOL_INTERCHANGE]

ARGS_SCHEMA = "region string, start string, end string"


def region_code(raw: Column) -> Column:
    """Upper-case, then map colloquial names to codes; unknown names fall through."""
    up = F.upper(raw)
    names = F.create_map(*[F.lit(x) for kv in NAME_TO_CODE.items() for x in kv])
    return F.coalesce(F.try_element_at(names, up), up)


def parse_requests(requests: DataFrame) -> DataFrame:
    """Decode ``args`` and normalise them: ``region_raw, region, start, end``.

    ``start``/``end`` are NULL when not strict ``YYYY-MM-DD``; such requests select
    nothing (the source raises instead; a table job must not fail on one row).
    """
    # The decoded fields come out of a one-element generator: filters on them (valid
    # range, known region) then stay above it instead of being pushed down with the JSON
    # decode inlined once per column reference. One decode per request, NULLs for bad JSON.
    a = F.from_json(F.col("args"), ARGS_SCHEMA)
    decoded = requests.select("request_id", "tool", F.inline_outer(F.array(a)))
    return decoded.select(
        "request_id",
        "tool",
        F.col("region").alias("region_raw"),
        region_code(F.col("region")).alias("region"),
        parse_iso_date(F.col("start")).alias("start"),
        parse_iso_date(F.col("end")).alias("end"),
    )


def valid_region(region: Column) -> Column:
    """Region check of the command-line path (the tools themselves do not check)."""
    return region.isin(*REGION_CODES)


def valid_range(start: Column, end: Column) -> Column:
    """Both dates present and ``end >= start``."""
    return start.isNotNull() & end.isNotNull() & (end >= start)


def daily_rollup(facts: DataFrame, key: str) -> DataFrame:
    """``(respondent, day, key)`` -> decimal sum, row count, first and last period."""
    return facts.groupBy("respondent", F.to_date("period").alias("day"), key).agg(
        F.sum(F.col("value").try_cast(DEC)).alias("sum_dec"),
        F.count(F.lit(1)).alias("n"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
    )


def prefix_sums(facts: DataFrame, key: str) -> DataFrame:
    """Running totals of ``(region, key)`` up to and including each of its days with facts:
    ``region, key, day, until_dec, until_n, first_period, last_period`` (the periods are the day's).

    One row per region, key and day, whatever the facts hold.
    """
    w = Window.partitionBy("respondent", key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily_rollup(facts, key).select(
        F.col("respondent").alias("region"), key, "day",
        F.sum(F.coalesce("sum_dec", F.lit(0).cast(DEC))).over(w).alias("until_dec"), F.sum("n").over(w).alias("until_n"),
        "first_period", "last_period",
    )


def range_totals(ranges: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Totals of every distinct ``(region, start, end)`` by ``key``: ``total_dec, n, first_period, last_period``,
    a row for each key that has facts in the range.

    A total over a range is the difference of two running totals: up to ``end``, and up to the day before
    ``start``. What holds on the days asked for, most of which have no facts of their own, is found once for
    each day that any range asks about: these days and the days with facts, a row each, are one small sorted
    sequence per region and key, in which the last running total before a day and the first period after it are
    carried along. Ranges then meet it in two equi-joins on (region, day). The rows after the joins are
    ranges times keys, however long the ranges are.
    """
    sums = prefix_sums(facts, key)
    span = sums.groupBy("region").agg(F.min("day").alias("__first"), F.max("day").alias("__last"))
    # Clipped to the days with facts: the days asked about are then no more than the calendar of the facts.
    clipped = ranges.join(span, "region").select(
        "region", "start", "end", F.date_sub(F.greatest("start", "__first"), 1).alias("before"), F.least("end", "__last").alias("until"),
    ).where(F.col("before") < F.col("until"))
    asked = (
        clipped.select("region", F.col("until").alias("day")).unionByName(clipped.select("region", F.col("before").alias("day"))).distinct()
        .join(sums.select("region", key).distinct(), "region").withColumn("asked", F.lit(True))
    )
    # Facts of a day come before the question about it; read backwards, after it.
    upto = Window.partitionBy("region", key).orderBy("day", F.col("asked").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("region", key).orderBy(F.col("day").desc(), F.col("asked").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = sums.unionByName(asked, allowMissingColumns=True).select(
        "region", key, "day", "asked", F.last("until_dec", True).over(upto).alias("dec"), F.last("until_n", True).over(upto).alias("n"),
        F.last("last_period", True).over(upto).alias("last"), F.last("first_period", True).over(after).alias("next"),
    ).where("asked")
    ends = at.select("region", key, F.col("day").alias("until"), F.col("dec").alias("end_dec"), F.col("n").alias("end_n"), F.col("last").alias("last_period"))
    starts = at.select(F.col("region").alias("__r"), F.col(key).alias("__k"), F.col("day").alias("__d"), F.col("dec").alias("start_dec"), F.col("n").alias("start_n"), F.col("next").alias("first_period"))
    both = clipped.join(ends, ["region", "until"])
    met = both.join(starts, (both["region"] == F.col("__r")) & (F.col("before") == F.col("__d")) & F.col(key).eqNullSafe(F.col("__k")))
    n = F.coalesce("end_n", F.lit(0)) - F.coalesce("start_n", F.lit(0))
    return met.select(
        "region", "start", "end", key, (F.col("end_dec") - F.coalesce("start_dec", F.lit(0))).cast("decimal(38,9)").alias("total_dec"), n.alias("n"),
        "first_period", "last_period",
    ).where(F.col("n") > 0)


RANGE = ["region", "start", "end"]


def valid_ranges(parsed: DataFrame) -> DataFrame:
    """The distinct valid ranges asked for; each is computed once, however many requests share it."""
    return parsed.where(F.col("region").isNotNull() & valid_range(F.col("start"), F.col("end"))).select(*RANGE).distinct()


def generation_ranges(ranges: DataFrame, generation: DataFrame) -> DataFrame:
    """Generation of every range by fuel: ``rows, period_start, period_end, type_name, fuel_rank, mwh``."""
    per = range_totals(ranges, generation, "type_name")
    whole = Window.partitionBy(*RANGE)
    return per.select(
        *RANGE, F.sum("n").over(whole).cast("long").alias("rows"),
        timestamp_text(F.min("first_period").over(whole)).alias("period_start"), timestamp_text(F.max("last_period").over(whole)).alias("period_end"),
        "type_name", F.row_number().over(whole.orderBy(F.col("total_dec").desc(), F.col("type_name"))).alias("fuel_rank"),
        to_double("total_dec", 1).alias("mwh"),
    )


def interchange_ranges(ranges: DataFrame, region_facts: DataFrame) -> DataFrame:
    """Demand, net generation and interchange of every range: ``rows, type, series, total_mwh``."""
    per = range_totals(ranges, region_facts.where(F.col("type").isin(*REGION_TYPES)), "type")
    return per.select(
        *RANGE, F.sum("n").over(Window.partitionBy(*RANGE)).cast("long").alias("rows"), "type",
        series_label("type").alias("series"), to_double("total_dec", 1).alias("total_mwh"),
    )


def tool_generation(parsed: DataFrame, generation: DataFrame, bounds: bool = True) -> DataFrame:
    """Generation tool for every request that has data.

    Long rows ``request_id, region, rows, [period_start, period_end], type_name,
    fuel_rank, mwh`` with ``mwh`` rounded to 1 decimal and ranks largest-first.
    ``bounds=False`` is the agent variant without the period bounds. Rows that repeat a
    request id are requests each.
    """
    return _generation_rows(parsed, generation_ranges(valid_ranges(parsed), generation), bounds)


def _generation_rows(parsed: DataFrame, found: DataFrame, bounds: bool) -> DataFrame:
    period = ["period_start", "period_end"] if bounds else []
    return parsed.join(found, RANGE).select("request_id", "region", "rows", *period, "type_name", "fuel_rank", "mwh")


def tool_interchange(parsed: DataFrame, region_facts: DataFrame) -> DataFrame:
    """Demand / net generation / interchange tool: ``request_id, region, rows, type,
    series, total_mwh`` (1 decimal). Only D, NG and TI are selected (the type facet);
    a type without rows is absent."""
    return _interchange_rows(parsed, interchange_ranges(valid_ranges(parsed), region_facts))


def _interchange_rows(parsed: DataFrame, found: DataFrame) -> DataFrame:
    return parsed.join(found, RANGE).select("request_id", "region", "rows", "type", "series", "total_mwh")


def _no_data(parsed: DataFrame, tool: str, found: DataFrame, note: str) -> DataFrame:
    """Requests to ``tool`` whose range is not among ``found``."""
    return parsed.where(F.col("tool") == tool).join(found.select(*RANGE).distinct(), RANGE, "left_anti").select(
        "request_id", "tool", "region", F.lit(0).cast("long").alias("rows"), F.lit(note).alias("note"))


def tool_no_data(parsed: DataFrame, generation: DataFrame, region_facts: DataFrame,
                 note: str = NOTE_NO_DATA) -> DataFrame:
    """Known-tool requests whose selection is empty: ``request_id, tool, region, rows=0, note``.

    Found with a left-anti join of requests against the ranges that have totals. ``note``
    is the agent's text by default; the single-turn tool's text is ``NOTE_NO_DATA_RETURNED``.
    """
    one = range_totals(valid_ranges(parsed.where(F.col("tool") == TOOL_GENERATION)), generation.withColumn("__all", F.lit(0)), "__all")
    facet = region_facts.where(F.col("type").isin(*REGION_TYPES)).withColumn("__all", F.lit(0))
    two = range_totals(valid_ranges(parsed.where(F.col("tool") == TOOL_INTERCHANGE)), facet, "__all")
    return _no_data(parsed, TOOL_GENERATION, one, note).unionByName(_no_data(parsed, TOOL_INTERCHANGE, two, note))


def tool_unknown(parsed_or_raw: DataFrame) -> DataFrame:
    """Requests naming a tool that does not exist: ``request_id, tool, error``.

    A request without a tool name gets a message as well (it names ``None``).
    """
    return parsed_or_raw.where(~F.coalesce(F.col("tool").isin(*KNOWN_TOOLS), F.lit(False))).select(
        "request_id", "tool", F.concat(F.lit("unknown tool "), F.coalesce("tool", F.lit("None"))).alias("error")
    )


def dispatch_requests(requests: DataFrame, generation: DataFrame, region_facts: DataFrame) -> dict[str, DataFrame]:
    """Split a request table by tool name and run each tool on its share.

    Returns the per-tool result tables plus ``unknown`` and ``no_data``.
    """
    parsed = parse_requests(requests)
    return {
        TOOL_GENERATION: tool_generation(parsed.where(F.col("tool") == TOOL_GENERATION), generation, bounds=False),
        TOOL_INTERCHANGE: tool_interchange(parsed.where(F.col("tool") == TOOL_INTERCHANGE), region_facts),
        "unknown": tool_unknown(parsed),
        "no_data": tool_no_data(parsed, generation, region_facts),
    }


def tool_results_json(gen_rows: DataFrame, bounds: bool = True) -> DataFrame:
    """Encode generation-tool rows as the tool's JSON result, one string per request.

    The fuel map keeps the largest-first order (map entries are emitted in rank order).
    """
    entries = F.array_sort(F.collect_list(F.struct("fuel_rank", "type_name", "mwh")))
    fuel_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["type_name"], e["mwh"])))
    group = ["request_id", "region", "rows"] + (["period_start", "period_end"] if bounds else [])
    fields = [F.col("region"), *([F.col("period_start"), F.col("period_end")] if bounds else []),
              F.col("rows"), F.col("generation_mwh_by_fuel")]
    return gen_rows.groupBy(*group).agg(fuel_map.alias("generation_mwh_by_fuel")).select(
        "request_id", F.to_json(F.struct(*fields)).alias("result")
    )


def interchange_results_json(rows: DataFrame) -> DataFrame:
    """Encode interchange-tool rows as the tool's JSON result, one string per request."""
    totals = F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "total_mwh"))))
    return rows.groupBy("request_id", "region", "rows").agg(totals.alias("totals")).select(
        "request_id",
        F.to_json(F.struct("region", "rows", "totals", F.lit(INTERCHANGE_CONVENTION).alias("convention")))
        .alias("result"),
    )


def dispatch_results(requests: DataFrame, generation: DataFrame, region_facts: DataFrame,
                     bounds: bool = False, note: str = NOTE_NO_DATA) -> DataFrame:
    """Every request with its tool's answer as JSON: ``request_id, tool, result``.

    The answer is the tool's result, ``{"region", "rows": 0, "note"}`` if the selection is
    empty, or ``{"error"}`` for a tool that does not exist. ``bounds`` and ``note`` choose
    between the agent's and the single-turn tool's form.
    """
    parsed = parse_requests(requests)
    one = parsed.where(F.col("tool") == TOOL_GENERATION)
    two = parsed.where(F.col("tool") == TOOL_INTERCHANGE)
    # Read twice: for the answers, and for the requests that have none.
    made = materialize(generation_ranges(valid_ranges(one), generation), "generation-ranges")
    flows = materialize(interchange_ranges(valid_ranges(two), region_facts), "interchange-ranges")
    name = lambda df, tool: df.select("request_id", F.lit(tool).alias("tool"), "result")
    empty = _no_data(parsed, TOOL_GENERATION, made, note).unionByName(_no_data(parsed, TOOL_INTERCHANGE, flows, note)).select(
        "request_id", "tool", F.to_json(F.struct("region", "rows", "note")).alias("result"))
    unknown = tool_unknown(parsed).select("request_id", "tool", F.to_json(F.struct("error")).alias("result"))
    # A JSON answer per range, then the requests that ask for it.
    as_request = F.struct(*RANGE).alias("request_id")
    gen = tool_results_json(made.withColumn("request_id", as_request), bounds).select("request_id.*", "result")
    inter = interchange_results_json(flows.withColumn("request_id", as_request)).select("request_id.*", "result")
    return (
        name(one.join(gen, RANGE), TOOL_GENERATION).unionByName(name(two.join(inter, RANGE), TOOL_INTERCHANGE))
        .unionByName(empty).unionByName(unknown)
    )


__all__ = [
    "KNOWN_TOOLS", "NOTE_NO_DATA", "NOTE_NO_DATA_RETURNED", "TOOL_GENERATION", "TOOL_INTERCHANGE",
    "dispatch_requests", "dispatch_results", "interchange_results_json", "parse_requests", "prefix_sums", "range_totals", "region_code",
    "tool_generation", "tool_interchange", "tool_no_data", "tool_results_json", "tool_unknown",
    "valid_range", "valid_ranges", "valid_region",
]
