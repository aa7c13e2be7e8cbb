"""Fact summaries: fuel mix, shares, range bounds, interchange totals, net position.

Sums run as decimals and are turned into double once at the end, so totals do not depend
on partition order (double addition is not associative). An all-null group sums to 0, as
the source application's frame library does. Record validation rejects values that the
decimal cannot hold, visibly; in facts from elsewhere such a value counts as missing
instead of failing every sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltframe.constants import (
    POSITION_BALANCED,
    POSITION_EXPORTER,
    POSITION_IMPORTER,
    SERIES_LABELS,
    VALUE_DECIMAL,
)
from voltframe.functions.parse import timestamp_text

DEC = VALUE_DECIMAL


def dec_sum(col: str | Column) -> Column:
    """Order-independent sum; NULL-only groups give 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c.try_cast(DEC)), F.lit(0).cast(DEC))


def to_double(col: str | Column, digits: int | None = None) -> Column:
    """Decimal -> double, optionally rounded (half-up) on the decimal first."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c, digits) if digits is not None else c).cast("double")


def fuel_mix(facts: DataFrame, by: Sequence[str] = ("respondent",), fuel_col: str = "type_name") -> DataFrame:
    """Total MWh per fuel within each ``by`` group, ranked (largest first, name breaks ties).

    Output: ``*by, type_name, mwh_dec (decimal), mwh (double), fuel_rank``.
    """
    by = list(by)
    rank_w = Window.partitionBy(*by).orderBy(F.col("mwh_dec").desc(), F.col(fuel_col).asc())
    return (
        facts.groupBy(*by, fuel_col)
        .agg(dec_sum("value").alias("mwh_dec"))
        .withColumn("mwh", to_double("mwh_dec"))
        .withColumn("fuel_rank", F.row_number().over(rank_w))
    )


def fuel_share(mix: DataFrame, by: Sequence[str] = ("respondent",)) -> DataFrame:
    """Add ``share_pct`` = fuel total / group total * 100 (0 when the total is 0).

    The total is a window partitioned by the group, never an empty ``OVER ()``.
    """
    total = F.sum("mwh_dec").over(Window.partitionBy(*by))
    return mix.withColumn("total_mwh", to_double(total)).withColumn(
        "share_pct",
        F.when(F.col("total_mwh") != 0, F.col("mwh") / F.col("total_mwh") * F.lit(100.0)).otherwise(F.lit(0.0)),
    )


def range_summary(facts: DataFrame, by: Sequence[str] = ("respondent",)) -> DataFrame:
    """Row count and first/last period per group; periods also as ``YYYY-MM-DD HH:MM:SS``."""
    return (
        facts.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("period").alias("first_period"),
            F.max("period").alias("last_period"),
        )
        .withColumn("period_start", timestamp_text("first_period"))
        .withColumn("period_end", timestamp_text("last_period"))
    )


def series_label(type_col: str | Column) -> Column:
    """D/NG/TI -> demand_mwh / net_generation_mwh / total_interchange_mwh; others unchanged."""
    c = F.col(type_col) if isinstance(type_col, str) else type_col
    labels = F.create_map(*[F.lit(x) for kv in SERIES_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, c), c)


def interchange_totals(region_facts: DataFrame, by: Sequence[str] = ("respondent",)) -> DataFrame:
    """Totals per series type (long form): ``*by, type, series, total_mwh`` (1 decimal).

    A type with no rows in a group is simply absent, as in the source.
    """
    return (
        region_facts.groupBy(*by, "type")
        .agg(dec_sum("value").alias("total_dec"))
        .withColumn("series", series_label("type"))
        .withColumn("total_mwh", to_double("total_dec", 1))
    )


def net_position(region_facts: DataFrame, by: Sequence[str] = ("respondent",)) -> DataFrame:
    """Wide totals (NULL when a series is absent) and the net position from TI.

    TI > 0 -> net exporter, TI < 0 -> net importer, TI = 0 -> balanced, no TI -> NULL.
    """

    def total_of(code: str) -> Column:
        v = F.when(F.col("type") == code, F.col("value").try_cast(DEC))
        has = F.max(F.when(F.col("type") == code, F.lit(1)))
        return F.when(has == 1, F.coalesce(F.sum(v), F.lit(0).cast(DEC)))

    wide = region_facts.groupBy(*by).agg(
        to_double(total_of("D"), 1).alias("demand_mwh"),
        to_double(total_of("NG"), 1).alias("net_generation_mwh"),
        to_double(total_of("TI"), 1).alias("total_interchange_mwh"),
    )
    return wide.withColumn("position", position(F.col("total_interchange_mwh")))


def position(ti: Column) -> Column:
    """Net position from total interchange *as reported* (one decimal), so that the sign
    stated always agrees with the number shown."""
    return (
        F.when(ti > 0, F.lit(POSITION_EXPORTER))
        .when(ti < 0, F.lit(POSITION_IMPORTER))
        .when(ti == 0, F.lit(POSITION_BALANCED))
    )


def _padded(c: Column, width: int, pad) -> Column:
    """``c`` padded to ``width``; longer text is kept whole."""
    return F.when(F.length(c) >= width, c).otherwise(pad(c, width, " "))


def summary_lines(facts: DataFrame, by: str = "respondent") -> DataFrame:
    """The printed summary as rows: ``by, line_no, line``.

    Line 1 has the row count, line 2 the period range, and then each fuel, largest first,
    has a line: name padded to 22, total in MWh (14 wide, thousands separated, no
    decimals) and share (4 wide, one decimal). Numbers round half to even.
    """
    shares = fuel_share(fuel_mix(facts, [by]), [by])
    pct = F.regexp_replace(F.format_number("share_pct", 1), ",", "")
    fuel = F.concat(
        F.lit("    "), _padded(F.col("type_name"), 22, F.rpad), F.lit(" "), _padded(F.format_number("mwh", 0), 14, F.lpad),
        F.lit(" MWh  ("), _padded(pct, 4, F.lpad), F.lit("%)"))
    fuels = shares.select(by, (F.col("fuel_rank") + 2).cast("int").alias("line_no"), fuel.alias("line"))
    head = F.posexplode(F.array(
        F.concat(F.col(by), F.lit(": "), F.format_number("rows", 0), F.lit(" rows")),
        F.concat(F.lit("  period:  "), F.col("period_start"), F.lit(" \u2192 "), F.col("period_end"))))
    heads = range_summary(facts, [by]).select(by, head.alias("pos", "line")).select(by, (F.col("pos") + 1).cast("int").alias("line_no"), "line")
    return heads.unionByName(fuels)


def mix_summary(facts: DataFrame, by: str = "respondent") -> DataFrame:
    """One record per group: region, top fuel, its share (1 decimal) and a sentence.

    Ties on the top total go to the alphabetically first fuel (rank 1 of :func:`fuel_mix`).
    """
    shares = fuel_share(fuel_mix(facts, [by]), [by])
    pct = F.round(F.col("share_pct"), 1)
    n_fuels = F.max("fuel_rank").over(Window.partitionBy(by))
    return (
        shares.withColumn("n_fuels", n_fuels)
        .where(F.col("fuel_rank") == 1)
        .select(
            F.col(by).alias("region"),
            F.col("type_name").alias("top_fuel"),
            pct.alias("top_fuel_pct"),
            F.concat(
                F.col(by), F.lit(": "), F.col("type_name"), F.lit(" is the largest of "),
                F.col("n_fuels").cast("string"), F.lit(" fuels at "), pct.cast("string"),
                F.lit("% of net generation."),
            ).alias("summary_text"),
        )
    )
