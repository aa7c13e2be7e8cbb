"""Landed API pages: write them, read them, unwrap and validate their records.

A page is one JSON document ``{"response": {"total": "N", "data": [record, ...]}}`` of at
most ``PAGE_LIMIT`` records. Pages are read as text (one page per file, or one per
line), parsed with a declared schema (numbers and totals read as text so quoted and
unquoted numbers both work) and exploded into records. Record validation never raises
by default: every record gets a ``reject_reason`` (NULL when good), and callers take the
good side, the reject side, or ask for strict mode which fails the job on the first bad
record like the source application's page validation. The same holds for pages: one whose
envelope cannot be read (not JSON, no ``response``, ``total`` not an integer or beyond
``MAX_TOTAL``, ``data`` not a list) is a reject with its body, or an error in strict mode; no
page vanishes. Bodies are decoded as VARIANT, whose list keeps every element whatever its
type: an element that is no object is a reject of its own, and the records beside it count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.constants import GENERATION_COLUMNS, PAGE_LIMIT, REGION_COLUMNS
from voltframe.functions.parse import number_is_bad, number_is_out_of_range, parse_number, parse_period, period_is_wellformed
from voltframe.operators.ordinal import numbered_with_group_sizes
from voltframe.schema import RAW_GENERATION_RECORD, RAW_REGION_RECORD, envelope


INTEGER = r"^\s*[+-]?\d+\s*$"
MAX_TOTAL = 1_000_000_000  # records of one request; a page that states more is a reject
PAGE_BLOCK = 4096  # expected pages listed from one row


# ----------------------------------------------------------------------------- landing
def land_pages(
    records: DataFrame,
    key_col: str,
    bucket: Column,
    order_cols: list[str],
    record_col: str = "record",
    page_limit: int = PAGE_LIMIT,
) -> DataFrame:
    """Cut records into pages of ``page_limit`` per ``key_col`` (one request), in order.

    Returns ``key_col, page_offset, total, body`` where ``body`` is the page JSON. The
    per-key ordinal is the skew-safe one; a page holds at most ``page_limit`` records, so
    no group is unbounded.
    """
    numbered, totals = numbered_with_group_sizes(records, [key_col], bucket, order_cols, "__rn", "total")
    page = F.floor((F.col("__rn") - 1) / page_limit).cast("long")
    pages = numbered.groupBy(key_col, page.alias("__page")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("__rn"), F.col(record_col).alias("r")))).alias("__recs")
    )
    return pages.join(totals, key_col).select(
        key_col,
        (F.col("__page") * page_limit).alias("page_offset"),
        F.col("total"),
        F.to_json(
            F.struct(
                F.struct(
                    F.col("total").cast("string").alias("total"),
                    F.transform("__recs", lambda x: x["r"]).alias("data"),
                ).alias("response")
            )
        ).alias("body"),
    )


def write_landed_pages(pages: DataFrame, path: str, one_page_per_file: bool = False) -> None:
    """Write pages as JSON lines (one page per line), or each page as a file of its own (its
    body may then span lines), replacing ``path``."""
    writer = pages.select("body").write.mode("overwrite")
    if one_page_per_file:
        writer = writer.option("maxRecordsPerFile", 1)
    writer.text(path)


def read_landed_pages(spark: SparkSession, path: str, one_page_per_file: bool = False) -> DataFrame:
    """Read landed pages as ``source_file, body``.

    ``one_page_per_file`` reads each file whole (API responses saved as-is); otherwise
    every line is one page.
    """
    return spark.read.text(path, wholetext=one_page_per_file).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))


# ----------------------------------------------------------------------------- parsing
def _page_reason(page: Column, total: Column, data: Column) -> Column:
    """Why a page's envelope is unusable; NULL for a good page."""
    response = F.schema_of_variant(F.try_variant_get(page, "$.response", "variant"))
    number = total.try_cast("long")
    return (
        F.when(page.isNull(), F.lit("page: not JSON"))
        .when(~F.coalesce(response.startswith("OBJECT"), F.lit(False)), F.lit("page: response missing"))
        .when(~F.coalesce(total.rlike(INTEGER), F.lit(False)), F.lit("page: total not an integer"))
        .when(number.isNull() | (F.abs(number) > MAX_TOTAL), F.lit("page: total out of range"))
        .when(data.isNull(), F.lit("page: data not a list of records"))
    )


def read_envelopes(pages: DataFrame, record_schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """One row per page: ``keep, body, total, data, page_reason`` (NULL for a good page); ``data`` is the
    list of the page's elements as VARIANT.

    Decoded once: the columns come out of a one-element generator, so that filters on them
    stay above it.
    """
    parsed = pages.select(*(keep or []), "body", F.inline_outer(F.array(F.struct(F.try_parse_json("body").alias("__page")))))
    page = F.col("__page")
    total, data = F.try_variant_get(page, "$.response.total", "string"), F.try_variant_get(page, "$.response.data", "array<variant>")
    return parsed.select(
        *(keep or []), "body",
        F.inline_outer(F.array(F.struct(
            total.try_cast("long").alias("total"), data.alias("data"), _page_reason(page, total, data).alias("page_reason"),
        ))),
    )


def _record(element: Column, record_schema: T.StructType) -> Column:
    """An element as a raw record, every scalar as text; NULL if it is no object."""
    fields = [F.try_variant_get(element, f"$['{f.name}']", "string").alias(f.name) for f in record_schema.fields]
    return F.when(F.schema_of_variant(element).startswith("OBJECT"), F.struct(*fields))


def reject_pages(pages: DataFrame, record_schema: T.StructType = RAW_GENERATION_RECORD, keep: list[str] | None = None) -> DataFrame:
    """Pages whose envelope is unusable: ``keep, body, reject_reason``."""
    bad = read_envelopes(pages, record_schema, keep).where(F.col("page_reason").isNotNull())
    return bad.select(*(keep or []), "body", F.col("page_reason").alias("reject_reason"))


def explode_envelope(pages: DataFrame, record_schema: T.StructType, keep: list[str] | None = None, strict: bool = False) -> DataFrame:
    """One row per element of the readable pages: ``keep, total, record_pos, rec, element``; ``rec`` is NULL
    for an element that is no object.

    Unreadable pages are in :func:`reject_pages`; with ``strict`` they fail the job.
    """
    keep = keep or []
    env = read_envelopes(pages, record_schema, keep)
    data = F.col("data")
    if strict:
        fail = F.raise_error(F.concat(F.lit("invalid "), F.col("page_reason"))).cast(env.schema["data"].dataType)
        data = F.when(F.col("page_reason").isNotNull(), fail).otherwise(data)
    else:
        data = F.when(F.col("page_reason").isNull(), data)
    exploded = env.select(*keep, "total", F.posexplode_outer(data).alias("record_pos", "element"))
    exploded = exploded.where(F.col("record_pos").isNotNull())  # a page without records
    # The fields are taken out of the element once, whatever reads them later.
    return exploded.select(*keep, "total", "record_pos", F.inline_outer(F.array(F.struct(
        _record(F.col("element"), record_schema).alias("rec"), F.to_json("element").alias("element")))))


def _either(a: str, b: str) -> Column:
    return F.coalesce(F.col(f"rec.`{a}`"), F.col(f"rec.`{b}`"))


def _reason(kind_col: str) -> Column:
    period = F.col("rec.period")
    checks = [
        (F.col("rec").isNull(), "record: not an object"),
        (period.isNull(), "period: missing"),
        (~period_is_wellformed(period) | parse_period(period).isNull(), "period: invalid"),
        (F.col("rec.respondent").isNull(), "respondent: missing"),
        (_either("respondent-name", "respondent_name").isNull(), "respondent_name: missing"),
        (F.col(f"rec.{kind_col}").isNull(), f"{kind_col}: missing"),
        (_either("type-name", "type_name").isNull(), "type_name: missing"),
        (number_is_bad(F.col("rec.value")), "value: not a finite number"),
        (number_is_out_of_range(F.col("rec.value")), "value: out of range"),
    ]
    expr = None
    for cond, text in reversed(checks):
        expr = F.when(cond, F.lit(text)) if expr is None else F.when(cond, F.lit(text)).otherwise(expr)
    return expr


def _typed(kind_col: str, columns: list[str]) -> list[Column]:
    out = {
        "period": parse_period(F.col("rec.period")).alias("period"),
        "respondent": F.col("rec.respondent").alias("respondent"),
        "respondent_name": _either("respondent-name", "respondent_name").alias("respondent_name"),
        kind_col: F.col(f"rec.{kind_col}").alias(kind_col),
        "type_name": _either("type-name", "type_name").alias("type_name"),
        "value_units": _either("value-units", "value_units").alias("value_units"),
        "value": parse_number(F.col("rec.value")).alias("value"),
    }
    return [out[c] for c in columns]


def validate_records(exploded: DataFrame, kind: str = "generation", keep: list[str] | None = None) -> DataFrame:
    """Typed columns plus ``reject_reason`` (NULL for a good record)."""
    kind_col, columns = ("fueltype", GENERATION_COLUMNS) if kind == "generation" else ("type", REGION_COLUMNS)
    # Typed columns and reason are built in one projection and come out of a one-element
    # generator: a filter on ``reject_reason`` then stays above it, instead of being pushed
    # down with every parse check inlined and the parses run a second time.
    checked = F.struct(*_typed(kind_col, columns), _reason(kind_col).alias("reject_reason"), F.col("rec").alias("raw"), F.col("element").alias("raw_text"))
    return exploded.select(*(keep or []), F.inline_outer(F.array(checked)))


def parse_pages(pages: DataFrame, kind: str = "generation", mode: str = "quarantine",
                keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Landed pages -> (good typed facts, rejects).

    ``mode="strict"`` makes the good side fail the job at the first bad record or page.
    Rejects keep the raw record (of an unreadable page: its body) plus the reason.
    """
    schema = RAW_GENERATION_RECORD if kind == "generation" else RAW_REGION_RECORD
    columns = GENERATION_COLUMNS if kind == "generation" else REGION_COLUMNS
    checked = validate_records(explode_envelope(pages, schema, keep, mode == "strict"), kind, keep)
    good = checked.where(F.col("reject_reason").isNull()).select(*(keep or []), *columns)
    if mode == "strict":
        # The guard sits inside a kept column so column pruning cannot drop it.
        fail = F.raise_error(F.concat(F.lit("invalid record: "), F.col("reject_reason")))
        good = checked.select(
            *(keep or []),
            *[
                (F.when(F.col("reject_reason").isNotNull(), fail.cast(checked.schema[c].dataType))
                 .otherwise(F.col(c)).alias(c) if c == "period" else F.col(c))
                for c in columns
            ],
        )
    rejects = checked.where(F.col("reject_reason").isNotNull()).select(
        *(keep or []), F.col("raw_text").alias("raw_record"), "reject_reason"
    )
    return good, rejects.unionByName(reject_pages(pages, schema, keep).withColumnRenamed("body", "raw_record"))


def page_manifest(pages: DataFrame, key_col: str, page_limit: int = PAGE_LIMIT, requests: DataFrame | None = None) -> DataFrame:
    """Expected page offsets per request (``0`` plus ``range(limit, total, limit)``) against
    the pages actually landed: ``key, page_offset, expected_rows, landed, landed_rows``.

    ``total`` is read from the landed pages' envelopes and records are counted without
    decoding them. ``requests`` lists the keys that were asked for: one of which no page
    landed is expected to have its first page, of unknown size (``expected_rows`` NULL).
    """
    landed = pages.select(
        key_col,
        "page_offset",
        F.get_json_object("body", "$.response.total").try_cast("long").alias("total"),
        F.json_array_length(F.get_json_object("body", "$.response.data")).cast("long").alias("landed_rows"),
    )
    stated = F.when(F.col("total").between(0, MAX_TOTAL), F.col("total"))  # any other is a page reject
    totals = landed.groupBy(key_col).agg(F.max(stated).alias("total"))
    if requests is not None:
        totals = requests.select(key_col).distinct().join(totals, key_col, "left")
    n_pages = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("total", F.lit(0)) / page_limit))
    blocks = totals.select(key_col, "total", n_pages.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_pages - 1) / PAGE_BLOCK))).alias("__b"))
    page = F.explode(F.sequence(F.col("__b") * PAGE_BLOCK, F.least(F.col("__n"), (F.col("__b") + 1) * PAGE_BLOCK) - 1))
    # Dealt out by block, so that one long request does not list all its pages in one task.
    expected = blocks.repartition(key_col, "__b").select(key_col, "total", page.alias("__p")).select(
        key_col,
        (F.col("__p") * page_limit).cast("long").alias("page_offset"),
        F.when(F.col("total").isNotNull(), F.least(F.lit(page_limit), F.col("total") - F.col("__p") * page_limit)).cast("long").alias("expected_rows"),
    )
    seen = landed.select(key_col, "page_offset", "landed_rows", F.lit(True).alias("landed"))
    return expected.join(seen, [key_col, "page_offset"], "left").select(
        key_col, "page_offset", "expected_rows", F.coalesce("landed", F.lit(False)).alias("landed"), "landed_rows")
