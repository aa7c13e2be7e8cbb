"""The test tables re-read as this application's relations.

Every mapping is a plain projection (plus, where a per-group ordinal is needed, the
skew-safe numbering of :mod:`voltframe.operators.ordinal`), so each relation grows with
its source table and keeps its partitioning.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.constants import CITATION_ALIASES, PAGE_LIMIT, REFUSAL, REGION_CODES, REGION_NAMES
from voltframe.operators.layout import spread
from voltframe.operators.ordinal import row_number_in_group

# Colloquial / raw region spellings used by the request mapping, indexed by nation % 8.
REQUEST_REGIONS = ["caiso", "ERCOT", "PJM", "nyiso", "ISO-NE", "MISO", "SPP", "XXXX"]
REQUEST_EPOCH = "2024-01-01"
SEGMENT_TOOLS = {
    "BUILDING": "get_generation",
    "MACHINERY": "get_generation",
    "HOUSEHOLD": "get_demand_and_interchange",
    "FURNITURE": "get_demand_and_interchange",
    "AUTOMOBILE": "get_forecast",
}
EVENT_TYPE_SERIES = {"view": "D", "click": "NG", "purchase": "TI"}
SERIES_NAMES = {"D": "Demand", "NG": "Net generation", "TI": "Total interchange"}
TI_OFFSET = 245.0


# Tables whose rows get per-row regex/JSON work; they are spread over all cores.
TEXT_TABLES = {"documents", "conversations", "benchmark", "pages", "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; tables with per-row text work get at least one scan partition per core."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def _lit_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def code_of(n: Column, codes: list[str] = REGION_CODES) -> Column:
    """``codes[n mod len(codes)]``."""
    return F.element_at(F.array(*[F.lit(c) for c in codes]), (n % len(codes) + 1).cast("int"))


def region_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(_lit_map(REGION_NAMES), code), code)


def hour_of(ts: Column) -> Column:
    # date_trunc returns a session-zone timestamp; cast back to timestamp_ntz.
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hour_number(period: Column) -> Column:
    """Hours since 1970-01-01 of a ``timestamp_ntz`` (no session time zone involved)."""
    return F.datediff(F.to_date(period), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(period)


def capitalized(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def generation_from_events(events: DataFrame, keep_id: bool = False) -> DataFrame:
    """Generation facts G from ``events``: hour period, region by user, fuel by event type."""
    resp = code_of(F.col("user_id"))
    cols = [
        hour_of(F.col("ts")).alias("period"),
        resp.alias("respondent"),
        region_name(resp).alias("respondent_name"),
        F.upper(F.substring("event_type", 1, 3)).alias("fueltype"),
        capitalized(F.col("event_type")).alias("type_name"),
        F.lit("megawatthours").alias("value_units"),
        F.col("value"),
    ]
    if keep_id:
        cols += ["event_id", F.get_json_object("props", "$.k").cast("int").alias("k")]
    return events.select(*cols)


def generation_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The large generation relation: ship date as period, flag+status as fuel."""
    resp = code_of(F.col("l_suppkey"))
    fuel = F.concat("l_returnflag", "l_linestatus")
    return lineitem.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("period"),
        resp.alias("respondent"),
        region_name(resp).alias("respondent_name"),
        fuel.alias("fueltype"),
        fuel.alias("type_name"),
        F.lit("megawatthours").alias("value_units"),
        F.col("l_quantity").alias("value"),
    )


def region_from_events(events: DataFrame) -> DataFrame:
    """Region facts R from ``events``: view/click/purchase -> D/NG/TI, others kept so the
    type facet has work; TI is shifted by -245 so signs vary."""
    t = F.coalesce(F.try_element_at(_lit_map(EVENT_TYPE_SERIES), F.col("event_type")), F.col("event_type"))
    resp = code_of(F.col("user_id"))
    return events.select(
        hour_of(F.col("ts")).alias("period"),
        resp.alias("respondent"),
        region_name(resp).alias("respondent_name"),
        t.alias("type"),
        F.coalesce(F.try_element_at(_lit_map(SERIES_NAMES), t), capitalized(F.col("event_type"))).alias("type_name"),
        F.lit("megawatthours").alias("value_units"),
        F.when(t == "TI", F.col("value") - F.lit(TI_OFFSET)).otherwise(F.col("value")).alias("value"),
    )


def requests_from_customer(customer: DataFrame) -> DataFrame:
    """Tool requests Q: one per customer, ``args`` as JSON text."""
    start = F.date_add(F.lit(REQUEST_EPOCH).cast("date"), (F.col("c_custkey") % 28).cast("int"))
    end = F.date_add(start, (F.col("c_custkey") % 5).cast("int"))
    args = F.to_json(
        F.struct(
            code_of(F.col("c_nationkey"), REQUEST_REGIONS).alias("region"),
            F.date_format(start, "yyyy-MM-dd").alias("start"),
            F.date_format(end, "yyyy-MM-dd").alias("end"),
        )
    )
    return customer.select(
        F.col("c_custkey").cast("long").alias("request_id"),
        F.try_element_at(_lit_map(SEGMENT_TOOLS), F.col("c_mktsegment")).alias("tool"),
        args.alias("args"),
    )


def invocations_from_orders(orders: DataFrame) -> DataFrame:
    """Command-line fetch invocations: region by customer, a range around the order
    date whose end may fall before its start."""
    start = F.to_date("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("invocation_id"),
        code_of(F.col("o_custkey")).alias("region"),
        start.alias("start"),
        F.date_add(start, (F.col("o_orderkey") % 11 - 3).cast("int")).alias("end"),
    )


def pages_from_conversations(conversations: DataFrame) -> DataFrame:
    """Short pages with carry: one document per conversation, one page per turn."""
    return conversations.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("source_pdf"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        F.col("text").alias("page_text"),
    )


def document_source(doc_id: Column) -> Column:
    """File name of a document: ``doc-<id>.pdf``."""
    return F.concat(F.lit("doc-"), doc_id.cast("string"), F.lit(".pdf"))


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """Long pages: one single-page document per row."""
    return documents.select(
        document_source(F.col("doc_id")).alias("source_pdf"),
        F.lit(1).alias("page_number"),
        F.col("text").alias("page_text"),
    )


def pages_by_source(documents: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """Long pages with carry: one document per ``source``, pages in ``doc_id`` order.

    The page number is a per-source ordinal computed without sorting a source in one task.
    """
    numbered = row_number_in_group(
        documents.select("source", "doc_id", "text"),
        ["source"],
        F.floor(F.col("doc_id") / bucket_width),
        ["doc_id"],
        "page_no",
    )
    return numbered.select(
        F.concat(F.col("source"), F.lit(".pdf")).alias("source_pdf"),
        F.col("page_no").cast("int").alias("page_number"),
        F.col("text").alias("page_text"),
    )


# What stands around an answer, by turn modulo the length of the list.
ANSWER_TAILS = ["", "\n", "\t", "\u00a0", " \n "]


def answers_from_conversations(conversations: DataFrame) -> DataFrame:
    """Model answers to check: assistant turns, some with a citation tag appended, some
    replaced by the refusal sentence, some empty or missing, all with white space around."""
    tag = F.concat(F.lit(" [conv-"), F.col("conv_id").cast("string"), F.lit(" p."),
                   (F.col("turn") + 1).cast("string"), F.lit("]"))
    m = F.col("conv_id") % 3
    tail = code_of(F.col("turn"), ANSWER_TAILS)
    text = (
        F.when(F.col("conv_id") % 17 == 5, F.lit(None).cast("string"))
        .when(F.col("conv_id") % 17 == 6, tail)
        .when(m == 0, F.concat(F.col("text"), tag, tail))
        .when(m == 1, F.concat(tail, F.lit(REFUSAL), tail))
        .otherwise(F.concat(tail, F.col("text")))
    )
    return conversations.where(F.col("role") == "assistant").select(
        F.col("conv_id"), F.col("turn"), text.alias("answer")
    )


def questions_from_benchmark(benchmark: DataFrame) -> DataFrame:
    """Questions; one in ten is blank, so that nothing can be found for it."""
    text = F.when(F.col("item_id") % 10 == 3, F.lit(" \t ")).otherwise(F.col("text"))
    return benchmark.select(F.col("item_id").alias("query_id"), text.alias("question"))


def blank_pages(conversations: DataFrame) -> DataFrame:
    """Conversation pages of which every third is blank, and all of one document in five."""
    blank = (F.col("turn") % 3 == 1) | (F.col("conv_id") % 5 == 2)
    text = F.when(blank & (F.col("turn") % 2 == 0), F.lit("")).when(blank, F.lit(" \n\t ")).otherwise(F.col("text"))
    return pages_from_conversations(conversations.withColumn("text", text))


def file_names(documents: DataFrame) -> DataFrame:
    """File names, some of them known ones that have a fixed citation label."""
    known = list(CITATION_ALIASES)
    name = F.when(F.col("doc_id") % 11 == 3, code_of(F.col("doc_id"), known)).otherwise(document_source(F.col("doc_id")))
    return documents.select(name.alias("source_pdf"))


# Landed-record variations, keyed by the ``k`` property of an event (0..99). They stand in
# for what a real API feed carries: snake_case keys, NaN readings, units pasted into the
# number, month-only periods and records without a respondent.
K_SNAKE_KEYS = 3
K_VALUE_WITH_UNIT = 7
K_MONTH_PERIOD = 13
K_NO_RESPONDENT = 42
K_NAN_VALUE = 99


def raw_generation_records(events: DataFrame) -> DataFrame:
    """Generation facts as the API would send them: every scalar as text, hyphenated keys,
    hour-only periods. Returns ``respondent, period, event_id, record``."""
    g = generation_from_events(events, keep_id=True)
    k = F.col("k")
    snake = k == K_SNAKE_KEYS
    period_txt = F.when(k == K_MONTH_PERIOD, F.date_format("period", "yyyy-MM")).otherwise(
        F.date_format("period", "yyyy-MM-dd'T'HH")
    )
    value_txt = (
        F.when(k == K_VALUE_WITH_UNIT, F.concat(F.col("value").cast("string"), F.lit(" MWh")))
        .when(k == K_NAN_VALUE, F.lit("nan"))
        .otherwise(F.col("value").cast("string"))
    )
    record = F.struct(
        period_txt.alias("period"),
        F.when(k != K_NO_RESPONDENT, F.col("respondent")).alias("respondent"),
        F.when(~snake, F.col("respondent_name")).alias("respondent-name"),
        F.when(snake, F.col("respondent_name")).alias("respondent_name"),
        F.col("fueltype"),
        F.when(~snake, F.col("type_name")).alias("type-name"),
        F.when(snake, F.col("type_name")).alias("type_name"),
        value_txt.alias("value"),
        F.when(~snake, F.col("value_units")).alias("value-units"),
        F.when(snake, F.col("value_units")).alias("value_units"),
    )
    return g.select("respondent", "period", "event_id", record.alias("record"))


# Events of one hour and region are numbered in blocks of ids, so that the numbering has as
# many tasks as the data needs: the hours of the data are few whatever its size.
EVENT_BLOCK = 4096


def event_bucket() -> Column:
    """Bucket of an event in (period, event_id) order: its hour and its block of ids."""
    return F.struct(hour_number(F.col("period")).alias("hour"), F.floor(F.col("event_id") / EVENT_BLOCK).alias("block"))


def landed_generation_pages(events: DataFrame, page_limit: int = PAGE_LIMIT) -> DataFrame:
    """Pages of ``page_limit`` records per region in (period, event_id) order."""
    from voltframe.sources.landed_pages import land_pages

    return land_pages(raw_generation_records(events), "respondent", event_bucket(), ["period", "event_id"], page_limit=page_limit)


# Pages saved badly, by the page's number in its request modulo five.
SMALL_PAGE = 200
PAGE_CUT_OFF, PAGE_BAD_TOTAL, PAGE_NO_DATA = 1, 3, 4


def saved_pages(events: DataFrame) -> DataFrame:
    """Small pages as saved: bodies span two lines, and some are cut off, lack their data or
    state a total that is no number."""
    pages = landed_generation_pages(events, SMALL_PAGE)
    m = F.floor(F.col("page_offset") / SMALL_PAGE) % 5
    body = (
        F.when(m == PAGE_CUT_OFF, F.expr("substring(body, 1, length(body) - 3)"))
        .when(m == PAGE_BAD_TOTAL, F.regexp_replace("body", r'"total":"\d+"', '"total":"many"'))
        .when(m == PAGE_NO_DATA, F.lit('{"response":{"total":"7"}}'))
        .otherwise(F.col("body"))
    )
    return pages.withColumn("body", F.regexp_replace(body, r"^\{", "{\n"))


# A fetch that lost some pages: no page of one region, and one page in four of the others.
LOST_REGION, LOST_PAGE = "PJM", 2
REQUESTED_REGIONS = [*REGION_CODES, "NONE"]


def partly_landed_pages(events: DataFrame) -> DataFrame:
    """Small pages less those that never landed."""
    pages = landed_generation_pages(events, SMALL_PAGE)
    number = F.floor(F.col("page_offset") / SMALL_PAGE)
    return pages.where((F.col("respondent") != LOST_REGION) & ((number % 4 != LOST_PAGE) | (number == 0)))


def raw_region_records(events: DataFrame) -> DataFrame:
    """Region facts as the API would send them (``type`` instead of ``fueltype``), with the
    same text-level variations as the generation records."""
    base = events.select("*", F.get_json_object("props", "$.k").cast("int").alias("k"))
    resp = code_of(F.col("user_id"))
    t = F.coalesce(F.try_element_at(_lit_map(EVENT_TYPE_SERIES), F.col("event_type")), F.col("event_type"))
    period = hour_of(F.col("ts"))
    value = F.when(t == "TI", F.col("value") - F.lit(TI_OFFSET)).otherwise(F.col("value"))
    k = F.col("k")
    snake = k == K_SNAKE_KEYS
    type_name = F.coalesce(F.try_element_at(_lit_map(SERIES_NAMES), t), capitalized(F.col("event_type")))
    record = F.struct(
        F.when(k == K_MONTH_PERIOD, F.date_format(period, "yyyy-MM"))
        .otherwise(F.date_format(period, "yyyy-MM-dd'T'HH")).alias("period"),
        F.when(k != K_NO_RESPONDENT, resp).alias("respondent"),
        F.when(~snake, region_name(resp)).alias("respondent-name"),
        F.when(snake, region_name(resp)).alias("respondent_name"),
        t.alias("type"),
        F.when(~snake, type_name).alias("type-name"),
        F.when(snake, type_name).alias("type_name"),
        F.when(k == K_VALUE_WITH_UNIT, F.concat(value.cast("string"), F.lit(" MWh")))
        .when(k == K_NAN_VALUE, F.lit("nan")).otherwise(value.cast("string")).alias("value"),
        F.when(~snake, F.lit("megawatthours")).alias("value-units"),
        F.when(snake, F.lit("megawatthours")).alias("value_units"),
    )
    return base.where(t.isin("D", "NG", "TI")).select(
        resp.alias("respondent"), period.alias("period"), "event_id", record.alias("record")
    )


def landed_region_pages(events: DataFrame) -> DataFrame:
    """Region-data pages (type facet D/NG/TI applied at the source), 5,000 records each."""
    from voltframe.sources.landed_pages import land_pages

    return land_pages(raw_region_records(events), "respondent", event_bucket(), ["period", "event_id"])
