"""Incremental stream ingest (ST1) and the SQL table functions (X1-X3)."""

from __future__ import annotations

import os
import tempfile

from voltframe.plans import relations as R
from voltframe.plans.sql_functions import register_tool_functions, tool_registry
from voltframe.sources.store import read_store
from voltframe.streaming.incremental import ingest_log, ingest_stream

from .conftest import SF001


def test_stream_ingest_picks_up_only_new_files(spark):
    base = tempfile.mkdtemp(prefix="vf-stream-")
    src, store, ckpt = (os.path.join(base, x) for x in ("src", "store", "ckpt"))
    schema = "source_pdf string, page_number int, page_text string"
    spark.createDataFrame([("a.pdf", 1, "one two"), ("a.pdf", 2, "three")], schema).coalesce(1) \
        .write.mode("append").parquet(src)
    ingest_stream(spark, src, store, ckpt)
    assert read_store(spark, store).count() == 2
    # second file: a new document plus an exact re-delivery of the first one
    spark.createDataFrame([("b.pdf", 1, "four"), ("a.pdf", 1, "one two"), ("a.pdf", 2, "three")], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    ingest_stream(spark, src, store, ckpt)
    assert read_store(spark, store).count() == 3
    log = ingest_log(spark, store).orderBy("batch_id").collect()
    assert [(r.n_embedded, r.n_skipped) for r in log] == [(2, 0), (1, 2)]
    assert log[-1].embedded_so_far == 3


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, "source_pdf string, page_number int, page_text string").coalesce(1).write.mode("append").parquet(folder)


def chunks_of(df):
    return {(r.chunk_id, r.source_pdf, r.page_number, r.chunk_index, r.text) for r in df.collect()}


def test_a_document_over_many_deliveries_equals_one_batch(spark):
    """Pages in order over four micro-batches, with empty pages, long pages and gaps in the numbers."""
    from voltframe.operators.chunks import chunk_pages

    base = tempfile.mkdtemp(prefix="vf-split-")
    src, store, ckpt = (os.path.join(base, x) for x in ("src", "store", "ckpt"))
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    pages = [(f"d{d}.pdf", p, "" if (d + p) % 4 == 0 else words(f"{d}x{p}x", 1700 if p == 4 else 3 + 60 * (p % 3))) for d in range(6) for p in (1, 2, 4, 5, 8, 9, 10)]
    for low, high in ((0, 1), (2, 4), (5, 8), (9, 10)):
        deliver(spark, src, [r for r in pages if low <= r[1] <= high])
    ingest_stream(spark, src, store, ckpt, max_files_per_trigger=1)
    whole = spark.createDataFrame(pages, "source_pdf string, page_number int, page_text string")
    assert chunks_of(read_store(spark, store)) == chunks_of(chunk_pages(whole))
    assert len(ingest_log(spark, store).collect()) == 4
    # A second run of the query, with pages of every document delivered again and one new page.
    deliver(spark, src, [r for r in pages if r[1] in (2, 9)] + [("d1.pdf", 11, "the end")])
    before = read_store(spark, store).count()
    ingest_stream(spark, src, store, ckpt)
    after = chunks_of(read_store(spark, store))
    assert len(after) == before + 1 and after == chunks_of(chunk_pages(whole.unionByName(spark.createDataFrame([("d1.pdf", 11, "the end")], whole.schema))))


def test_late_pages_and_a_second_stream_on_the_same_store(spark):
    """A late page is carried into from its predecessor; a stream with a new checkpoint logs under its own name."""
    base = tempfile.mkdtemp(prefix="vf-late-")
    src, store = os.path.join(base, "src"), os.path.join(base, "store")
    deliver(spark, src, [("a.pdf", 1, "one"), ("a.pdf", 3, "three")])
    deliver(spark, src, [("a.pdf", 2, "two"), ("a.pdf", 4, "four")])
    ingest_stream(spark, src, store, os.path.join(base, "c1"), max_files_per_trigger=1)
    assert {r.text for r in read_store(spark, store).collect()} == {"one", "onethree", "onetwo", "threefour"}
    other = os.path.join(base, "other")
    deliver(spark, other, [("b.pdf", 1, "bee")])
    ingest_stream(spark, other, store, os.path.join(base, "c2"))
    log = ingest_log(spark, store, names=True).collect()
    assert sorted(r.n_embedded for r in log) == [1, 2, 2] and len({r.batch.split("/")[0] for r in log}) == 2


def test_tool_table_functions(spark):
    events = R.table(spark, SF001, "events")
    register_tool_functions(spark, R.generation_from_events(events), R.region_from_events(events))
    gen = spark.sql("SELECT * FROM get_generation('CAISO', '2024-01-01', '2024-01-02')").collect()
    assert gen and all(r.region == "CISO" for r in gen)
    assert sorted(r.fuel_rank for r in gen) == list(range(1, len(gen) + 1))
    inter = spark.sql("SELECT * FROM get_demand_and_interchange('spp', '2024-01-01', '2024-01-30')").collect()
    assert {r.type for r in inter} <= {"D", "NG", "TI"} and inter[0].region == "SWPP"
    assert spark.sql("SELECT * FROM get_generation('XXXX', '2024-01-01', '2024-01-02')").count() == 0
    lat = spark.sql("""SELECT r.k, f.* FROM VALUES (1, 'CISO'), (2, 'ERCOT') AS r(k, reg),
                       LATERAL get_generation(r.reg, '2024-01-01', '2024-01-01') f""").collect()
    assert {r.k for r in lat} == {1, 2}
    assert all(r.registered for r in tool_registry(spark).collect())


def test_table_argument_function_equals_the_tool(spark):
    """All requests in one call: one scan of the facts, the same rows as the tool, ranges without facts absent."""
    from pyspark.sql import functions as F

    from voltframe.operators import tools as TL
    from voltframe.plans import sql_functions as SF

    facts = R.generation_from_events(R.table(spark, SF001, "events"))
    parsed = TL.parse_requests(R.requests_from_customer(R.table(spark, SF001, "customer"))).where(F.col("tool") == TL.TOOL_GENERATION)
    SF.register_range_function(spark, parsed, facts)
    call = f"SELECT * FROM {SF.RANGE_FUNCTION}(TABLE({SF.RANGE_EVENTS}) PARTITION BY region ORDER BY (is_total DESC, day))"
    found = spark.sql(call)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("event_type") >= 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id") == 1
    got = parsed.join(found, ["region", "start", "end"]).select("request_id", "region", "rows", "period_start", "period_end", "type_name", "fuel_rank", "mwh")
    want = TL.tool_generation(parsed, facts, bounds=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() > 0
