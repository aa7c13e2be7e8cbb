"""Landed pages: records, envelopes, files and the manifest."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from voltframe.functions.parse import parse_iso_date
from voltframe.sources import landed_pages as LP


def record(**change):
    """A good record; a field set to ``...`` is left out. The keys are the wire spellings."""
    full = {
        "period": "2023-11-05T17", "respondent": "MISO", "respondent-name": "Middle", "fueltype": "NUC",
        "type-name": "Nuclear", "value": "88.25", "value-units": "MWh",
    }
    return {k: v for k, v in (full | {k.replace("_", "-") if k.replace("_", "-") in full else k: v for k, v in change.items()}).items() if v is not ...}


def body(records, total="1", **more):
    return json.dumps({"response": {"total": total, "data": records, **more}})


def pages(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_both_key_spellings_and_types(spark):
    snake = {"period": "2023-11-05", "respondent": "PJM", "respondent_name": "East", "fueltype": "OTH", "type_name": "Other", "value": 4, "value_units": "u"}
    good, rejects = LP.parse_pages(pages(spark, body([record(), snake], total=2, frequency="hourly")))
    rows = {r.respondent: r for r in good.collect()}
    assert rejects.count() == 0 and len(rows) == 2
    assert tuple(rows["MISO"]) == (dt.datetime(2023, 11, 5, 17), "MISO", "Middle", "NUC", "Nuclear", "MWh", 88.25)
    assert tuple(rows["PJM"]) == (dt.datetime(2023, 11, 5), "PJM", "East", "OTH", "Other", "u", 4.0)


@pytest.mark.parametrize("change,value", [({"value": None}, None), ({"value": ...}, None), ({"value": "nan"}, None), ({"value": 7}, 7.0), ({"value": "-1e3"}, -1000.0)])
def test_values_that_pass(spark, change, value):
    good, rejects = LP.parse_pages(pages(spark, body([record(**change)])))
    assert [r.value for r in good.collect()] == [value] and rejects.count() == 0


@pytest.mark.parametrize("change,reason", [
    ({"value": ""}, "value: not a finite number"), ({"value": "9,5"}, "value: not a finite number"), ({"value": "null"}, "value: not a finite number"),
    ({"value": "-inf"}, "value: not a finite number"), ({"value": "1e23"}, "value: out of range"), ({"period": "2023-11"}, "period: invalid"),
    ({"period": "2023-11-05T7"}, "period: invalid"), ({"period": "2023-11-05T07:00:00Z"}, "period: invalid"), ({"period": "2023-02-30T01"}, "period: invalid"),
    ({"period": ...}, "period: missing"), ({"respondent": None}, "respondent: missing"), ({"type_name": ...}, "type_name: missing"), ({"fueltype": ...}, "fueltype: missing"),
])
def test_records_that_are_rejected(spark, change, reason):
    good, rejects = LP.parse_pages(pages(spark, body([record(**change), record()], total="2")))
    assert [r.reject_reason for r in rejects.collect()] == [reason] and good.count() == 1


BAD_PAGES = {
    "{not json": "page: not JSON",
    "": "page: not JSON",
    '{"error": "busy"}': "page: response missing",
    body([record()], total="abc"): "page: total not an integer",
    body([record()], total="1.5"): "page: total not an integer",
    body([record()], total=None): "page: total not an integer",
    '{"response": "busy"}': "page: response missing",
    body([record()], total="99999999999999"): "page: total out of range",
    body([record()], total=10**30): "page: total out of range",
    '{"response": {"total": "3"}}': "page: data not a list of records",
    '{"response": {"total": "3", "data": {"period": "x"}}}': "page: data not a list of records",
}


@pytest.mark.parametrize("bad", list(BAD_PAGES))
def test_unreadable_page_is_a_reject_or_an_error(spark, bad):
    both = pages(spark, bad, body([record()]), body([], total="0"))
    good, rejects = LP.parse_pages(both)
    assert good.count() == 1
    assert [(r.raw_record, r.reject_reason) for r in rejects.collect()] == [(bad, BAD_PAGES[bad])]
    strict, _ = LP.parse_pages(both, mode="strict")
    with pytest.raises(Exception, match="invalid page"):
        strict.collect()


def test_strict_mode_raises_for_a_record_and_passes_clean_pages(spark):
    clean = pages(spark, body([record(), record(period="2023-11-05T18")], total="2"))
    assert LP.parse_pages(clean, mode="strict")[0].count() == 2
    with pytest.raises(Exception, match="invalid record"):
        LP.parse_pages(pages(spark, body([record(value="x")])), mode="strict")[0].collect()


def test_files_of_one_page_and_of_many(spark):
    folder = tempfile.mkdtemp(prefix="vf-pages-")
    pretty = json.dumps(json.loads(body([record()])), indent=2)
    os.mkdir(f"{folder}/whole")
    for name, text in (("a.json", pretty), ("b.json", "{cut")):
        with open(f"{folder}/whole/{name}", "w") as f:
            f.write(text)
    read = LP.read_landed_pages(spark, f"{folder}/whole", one_page_per_file=True)
    assert {r.source_file: r.body for r in read.collect()} == {"a.json": pretty, "b.json": "{cut"}
    good, rejects = LP.parse_pages(read, keep=["source_file"])
    assert good.count() == 1 and [(r.source_file, r.raw_record) for r in rejects.collect()] == [("b.json", "{cut")]

    two = pages(spark, body([record()]), body([record(), record()], total="2"))
    LP.write_landed_pages(two, f"{folder}/lines")
    assert LP.parse_pages(LP.read_landed_pages(spark, f"{folder}/lines"))[0].count() == 3
    LP.write_landed_pages(two.withColumn("body", F.regexp_replace("body", ",", ",\n")), f"{folder}/files", one_page_per_file=True)
    assert LP.parse_pages(LP.read_landed_pages(spark, f"{folder}/files", one_page_per_file=True))[0].count() == 3


def test_manifest_sizes_lost_pages_and_requests(spark):
    totals = {"none": 0, "under": 9, "exact": 10, "over": 11, "long": 35}
    rows = []
    for key, total in totals.items():
        for offset in range(0, max(total, 1), 10):
            if (key, offset) != ("long", 20):
                rows.append((key, offset, body([record()] * min(10, total - offset), total=str(total))))
    landed = spark.createDataFrame(rows, "key string, page_offset long, body string")
    asked = spark.createDataFrame([(k,) for k in [*totals, "unseen"]], "key string")
    got = {(r.key, r.page_offset): (r.expected_rows, r.landed, r.landed_rows) for r in LP.page_manifest(landed, "key", 10, asked).collect()}
    assert got == {
        ("none", 0): (0, True, 0), ("under", 0): (9, True, 9), ("exact", 0): (10, True, 10), ("over", 0): (10, True, 10), ("over", 10): (1, True, 1),
        ("long", 0): (10, True, 10), ("long", 10): (10, True, 10), ("long", 20): (10, False, None), ("long", 30): (5, True, 5), ("unseen", 0): (None, False, None),
    }


def test_dates_are_strict(spark):
    df = spark.createDataFrame([("2025-06-01",), (" 2025-06-01",), ("2025-06-01 ",), ("2025-6-1",), ("2025-02-30",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_iso_date("t")).collect()] == [dt.date(2025, 6, 1)] + [None] * 5


def test_one_bad_element_is_one_reject(spark):
    """Elements of any other type beside good records; nested values and unknown keys do no harm."""
    mixed = [record(), 5, "text", None, [record()], True, record(value="x"), record(extra={"a": [1]}, value=2)]
    good, rejects = LP.parse_pages(pages(spark, body(mixed, total="8"), body([7], total="1")))
    assert sorted(r.value for r in good.collect()) == [2.0, 88.25]
    got = sorted((r.reject_reason, r.raw_record) for r in rejects.collect())
    assert [g for g in got if g[0] == "record: not an object"] == sorted(("record: not an object", json.dumps(x, separators=(",", ":"), sort_keys=True)) for x in [*mixed[1:6], 7])
    assert [json.loads(g[1])["value"] for g in got if g[0] != "record: not an object"] == ["x"]
    with pytest.raises(Exception, match="invalid record"):
        LP.parse_pages(pages(spark, body([record(), 5], total="2")), mode="strict")[0].collect()


def test_manifest_of_long_and_impossible_requests(spark):
    rows = [("long", 0, body([], total="100000")), ("wild", 0, body([], total="99999999999999")), ("minus", 0, body([], total="-4"))]
    found = LP.page_manifest(spark.createDataFrame(rows, "key string, page_offset long, body string"), "key", 10)
    got = {r.key: r for r in found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_offset").alias("last"), F.sum("expected_rows").alias("rows")).collect()}
    assert (got["long"].n, got["long"].last, got["long"].rows) == (10_000, 99_990, 100_000)
    assert (got["wild"].n, got["wild"].rows) == (1, None) and got["minus"].n == 1
