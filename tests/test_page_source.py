"""The data source of page files: what it opens, odd folders and pages."""

from __future__ import annotations

import json
import os
import tempfile

import pytest

from voltframe.sources import page_source as PS


def page(respondent, *hours, value="1"):
    data = [{"period": h, "respondent": respondent, "respondent-name": "n", "fueltype": "NG", "type-name": "Gas", "value": value, "value-units": "MWh"} for h in hours]
    return respondent, json.dumps({"response": {"total": str(len(data)), "data": data}})


@pytest.fixture(scope="module")
def folder(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="vf-page-files-"), "pages")
    rows = [page("CISO", "2024-01-01T00", "2024-01-02T23"), page("CISO", "2024-01-03T00", "2024-01-04T23"), page("CISO", "2024-01-05T00"),
            page("PJM", "2024-01-03T05", "2024-01-03T06"), page("A/B=c", "2024-01-03"), (None, '{"response": {"total": "0", "data": []}}'), ("CISO", "{cut")]
    PS.register(spark)
    PS.write_page_files(spark.createDataFrame(rows, "respondent string, body string"), path, "generation")
    PS.write_page_files(spark.createDataFrame([page("CISO", "2024-01-03T00")], "respondent string, body string"), path, "region")
    return path


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_"))]


def test_every_page_is_a_partition_with_its_folders_values(spark, folder):
    df = spark.read.format(PS.NAME).load(folder)
    rows = df.collect()
    assert len(rows) == len(files(folder)) == 8 == df.rdd.getNumPartitions()
    assert {(r.kind, r.respondent, r.first_hour, r.last_hour) for r in rows} >= {
        ("generation", "CISO", "2024-01-01T00", "2024-01-02T23"), ("generation", "A/B=c", "2024-01-03T00", "2024-01-03T00"),
        ("generation", None, None, None), ("generation", "CISO", None, None), ("region", "CISO", "2024-01-03T00", "2024-01-03T00")}
    assert "{cut" in {r.body for r in rows}


def test_predicates_skip_files(spark, folder):
    df = spark.read.format(PS.NAME).load(folder)
    one = df.where("kind = 'generation' AND respondent = 'CISO' AND first_hour <= '2024-01-04T23' AND last_hour >= '2024-01-03T00'")
    assert one.rdd.getNumPartitions() == 1 and [r.first_hour for r in one.collect()] == ["2024-01-03T00"]
    assert df.where("respondent IN ('PJM', 'A/B=c')").rdd.getNumPartitions() == 2
    assert df.where("kind = 'region' AND body LIKE '%CISO%'").count() == 1  # Spark applies what is not pushed
    assert df.where("respondent = 'NONE'").count() == 0
    assert spark.read.format(PS.NAME).load(folder + "-absent").count() == 0


def test_skipped_files_are_not_opened(spark, folder):
    """Files that a request cannot need are made unreadable; the request does not notice."""
    for path in files(folder):
        if "respondent=CISO" not in path or "first=2024-01-03" not in path or "kind=generation" not in path:
            os.remove(path)
            os.mkdir(path)  # opening it fails
            with open(os.path.join(path, "_x"), "w"):
                pass
    good, rejects = PS.read_range(spark, folder, "CISO", "2024-01-03", "2024-01-03")
    assert [str(r.period) for r in good.collect()] == ["2024-01-03 00:00:00"] and rejects.count() == 0
