"""Fact sink and pruning (S12, S13, P1-P3), document listing (S14), model hook (F24), entry."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.operators.vectorize import vectorize_with_model
from voltframe.plans import relations as R
from voltframe.sources.facts import read_facts, select_range, write_facts
from voltframe.sources.store import list_documents

from .conftest import SF001


def test_write_facts_partitions_and_prunes(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="vf-facts-"), "gen")
    facts = R.generation_from_events(R.table(spark, SF001, "events"))
    assert write_facts(facts, path)
    back = read_facts(spark, path)
    assert back.count() == facts.count()
    sel = select_range(back, "CISO", "2024-01-03", "2024-01-04", sort=False)
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "respondent" in plan  # respondent partitions pruned at the scan
    want = select_range(facts, "CISO", "2024-01-03", "2024-01-04", sort=False)
    assert sel.exceptAll(want).count() == 0 and want.exceptAll(sel).count() == 0
    assert not write_facts(facts.where(F.lit(False)), path + "-empty")  # empty guard: nothing written
    assert not os.path.exists(path + "-empty")


def test_list_documents(spark):
    d = tempfile.mkdtemp(prefix="vf-docs-")
    for name in ("b.pdf", "a.pdf", "note.txt"):
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(b"%PDF-1.4")
    os.makedirs(os.path.join(d, "sub"))
    with open(os.path.join(d, "sub", "c.pdf"), "wb") as fh:
        fh.write(b"%PDF")
    names = sorted(r.source_pdf for r in list_documents(spark, d).collect())
    assert names == ["a.pdf", "b.pdf"]
    assert [r.source_pdf for r in list_documents(spark, d).collect()] == names  # in name order
    with pytest.raises(FileNotFoundError):
        list_documents(spark, d, "*.docx")


def test_model_backed_vectoriser(spark):
    def make_predict_fn():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.stack([np.array([len(t), 1.0, 0.0], dtype=np.float32) for t in texts])
        return predict

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, text string")
    out = {r.id: r.embedding for r in vectorize_with_model(df, "text", make_predict_fn, dim=3).collect()}
    assert out == {1: [2.0, 1.0, 0.0], 2: [4.0, 1.0, 0.0]}


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert rows and df.columns == ["respondent", "type_name", "mwh", "share_pct", "fuel_rank"]
    by_region: dict[str, float] = {}
    for r in rows:
        by_region[r.respondent] = by_region.get(r.respondent, 0.0) + r.share_pct
    assert all(abs(v - 100.0) < 1e-6 for v in by_region.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_values_keep_their_type_and_the_session_its_mode(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="vf-facts-"), "gen")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    facts = R.generation_from_events(R.table(spark, SF001, "events"))
    write_facts(facts.withColumn("respondent", F.lit("007")).limit(5), path)
    write_facts(facts.withColumn("respondent", F.lit("true")).limit(3), path)  # replaces no other partition
    back = read_facts(spark, path)
    assert {r[0] for r in back.select("respondent").distinct().collect()} == {"007", "true"} and back.count() == 8
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_shared_folder_is_required_off_local_threads(spark):
    from types import SimpleNamespace

    from voltframe import session

    class Conf:
        def get(self, key, default=None):
            return None

    far = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://cluster:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(far)


def test_materialized_tables_are_dropped(spark):
    from voltframe.session import drop_materialized, materialize

    table = materialize(spark.range(10).selectExpr("id", "CAST(NULL AS INT) AS n"), "probe")
    assert table.count() == 10
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file:").replace("//", "/"))
    assert os.path.isdir(folder)
    drop_materialized(table)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError, match="not a table"):
        drop_materialized(R.table(spark, SF001, "nation"))
