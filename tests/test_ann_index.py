"""The cell index: recall and exactness against brute force, what a search reads, odd rows."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.operators import ann_index as AN


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="vf-index-"), "index")


def frame(spark, vectors, ids=None):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(range(len(vectors)) if ids is None else ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(corpus, queries, k):
    """Ids of the ``k`` nearest rows of each query, ties at six decimals by id."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(corpus.astype(np.float32).astype(float)) @ unit(queries.astype(np.float32).astype(float)).T, 6)
    return [[int(i) for i in np.lexsort((np.arange(len(corpus)), -scores[:, j]))[:k]] for j in range(scores.shape[1])]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def kinds():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    clustered = centres[rng.integers(0, 30, 3000)] + rng.normal(scale=0.35, size=(3000, 24))
    low = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 24))
    hot = clustered.copy()
    hot[:1000] = centres[0] + rng.normal(scale=0.01, size=(1000, 24))  # a third of all rows in one place
    return {"clustered": clustered, "low rank": low, "hot cell": hot}


@pytest.mark.parametrize("kind", ["clustered", "low rank", "hot cell"])
def test_recall_and_exact_search(spark, kind):
    corpus = kinds()[kind]
    asked = np.arange(0, 3000, 50)
    index = AN.build(frame(spark, corpus), folder(), "vec_id")
    queries = frame(spark, corpus[asked], asked).withColumnRenamed("vec_id", "query_id")
    want = brute(corpus, corpus[asked], 5)
    near = found(AN.search(index, queries, k=5, row_block=200, query_block=7))  # many blocks
    assert all(len(v) == 5 for v in near.values())
    assert index.probes < len(index.cells(spark)) / 2  # most of the index is not read
    recall = np.mean([len(set(near[int(q)]) & set(w)) / 5 for q, w in zip(asked, want)])
    assert recall >= 0.9, recall
    exact = found(AN.search(index, queries, k=5, exact=True, probes=2, row_block=500))
    assert [exact[int(q)] for q in asked] == want


def test_default_probes_reach_their_recall_on_the_test_vectors(spark):
    from voltframe.plans.queries import QUERIES

    from .conftest import SF01

    near, exact = (found(QUERIES[n](spark, SF01)) for n in ("topk_lsh", "topk_index_exact"))
    assert near.keys() == exact.keys()
    assert np.mean([len(set(near[q]) & set(exact[q])) / 5 for q in exact]) >= 0.9


def test_only_probed_cells_are_read(spark):
    corpus = kinds()["clustered"]
    index = AN.build(frame(spark, corpus), folder(), "vec_id", n_cells=40)
    cells = index.cells(spark)
    assert sum(c["n"] for c in cells) == 3000  # every row is indexed
    rows = index.rows(spark, [3, 5])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(3,5\)", plan)
    query = frame(spark, corpus[:1], [7]).withColumnRenamed("vec_id", "query_id")
    result = AN.search(index, query, k=3, probes=2)
    files = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {int(re.search(r"cell=(-?\d+)", r.f).group(1)) for r in files} == {3, 5}
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.search(r"cell#\d+ IN \(([\d,]+)\)", plan).group(1).split(",")) == 2


def test_rows_without_a_direction_ties_repeats_and_empty_tables(spark):
    vectors = [[1, 0], [1, 0], [0, 0], None, [float("nan"), 1], [1, 0, 0], [0, 1], [float("inf"), 0], [2, 0]]
    df = frame(spark, vectors).unionByName(frame(spark, [[0, 1]], [6]))
    index = AN.build(df, folder(), "vec_id")
    assert spark.read.parquet(f"{index.path}/rows").count() == 10 and sum(c["n"] for c in index.cells(spark)) == 5
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "query_id int, embedding array<double>")
    for exact in (False, True):
        assert found(AN.search(index, queries, k=3, exact=exact)) == {1: [0, 1, 8], 4: [6, 6, 0]}
    assert AN.search(index, queries.limit(0), k=3, exact=True).count() == 0
    empty = AN.build(df.limit(0), folder(), "vec_id")
    assert AN.search(empty, queries).count() == 0
    nothing = AN.build(frame(spark, [None, [0, 0]]), folder(), "vec_id")
    assert AN.search(nothing, queries, exact=True).count() == 0
