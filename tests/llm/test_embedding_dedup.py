"""Embedding links against brute force, and the recall of the cells."""

from __future__ import annotations

import numpy as np

from voltframe.llm import embedding_dedup

from ..conftest import SF01
from .common import groups

EDGE = [
    (90001, None), (90002, [0.0, 0.0]), (90003, [float("nan"), 1.0]), (90004, []), (90005, [1.0, 2.0]), (90006, [2.0, 4.0]),
    (90007, [1.0, None]), (90008, [float("inf"), 1.0]), (None, [1.0, 2.0]), (90005, [1.0, 2.0]), (90009, [1.0, 2.0, 0.0]),
    (90010, [-0.0, 1.0]), (90011, [0.0, 1.0]), (90012, [1e-38, 2e-38]), (90013, [1e38, 2e38]),
]


def brute(rows, threshold=0.9):
    by_length = {}
    for i, (k, v) in enumerate(rows):
        if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            by_length.setdefault(len(v), []).append(i)
    pairs = []
    for own in by_length.values():
        x = np.array([rows[i][1] for i in own], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        pairs += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)))]
    links = np.bincount(np.array(pairs, dtype=int).ravel(), minlength=len(rows))
    out = []
    for own in groups(len(rows), pairs):
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [(rows[i][0], int(links[i]), least, rows[i][0] == least) for i in own]
    return sorted(out, key=str)


def result(df, **kw):
    return sorted(map(tuple, embedding_dedup.near_duplicates(df, **kw).collect()), key=str)


def test_edge_rows_and_table(spark):
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding")
    both = vectors.union(spark.createDataFrame(EDGE, vectors.schema))
    want = brute([tuple(r) for r in both.collect()])
    assert result(both) == want
    assert result(both.selectExpr("vec_id", "embedding", "1 AS rep", "2 AS cell")) == want
    assert result(both.limit(0)) == []


def test_many_cells_blocks_and_hot_groups(spark):
    """Planted pairs at 0.9 to 0.97, exact copies and a dense group, in many small cells and
    blocks; recall against brute force."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(700, 24)))
    side = rng.normal(size=x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9005, 0.97, (700, 1))
    dense = unit(x[:1] + 0.02 * rng.normal(size=(150, 24)))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*x, *(c * x + np.sqrt(1 - c**2) * side), *dense, *[x[3]] * 90])]
    want = brute(rows)
    got = result(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows_per_cell=32, block_rows=40, visit=0.224)
    assert got == want  # the exact margin finds every link
    found = sum(r[1] for r in result(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows_per_cell=32, block_rows=40))
    assert 0.99 <= found / sum(r[1] for r in want) <= 1


def test_low_rank_and_clustered_vectors_lose_no_pair(spark):
    """Pairs just above 0.9 among vectors that span few of their dimensions, or lie in clusters."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    flat = rng.normal(size=(500, 4))
    clustered = rng.normal(size=(12, 24))[rng.integers(0, 12, 500)] + 0.35 * rng.normal(size=(500, 24))
    for x in (unit(flat), unit(clustered)):
        side = rng.normal(size=x.shape)
        side = unit(side - (side * x).sum(1, keepdims=True) * x)
        both = np.concatenate([x, 0.9005 * x + np.sqrt(1 - 0.9005**2) * side])
        if x.shape[1] == 4:
            both = both @ np.linalg.qr(rng.normal(size=(24, 24)))[0][:4]
        rows = [(i, v.tolist()) for i, v in enumerate(both)]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert result(vectors, rows_per_cell=16) == brute(rows)


def test_a_dense_block_is_compared_in_bounded_memory():
    """A block whose vectors are all near each other: all links counted, one group, no list of all pairs."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 6000
    x = (np.array([1.0] + [0.0] * 15) + rng.normal(scale=0.02, size=(n, 16))).astype(np.float32)
    table = pa.table({
        "dim": pa.array([16] * n, pa.int32()), "cell": pa.array([0] * n, pa.int32()), "side": pa.array([0] * n, pa.int32()), "rep": pa.array(rng.permutation(n)),
        "weight": pa.array([1] * n), "home": pa.array([0] * n, pa.int32()), "visits": pa.array([[0]] * n, pa.list_(pa.int32())), "embedding": pa.array(list(x))})
    tracemalloc.start()
    ids, links, u, v = embedding_dedup._compare(table, 0.9, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == n and (links == n - 1).all() and set(v) == {0} and sorted(u) == list(range(1, n))
    assert peak < 400e6, peak  # all 18 million pairs of four numbers would take 576 MB and more
