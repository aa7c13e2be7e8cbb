"""Top-k against brute force, vectoriser, store ingest (J4, T15, T20, T-K1)."""

from __future__ import annotations

import os
import tempfile

import numpy as np

from voltframe.operators import retrieve as RT
from voltframe.operators.ingest import ingest
from voltframe.operators.vectorize import hash_vectors
from voltframe.sources.store import read_store


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    corpus = rng.normal(size=(400, 16)).astype(np.float32)
    corpus[5] = 0.0                                     # zero vector is skipped (T20)
    corpus[9] = corpus[10]                               # exact tie broken by id
    queries = rng.normal(size=(6, 16))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(100 + j, v.tolist()) for j, v in enumerate(queries)], "query_id long, embedding array<double>")
    got = RT.topk_cosine(cdf, qdf, k=5, corpus_id="vec_id", corpus_block=50, query_block=4).collect()  # many blocks
    c = corpus.astype(np.float64)
    norms = np.linalg.norm(c, axis=1)
    for j, q in enumerate(queries):
        s = np.full(len(c), -np.inf)
        ok = norms > 0
        s[ok] = (c[ok] @ q) / (norms[ok] * np.linalg.norm(q))
        order = sorted(range(len(c)), key=lambda i: (-round(s[i], 6), i))[:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == 100 + j), key=lambda r: r.rank)]
        assert mine == order


def test_corpus_smaller_than_k(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    qdf = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")
    got = RT.topk_cosine(cdf, qdf, k=5, corpus_id="vec_id").collect()
    assert len(got) == 2 and {r.rank for r in got} == {1, 2}


def test_hash_vectors_unit_length_and_lexical(spark):
    df = spark.createDataFrame([(1, "grid load peak"), (2, "grid  load peak"), (3, "solar wind"), (4, "")],
                               "id long, text string")
    v = {r.id: np.array(r.embedding) for r in hash_vectors(df, "id", "text").collect()}
    assert set(v) == {1, 2, 3, 4} and not v[4].any()      # empty text: the zero vector
    assert all(abs(np.linalg.norm(v[i]) - 1) < 1e-6 for i in (1, 2, 3))
    assert np.allclose(v[1], v[2])                        # leading whitespace is not part of a term


def test_ingest_is_resumable_and_keeps_stale_chunks(spark):
    store = os.path.join(tempfile.mkdtemp(prefix="vf-store-"), "store")
    pages = spark.createDataFrame(
        [("a.pdf", 1, "alpha beta gamma"), ("a.pdf", 2, "delta epsilon"), ("b.pdf", 1, "")],
        "source_pdf string, page_number int, page_text string",
    )
    s1 = {r.source_pdf: r for r in ingest(pages, store).collect()}
    assert (s1["a.pdf"].n_chunks, s1["a.pdf"].n_new, s1["b.pdf"].n_chunks) == (2, 2, 0)
    s2 = {r.source_pdf: r for r in ingest(pages, store).collect()}
    assert (s2["a.pdf"].n_new, s2["a.pdf"].n_skipped) == (0, 2)
    changed = pages.replace("delta epsilon", "delta zeta")
    s3 = {r.source_pdf: r for r in ingest(changed, store).collect()}
    assert (s3["a.pdf"].n_new, s3["a.pdf"].n_skipped) == (1, 1)
    assert read_store(spark, store).count() == 3          # the stale page-2 chunk stays (T15)


def test_new_chunks_is_the_difference_of_ids(spark):
    from voltframe.sources.store import new_chunks

    chunks = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "chunk_id string, n int")
    store = spark.createDataFrame([(f"id{i}",) for i in range(0, 200, 3)], "chunk_id string")
    assert {r.chunk_id for r in new_chunks(chunks, store).collect()} == {f"id{i}" for i in range(50) if i % 3}


def test_ingest_loses_and_doubles_nothing(spark):
    """A page whose hash coordinates cancel is stored once; pages delivered twice are one
    page; a replayed batch changes neither store nor log; no table stays behind."""
    from voltframe.operators.ingest import ingest_totals
    from voltframe.session import checkpoint_dir
    from voltframe.streaming.incremental import ingest_log

    base = tempfile.mkdtemp(prefix="vf-store-")
    store = os.path.join(base, "store")
    schema = "source_pdf string, page_number int, page_text string"
    cancel = spark.createDataFrame([("z.pdf", 1, "w53 w37")], schema)
    assert not np.array(hash_vectors(cancel, "source_pdf", "page_text").first().embedding).any()
    tables = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "tables")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    assert [r.n_new for r in ingest(cancel, store, batch="0").collect()] == [1]
    assert [r.n_new for r in ingest(cancel, store, batch="0").collect()] == [1]  # the first run's log
    assert [r.n_new for r in ingest(cancel, store, batch="1").collect()] == [0]
    assert read_store(spark, store).count() == 1
    twice = spark.createDataFrame([("t.pdf", 1, "hello world")] * 2 + [("t.pdf", 2, "again")], schema)
    assert tuple(ingest_totals(ingest(twice, store, batch="2")).first()) == (1, 2, 2, 0)
    assert sorted(r.text for r in read_store(spark, store).where("source_pdf = 't.pdf'").collect()) == ["hello world", "hello worldagain"]
    log = ingest_log(spark, store).orderBy("batch_id").collect()
    assert [tuple(r) for r in log] == [(0, 1, 1, 0, 1, 0), (1, 1, 0, 1, 1, 1), (2, 2, 2, 0, 3, 1)]
    assert (set(os.listdir(tables)) if os.path.isdir(tables) else set()) == before


def test_equal_rows_do_not_add_up(spark):
    """A corpus of copies: exactly k rows of each block leave, and the smallest ids win."""
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = RT.topk_cosine(same, asked, k=4, corpus_id="vec_id", corpus_block=500)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == [(q, i + 1, i) for q in (1, 2) for i in range(4)]
    assert RT.topk_cosine(same, asked.limit(0), k=4, corpus_id="vec_id").count() == 0


def test_python_term_codes_equal_sql_term_codes(spark):
    """The vectoriser's memoised Python codes equal the SQL expression form (which the
    DuckDB oracle reproduces), including every Unicode whitespace separator."""
    from voltframe.operators.vectorize import _Codes, term_codes

    seps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
            " ", " ", " ", " ", " ", " ", " ", " ", "　"]
    words = ["alpha", "Beta", "é", "漢字", "x1", "zero​width", "dash-ed", "a"]
    texts = [sep.join(words[i % len(words):] + words[: i % len(words)]) + sep for i, sep in enumerate(seps)]
    texts += ["", "   ", "single"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sql = {r.i: list(r.c) for r in df.select("i", term_codes("t").alias("c")).collect()}
    codes = _Codes(384)
    for i, t in enumerate(texts):
        assert [codes[x] for x in t.split()] == sql[i], repr(t)


def test_metadata_of_hits(spark):
    vecs = spark.createDataFrame(
        [(f"c{i}", f"text {i}", "a.pdf" if i % 2 else None, i, [float(i % 3 == 0), 1.0, float(i)]) for i in range(30)],
        "chunk_id string, text string, source_pdf string, page_number int, embedding array<float>",
    )
    qs = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 1.0, 5.0])], "query_id int, embedding array<float>")
    rows = RT.hits_with_metadata(RT.topk_cosine(vecs, qs, k=3), vecs).collect()
    assert len(rows) == 6 and all(r.chunk_text == f"text {r.page_number}" for r in rows)
    assert all(r.source_pdf == ("a.pdf" if r.page_number % 2 else "") for r in rows)


PAGES = "source_pdf string, page_number int, page_text string"


def test_store_reads_only_the_buckets_of_a_batch(spark):
    """Each document's chunks lie in its bucket; a batch's anti-join reads its documents' buckets only."""
    from pyspark.sql import functions as F

    from voltframe.sources import store as ST

    path = os.path.join(tempfile.mkdtemp(prefix="vf-store-"), "store")
    ST.create_store(spark, path, 16)
    pages = spark.createDataFrame([(f"d{i}.pdf", 1, f"text {i}") for i in range(100)], PAGES)
    ingest(pages, path, batch="all")
    assert ST.create_store(spark, path, 99) == 16  # fixed when the store was created
    assert read_store(spark, path).columns == ["chunk_id", "source_pdf", "page_number", "chunk_index", "text", "embedding"]
    few = pages.where("source_pdf IN ('d3.pdf', 'd4.pdf')")
    ids = ST.stored_ids(spark, path, few)
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<chunk_id:string>" in plan
    read = {r.f.split("bucket=")[1].split("/")[0] for r in ids.select(F.input_file_name().alias("f")).distinct().collect()}
    own = {str(r.b) for r in few.select(ST.bucket_of("source_pdf", 16).alias("b")).distinct().collect()}
    assert read == own and len(own) <= 2
    assert {r.n_new for r in ingest(few, path).collect()} == {0}
    # Names that make one hash input ("a|1" page 2, "a" page 1 with text "2|...") share a bucket.
    both = spark.createDataFrame([("a|1",), ("a",)], "s string").select(ST.bucket_of("s", 1 << 20).alias("b"))
    assert len({r.b for r in both.collect()}) == 1


def test_batch_names_replays_and_unnamed_batches(spark):
    """A name stands for its pages: a replay keeps the log, other pages are refused, an unnamed batch is logged
    beside them, an empty one too, in the order of the first runs."""
    import pytest

    from voltframe.operators.ingest import BatchNameReused, ingest_log

    store = os.path.join(tempfile.mkdtemp(prefix="vf-store-"), "store")
    page = lambda *names: spark.createDataFrame([(f"{n}.pdf", 1, f"words of {n}") for n in names], PAGES)
    assert [(r.source_pdf, r.n_new) for r in ingest(page("a"), store, batch="0").collect()] == [("a.pdf", 1)]
    with pytest.raises(BatchNameReused):
        ingest(page("b"), store, batch="0")
    assert read_store(spark, store).count() == 1
    ingest(page("b", "a"), store)
    assert [(r.source_pdf, r.n_new) for r in ingest(page("a"), store, batch="0").collect()] == [("a.pdf", 1)]
    ingest(page("c").limit(0), store, batch="x/../y z")
    ingest(page("c"), store, batch="")
    log = ingest_log(spark, store, names=True).orderBy("batch_id").collect()
    assert [(r.n_embedded, r.n_skipped, r.embedded_so_far) for r in log] == [(1, 0, 1), (1, 1, 2), (0, 0, 2), (1, 0, 3)]
    assert [log[i].batch for i in (0, 2, 3)] == ["0", "x/../y z", ""] and len(log[1].batch) == 32


def test_a_batch_reads_the_stored_ids_once(spark):
    """Statistics and append take their marks from one written join with the store."""
    from voltframe.operators import ingest as IN
    from voltframe.sources import store as ST

    store, calls = os.path.join(tempfile.mkdtemp(prefix="vf-store-"), "store"), []
    real = ST.stored_ids
    IN.stored_ids = lambda *a: calls.append(a) or real(*a)
    try:
        ingest(spark.createDataFrame([("a.pdf", 1, "x y")], PAGES), store)
    finally:
        IN.stored_ids = real
    assert len(calls) == 1


def _peak(run) -> float:
    """MB that ``run`` held at most."""
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_vectors_are_built_in_slices():
    """What the vectoriser holds follows a slice, not an Arrow batch: vectors leave as they are made."""
    import pyarrow as pa

    from voltframe.operators import vectorize as VZ

    texts = [None if i % 97 == 5 else " ".join(f"w{(i * 7 + j) % 300}" for j in range(i % 120)) for i in range(6000)]
    made = list(VZ.embed_batches(iter([pa.array(texts)]), 384))
    assert max(map(len, made)) <= VZ.SLICE_ROWS and sum(map(len, made)) == len(texts)
    got = np.asarray(pa.concat_arrays(made).flatten()).reshape(-1, 384)
    for i in (0, 5, 119, 511, 512, 5999):
        want = np.zeros(384)
        for term in (texts[i] or "").split():
            code = VZ._Codes(384)[term]
            want[code >> 1] += 1 - 2 * (code & 1)
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))
    batch = pa.array(texts)
    assert _peak(lambda: [None for _ in VZ.embed_batches(iter([batch]), 384)]) < 12


def test_long_terms_are_not_memoised():
    from voltframe.operators import vectorize as VZ

    codes = VZ._Codes(384)
    assert codes["x" * 1000] == codes["x" * 1000] and not codes
    assert codes["grid"] == codes["grid"] and list(codes) == ["grid"]


def test_block_is_compared_in_tiles():
    """Ties over several tiles end as in one sort, and what a comparison holds follows the tiles."""
    import pyarrow as pa
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("c_id", T.StringType()), T.StructField("s", T.DoubleType())])
    rng = np.random.default_rng(3)
    n, dim = 3 * RT.CORPUS_TILE + 17, 48
    m = np.round(rng.normal(size=(40, dim)))[rng.integers(0, 40, n)].astype(np.float32)  # many copies
    m[::50] = 0
    ids = [f"{x:05d}" for x in rng.permutation(n)]
    as_list = lambda x: pa.array(list(x), pa.list_(pa.from_numpy_dtype(x.dtype)))
    q = np.vstack([m[1:300].astype(np.float64), np.zeros((1, dim))])
    rows = pa.table({"c_id": pa.array(ids), "c_vec": as_list(m)})
    asked = pa.table({"q_id": pa.array(range(len(q))), "q_vec": as_list(q)})
    compare = RT.block_comparer(7, 6, out)
    got = sorted((a, -s, i) for a, i, s in zip(*compare(rows, asked).to_pydict().values()))
    ok = np.linalg.norm(m, axis=1) > 0
    unit = m[ok] / np.linalg.norm(m[ok].astype(np.float64), axis=1)[:, None]
    own, want = np.array(ids)[ok], []
    for j, v in enumerate(q):
        if v.any():
            s = np.round(unit @ (v / np.linalg.norm(v)), 6) + 0.0
            want += [(j, -s[i], str(own[i])) for i in np.lexsort((own, -s))[:7]]
    assert [(a, i) for a, _, i in got] == [(a, i) for a, _, i in sorted(want)]
    big = np.zeros((RT.CORPUS_BLOCK, 384), dtype=np.float32)
    big[:, :2] = rng.normal(size=(RT.CORPUS_BLOCK, 2))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(big) + 1, dtype=np.int32) * 384), pa.array(big.ravel()))
    rows = pa.table({"c_id": pa.array([f"{i:064d}" for i in range(len(big))]), "c_vec": flat})
    asked = pa.table({"q_id": pa.array(range(RT.QUERY_TILE)), "q_vec": flat.slice(0, RT.QUERY_TILE)})
    assert _peak(lambda: compare(rows, asked)) < 40


def test_infinite_components_keep_their_place(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, embedding array<double>")
    got = RT.topk_cosine(cdf, qdf, k=5, corpus_id="vec_id").collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3]
