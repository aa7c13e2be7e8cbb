"""Exact cosine top-k of many query vectors against a large vector table.

Corpus and queries are cut into blocks by a hash of their ids, and every pair of a corpus
block and a query block is one task of a cogroup on the two block numbers: the corpus
travels once for each query block (one, unless there are very many questions), the
queries once for each corpus block. Nothing goes through the driver and nothing is
broadcast. A task multiplies tiles of queries with tiles of its corpus block, keeps the best
of each query as it goes (what it holds beside the block follows the tiles), and lets exactly
the best k rows of each query leave, ties broken by id, so equal rows (copies, or rows
that share nothing with the question) do not add up. A final ``row_number`` per query
(planned with a partial ``WindowGroupLimit``) keeps k of the blocks' rows.

Zero vectors are skipped (cosine is undefined for them), and so are vectors of another
length than the query's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.constants import DEFAULT_K

CORPUS_BLOCK = 16_384  # rows of the corpus held by one task
QUERY_BLOCK = 4_096  # queries held by one task
QUERY_TILE = 256  # queries multiplied at once
CORPUS_TILE = 2_048  # rows of the corpus in double precision at once


def _unit(vectors: pa.ListArray, rows: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of those of ``rows`` (all of length ``dim``) with a norm, and which rows they are."""
    m = np.array(vectors.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(-1, dim)
    norms = np.linalg.norm(m, axis=1)
    ok = norms > 0
    if not ok.all():
        m, norms, rows = m[ok], norms[ok], rows[ok]
    m /= norms[:, None]
    return m, rows


def _rows_of(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of length ``dim``."""
    return np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)) == dim)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the best k scores of each row, equal ones by column."""
    n = scores.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    near = scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]
    for row in np.flatnonzero(np.count_nonzero(near, axis=1) > k):  # ties at the last place
        own = np.flatnonzero(near[row])
        near[row, own] = False
        near[row, own[np.lexsort((own, -scores[row, own]))[:k]]] = True
    return np.nonzero(near)


def block_comparer(k: int, digits: int, out: T.StructType):
    """For a cogroup of a block of rows (``c_id, c_vec``) and one of questions (``q_id, q_vec``): the best
    ``k`` rows of the block for each question, as ``out`` (question id, row id, similarity)."""
    from pyspark.sql.pandas.types import to_arrow_type

    names, types = out.names, [to_arrow_type(f.dataType) for f in out]

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        if rows.num_rows and asked.num_rows:
            c_vec, q_vec = rows.column("c_vec").combine_chunks(), asked.column("q_vec").combine_chunks()
            c_ids, q_ids = rows.column("c_id").combine_chunks(), asked.column("q_id").combine_chunks()
            for dim in pc.unique(pc.drop_null(pc.list_value_length(q_vec))).to_pylist():
                c_rows, asks = _rows_of(c_vec, dim), _rows_of(q_vec, dim)
                c_rows = c_rows[np.asarray(pc.sort_indices(c_ids.take(pa.array(c_rows)), null_placement="at_start"))]
                for at in range(0, len(asks), QUERY_TILE):
                    q, q_rows = _unit(q_vec, asks[at:at + QUERY_TILE], dim)
                    # The best so far stand before the next tile's rows, whose ids are higher: ties stay in order.
                    best, hits, n = np.empty((len(q), 0)), np.empty((len(q), 0), dtype=np.int64), 0
                    for lo in range(0, len(c_rows) if len(q) else 0, CORPUS_TILE):
                        c, own = _unit(c_vec, c_rows[lo:lo + CORPUS_TILE], dim)
                        scores = q @ c.T
                        np.round(scores, digits, out=scores)
                        scores += 0.0
                        scores[np.isnan(scores)] = np.inf  # a vector with an infinite component
                        n += len(own)
                        scores = np.hstack([best, scores])
                        row, column = _best(scores, k)
                        best = scores[row, column].reshape(len(q), -1)
                        old = hits.shape[1]
                        hits = np.where(column < old, hits[row, np.minimum(column, old - 1)] if old else 0, own[np.maximum(column - old, 0)] if len(own) else 0).reshape(len(q), -1)
                    asked_row, column = np.nonzero(np.isfinite(best) | (n <= k))
                    scores = best[asked_row, column]
                    scores[np.isinf(scores)] = np.nan
                    if len(scores):
                        found.append((q_ids.take(pa.array(q_rows[asked_row])), c_ids.take(pa.array(hits[asked_row, column])), scores))
        if not found:
            return pa.table([pa.array([], t) for t in types], names=names)
        return pa.table([pa.concat_arrays([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), pa.array(np.concatenate([f[2] for f in found]))], names=names)

    return compare


def topk_cosine(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    corpus_id: str = "chunk_id",
    vec_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "embedding",
    digits: int = 6,
    corpus_block: int = CORPUS_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, <corpus_id>, similarity_score`` for the k most similar rows.

    Ranking is by ``round(similarity, digits)`` descending, then ``corpus_id`` ascending,
    so results are deterministic across engines and partitionings. Fewer than k rows
    come back when the corpus is smaller than k. Both sides should be stored tables: they
    are counted first, to size the blocks.
    """
    parallel = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_corpus = max(-(-corpus.count() // corpus_block), parallel)
    n_query = max(-(-queries.count() // query_block), 1)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = corpus.select(F.col(corpus_id).alias("c_id"), F.col(vec_col).alias("c_vec"), block(corpus_id, n_corpus).alias("cb"), every(n_query, "qb"))
    right = queries.select(F.col(query_id).alias("q_id"), F.col(query_vec).alias("q_vec"), block(query_id, n_query).alias("qb"), every(n_corpus, "cb"))
    out = T.StructType([
        T.StructField("query_id", queries.schema[query_id].dataType),
        T.StructField(corpus_id, corpus.schema[corpus_id].dataType),
        T.StructField("similarity_score", T.DoubleType()),
    ])
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(block_comparer(k, digits, out), out)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col(corpus_id).asc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", corpus_id, "similarity_score")


def hits_with_metadata(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach chunk text and citation metadata; missing fields get ``""`` / ``-1``.

    ``hits`` are rows of ``vectors`` (unique ids), so each matches exactly one metadata
    row and an inner join keeps every hit. The join's strategy is left to adaptive
    execution, which broadcasts the hits when they turn out small.
    """
    meta = vectors.select("chunk_id", F.col("text").alias("chunk_text"), "source_pdf", "page_number")
    return hits.join(meta, "chunk_id").select(
        "query_id", "rank", "chunk_id", "chunk_text",
        F.coalesce("source_pdf", F.lit("")).alias("source_pdf"),
        F.coalesce("page_number", F.lit(-1)).alias("page_number"),
        "similarity_score",
    )


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label (double); element-wise average without collecting a group."""
    per_dim = vectors.select(label_col, F.posexplode(vec_col).alias("pos", "x")).groupBy(label_col, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    return per_dim.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("embedding")
    )
