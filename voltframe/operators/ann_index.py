"""An index of vectors in inverted cells: nearest neighbours without comparing every vector.

Unit vectors are assigned to the cell of their nearest centroid (spherical k-means) and
written as a table partitioned by cell. A search looks only into the ``probes`` cells whose
centroids are nearest to the question, and reads no other cell's files. How many probes a
corpus needs depends on its shape (few if it is clustered, many if it fills its dimensions),
so :func:`build` measures it: the least number that finds ``TARGET_RECALL`` of the exact
neighbours of 256 sampled vectors among the sample. Candidates are compared exactly and
none is capped; what the approximation can miss are neighbours in
cells that were not probed. ``exact=True`` closes that gap: a cell can hold a better vector
only if the angle to its centroid less the cell's radius (the largest angle of a row to the
centroid) is small enough, so a second round reads the cells that may still matter.

Scale:

* The centroids are fitted on a bounded sample, ``max_training_rows`` rows chosen by a hash
  of the id (at most 65,536), on the driver. Every row is then assigned and stored.
* There are about as many cells as the square root of the rows, ``MAX_CELLS`` at most; the
  centroids go to the tasks in one broadcast (``max_cells`` x dimension doubles).
* A cell of many rows, and a cell that many questions probe, are cut into blocks by hashes
  of the ids; a task compares one block of rows with one block of questions and lets the
  best k of each question leave. One cell with a third of all vectors is thus many tasks.
* Cells on disk are spread by ``rebalance``, which splits large ones over several files.

Rows without a direction (null, zero, not finite, or of another length) are stored in cell
-1 and never found. Rows that repeat an id are rows each. An empty table gives an index
without cells, which finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.constants import DEFAULT_K
from voltframe.operators.retrieve import CORPUS_BLOCK, QUERY_BLOCK, block_comparer
from voltframe.session import materialize

MAX_CELLS = 4096
MAX_TRAINING_ROWS = 65_536
TARGET_RECALL = 0.95
CALIBRATION_QUESTIONS = 256
NO_CELL = -1


def _units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction in ``dim`` dimensions, and which rows they are."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)) == dim)
    m = np.asarray(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    norms = np.linalg.norm(m, axis=1)
    ok = np.isfinite(norms) & (norms > 0)
    return m[ok] / norms[ok, None], rows[ok]


def fit_centroids(sample: np.ndarray, n_cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors: unit centroids, ``n_cells`` at most."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.permutation(len(distinct))[:n_cells]]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[k:k + 8192] @ centroids.T, axis=1) for k in range(0, len(sample), 8192)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-9
        sums[lost], norms[lost] = sample[rng.integers(0, len(sample), int(lost.sum()))], 1.0
        centroids = sums / norms[:, None]
    return centroids


def calibrate(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """Least number of nearest cells that hold ``target`` of the ``k`` nearest sampled vectors of sampled questions.

    Neighbours in a sample lie farther than those in the whole corpus, so more cells are asked for, not fewer.
    """
    own = np.concatenate([np.argmax(sample[i:i + 8192] @ centroids.T, axis=1) for i in range(0, len(sample), 8192)])
    needed = []
    for q in np.linspace(0, len(sample) - 1, min(CALIBRATION_QUESTIONS, len(sample))).astype(int):
        scores = sample @ sample[q]
        near = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
        place = np.empty(len(centroids), dtype=np.int64)
        place[np.argsort(-(centroids @ sample[q]), kind="stable")] = np.arange(len(centroids))
        needed.append(place[own[near]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)]) + 1


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: ``rows/`` (id, vector, angle, by cell) and ``cells/`` (cell, centroid, n, radius)."""

    path: str
    id_col: str
    vec_col: str
    probes: int

    def cells(self, spark: SparkSession) -> list:
        """Cells with a centroid, at most ``MAX_CELLS`` rows."""
        return spark.read.parquet(f"{self.path}/cells").where(F.col("cell") >= 0).orderBy("cell").collect()

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        """Stored rows of ``cells``; no other cell's files are read."""
        return spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(cells))


def build(vectors: DataFrame, path: str, id_col: str = "chunk_id", vec_col: str = "embedding", n_cells: int | None = None,
          max_training_rows: int = MAX_TRAINING_ROWS, k: int = DEFAULT_K, target_recall: float = TARGET_RECALL) -> VectorIndex:
    """Index all rows of ``vectors`` (a stored table: it is read three times) below ``path``.

    The number of cells that a search probes is set for ``target_recall`` at ``k`` (:func:`calibrate`)."""
    spark = vectors.sparkSession
    n_rows = vectors.count()
    n_cells = min(n_cells or int(np.ceil(np.sqrt(n_rows))), MAX_CELLS)
    sample = (
        vectors.select(id_col, vec_col).where(F.col(vec_col).isNotNull())
        .orderBy(F.xxhash64(id_col, F.lit(29)), id_col).limit(min(max_training_rows, MAX_TRAINING_ROWS)).select(vec_col).toArrow()
    )
    column = sample.column(vec_col).combine_chunks()
    lengths = pc.value_counts(pc.list_value_length(column)).to_pylist()
    dim = max(lengths, key=lambda v: (v["counts"], v["values"]))["values"] if lengths else 0
    units = _units(column, dim)[0] if dim else np.zeros((0, 0))
    centroids = fit_centroids(units, max(n_cells, 1)) if len(units) else np.zeros((0, dim))
    probes = calibrate(units, centroids, k, target_recall) if len(units) else 1
    shared = spark.sparkContext.broadcast(centroids)
    kept = [vectors.schema[id_col], vectors.schema[vec_col]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            cell, angle = np.full(batch.num_rows, NO_CELL, dtype=np.int32), np.zeros(batch.num_rows)
            if len(c):
                m, at = _units(batch.column(vec_col), c.shape[1])
                for k in range(0, len(m), 4096):
                    sims = m[k:k + 4096] @ c.T
                    best = np.argmax(sims, axis=1)
                    cell[at[k:k + 4096]] = best
                    angle[at[k:k + 4096]] = np.arccos(np.clip(sims[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(vec_col), pa.array(angle), pa.array(cell)], names=[id_col, vec_col, "angle", "cell"])

    schema = T.StructType([*kept, T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    assigned = vectors.select(id_col, vec_col).mapInArrow(assign, schema)
    assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    stored = spark.read.schema(schema).parquet(f"{path}/rows") if n_rows else assigned
    stats = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    table = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    table.join(stats, "cell", "right").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a row for each cell
    return VectorIndex(path, id_col, vec_col, probes)


def _nearest_cells(queries: DataFrame, query_id: str, query_vec: str, shared, probes: int, bounds: bool) -> DataFrame:
    """``q_id, q_vec, cell`` of the ``probes`` nearest cells; with ``bounds`` of every other cell that can hold
    a vector as similar as ``floor``."""
    fields = [T.StructField("q_id", queries.schema[query_id].dataType), T.StructField("q_vec", queries.schema[query_vec].dataType), T.StructField("cell", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centroids, radius = shared.value
        for batch in batches:
            m, at = _units(batch.column("q_vec"), centroids.shape[1])
            for k in range(0, len(m), 1024):
                sims = m[k:k + 1024] @ centroids.T
                near = np.zeros(sims.shape, dtype=bool)
                np.put_along_axis(near, np.argsort(-sims, axis=1, kind="stable")[:, :probes], True, axis=1)
                if bounds:
                    floor = np.asarray(batch.column("floor"), dtype=np.float64)[at[k:k + 1024]]
                    most = np.cos(np.maximum(np.arccos(np.clip(sims, -1, 1)) - radius - 1e-7, 0))
                    near = ~near & (most >= floor[:, None])
                q, c = np.nonzero(near)
                rows = pa.array(at[k:k + 1024][q])
                yield pa.RecordBatch.from_arrays([batch.column("q_id").take(rows), batch.column("q_vec").take(rows), pa.array(numbers[c])], names=["q_id", "q_vec", "cell"])

    extra = ["floor"] if bounds else []
    return queries.select(F.col(query_id).alias("q_id"), F.col(query_vec).alias("q_vec"), *extra).mapInArrow(run, T.StructType(fields))


def _compare(spark: SparkSession, index: VectorIndex, pairs: DataFrame, sizes: dict[int, int], k: int, digits: int,
             row_block: int, query_block: int) -> DataFrame:
    """Best ``k`` rows of each probed block for each question: ``query_id, <id>, similarity_score``."""
    asked = {r["cell"]: r["count"] for r in pairs.groupBy("cell").count().collect()}  # one row a cell
    plan = [(c, -(-sizes[c] // row_block), -(-n // query_block)) for c, n in asked.items()]
    # A row a cell, at most MAX_CELLS: small enough for a broadcast, whatever the tables hold.
    split = F.broadcast(spark.createDataFrame(plan, "cell int, n_rb int, n_qb int"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    block = lambda c, n, name: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(name)
    rows = index.rows(spark, sorted(asked)).join(split, "cell")
    left = rows.select(F.col(index.id_col).alias("c_id"), F.col(index.vec_col).alias("c_vec"), "cell", block(index.id_col, "n_rb", "rb"), every("n_qb", "qb"))
    right = pairs.join(split, "cell").select("q_id", "q_vec", "cell", block("q_id", "n_qb", "qb"), every("n_rb", "rb"))
    out = T.StructType([
        T.StructField("query_id", pairs.schema["q_id"].dataType),
        T.StructField(index.id_col, left.schema["c_id"].dataType),
        T.StructField("similarity_score", T.DoubleType()),
    ])
    keys = ["cell", "rb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_comparer(k, digits, out), out)


def search(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, exact: bool = False, query_id: str = "query_id",
           query_vec: str = "embedding", digits: int = 6, row_block: int = CORPUS_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, <id>, similarity_score`` of the ``k`` most similar rows in the probed cells (by default as
    many as the index was calibrated for), or of all rows with ``exact``. Ordered as :func:`voltframe.operators.retrieve.topk_cosine` orders them."""
    spark = queries.sparkSession
    cells = index.cells(spark)
    stored = spark.read.parquet(f"{index.path}/rows") if cells else None
    id_type = stored.schema[index.id_col].dataType.simpleString() if cells else "string"
    if not cells:
        return spark.createDataFrame([], f"query_id {queries.schema[query_id].dataType.simpleString()}, rank int, {index.id_col} {id_type}, similarity_score double")
    shared = spark.sparkContext.broadcast((
        np.array([c["cell"] for c in cells], dtype=np.int32), np.array([c["centroid"] for c in cells]), np.array([c["radius"] for c in cells])))
    sizes = {c["cell"]: c["n"] for c in cells}
    w = Window.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col(index.id_col).asc())
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    compare = lambda pairs: _compare(spark, index, pairs, sizes, k, digits, row_block, query_block)
    near = materialize(_nearest_cells(queries, query_id, query_vec, shared, probes or index.probes, False), "probed-cells")
    found = compare(near)
    if exact:
        found = materialize(best(found).drop("rank"), "probed-hits")
        worst = found.groupBy(F.col("query_id").alias("__q")).agg(F.min("similarity_score").alias("__least"), F.count(F.lit(1)).alias("__n"))
        floor = F.when(F.col("__n") == k, F.col("__least") - 0.51 * 10.0 ** -digits).otherwise(F.lit(-2.0))
        told = queries.select(query_id, query_vec).join(worst, F.col(query_id) == F.col("__q"), "left").select(query_id, query_vec, F.coalesce(floor, F.lit(-2.0)).alias("floor"))
        more = materialize(_nearest_cells(told, query_id, query_vec, shared, probes or index.probes, True), "bounded-cells")
        found = found.unionByName(compare(more))
    return best(found).select("query_id", "rank", index.id_col, "similarity_score")
