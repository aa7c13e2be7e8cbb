"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

1. Vectors that are equal component by component become one row with a count, so a group
   of exact copies costs one row whatever its size.
2. Unit centroids are fitted on a bounded sample (``sample_per_cell`` vectors for each
   cell, at most ``MAX_CELLS`` cells and ``MAX_SAMPLE_VALUES`` numbers); the number of cells grows with the number of
   vectors up to that bound. Every vector is assigned, not only the sample.
3. A vector's home is its nearest cell. It also visits every cell whose boundary with the
   home cell it lies close to: the distance to the bisecting plane is at most ``visit``.
   For a pair at the threshold t on two sides of a plane, one of the two is within
   sqrt(2 - 2t) / 2 of it (0.224 at 0.9), so that margin, the default, finds every pair
   whatever the vectors' distribution. A smaller ``visit`` costs less and loses pairs, the
   more the fewer dimensions the vectors really span.
   Neighbouring cells form regions of about ``block_rows`` vectors, and a vector travels
   once to each region with a cell it visits, not to each cell: within a region all of its
   rows at home meet anyway. From here on ``cell`` stands for the region.
4. The rows at home in a region and its visitors are cut into blocks of ``block_rows`` by a
   hash of the id, and each pair of blocks with rows at home is a task of its own, so no
   task holds a region. Within a task matrix products give the cosines of its rows at home with all others, some
   two million at a time; links are counted and groups joined as they are found, so no task holds the pairs of a dense region.
   Two vectors with the same home are compared there;
   two with different homes where one visits the other's home, and counted in one cell
   only. What leaves a task is one count per vector and a spanning forest of its links.
5. The forests become components, and a component's smallest id is its representative.

A cell's work grows with the square of its rows, in tasks of bounded size: that is the
price of comparing all of a dense region, and more cells lower it.

Edge cases: a vector that is null, empty, all zero, or holds a null or non-finite
component links with nothing and is kept. Vectors of different lengths are never linked.
Repeated ids are rows of their own (each counts as another vector); rows without an id are
not linked. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.llm.components import components, forest
from voltframe.session import materialize

MAX_CELLS = 4096
ROWS_PER_CELL = 256
SAMPLE_PER_CELL = 16
MAX_SAMPLE_VALUES = 4_000_000  # numbers of the sample that the driver fits the cells on
ROUNDING = 1e-9  # of cosines, so that a pair at the very margin is found
BLOCK_ROWS = 8192
STEP_PRODUCTS = 2_000_000  # cosines, and pairs found among them, held at once
SENT_ROWS = 8192  # rows of one batch that leaves the assignment


def _units(lists, dim: int) -> np.ndarray:
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)
    # Scaling by the largest component first keeps very large or small vectors finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids of the unit rows of ``x``."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[a:a + 4096] @ centre.T, axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        full = size > 1e-9
        centre[full] = total[full] / size[full, None]
    return centre


def regions(centre: np.ndarray, rows: int, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The region of each cell: neighbouring centroids, about ``block_rows`` of ``rows`` vectors together."""
    around = spherical_kmeans(centre, max(1, -(-rows // block_rows)))
    return np.argmax(centre @ around.T, axis=1)


def fit_cells(vectors: DataFrame, rows_per_cell: int = ROWS_PER_CELL, max_cells: int = MAX_CELLS,
              sample_per_cell: int = SAMPLE_PER_CELL, block_rows: int = BLOCK_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centroids and the regions they belong to by vector length, from a sample of at most ``max_cells * sample_per_cell``
    vectors and ``MAX_SAMPLE_VALUES`` numbers."""
    n, widest = vectors.agg(F.count(F.lit(1)), F.max("dim")).first()
    cells = max(1, min(max_cells, -(-n // rows_per_cell), MAX_SAMPLE_VALUES // max(widest or 1, 1)))
    rows = min(cells * sample_per_cell, max(1, MAX_SAMPLE_VALUES // max(widest or 1, 1)))
    sample = vectors.select("dim", "embedding").orderBy(F.xxhash64("embedding", F.lit(5))).limit(rows).toArrow()
    dims = np.asarray(sample.column("dim"))
    out = {}
    for dim in np.unique(dims).tolist():
        own = sample.filter(pa.array(dims == dim)).column("embedding").combine_chunks()
        centre = spherical_kmeans(_units(own, dim), max(1, cells * len(own) // len(dims)))
        out[dim] = centre, regions(centre, n * len(own) // len(dims), block_rows)
    return out


def exact_visit(threshold: float) -> float:
    """The least margin at which every pair with a cosine of ``threshold`` or more meets."""
    return math.sqrt(max(2 - 2 * threshold, 0)) / 2


def assign(vectors: DataFrame, fitted: dict[int, tuple[np.ndarray, np.ndarray]], visit: float) -> DataFrame:
    """Rows ``dim, cell, home, visits, rep, weight, embedding``: one for the home region and
    one for each region visited. A length without centroids has one region, -1."""
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)  # at most MAX_CELLS vectors

    def placed(table: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        if dim not in sent.value:
            home, who, cell = np.full(n, -1), np.arange(n), np.full(n, -1)
        else:
            centre, region = sent.value[dim]
            near = _units(table.column("embedding"), dim) @ centre.T
            nearest = near.argmax(axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * (centre[nearest] @ centre.T), 0))
            inside = near[np.arange(n), nearest][:, None] - near <= visit * apart + ROUNDING
            home = region[nearest]
            met = np.zeros((n, int(region.max()) + 1), dtype=bool)
            for k in range(met.shape[1]):
                met[:, k] = inside[:, region == k].any(axis=1)
            met[np.arange(n), home] = True
            who, cell = np.nonzero(met)
        ends = np.searchsorted(who, np.arange(n + 1))
        visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell, pa.int32()))
        for at in range(0, len(who), SENT_ROWS):
            own = who[at:at + SENT_ROWS]
            picked = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [table.column("dim").take(picked), pa.array(cell[at:at + SENT_ROWS], pa.int32()), pa.array(home[own], pa.int32()),
                 visits.take(picked), *(table.column(c).take(picked) for c in ("rep", "weight", "embedding"))],
                names=["dim", "cell", "home", "visits", "rep", "weight", "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                table = batch.filter(pa.array(dims == dim))
                step = max(1, STEP_PRODUCTS // len(sent.value[dim][0]) if dim in sent.value else table.num_rows)
                for at in range(0, table.num_rows, step):
                    yield from placed(table.slice(at, step), dim)

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(run, f"dim int, cell int, home int, visits array<int>, rep long, weight long, embedding {kind}")


def _compare(x: pa.Table, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, links, u, v)`` of one pair of blocks: rows of block 0 against rows of block 1
    (or block 0 against itself)."""
    dim = x.column("dim")[0].as_py()
    cell = x.column("cell")[0].as_py()
    side = np.asarray(x.column("side"))
    ids, weight, home = (np.asarray(x.column(c)) for c in ("rep", "weight", "home"))
    vec = _units(x.column("embedding").combine_chunks(), dim)
    visits = x.column("visits").combine_chunks()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    # Only pairs with a row at home count: rows at home of one side against the other side.
    pairs = [(left[home[left] == cell], right, False)]
    if not same:
        pairs.append((right[home[right] == cell], left, True))
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[by_id] = np.arange(len(ids))
    # (row, region it visits) as one sorted number each, to look pairs up in.
    sizes = np.diff(np.asarray(visits.offsets))
    wide = int(max(home.max(initial=0), cell, 0)) + 2
    visited = np.sort(np.repeat(np.arange(len(ids)), sizes) * wide + np.asarray(visits.flatten(), dtype=np.int64))
    links, label = np.zeros(len(ids)), np.arange(len(ids))
    for own, others, swapped in pairs:
        step = max(1, STEP_PRODUCTS // max(len(others), 1))
        for at in range(0, len(own), step):
            i, j = np.nonzero(vec[own[at:at + step]] @ vec[others].T >= threshold)
            a, b = own[at + i], others[j]
            # Two rows at home meet twice: once from either side.
            keep = (home[b] != cell) | ((a < b) if same else np.full(len(a), not swapped))
            # One at home: counted in the smaller of the two home cells, or here if the pair does not meet in that one.
            guest = np.flatnonzero(keep & (home[b] != cell) & (home[b] < cell))
            asked = a[guest] * wide + home[b[guest]]
            place = np.minimum(np.searchsorted(visited, asked), max(len(visited) - 1, 0))
            keep[guest[visited[place] == asked] if len(visited) else guest[:0]] = False
            a, b = a[keep], b[keep]
            links += np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            # Only roots that this step joins: in a dense group, few after the first steps.
            u, v = label[rank[a]], label[rank[b]]
            apart = u != v
            if apart.any():
                label = forest(len(ids), u[apart], v[apart])[label]
    linked = np.flatnonzero(links)
    node = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], links[linked].astype(np.int64), ids[by_id[node]], ids[by_id[label[node]]]


def cell_links(assigned: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``edge, a, b``: an edge between ids, or (``edge`` false) an id and its links."""
    place, at_home = ["dim", "cell"], F.col("home") == F.col("cell")
    cut = lambda of: F.ceil(F.count(F.when(of, 1)) / F.lit(block_rows)).cast("int")
    blocks = assigned.groupBy(*place).agg(cut(at_home).alias("own"), cut(~at_home).alias("guests")).where("own > 0")
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rows = assigned.join(blocks, place).withColumn("block", F.when(at_home, part("own")).otherwise(F.col("own") + part("guests")))
    # Blocks of visitors meet those of rows at home only.
    others = F.sequence(F.lit(0), F.when(at_home, F.col("own") + F.col("guests")).otherwise(F.col("own")) - 1)
    tasks = rows.withColumn("other", F.explode(others)).select(
        *place, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "home", "visits", "rep", "weight", "embedding")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, links, u, v = _compare(table, threshold, key[2].as_py() == key[3].as_py())
        return pa.table({"edge": np.concatenate([np.zeros(len(ids), bool), np.ones(len(u), bool)]),
                         "a": np.concatenate([ids, u]).astype(np.int64), "b": np.concatenate([links, v]).astype(np.int64)})

    return tasks.groupBy(*place, "one", "two").applyInArrow(run, "edge boolean, a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding",
                    visit: float | None = None, rows_per_cell: int = ROWS_PER_CELL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``; ``visit`` is
    :func:`exact_visit` of the threshold unless given."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    vec = F.col(vec_col)
    usable = F.coalesce(
        F.col(id_col).isNotNull() & vec.isNotNull() & F.forall(vec, finite) & F.exists(vec, lambda c: c != 0), F.lit(False))
    keyed = vectors.select(
        F.col(id_col).cast("long").alias("id"), vec.alias("embedding"), usable.alias("usable"))
    # Zeros of either sign are one value.
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    plain = F.transform("embedding", lambda c: F.when(c == 0, F.lit(0).cast(kind)).otherwise(c))
    keyed = keyed.withColumn("embedding", F.when(F.col("usable"), plain))
    keyed = keyed.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.reverse("embedding")))
    keyed = materialize(keyed, "vectors")
    good = keyed.where("usable")
    distinct = good.groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    distinct = materialize(distinct.withColumn("dim", F.size("embedding")), "vector-classes")
    assigned = assign(distinct.select("dim", "rep", "weight", "embedding"), fit_cells(distinct, rows_per_cell, block_rows=block_rows),
                      exact_visit(threshold) if visit is None else visit)
    links = materialize(cell_links(materialize(assigned, "vector-cells"), threshold, block_rows), "vector-links")

    counts = links.where(~F.col("edge")).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    joined = components(links.where("edge").select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = (
        distinct.select("k1", "k2", "rep", "weight")
        .join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("component", "rep").alias("component"))
    )
    out = keyed.select("id", "usable", "k1", "k2").join(classes.withColumn("usable", F.lit(True)), ["usable", "k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("component", "id").eqNullSafe(F.col("id"))).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x,
           coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
                    AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS usable
    FROM embeddings),
u AS (SELECT r, x, len(x) AS dim FROM v WHERE usable),
e AS (SELECT a.r AS p, b.r AS q FROM u a JOIN u b ON a.dim = b.dim AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT p, q FROM e UNION SELECT reach.p, e.q FROM reach JOIN e ON reach.q = e.p),
c AS (SELECT p, min(o.vec_id) AS least FROM reach JOIN v o ON o.r = reach.q GROUP BY p),
n AS (SELECT p, count(*) AS links FROM e GROUP BY p)
SELECT v.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id,
       least(v.vec_id, coalesce(c.least, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.p = v.r LEFT JOIN c ON c.p = v.r
"""
