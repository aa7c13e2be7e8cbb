"""The chunk-vector store: a Parquet table keyed by ``chunk_id``, in buckets by document.

An id hashes the chunk's text, so a stored row never changes: upsert is an anti-join
plus append, and a re-run (or a replayed micro-batch) adds nothing twice. Changed
documents add new chunks and leave the old ones (nothing is pruned implicitly).

Layout: ``<path>/bucket=<n>/``, where the bucket hashes the part of the document's name up
to its first ``|``. An id hashes ``source|page|index|text``, so equal ids agree in that
part, and an id can only be stored in its own document's bucket: the anti-join of a batch
reads the ids of the buckets that its documents fall into and no others (partition
pruning). What an ingest reads thus follows its documents, not the store. The number of
buckets is fixed when the store is created and kept beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.schema import CHUNK_VECTORS

STORE_BUCKETS = 256


def store_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}/_layout"


def create_store(spark: SparkSession, path: str, buckets: int = STORE_BUCKETS) -> int:
    """Number of buckets of the store at ``path``; an absent store is created with ``buckets``."""
    if not store_exists(spark, f"{_layout_path(path)}/_SUCCESS"):
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(_layout_path(path))
    return spark.read.schema("buckets int").parquet(_layout_path(path)).first()["buckets"]


def bucket_of(source: Column | str, buckets: int) -> Column:
    """Bucket of a document's chunks."""
    return F.pmod(F.xxhash64(F.substring_index(source, "|", 1)), F.lit(buckets)).cast("int")


def _has_rows(spark: SparkSession, path: str) -> bool:
    return store_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunk vectors; an empty frame with the declared schema if none exist yet."""
    if not _has_rows(spark, path):
        return spark.createDataFrame([], CHUNK_VECTORS)
    return spark.read.schema(CHUNK_VECTORS).parquet(path).select(*CHUNK_VECTORS.names)


def stored_ids(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """``chunk_id`` of the stored chunks in the buckets of ``documents`` (``source_pdf``), which are
    all that their chunks can meet. At most as many bucket numbers as there are buckets come
    to the driver; no other bucket's files are read."""
    if not _has_rows(spark, path):
        return spark.createDataFrame([], "chunk_id string")
    buckets = create_store(spark, path)
    touched = sorted(r["b"] for r in documents.select(bucket_of("source_pdf", buckets).alias("b")).distinct().collect())
    return spark.read.schema("chunk_id string, bucket int").parquet(path).where(F.col("bucket").isin(touched)).select("chunk_id")


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet (set difference on the key, a left-anti join whose
    strategy is left to adaptive execution; only ``chunk_id`` is read from the store)."""
    return chunks.join(store.select("chunk_id"), "chunk_id", "left_anti")


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append rows to the store (callers anti-join first).

    Rows are dealt out by bucket, small buckets together and large ones in parts, so a
    batch writes few files and one document does not fill a task."""
    buckets = create_store(vectors.sparkSession, path)
    rows = vectors.select(*[f.name for f in CHUNK_VECTORS.fields], bucket_of("source_pdf", buckets).alias("bucket"))
    rows.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def list_documents(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """Files matching ``glob`` directly in ``directory`` (non-recursive): ``path, source_pdf``.

    Only file metadata is read (the content column is pruned). Rows are in name order.
    Raises when none match.
    """
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "false")
        .load(directory)
        .select("path", F.col("_metadata.file_name").alias("source_pdf"))
    )
    if df.isEmpty():
        raise FileNotFoundError(f"No {glob} files found in {directory}")
    return df.orderBy("source_pdf")
