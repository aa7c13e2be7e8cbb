"""Resumable ingest: chunk, skip stored ids, vectorise the rest, append, report."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltframe.operators.chunks import chunk_windows, chunk_windows_with, page_windows
from voltframe.operators.layout import spread
from voltframe.operators.vectorize import hash_vectors
from voltframe.session import drop_materialized, materialize
from voltframe.sources.store import append_vectors, create_store, store_exists, stored_ids

STATS = "source_pdf string, n_chunks long, n_new long, n_skipped long"


def mark_new(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """``chunks`` plus ``is_new`` (id not yet stored), via a left join on the key."""
    known = store.select("chunk_id").distinct().withColumn("__known", F.lit(True))
    return chunks.join(known, "chunk_id", "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def ingest_stats(documents: DataFrame, chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Per document: ``source_pdf, n_chunks, n_new, n_skipped``. ``store`` needs ``chunk_id``
    only (the store itself or the stored ids that can match).

    ``documents`` lists every document seen (``source_pdf``); those without any chunk are
    kept with zeros, as the source counts them but embeds nothing.
    """
    return marked_stats(documents, mark_new(chunks, store))


def marked_stats(documents: DataFrame, marked: DataFrame) -> DataFrame:
    """:func:`ingest_stats` of chunks that carry ``is_new`` already."""
    per = marked.groupBy("source_pdf").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if("is_new").alias("n_new"),
    )
    docs = documents.select("source_pdf").distinct()
    return docs.join(per, "source_pdf", "left").select(
        "source_pdf",
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"),
        (F.coalesce("n_chunks", F.lit(0)) - F.coalesce("n_new", F.lit(0))).cast("long").alias("n_skipped"),
    )


def ingest_totals(stats: DataFrame) -> DataFrame:
    """Grand totals: documents, chunks, embedded, skipped."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n_chunks").alias("n_chunks"),
        F.sum("n_new").alias("n_embedded"),
        F.sum("n_skipped").alias("n_skipped"),
    )


def vectorize_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks plus their ``embedding`` (hashing vectoriser)."""
    return hash_vectors(chunks, "chunk_id", "text", keep=["source_pdf", "page_number", "chunk_index", "text"])


def one_page_each(pages: DataFrame) -> DataFrame:
    """One row per (document, page): of a page delivered more than once, the smallest text.

    Chunk ids are then unique within the batch, since each hashes its document, page and
    index.
    """
    return pages.groupBy("source_pdf", "page_number").agg(F.min("page_text").alias("page_text"))


class BatchNameReused(ValueError):
    """A batch name that stands for other pages already."""


def log_path(store_path: str, batch: str | None = None) -> str:
    """Where statistics of batches are kept: a folder a batch, named by the hash of its name."""
    root = f"{store_path.rstrip('/')}/_ingest_log"
    return root if batch is None else f"{root}/{hashlib.sha256(batch.encode()).hexdigest()[:32]}"


def batch_path(store_path: str, batch: str | None = None) -> str:
    """Where the batches themselves are kept (name, time, digest of the pages), as :func:`log_path`."""
    return log_path(store_path, batch).replace("/_ingest_log", "/_ingest_batches")


BATCHES = "batch string, written long, pages string"


def pages_digest(pages: DataFrame) -> str:
    """Digest of a table of pages, whatever the order of its rows."""
    h = lambda seed: F.sum(F.xxhash64("source_pdf", "page_number", "page_text", F.lit(seed)).cast("decimal(38,0)"))
    row = pages.agg(F.count(F.lit(1)), h(1), h(2)).first()
    return hashlib.sha256(repr([str(x) for x in row]).encode()).hexdigest()


def ingest(pages: DataFrame, store_path: str, batch: str | None = None, carries: DataFrame | None = None) -> DataFrame:
    """Ingest a page table into the store; returns per-document statistics.

    Chunks meet the stored ids in one join (of the buckets they can be in), which marks the
    new ones; statistics and append read the marks. Known chunks are never embedded again.

    The statistics are logged under the batch's name *before* anything is appended, with a
    digest of the batch's pages. A batch that is run again keeps the log of its first run:
    the append finds its chunks stored and adds none, so a replay changes neither store nor
    log. A name that was used for other pages is an error (:class:`BatchNameReused`); a
    batch without a name gets one of its own.

    ``carries`` (``source_pdf, page_number, carry``) replaces the carry between the pages of
    this batch by what is known from elsewhere (see :mod:`voltframe.streaming.carry`).

    The window and chunk tables in the shared folder are deleted at the end.
    """
    spark = pages.sparkSession
    name = batch if batch is not None else uuid.uuid4().hex
    digest = pages_digest(pages)
    first_run = not store_exists(spark, f"{batch_path(store_path, name)}/_SUCCESS")
    if not first_run:
        before = spark.read.schema(BATCHES).parquet(batch_path(store_path, name)).first()
        if before["pages"] != digest:
            raise BatchNameReused(f"batch {name!r} was ingested before with other pages")
    create_store(spark, store_path)
    # A micro-batch of a few large files is a few scan splits; give the chunker all cores.
    windows = materialize(page_windows(one_page_each(spread(pages))), "ingest-windows")
    chunked = chunk_windows(windows) if carries is None else chunk_windows_with(windows, carries)
    chunks = materialize(chunked, "ingest-chunks")
    marked = materialize(mark_new(chunks, stored_ids(spark, store_path, pages)), "ingest-marked")
    if first_run:
        marked_stats(pages, marked).write.mode("overwrite").parquet(log_path(store_path, name))
        known = spark.createDataFrame([(name, time.time_ns() // 1000, digest)], BATCHES)
        known.coalesce(1).write.mode("overwrite").parquet(batch_path(store_path, name))  # from here on the batch counts as logged
    append_vectors(vectorize_chunks(marked.where("is_new").drop("is_new")), store_path)
    drop_materialized(windows, chunks, marked)
    return spark.read.schema(STATS).parquet(log_path(store_path, name))


def ingest_log(spark: SparkSession, store_path: str, names: bool = False) -> DataFrame:
    """Statistics of every batch with running totals, in the order in which batches were first
    logged: ``batch_id`` (0, 1, ...), ``n_chunks, n_embedded, n_skipped, embedded_so_far,
    skipped_so_far``, and with ``names`` the ``batch``'s name. A batch without documents counts."""
    deep = lambda schema, path: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder")
    batches = deep(BATCHES, batch_path(store_path)).select("batch", "written", folder)
    stats = deep(STATS, log_path(store_path)).select("*", folder).groupBy("folder").agg(
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_new").alias("n_embedded"), F.sum("n_skipped").alias("n_skipped"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_embedded", "n_skipped")]
    per_batch = batches.join(stats, "folder", "left").select("batch", "written", *zero)
    order = Window.orderBy("written", "batch")  # one row per batch
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return per_batch.select(
        (F.row_number().over(order) - 1).cast("long").alias("batch_id"), "n_chunks", "n_embedded", "n_skipped",
        F.sum("n_embedded").over(running).alias("embedded_so_far"), F.sum("n_skipped").over(running).alias("skipped_so_far"),
        *(["batch"] if names else []),
    )
