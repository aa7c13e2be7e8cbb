"""Incremental ingest over a growing directory (Structured Streaming).

New page files are picked up by a file-source stream; each micro-batch is ingested
with :func:`voltframe.operators.ingest.ingest`, whose anti-join against the store makes a
replayed batch a no-op, so the sink is idempotent under at-least-once delivery. The
stream's checkpoint records which files were processed. Per-batch statistics are logged
once, under the query's id and the batch's number, so several streams (and streams with a
new checkpoint) can feed one store.

The pages of a document may arrive in several files and micro-batches: the carry between
pages comes from keyed state (:mod:`voltframe.streaming.carry`). In the stream a page
travels as it is, and beside it, from the stateful operator, the text carried into it; the
two meet in the micro-batch. A micro-batch is written to the shared folder before anything
reads it, so the stateful operator runs once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.operators.ingest import ingest, ingest_log
from voltframe.schema import PAGES
from voltframe.session import drop_materialized, materialize
from voltframe.streaming.carry import carries

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def query_id(spark: SparkSession, checkpoint_location: str) -> str:
    """Id of the streaming query that owns a checkpoint; it stays the same over restarts."""
    return json.loads(spark.read.text(f"{checkpoint_location.rstrip('/')}/metadata").first()[0])["id"]


def ingest_stream(
    spark: SparkSession,
    source_dir: str,
    store_path: str,
    checkpoint_location: str,
    to_pages: Callable[[DataFrame], DataFrame] | None = None,
    source_format: str = "parquet",
    source_schema=PAGES,
    glob: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    split_documents: bool = True,
):
    """Start (and with ``available_now`` run to completion) the incremental ingest.

    ``to_pages`` maps source rows to ``(source_pdf, page_number, page_text)`` when the
    files hold something else. ``max_files_per_trigger`` bounds a micro-batch. Where every
    document is known to arrive whole in one file, ``split_documents=False`` saves the keyed
    state; the state store is RocksDB, which keyed state needs. Returns the finished (or
    running) ``StreamingQuery``.
    """
    reader = spark.readStream.format(source_format).schema(source_schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(source_dir)
    pages = (to_pages(stream) if to_pages else stream).select("source_pdf", F.col("page_number").cast("int").alias("page_number"), "page_text")
    null = F.lit(None).cast("string")
    both = pages.select("*", null.alias("carry"), F.lit(True).alias("is_page"))
    if split_documents:
        both = both.unionByName(carries(pages).select("source_pdf", "page_number", null.alias("page_text"), "carry", F.lit(False).alias("is_page")))
        spark.conf.set(STATE_STORE, ROCKSDB)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        landed = materialize(batch, "stream-batch")
        ingest(
            landed.where("is_page").select("source_pdf", "page_number", "page_text"), store_path,
            batch=f"{query_id(spark, checkpoint_location)}/{batch_id}",
            carries=landed.where("NOT is_page").select("source_pdf", "page_number", "carry") if split_documents else None)
        drop_materialized(landed)

    writer = both.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


__all__ = ["ingest_log", "ingest_stream", "query_id"]
