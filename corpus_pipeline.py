"""Training-data pipeline over ``documents``.

Each stage takes the documents its predecessor kept and returns documents (the last one
their token ids). ``run`` writes every stage's result to the shared folder and reads it
back, so that a lost executor costs tasks of one stage and no stage runs twice.

SQL expresses neither the learned scores nor the fingerprints, so there is no oracle for
the whole; each stage is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm import bpe, line_dedup, mixing, quality_model, simhash
from voltframe.session import materialize

MIN_SCORE = 0.7
SHINGLE, RADIUS = 3, 2

ORACLE_SQL = None


def _as_before(result: DataFrame, docs: DataFrame) -> DataFrame:
    """``result`` with the columns of ``docs`` in their order. A further column that is named
    like one that a stage's operator adds is lost to the operator's own."""
    return result.select(*[c for c in docs.columns if c in result.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The model learns from the labels of this stage's documents that are not held out.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out("doc_id")))
    scored = quality_model.score(docs, model, score_col="__score")
    return _as_before(scored.where(F.col("__score") >= MIN_SCORE), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many distinct sources; ``n_chars`` follows."""
    cleaned = line_dedup.remove_boilerplate(docs).drop("n_lines", "n_removed")
    return _as_before(cleaned.withColumn("n_chars", F.length("text").cast("long")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and of rows
    that repeat that id in the group the one with the smallest text.

    Rows are told apart by id and fingerprint, so rows of one id stand each in the group of
    their own text. Rows without an id go if their group has a document with one; a group
    without any id keeps its smallest text.
    """
    prints = materialize(simhash.with_fingerprints(docs.select("doc_id", "text"), SHINGLE), "near-duplicate-prints")
    # Groups are named by a fingerprint: an id may stand in more than one.
    found = materialize(simhash.link_components(prints, RADIUS, "fp").withColumnRenamed("component_id", "group"), "near-duplicates")
    first = found.groupBy("group").agg(F.min("doc_id").alias("__id"))
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    again = repeated.limit(1).count() > 0
    nameless = first.where(F.col("__id").isNull()).limit(1).count() > 0
    unique = first.where(F.col("__id").isNotNull()).select("__id")
    if again:
        unique = unique.join(repeated, F.col("__id") == F.col("doc_id"), "left_anti")
    named = docs.join(unique, F.col("doc_id") == F.col("__id"), "left_semi")
    if not (again or nameless):
        return named
    # Ids that do not tell rows apart: the rows' fingerprints are needed.
    unclear = docs.where(F.col("doc_id").isNull()).unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    marked = simhash.with_fingerprints(unclear.withColumn("__text", F.col("text")), SHINGLE, "__text", "__fp")
    least = F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("__row")
    rows = marked.groupBy("doc_id", "__fp").agg(least).withColumnRenamed("doc_id", "__doc")
    chosen = found.join(first, "group").where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "fp", "group").distinct()
    met = rows.join(chosen, F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__fp") == F.col("fp")))
    return named.unionByName(met.groupBy("group").agg(F.min("__row").alias("__row")).select("__row.*").select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    sized = docs.withColumn("__size", mixing.word_count("text"))
    return _as_before(mixing.emit(mixing.mix(sized, "__size")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary, public_tokenizers.PATTERN, keep_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
