"""Registered queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame``.

Each query applies one operator, with production parameters, to its whole table and
derives the contract's digest columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm import conversation_repair, embedding_dedup, filter_audit, line_dedup, mixing, quality_rules, substring_dedup
from voltframe.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    import public_tokenizers

    from voltframe.llm import bpe

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


@register("op3_source_mix", oracle=mixing.ORACLE_SQL)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(materialize(sized, "mix-sizes"), "size").select("doc_id", "size", "source_size", "target", "taken")


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    from voltframe.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@register("op8_line_dedup", oracle=line_dedup.ORACLE_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that stand on ten distinct sources or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_dedup.remove_boilerplate(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op7_quality_rules", oracle=quality_rules.ORACLE_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged against their language's and source's own thresholds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: known shapes and strings that take too many tokens."""
    import public_tokenizers

    from voltframe.llm import bpe, secrets_scan

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = secrets_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("random"))


@register("op10_embedding_dedup", oracle=embedding_dedup.ORACLE_SQL)
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more among all vectors, and one vector kept of each group."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from voltframe.llm import html_text

    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


@register("op5_quality_model")
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    from voltframe.llm import quality_model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out("doc_id")))
    scored = quality_model.score(docs, model, keep_text=False)
    return scored.select(
        "doc_id", quality_model.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op4_substring_dedup", oracle=substring_dedup.ORACLE_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words that repeated 35-word windows cover."""
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@register("op12_filter_audit", oracle=filter_audit.ORACLE_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, by language, in each of their 120 orders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit(docs, labels)


@register("op11_conversation_repair", oracle=conversation_repair.ORACLE_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure of all conversations after damage, and their cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(conversation_repair.damage(rows), live_col="live")
    return found.select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("digest").alias("repaired_sha256"))


@register("op13_recurrent_lm")
def op13_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a recurrent model and under word counts, learned
    from the documents that are not held out."""
    from voltframe.llm import recurrent_lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = ~recurrent_lm.held_out("doc_id")
    model = recurrent_lm.learn_counts(docs.where(learned))
    encoded = recurrent_lm.encode(docs, model.counts)
    found = recurrent_lm.score_encoded(encoded, recurrent_lm.learn_weights(encoded.where(learned), model))
    return found.select("doc_id", recurrent_lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
