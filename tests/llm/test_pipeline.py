"""Every pipeline stage against a brute-force version, on documents with planted cases."""

from __future__ import annotations

import tempfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltframe.llm import bpe, mixing, quality_model

from ..conftest import SF001
from .common import WORD, SCHEMA, groups
from .test_bpe import PATTERN, VOCABULARY, reference
from .test_mixing_lines import same, sql_rows
from .test_simhash import brute_fingerprint

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PROSE = "the cat sat on the mat and it was the best of all the mats that were in the house at that time of the year"


@pytest.fixture(scope="module")
def folder(spark):
    """The small tables plus copies, near copies, lines of many sites, and edge rows."""
    path = tempfile.mkdtemp(prefix="vf-pipeline-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(*COLUMNS)
    rows = [(9000 + i, f"Shared by all sites.\nText number {i}: {PROSE} {i}", "en", f"site{i}", 1) for i in range(12)]
    rows += [(9100 + i, f"{PROSE} {PROSE} copy", "en", f"site{i}", 1) for i in range(5)]
    rows += [(9200, "an id twice, " + PROSE, "en", "x", 1)] * 2 + [(9201, None, None, None, None), (9202, "", "en", "x", 0), (None, "no id, " + PROSE, "en", None, 1)]
    docs.union(spark.createDataFrame(rows, SCHEMA)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF001}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def tuples(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        out.append((docs, result))
        docs = result
    return out


def test_quality_keeps_what_scores_enough(spark, folder, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality_model.fit(before, labels.where(~quality_model.held_out("doc_id")))
    want = [r for r in tuples(before) if round(float(model.score(*quality_model.encode_passages([r[1]]))[0]), 6) >= 0.7]
    assert tuples(after) == want and 0 < len(want) < before.count()
    quality = dict(labels.select("doc_id", "quality").collect())
    kept = {r[0] for r in want}
    assert all(k in kept for k, q in quality.items() if q) and not any(k in kept for k, q in quality.items() if not q)


def test_lines_of_many_sources_go(stages):
    before, after = stages[1]
    sites = defaultdict(set)
    for r in before.collect():
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                sites[line].add(r.source)
    want = []
    for r in before.collect():
        lines = (r.text or "").split("\n")
        full = [x for x in lines if WORD.search(x)]
        gone = [x for x in full if len(sites[x]) >= 10]
        text = r.text if len(gone) in (0, len(full)) else "\n".join(x for x in lines if x not in gone)
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert tuples(after) == sorted(want, key=str)
    assert "Shared by all sites." not in {x for r in after.collect() for x in (r.text or "").split("\n")}


def test_one_document_of_each_near_duplicate_group_stays(stages):
    before, after = stages[2]
    rows = sorted(set(tuples(before)), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = []
    for own in groups(len(rows), near):
        named = [i for i in own if rows[i][0] is not None]
        want += [rows[min(named, key=lambda i: rows[i][0])]] if named else [rows[i] for i in own]
    assert tuples(after) == sorted(want, key=str)
    copies = [r[0] for r in tuples(after) if r[0] is not None and 9100 <= r[0] < 9200]
    assert copies == [9100]


def test_repeated_and_missing_ids_lose_no_text(spark, folder):
    """Rows of one id with different texts, and groups without any id."""
    other = " ".join(f"unlike{i * i}" for i in range(60))
    third = " ".join(f"third{i * 7}" for i in range(60))
    rows = [
        (1, f"{PROSE} {PROSE}", "en", "a", 1), (5, f"{PROSE} {PROSE}", "en", "b", 1), (5, other, "en", "c", 1),  # the unique one of 5 stays
        (6, third, "en", "x", 1), (6, third + "\n", "en", "x", 2), (7, third, "en", "y", 1),  # one row of a repeated id
        (None, "no id here at all", "en", "p", 1), (None, "no id here at all", "en", "q", 1), (None, "no id here at all", "de", "r", 1),
        (None, other, "en", "z", 1), (8, "alone", "en", "a", 1), (9, "", "en", "a", 1), (9, None, "en", "a", 1),
    ]
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("group", F.lit(2))
    got = corpus_pipeline.near_duplicates(spark, wide, folder)
    want = [rows[0], rows[2], rows[3], rows[8], rows[10], rows[12]]
    assert tuples(got) == sorted(want, key=str) and got.columns == wide.columns


def test_mix_takes_copies_like_its_sql(stages):
    before, after = stages[3]
    taken = sql_rows(mixing.ORACLE_SQL, [tuple(r) for r in before.select(*COLUMNS).collect()])
    got = mixing.mix(before.withColumn("n", mixing.word_count("text")), "n").select("doc_id", "size", "source_size", "target", "taken").toPandas()
    same(got, taken)
    words = after.withColumn("n", mixing.word_count("text")).agg(F.sum("n")).first()[0]
    assert words == taken.taken.sum()
    assert set(tuples(after)) <= set(tuples(before))


def test_encoding_equals_the_library(stages):
    before, after = stages[4]
    encode = reference()
    want = sorted(((r.doc_id, r.source, encode(r.text or "")) for r in before.collect()), key=str)
    assert sorted(((r.doc_id, r.source, r.ids) for r in after.collect()), key=str) == want
    assert after.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    back = bpe.decode(after.select("doc_id", "ids"), VOCABULARY, PATTERN).select(F.sha2("decoded", 256).alias("h"))
    assert sorted(r.h for r in back.collect()) == sorted(r.decoded_sha256 for r in after.collect())


def test_stages_on_empty_and_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:4]:
        wide = docs.limit(40).withColumns({c: F.lit(1) for c in ("n_lines", "fp", "copies", "target", "size")})
        result = stage(spark, wide, folder)
        assert result.columns[:5] == COLUMNS and set(result.columns) <= set(wide.columns) and result.count() > 0


def test_registered_as_pipeline():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert [n for n in entry.queries() if n.startswith("op")] and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in entry.queries()}
