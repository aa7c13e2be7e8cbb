"""Source mix and line dedup against their SQL and their own rules."""

from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from voltframe.llm import line_dedup, mixing

from .common import ROWS, SCHEMA, clashing, frame

COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def sql_rows(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows])
    return con.sql(sql).df()


def same(a: pd.DataFrame, b: pd.DataFrame):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    number = lambda r: tuple(x[:-2] if x.endswith(".0") else x for x in r)
    assert sorted(map(number, rows(a))) == sorted(map(number, rows(b)))


def mixed(df, **kw):
    sized = df.select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix(sized, "size", **kw)


def test_mix_equals_sql_on_edge_rows(spark):
    many = ROWS + [(100 + i, "w " * (i % 40), "en", f"s{i % 7}", 1) for i in range(300)] + [(500 + i, "hot " * 9, "en", "hot", 1) for i in range(200)]
    for rows in (ROWS, many):
        for bucket in (4096, 3):
            got = mixed(frame(spark, rows), rows_per_bucket=bucket).select("doc_id", "size", "source_size", "target", "taken").toPandas()
            same(got, sql_rows(mixing.ORACLE_SQL, rows))


def test_mix_properties(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{i % 5 if i % 3 else 0}", 1) for i in range(3000)]
    out = mixed(frame(spark, rows)).toPandas()
    by = out.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 60).all()  # about one document
    assert (by.target <= 3 * by["size"] + 1e-6).all() and abs(by.target.sum() - out["size"].sum()) < 1e-6
    assert (out.taken <= 3 * out["size"]).all()
    again = mixed(frame(spark, rows).repartition(7)).toPandas()
    same(out, again)


def test_mix_emits_copies_and_keeps_columns(spark):
    df = clashing(frame(spark), ["target", "taken", "copies"]).withColumn("n", mixing.word_count("text"))
    result = mixing.mix(df, "n")
    assert {"text", "lang", "copies", "size"} <= set(result.columns)
    copies = result.agg(F.sum("copies")).first()[0]
    assert mixing.emit(result).count() == copies
    assert mixing.mix(df.limit(0), "n").count() == 0


def test_lines_equal_sql_on_edge_rows(spark):
    shared = [(100 + i, f"own {i}\nEverywhere\n\n  \nTwo words\nown {i}", "en", f"s{i % 12}", 1) for i in range(60)]
    shared += [(200 + i, "Nine sites", "en", f"s{i % 9}", 1) for i in range(30)] + [(300, "Everywhere", "en", None, 1), (301, "Everywhere\n\nTwo words", "en", "x", 1)]
    for rows in (ROWS, [r for r in ROWS if r[0] not in (None, 6)] + shared):
        unique = [r for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1]
        got = line_dedup.remove_boilerplate(frame(spark, unique))
        got = got.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")).toPandas()
        same(got, sql_rows(line_dedup.ORACLE_SQL, unique))


def test_lines_near_threshold_repeats_and_columns(spark):
    rows = [(i, "Ten sites\nbody", "en", f"s{i}", 1) for i in range(10)] + [(50 + i, "Nine sites\nbody x", "en", f"s{i}", 1) for i in range(9)]
    rows += [(1, "Ten sites\nanother body", "en", "s1", 1), (None, "Ten sites\nno id", "en", "s1", 1), (None, None, None, None, None)]
    df = clashing(frame(spark, rows), ["n_lines", "a", "b", "__x"])
    out = {(r.doc_id, r.text) for r in line_dedup.remove_boilerplate(df, keep_whole_copies=False).collect()}
    assert (1, "another body") in out and (None, "no id") in out and (None, None) in out
    assert (3, "") in out  # "body" stands on ten sites as well
    assert (52, "Nine sites\nbody x") in out
    assert {r.text for r in line_dedup.remove_boilerplate(df).where("doc_id = 3").collect()} == {"Ten sites\nbody"}  # a whole copy
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_lines_of_long_documents_cost_in_proportion(spark):
    """Twelve long documents of shared lines, and many rows without an id."""
    import time

    long = "\n".join(f"line {i}" for i in range(20_000))
    rows = [(i, f"{long}\nown {i}", "en", f"s{i}", 1) for i in range(12)]
    rows += [(None, f"line {i}\nown text {i}\n\nline {i}", "en", f"s{i % 3}", 1) for i in range(300)]
    began = time.time()
    out = line_dedup.remove_boilerplate(frame(spark, rows)).collect()
    assert time.time() - began < 60
    assert sorted(r.text for r in out if r.doc_id is not None) == sorted(f"own {i}" for i in range(12))
    assert sorted(r.text for r in out if r.doc_id is None) == sorted(f"own text {i}\n" for i in range(300)) and {r.n_removed for r in out} == {20_000, 2}
