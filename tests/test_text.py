"""Whitespace classes, normalisation, tokens, stems and tags."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voltframe.constants import NOT_WS, WS, WS_CHARS_RE2
from voltframe.functions import text as TX


def test_whitespace_class_equals_python_isspace(spark):
    # Every BMP code point (surrogates excluded): Spark's class must agree with str.isspace.
    cps = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in cps], "cp int, ch string")
    got = {r.cp for r in df.where(F.col("ch").rlike("^" + WS + "$")).select("cp").collect()}
    want = {c for c in cps if chr(c).isspace()}
    assert got == want
    not_ws = {r.cp for r in df.where(F.col("ch").rlike("^" + NOT_WS + "$")).select("cp").collect()}
    assert not_ws == set(cps) - want


def test_re2_spelling_lists_the_same_set():
    want = {c for c in range(0x10000) if chr(c).isspace()}
    pattern = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\x" if False else chr(int(m.group(1), 16)),
                                       WS_CHARS_RE2) + "]")
    got = {c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF and pattern.fullmatch(chr(c))}
    assert got == want


def test_normalised_text_by_hand(spark):
    samples = {
        "one   two\t \tthree\n\n\n four\t\n": "one two three\n four",
        "a\tb\nline\x0bup\x85next\x1cfile\u2028end\u00a0": "a\tb\nline\nup\nnext\nfile\nend",
        "hard blank\u00a0\u00a0\nleft  \x1f\n   \n": "hard blank\nleft",
        "": "",
        "\r\nfirst\r\nsecond\rthird": "first\nsecond\nthird",
        "   \n\t": "",
    }
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = {r.t: r.n for r in df.select("t", TX.normalize_text("t").alias("n")).collect()}
    assert got == samples
    assert df.select(TX.normalize_text(F.lit(None).cast("string"))).first()[0] == ""


def test_tokens_are_lossless_on_normalised_text(spark):
    df = spark.createDataFrame([("  lead one two\nthree\u3000four",)], "t string")
    row = df.select(TX.tokenize("t").alias("tok")).select("tok", TX.detokenize("tok").alias("back")).first()
    assert row.back == "  lead one two\nthree\u3000four"
    assert row.tok == ["  lead", " one", " two", "\nthree", "\u3000four"]


def test_file_stem_and_citation_tag(spark):
    names = ["a.tar.gz", ".hidden", "noext", "may2026.pdf", "some_other_file.pdf", "dir/x.pdf", "a..b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(TX.file_stem("n")).collect()]
    assert got == ["a.tar", ".hidden", "noext", "may2026", "some_other_file", "x", "a."]
    tag = df.limit(1).select(TX.citation_tag(F.lit("Silver Star"), F.lit(4))).first()[0]
    assert tag == "[Silver Star p.4]"


def test_citation_match(spark):
    rows = ["See [Silver Star p.4].", "no tag", "[x p.]", "[ER23-2309 Index p.12] ok"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    assert [r[0] for r in df.select(TX.has_citation("a")).collect()] == [True, False, False, True]


def test_answer_checks(spark):
    from voltframe.constants import REFUSAL
    from voltframe.operators.cite import check_answers

    rows = [(1, ""), (2, REFUSAL), (3, "Fact. [Silver Star p.4]"), (4, "Fact without tag."), (5, "Odd [x p.] tag"),
            (6, "  " + REFUSAL + "  "), (7, REFUSAL + "\n"), (8, " \n \t"), (9, None), (10, "\u00a0" + REFUSAL + "\u2028"), (11, "\nNo tag\n")]
    df = spark.createDataFrame(rows, "id int, answer string")
    got = {r.id: (r.uncited, r.refusal) for r in check_answers(df).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, False), 4: (True, False), 5: (True, False),
                   6: (False, True), 7: (False, True), 8: (False, False), 9: (False, False), 10: (False, True), 11: (True, False)}


def test_context_and_prompt(spark):
    from voltframe.constants import CONTEXT_SEPARATOR, REFUSAL
    from voltframe.operators.cite import context_blocks, prompt_rows

    hits = spark.createDataFrame(
        [(1, 2, "second", "may2026.pdf", 3), (1, 1, "first", "x/report.v2.pdf", 1)],
        "query_id long, rank int, chunk_text string, source_pdf string, page_number int",
    )
    ctx = context_blocks(hits)
    c = ctx.first()
    assert c.context == "[report.v2 p.1]\nfirst" + CONTEXT_SEPARATOR + "[EIA EPM May 2026 p.3]\nsecond"
    qs = spark.createDataFrame([(1, "what?"), (2, "nothing?")], "query_id long, question string")
    out = {r.query_id: r for r in prompt_rows(qs, ctx).collect()}
    assert out[2].refused and out[2].response == REFUSAL and out[2].prompt is None
    p = out[1].prompt
    assert p.endswith("QUESTION: what?\n") and c.context in p and REFUSAL in p
