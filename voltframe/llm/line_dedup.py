"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites (the source
column), however often it stands on each. Every line's sites go into a HyperLogLog sketch
that is merged by aggregation, so a line that a third of all documents carry costs one
sketch per input task, not one row per occurrence. Where the estimate lies within
``margin`` of the threshold, the sites of that line are counted exactly; elsewhere the
estimate decides (the margin is many times the sketch's standard error).

Plan: the lines are hashed once to a narrow table ``(id, site, key)`` in the shared
folder (128-bit keys; texts do not move), which the sketches, the exact counts and the
marking read. Marking is a left-semi join on the line key, which adaptive execution may
split where a line is hot; the positions found are gathered per document (bounded by the
document's own lines) and meet the texts in one join on the id and the text's hash, so
rows without an id share no key. Positions are taken out by a set difference, whose cost
grows with the lines and not with their square.

A document all of whose lines are boilerplate is a copy rather than a page with furniture:
it is left as it is, for a near-duplicate stage to judge (``keep_whole_copies``).

Edge cases: a null text stays null and has no lines; blank lines (white space only) are
neither counted nor removed; a null site is a site of its own; lines are compared
unchanged. Rows that repeat an id are treated each by their own text. An empty table
gives no rows. Input columns named ``n_lines`` or ``n_removed`` are replaced; others pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.session import materialize

NOT_BLANK = r"[^\x20\x09-\x0D]"
MIN_SITES = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128-bit key of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.concat(F.lit("\n"), line)).alias("b"))


def line_table(docs: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """One row per line that is not blank: ``id, text_a, text_b`` (hashes of the text it stands in), its
    position ``at`` there, ``site, a, b``."""
    text = _key(F.col(text_col))
    line = F.posexplode(_lines(F.col(text_col))).alias("at", "line")
    return (
        docs.select(F.col(id_col).alias("id"), text["a"].alias("text_a"), text["b"].alias("text_b"),
                    F.coalesce(F.concat(F.lit("="), F.col(site_col)), F.lit("")).alias("site"), line)
        .where(F.col("line").rlike(NOT_BLANK))
        .select("id", "text_a", "text_b", "at", "site", _key(F.col("line")).alias("key"))
        .select("id", "text_a", "text_b", "at", "site", "key.a", "key.b")
    )


def boilerplate_keys(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """Keys ``a, b`` of the lines on at least ``min_sites`` distinct sites."""
    spread = (
        lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
        .select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - margin))
    )
    spread = materialize(spread, "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("a", "b")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("a", "b")
    exact = (
        lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct()
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("a", "b")
    )
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id",
                       min_sites: int = MIN_SITES, margin: float = 0.25, keep_whole_copies: bool = True) -> DataFrame:
    """``docs`` with the text less its boilerplate lines, ``n_lines`` (lines not blank) and
    ``n_removed`` (long)."""
    lines = materialize(line_table(docs, text_col, site_col, id_col), "lines")
    row = ["id", "text_a", "text_b"]
    found = (
        lines.join(boilerplate_keys(lines, min_sites, margin), ["a", "b"], "left_semi")
        .groupBy(*[F.col(c).alias(f"__{c}") for c in row]).agg(F.collect_set("at").alias("__gone"))
    )
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    key = _key(F.col(text_col))
    same = plain[id_col].eqNullSafe(found["__id"]) & (key["a"] == found["__text_a"]) & (key["b"] == found["__text_b"])
    # Lines and the positions of those that stay come out of a generator: both are made once for each row.
    split = _lines(F.col(text_col))
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone"))
    marked = plain.join(found, same, "left").select("*", F.inline_outer(F.array(F.struct(
        split.alias("__lines"), F.when(F.col("__gone").isNotNull(), stays).alias("__stays")))))
    all_lines = F.col("__lines")
    n_lines = F.coalesce(F.size(F.filter(all_lines, lambda x: x.rlike(NOT_BLANK))), F.lit(0))
    kept = F.transform("__stays", lambda i: F.get(all_lines, i))
    n_gone = F.coalesce(F.size("__gone"), F.lit(0))
    marked = marked.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("long")).withColumn("n_removed", n_gone.cast("long"))
    if keep_whole_copies:
        marked = marked.withColumn("n_removed", F.when(F.col("n_removed") == F.col("n_lines"), 0).otherwise(F.col("n_removed")).cast("long"))
    text = F.when(F.col("n_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    names = [c if c != text_col else text.alias(text_col) for c in plain.columns]
    return marked.select(*names, "n_lines", "n_removed")


ORACLE_SQL = r"""
WITH l AS (
    SELECT doc_id, coalesce('=' || source, '') AS site, u.line AS line, u.pos AS pos
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
b AS (
    SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    GROUP BY line HAVING count(DISTINCT site) >= 10),
m AS (
    SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone, regexp_matches(l.line, '[^\x20\x09-\x0D]') AS full_line
    FROM l LEFT JOIN b ON b.line = l.line),
k AS (
    SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_gone,
           string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
    FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines,
       CASE WHEN k.n_gone IS NULL OR k.n_gone = k.n_lines THEN 0 ELSE k.n_gone END::BIGINT AS n_removed,
       sha256(CASE WHEN k.n_gone IS NULL OR k.n_gone = 0 OR k.n_gone = k.n_lines THEN coalesce(d.text, '') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
