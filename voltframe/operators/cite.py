"""Citations, context assembly, prompts and the answer checks."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.constants import CITATION_ALIASES, CONTEXT_SEPARATOR, PROMPT_TEMPLATE, REFUSAL
from voltframe.functions.text import citation_tag, file_stem, has_citation, strip_ws


def alias_for(source_pdf: Column | str) -> Column:
    """Citation label: the fixed alias of a known file, else the file stem."""
    c = F.col(source_pdf) if isinstance(source_pdf, str) else source_pdf
    known = F.create_map(*[F.lit(x) for kv in CITATION_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), file_stem(c))


def with_alias(df: DataFrame, source_col: str = "source_pdf", out_col: str = "alias") -> DataFrame:
    return df.withColumn(out_col, alias_for(source_col))


def context_blocks(hits: DataFrame) -> DataFrame:
    """``query_id, n_hits, context``: ``[alias p.N]\\ntext`` blocks in rank order, joined by
    the separator. Each group holds one query's k hits, so it is bounded by k."""
    block = F.concat(citation_tag(alias_for("source_pdf"), "page_number"), F.lit("\n"), F.col("chunk_text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b"))))
    return hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_join(F.transform(ordered, lambda e: e["b"]), CONTEXT_SEPARATOR).alias("context"),
    )


def _template_parts() -> list[tuple[str, str | None]]:
    """PROMPT_TEMPLATE split into (literal, field) pairs."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(PROMPT_TEMPLATE)]


def fill_prompt(context: Column, query: Column) -> Column:
    """The answer prompt with refusal sentence, context and question filled in."""
    values = {"refusal": F.lit(REFUSAL), "context": context, "query": query}
    parts: list[Column] = []
    for lit, field in _template_parts():
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def prompt_rows(questions: DataFrame, contexts: DataFrame, query_col: str = "question") -> DataFrame:
    """``query_id, question, refused, prompt, response``.

    Questions without hits are answered with the refusal sentence directly (no prompt);
    the others get a prompt for a later batch model job (response NULL).
    """
    j = questions.join(contexts, "query_id", "left")
    refused = F.col("context").isNull()
    return j.select(
        "query_id",
        F.col(query_col).alias("question"),
        refused.alias("refused"),
        F.when(~refused, fill_prompt(F.col("context"), F.col(query_col))).alias("prompt"),
        F.when(refused, F.lit(REFUSAL)).alias("response"),
    )


def uncited(answer: Column | str) -> Column:
    """An answer that is non-empty, not the refusal and carries no citation tag."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return (a != "") & (a != REFUSAL) & ~has_citation(a)


def check_answers(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Add ``uncited`` and ``refusal`` flags to a table of answers.

    All white space around an answer is stripped first (model output often ends in a line
    break); a NULL answer counts as empty.
    """
    a = strip_ws(F.coalesce(F.col(answer_col), F.lit("")))
    return answers.withColumn("uncited", uncited(a)).withColumn("refusal", a == REFUSAL)
