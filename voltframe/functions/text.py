"""Text expressions: page normalisation, tokens, chunk ids, file stems, citation tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltframe.constants import (
    CITATION_PATTERN,
    LINE_BREAK,
    NOT_WS,
    TOKEN_PATTERN,
    WS,
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_text(col: Column | str) -> Column:
    """Collapse blank/tab runs inside each line, right-strip lines, drop blank lines.

    Lines are split on every boundary ``str.splitlines`` knows; a run of two or more
    blanks/tabs becomes one space (a single tab stays); trailing Unicode whitespace is
    removed; lines left empty are dropped; the rest are joined with ``\\n``. A null text
    counts as the empty page.
    """
    lines = F.split(F.coalesce(_c(col), F.lit("")), LINE_BREAK)
    cleaned = F.transform(
        lines,
        lambda line: F.regexp_replace(
            F.regexp_replace(line, r"[ \t]{2,}", " "), WS + r"+\z", ""
        ),
    )
    return F.array_join(F.filter(cleaned, lambda line: line != F.lit("")), "\n")


def tokenize(col: Column | str) -> Column:
    """Lossless tokens: each is optional leading whitespace plus a non-whitespace run."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def detokenize(tokens: Column | str) -> Column:
    """Inverse of :func:`tokenize` (tokens are concatenated with nothing in between)."""
    return F.array_join(_c(tokens), "")


def strip_ws(col: Column | str) -> Column:
    """Strip Unicode whitespace at both ends (``str.strip()``)."""
    return F.regexp_replace(_c(col), "^" + WS + "+|" + WS + r"+\z", "")


def has_text(col: Column | str) -> Column:
    """True when the string holds any non-whitespace character."""
    return _c(col).rlike(NOT_WS)


def chunk_id(source_pdf: Column | str, page_number: Column | str, chunk_index: Column | str,
             text: Column | str) -> Column:
    """Hex SHA-256 of ``source|page|index|text`` (UTF-8). ``concat`` keeps a null key null."""
    return F.sha2(
        F.concat(
            _c(source_pdf), F.lit("|"),
            _c(page_number).cast("string"), F.lit("|"),
            _c(chunk_index).cast("string"), F.lit("|"),
            _c(text),
        ),
        256,
    )


def base_name(path: Column | str) -> Column:
    """Last path component."""
    return F.regexp_extract(_c(path), r"[^/]*$", 0)


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix; a leading dot is not a suffix.

    ``a.tar.gz`` -> ``a.tar``, ``.hidden`` -> ``.hidden``, ``noext`` -> ``noext``.
    """
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def citation_tag(alias: Column | str, page_number: Column | str) -> Column:
    """``[alias p.N]``."""
    return F.concat(F.lit("["), _c(alias), F.lit(" p."), _c(page_number).cast("string"), F.lit("]"))


def has_citation(text: Column | str) -> Column:
    """True when the text holds at least one citation tag."""
    return _c(text).rlike(CITATION_PATTERN)
