"""Page-scoped token chunks with cross-page carry and content-addressed ids.

Rules (per document, pages in page-number order):

* a page with no tokens yields nothing and leaves the carry untouched;
* windows of ``CHUNK_TOKENS`` tokens start every ``CHUNK_TOKENS - OVERLAP_TOKENS``
  tokens and stop at the first window that reaches the page end, so
  ``n_windows = 1 if n <= 800 else ceil((n - 800) / 700) + 1``;
* the first window of a page is prefixed with the last ``OVERLAP_TOKENS`` tokens of the
  previous non-empty page of the same document (its own tokens, not its carry);
* a chunk's text is its tokens concatenated and stripped; empty chunks are dropped and
  ``chunk_index`` counts kept chunks from 0 (with whitespace-led tokens no window is
  ever empty, so the index equals the window number);
* ``chunk_id`` = SHA-256 of ``source|page|index|text``.

Physical plan: windows are built per page inside one expression (no shuffle). The carry
needs the previous non-empty page, found without a per-document sort: first windows are
partitioned by (document, page bucket), ``lag`` runs inside a bucket and a small
per-bucket summary bridges bucket boundaries. Later windows never move through a
shuffle; first windows move once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltframe.constants import CHUNK_TOKENS, OVERLAP_TOKENS
from voltframe.functions.text import chunk_id, has_text, normalize_text, strip_ws, tokenize
from voltframe.session import materialize

STEP = CHUNK_TOKENS - OVERLAP_TOKENS
CARRY_BUCKET = 4096  # pages of one document per carry task, at most


def normalize_pages(pages: DataFrame) -> DataFrame:
    """``page_text`` whitespace-normalised (the page table the chunker consumes)."""
    return pages.withColumn("page_text", normalize_text("page_text"))


def window_count(n: F.Column) -> F.Column:
    return F.when(n <= CHUNK_TOKENS, F.lit(1)).otherwise(F.ceil((n - CHUNK_TOKENS) / F.lit(STEP)) + 1).cast("int")


def _window_texts(tokens: F.Column) -> F.Column:
    n = F.size(tokens)
    return F.transform(
        F.sequence(F.lit(0), window_count(n) - 1),
        lambda i: F.array_join(F.slice(tokens, i * STEP + 1, CHUNK_TOKENS), ""),
    )


def _tail_text(tokens: F.Column) -> F.Column:
    n = F.size(tokens)
    tail = F.slice(tokens, F.greatest(F.lit(1), n - (OVERLAP_TOKENS - 1)), OVERLAP_TOKENS)
    return F.array_join(tail, "")


def page_windows(pages: DataFrame, normalized: bool = False) -> DataFrame:
    """One pass over the page text: one row per window with
    ``source_pdf, page_number, n_tokens, window, raw`` and, on window 0 only, ``tail``
    (the page's last ``OVERLAP_TOKENS`` tokens, clamped for short pages).

    No filter here: a page without tokens yields one empty window (dropped later), so no
    predicate is pushed below the scan's repartitioning into a single task.
    """
    text = F.col("page_text") if normalized else normalize_text("page_text")
    tok = pages.select("source_pdf", "page_number", tokenize(text).alias("tokens"))
    per_page = tok.select(
        "source_pdf", "page_number", F.size("tokens").alias("n_tokens"),
        _window_texts(F.col("tokens")).alias("texts"), _tail_text(F.col("tokens")).alias("tail"),
    )
    # posexplode_outer: the plain generator makes Catalyst infer ``size(texts) > 0`` and
    # push that predicate (tokeniser inlined) below the scan's repartitioning. The array
    # always has >= 1 element, so the outer form yields the same rows.
    return per_page.select(
        "source_pdf", "page_number", "n_tokens", F.posexplode_outer("texts").alias("window", "raw"), "tail"
    ).withColumn("tail", F.when(F.col("window") == 0, F.col("tail")))


def first_windows_with_carry(first: DataFrame, n_parts: int, bucket_width: int = CARRY_BUCKET) -> DataFrame:
    """First windows (one row per non-empty page: ``source_pdf, page_number, window, raw,
    tail``) with ``raw`` prefixed by the tail of the previous non-empty page of the same
    document.

    Skew-safe without a per-document sort: rows are hash-partitioned by (document, page
    bucket) and ``lag`` runs inside each bucket, so a task holds at most ``bucket_width``
    pages of one document however large the document is. The first page of a bucket takes
    the last tail of the nearest earlier non-empty bucket, from a per-bucket summary
    (rows / ``bucket_width`` rows). Page text moves through one shuffle; the summary
    join reuses the bucket partitioning of the large side.
    """
    b = "__vf_b"
    keyed = first.select(
        "source_pdf", "page_number", "window", "raw", "tail",
        F.floor(F.col("page_number") / bucket_width).alias(b),
    ).repartition(n_parts, "source_pdf", b)
    in_bucket = Window.partitionBy("source_pdf", b).orderBy("page_number")
    lagged = keyed.select(
        "source_pdf", b, "page_number", "window", "raw",
        F.lag("tail").over(in_bucket).alias("__vf_in"),
        (F.row_number().over(in_bucket) == 1).alias("__vf_head"),
    )
    last = keyed.groupBy("source_pdf", b).agg(F.max_by("tail", "page_number").alias("__vf_last"))
    by_bucket = Window.partitionBy("source_pdf").orderBy(b)
    prev = last.select("source_pdf", b, F.lag("__vf_last").over(by_bucket).alias("__vf_prev"))
    carry = F.when(F.col("__vf_head"), F.col("__vf_prev")).otherwise(F.col("__vf_in"))
    return lagged.join(prev, ["source_pdf", b], "left").select(
        "source_pdf", "page_number", "window", F.concat(F.coalesce(carry, F.lit("")), F.col("raw")).alias("raw")
    )


def chunk_windows(windows: DataFrame, bucket_width: int = CARRY_BUCKET) -> DataFrame:
    """Windows (see :func:`page_windows`) -> chunks with carry and ids."""
    first = windows.where((F.col("window") == 0) & (F.col("n_tokens") > 0))
    # First windows carry most of the text of short pages and all the per-row work after
    # the carry (strip, hashing, vectorising). Adaptive execution would coalesce their
    # shuffle by bytes into very few tasks, so the partition count is explicit: the
    # session's shuffle partitions, which a job sizes to its input.
    n_parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _chunks(first_windows_with_carry(first, n_parts, bucket_width), windows)


def chunk_windows_with(windows: DataFrame, carries: DataFrame) -> DataFrame:
    """Windows -> chunks, where the text carried into a page is given: ``carries`` has one
    ``source_pdf, page_number, carry`` for each page that is carried into."""
    first = windows.where((F.col("window") == 0) & (F.col("n_tokens") > 0))
    met = first.join(carries.select("source_pdf", "page_number", "carry"), ["source_pdf", "page_number"], "left")
    return _chunks(met.select("source_pdf", "page_number", "window", F.concat(F.coalesce("carry", F.lit("")), F.col("raw")).alias("raw")), windows)


def _chunks(first_text: DataFrame, windows: DataFrame) -> DataFrame:
    """Chunks of the first windows as given and of the later ones among ``windows``."""
    rest = windows.where(F.col("window") > 0).select("source_pdf", "page_number", "window", "raw")
    # "Strips to empty" is tested as "has no non-whitespace character": the same rows, but a
    # scan that stops at the first character instead of a second strip (a filter on the
    # stripped text would be pushed below the projection and strip every chunk twice).
    chunks = first_text.unionByName(rest).where(has_text("raw")).select(
        "source_pdf", "page_number", F.col("window").cast("int").alias("chunk_index"), strip_ws("raw").alias("text")
    )
    return chunks.select(
        chunk_id("source_pdf", "page_number", "chunk_index", "text").alias("chunk_id"),
        "source_pdf", "page_number", "chunk_index", "text",
    )


def page_tails(pages: DataFrame) -> DataFrame:
    """``source_pdf, page_number, tail`` of the pages with tokens: what each carries into the next."""
    tok = pages.select("source_pdf", "page_number", tokenize(normalize_text("page_text")).alias("tokens"))
    return tok.where(F.size("tokens") > 0).select("source_pdf", "page_number", _tail_text(F.col("tokens")).alias("tail"))


def chunk_pages(pages: DataFrame, normalized: bool = False, materialize_windows: bool = True,
                bucket_width: int = CARRY_BUCKET) -> DataFrame:
    """Pages ``(source_pdf, page_number, page_text)`` -> chunks
    ``(chunk_id, source_pdf, page_number, chunk_index, text)``.

    The window table is consumed by three branches (rest windows, first windows, carry);
    by default it is written once to the shared checkpoint folder so page text is read
    and tokenised exactly once.
    """
    windows = page_windows(pages, normalized)
    if materialize_windows:
        windows = materialize(windows, "page-windows")
    return chunk_windows(windows, bucket_width)
