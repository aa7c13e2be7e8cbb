"""Corpus vectorisation: signed feature hashing, row-local in Spark.

Default embedder (the source runs a local neural model, which is not available here):
every term of a text (a maximal run of non-whitespace, i.e. a token without its leading
whitespace) is hashed with MD5; the first 8 hex digits modulo ``dim`` pick the
coordinate and the next byte picks the sign (Weinberger et al., 2009). Coordinates are
summed per text, then the vector is L2-normalised and stored as FLOAT. This is a
*lexical* embedding: texts sharing words score high; it has no notion of synonyms. A
model-backed embedder can replace it through :func:`vectorize_with_model`
(``predict_batch_udf``).

Plan: a vector depends on its own row only, so vectorising is a narrow projection with
no shuffle: an Arrow UDF from text to vector, like a model call. A Python worker holds one
Arrow batch of texts, and terms and vectors of a slice of it.

Why Python here: MD5 per term is the whole cost. As a SQL expression it runs for every
occurrence (~4 us per term: 4.2 M terms at sf0.1 cost ~17 core-seconds), and SQL cannot
memoise. Text repeats its vocabulary, so the UDF hashes each distinct term once per
worker (a bounded cache) and builds a slice of vectors with one ``bincount``.
Terms are ``str.split()``: Python's whitespace is exactly the JVM class ``WS`` of
:mod:`voltframe.constants` (checked on every code point), so codes equal the
SQL form :func:`term_codes`, which DuckDB reproduces as the oracle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.constants import HASH_DIM, NOT_WS
from voltframe.functions.vectors import term_code, term_hash

TERM_PATTERN = NOT_WS + "+"
CODE_CACHE_LIMIT = 200_000  # distinct terms memoised per Python worker (~30 MB); cleared when full
CODE_CACHE_TERM = 64  # characters of a memoised term, at most
SLICE_ROWS = 512  # vectors built at once, at most
SLICE_TERMS = 65_536  # terms after which a slice of texts is turned into vectors


def term_codes(text: Column | str, dim: int = HASH_DIM) -> Column:
    """SQL form of the term codes: ``ARRAY<INT>``, per term ``bucket * 2 + negative``."""
    t = F.col(text) if isinstance(text, str) else text
    hashes = F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TERM_PATTERN), 0), term_hash)
    return F.transform(hashes, lambda h: term_code(h, dim))


class _Codes(dict):
    """term -> signed code, computed on first use (same rule as :func:`term_code`); long terms are not kept."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, term: str) -> int:
        v = int.from_bytes(hashlib.md5(term.encode("utf-8")).digest()[:5], "big")
        code = ((v >> 8) % self.dim) * 2 + ((v >> 7) & 1)
        if len(term) <= CODE_CACHE_TERM:
            self[term] = code
        return code


_CACHES: dict[int, _Codes] = {}


def _codes_cache(dim: int) -> _Codes:
    cache = _CACHES.get(dim)
    if cache is None or len(cache) > CODE_CACHE_LIMIT:
        cache = _CACHES[dim] = _Codes(dim)
    return cache


def hash_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM,
                 keep: list[str] | None = None) -> DataFrame:
    """``(id, [keep...], embedding ARRAY<FLOAT>)`` unit vectors, one for every row; a text
    whose coordinates are all 0 (no terms, or every coordinate cancelled) has the zero
    vector, which a search skips, and is stored like any other.

    Row-local: the input keeps its partitioning and nothing is shuffled.
    """
    keep = [c for c in (keep or []) if c != id_col]
    return df.select(id_col, *keep, _embed(dim)(F.col(text_col)).alias("embedding"))


def _vectors(codes: list[int], lengths: list[int], dim: int) -> pa.Array:
    """Unit vectors of rows with ``lengths`` terms each, of all their ``codes``.

    One ``bincount`` over ``row * dim + bucket``; the result is exact (integer sums),
    normalised in float64.
    """
    n = len(lengths)
    flat = np.asarray(codes, dtype=np.int64)
    at = np.repeat(np.arange(n, dtype=np.int64) * dim, lengths) + (flat >> 1)
    dense = np.bincount(at, weights=1.0 - 2.0 * (flat & 1), minlength=n * dim).astype(np.float64, copy=False).reshape(n, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", dense, dense))
    norms[norms == 0] = 1
    dense /= norms[:, None]
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(dense.astype(np.float32).ravel()))


def embed_batches(batches: Iterator[pa.Array], dim: int) -> Iterator[pa.Array]:
    """Vectors of the texts of every batch, in order, in slices of at most ``SLICE_ROWS`` rows that end
    once they have ``SLICE_TERMS`` terms: what is held follows a slice, not Spark's batch."""
    for texts in batches:
        codes: list[int] = []
        lengths: list[int] = []
        for text in texts:
            before = len(codes)
            if text.is_valid:
                codes.extend(map(_codes_cache(dim).__getitem__, text.as_py().split()))
            lengths.append(len(codes) - before)
            if len(lengths) >= SLICE_ROWS or len(codes) >= SLICE_TERMS:
                yield _vectors(codes, lengths, dim)
                codes, lengths = [], []
        if lengths:
            yield _vectors(codes, lengths, dim)


def _embed(dim: int):
    """Arrow UDF: text -> unit FLOAT vector of width ``dim`` (zeros if there is none)."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from embed_batches(batches, dim)

    return embed


def vectorize_with_model(
    df: DataFrame,
    text_col: str,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    dim: int,
    batch_size: int = 256,
) -> DataFrame:
    """Embed ``text_col`` with a model loaded once per Python worker (Arrow batches).

    ``make_predict_fn`` returns ``texts (ndarray of str) -> (n, dim) float array``.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=None,
    )
    return df.withColumn("embedding", udf(F.col(text_col)))
