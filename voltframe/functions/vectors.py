"""The hashing vectoriser's term features as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltframe.constants import HASH_DIM


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def term_hash(term: Column | str) -> Column:
    """Hex MD5 of a term (computed once; bucket and sign both read it)."""
    return F.md5(_c(term))


def term_code(h: Column | str, dim: int = HASH_DIM) -> Column:
    """Signed feature code ``bucket * 2 + negative`` from a hex term hash.

    The first 8 hex digits modulo ``dim`` give the bucket; the next byte gives the sign
    (-1 when it is >= 128). Both come from one conversion of the first 10 hex digits.
    """
    v = F.conv(F.substring(_c(h), 1, 10), 16, 10).cast("bigint")
    return ((F.shiftright(v, 8) % F.lit(dim)) * 2 + (F.shiftright(v, 7) % 2)).cast("int")
