"""Parsing expressions for landed API records and tool arguments.

Every parse is total: bad input gives NULL plus a reason column elsewhere, never an
exception, so one bad row cannot fail a job over millions (ANSI mode stays on).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltframe.constants import PERIOD_PATTERN, VALUE_LIMIT


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pad_hourly_period(col: Column | str) -> Column:
    """``YYYY-MM-DDTHH`` (13 chars, ``T`` at position 11) -> ``YYYY-MM-DDTHH:00:00``."""
    c = _c(col)
    return F.when((F.length(c) == 13) & (F.substring(c, 11, 1) == "T"), F.concat(c, F.lit(":00:00"))) \
        .otherwise(c)


def period_is_wellformed(col: Column | str) -> Column:
    """Shape check after padding (rejects ``2025-06``, unpadded hours and zone suffixes)."""
    return pad_hourly_period(col).rlike(PERIOD_PATTERN)


def parse_period(col: Column | str) -> Column:
    """Padded, shape-checked period as ``timestamp_ntz``; NULL when unusable."""
    padded = pad_hourly_period(col)
    return F.when(padded.rlike(PERIOD_PATTERN), padded.try_cast("timestamp_ntz"))


def parse_number(col: Column | str) -> Column:
    """Text number -> double; ``nan`` -> NULL (sums skip it); other junk -> NULL."""
    d = _c(col).try_cast("double")
    return F.when(~F.isnan(d), d)


def number_is_bad(col: Column | str) -> Column:
    """True for a present value that is not a finite number or NaN."""
    c = _c(col)
    d = c.try_cast("double")
    return c.isNotNull() & (d.isNull() | (F.abs(d) == F.lit(float("inf"))))


def number_is_out_of_range(col: Column | str) -> Column:
    """True for a finite number that exact sums cannot hold (:data:`VALUE_LIMIT` and above)."""
    d = _c(col).try_cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) >= F.lit(VALUE_LIMIT)), F.lit(False))


def parse_iso_date(col: Column | str) -> Column:
    """Strict ``YYYY-MM-DD`` -> date; anything else (impossible days, blanks) -> NULL."""
    c = _c(col)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def timestamp_text(col: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` text of a timestamp."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")
