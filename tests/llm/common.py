"""Edge rows that every operator over documents must handle."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The cat sat on the mat.\nIt was warm.\n\nThe cat sat on the mat.", "en", "a", 5),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \t\n\r\x0b\x0c ", "en", None, 7),
    (5, "one", "de", "b", 3),
    (6, "one", "de", "b", 3),
    (6, "one", "de", "b", 3),
    (7, LONG, "fr", "a", len(LONG)),
    (8, LONG, "fr", "c", len(LONG)),
    (9, "é ü ß 日本語 🙂 \x00 x", "es", "c", 12),
    (10, "Same line\nother\nSame line\n" * 30, "en", "", 1),
    (None, "no id at all", "en", "a", 2),
    (None, None, None, None, None),
]


def frame(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(df, names):
    """``df`` with extra columns whose names are those of results."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("mine") for n in names})


def groups(n: int, pairs) -> list[list[int]]:
    """Members of the connected groups of ``n`` things."""
    to = list(range(n))

    def root(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    for a, b in pairs:
        to[root(a)] = root(b)
    out = defaultdict(list)
    for i in range(n):
        out[root(i)].append(i)
    return list(out.values())
