"""Filter interaction audit against its SQL and a walk over the documents themselves."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from voltframe.llm import filter_audit

from .common import ROWS, WORD, clashing, frame
from .test_mixing_lines import same, sql_rows

LABELS = [(1, 1, 0), (5, 1, 1), (6, 0, 1), (6, 1, None), (7, 1, 0), (999, 1, 1), (None, 1, 1), (8, None, 1)]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
MIXED = [
    (1000 + i, " ".join(WORDS[(i * j) % (1 + i % 10)] for j in range(60 * (i % 7))) + ["", " $", " ABCDEF" * 20][i % 3], ["en", "de", None, ""][i % 4], "s", 1)
    for i in range(120)
] + [(2000 + i, "the same text", "en" if i % 3 else "fr", "s", 1) for i in range(40)] + [(1003, "the same text", "en", "s", 1)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fails(rows):
    """Failing letters of each row, from the definitions."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = "A" if len(words) < 200 else ""
        bad += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        bad += "D" if re.search("[#$%&*|]", text) else ""
        twins = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        bad += "E" if doc_id is not None and any(t < doc_id for t in twins) else ""
        out.append(bad)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = list(zip(rows, fails(rows)))
    table = set()
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], bad) for r, bad in found if (r[2] or "") == part]
        removed_by = Counter()
        steps = []
        for order in permutations("ABCDE"):
            alive = docs
            for k, letter in enumerate(order, 1):
                gone = [d for d in alive if letter in d[1]]
                alive = [d for d in alive if letter not in d[1]]
                removed_by[letter] += len(gone)
                steps.append((part, "".join(order), k, letter, len(alive), len(gone), sum(letter in d[1] for d in docs) - len(gone),
                              sum(d[1] == letter for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        table |= {(*s[:3], *s[4:], removed_by[s[3]]) for s in steps}
    return table


@pytest.mark.parametrize("rows", [ROWS, ROWS + MIXED])
def test_audit_equals_every_order_walked(spark, rows):
    got = filter_audit.audit(clashing(frame(spark, rows), ["part", "mask", "n", "q", "digest", "id"]), labelled(spark, LABELS)).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert {tuple(r) for r in got} == brute(rows, LABELS)


def test_audit_equals_sql(spark):
    import duckdb  # noqa: F401

    rows = [r for r in ROWS + MIXED if r[0] is not None]
    setup = "WITH labels AS (SELECT * FROM (VALUES " + ", ".join(str(t).replace("None", "NULL") for t in LABELS) + ") t(doc_id, quality, toxic)),\n"
    sql = filter_audit.ORACLE_SQL.strip().removeprefix("WITH")
    same(filter_audit.audit(frame(spark, rows), labelled(spark, LABELS)).toPandas(), sql_rows(setup + sql, rows))


def test_masks_of_texts():
    mask = lambda t: filter_audit.text_mask(t.encode(), len(t))
    assert mask("") == 1 and mask("w " * 200) == 2 and mask(" ".join(f"w{i}" for i in range(200))) == 0
    assert mask("A") == 1 + 4 and mask("é" * 33 + "A") == 1 + 4 - 4 * (100 <= 3 * 34) and mask("#") == 1 + 8
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    assert mask(long) == 2 and mask("x" * 3_000_000) == 1  # pieces are cut at white space, a long word not at all
    assert b"".join(filter_audit.pieces(b"ab cd  ef\tg", 2)) == b"ab cd  ef\tg" and [p for p in filter_audit.pieces(b"", 2)] == [b""]


def test_states_are_the_survivors_of_each_subset():
    cells = {m: (m * m + 1, m % 3, m % 2) for m in range(32) if m % 5}
    for subset, state in enumerate(filter_audit.subset_states(cells)):
        assert state == tuple(sum(c[i] for m, c in cells.items() if not m & subset) for i in range(3))
    assert set(filter_audit.subset_states({})) == {(0, 0, 0)}


def test_cells_are_few_and_empty_tables_give_nothing(spark):
    cells = filter_audit.mask_cells(frame(spark, ROWS + MIXED), labelled(spark, LABELS))
    assert cells.agg(F.sum("n")).first()[0] == len(ROWS + MIXED) and cells.groupBy("part").count().where("count > 32").count() == 0
    assert filter_audit.audit(frame(spark, []), labelled(spark, LABELS)).count() == 0
    assert filter_audit.audit(frame(spark), labelled(spark, [])).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
