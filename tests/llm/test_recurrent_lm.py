"""Recurrent language model: counts and base score by brute force, the network against a plain
version and the numeric gradient, probabilities that sum to one, held-out documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltframe.llm import recurrent_lm as L

from ..conftest import SF01
from .common import ROWS, WORD, clashing, frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def learned(row):
    return zlib.crc32(str(row[0]).encode()) % 5 != 1 if row[0] is not None else True


def brute(rows):
    """``doc_id, text -> n_tokens, n_known, train_tokens, base_score``."""
    train = [words(r[1]) for r in rows if learned(r)]
    count = Counter(w for d in train for w in d)
    count["<end>"] = len(train)  # no word is that: none has a blank, and this one is counted apart below
    total, distinct = sum(count.values()), len([c for c in count.values() if c])
    out = []
    for doc_id, text, *_ in rows:
        c = [count[w] if w != "<end>" else 0 for w in words(text)] + [len(train)]
        out.append((doc_id, len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 0.5) / (total + 0.5 * (distinct + 1))) for x in c)))
    return sorted(out, key=str)


def run(df, **fit):
    model = L.fit(df.where(~L.held_out("doc_id")), **fit)
    return L.score(df, model), model


@pytest.mark.parametrize("fit", [{}, {"head_words": 40}, {"head_words": 0, "rounds": 3}])
def test_base_score_equals_brute_force(spark, fit):
    rows = ROWS + [(100 + i, " ".join(f"V{(i * j) % 23}é" for j in range(i)), "en", "s", 1) for i in range(50)]
    df = clashing(frame(spark, rows), ["word", "n", "score", "__row", "shape"]).repartition(4)
    got = sorted((tuple(r) for r in run(df, **fit)[0].collect()), key=str)
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= 1e-8 * max(1, abs(w[4])) for g, w in zip(got, want))
    assert all(math.isfinite(g[5]) and g[5] < 0 for g in got)


def test_empty_tables_and_nothing_to_learn(spark):
    assert run(frame(spark, []))[0].count() == 0
    df = frame(spark, [(1, "a b", "en", "s", 1), (2, None, "en", "s", 1)])
    model = L.fit(df.limit(0))
    rows = {r.doc_id: r for r in L.score(df, model).collect()}
    assert rows[1][1:4] == (3, 0, 0) and rows[2][1:4] == (1, 0, 0) and abs(rows[1].base_score) < 1e-9


def small_network(seed=0):
    rng = np.random.default_rng(seed)
    layout = L.Layout.by_mass(np.array([40] + [1000 // k for k in range(1, 60)], dtype=float), 7)
    w = L.begin(layout, np.full(60, 3.0), np.arange(16.0))
    return layout, {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in w.items()}, rng


def plain_log_probability(w, layout, codes):
    """One document, one step and one equation at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, h, total = L.HIDDEN, np.zeros(L.HIDDEN), 0.0
    for before, code in zip(codes, codes[1:]):
        x = w["wx"] @ w["emb"][:, before] + w["b"][:, 0]
        u = w["wh"] @ h
        z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n:2 * n] + u[n:2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n:] + r * u[2 * n:])
        e = np.exp(w["wc"] @ h + w["bc"][:, 0])
        c = layout.class_of[code]
        total += np.log(e[c] / e.sum())
        if c < len(layout.first) - 1:
            a, b = layout.first[c], layout.first[c + 1]
            e = np.exp(w["wo"][a:b] @ h + w["bo"][a:b, 0])
            total += np.log(e[code - a] / e.sum())
    return total


def test_scores_equal_a_plain_network_in_lanes_of_any_width():
    layout, w, rng = small_network()
    docs = [np.concatenate([[0], rng.integers(1, 76, n), [0]]).astype(np.int16) for n in (0, 1, 5, 31, 32, 33, 200, 70, 3, 500)]
    want = [plain_log_probability(w, layout, d) for d in docs]
    for width in (1, 3, 64):
        got = L.log_probabilities({k: v.astype(np.float32) for k, v in w.items()}, layout, docs, width)
        assert np.allclose(got, want, rtol=2e-4)  # the state goes from window to window to the end


def test_gradient_equals_numeric_gradient():
    layout, w, rng = small_network(1)
    inputs, targets = rng.integers(0, 76, (6, 5)), rng.integers(0, 76, (6, 5))
    live, h = np.arange(6)[:, None] < np.array([6, 2, 6, 1, 4]), rng.normal(0, 0.5, (L.HIDDEN, 5))
    loss = lambda: L.loss_and_gradient(w, layout, inputs, targets, live, h)
    grads = loss()[1]
    for name, v in w.items():
        most = np.argsort(-np.abs(grads[name]).ravel())[:6]
        for i in [*most, *rng.integers(0, v.size, 6)]:
            old, step = v.ravel()[i], 1e-5
            v.ravel()[i] = old + step
            up = loss()[0]
            v.ravel()[i] = old - step
            numeric = (up - loss()[0]) / (2 * step)
            v.ravel()[i] = old
            assert abs(numeric - grads[name].ravel()[i]) <= 1e-5 * max(1, abs(numeric)), name


def test_probabilities_of_all_next_tokens_sum_to_one():
    layout, w, rng = small_network(2)
    h = rng.normal(0, 0.5, (L.HIDDEN, 1))
    codes = np.arange(layout.n_words + L.SHAPES)
    logp = L._output(w, layout, np.repeat(h, len(codes), axis=1), codes, codes)
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    assert (np.diff(layout.class_of) >= 0).all() and set(layout.class_of) == set(range(layout.n_classes))


def test_learning_lowers_the_loss_and_reads_all_tokens():
    layout, w, rng = small_network(3)
    docs = [np.array([0, *([5, 9, 20, 3] * n), 0], dtype=np.int16) for n in rng.integers(1, 400, 60)]
    start = {k: v.astype(np.float32) for k, v in w.items()}
    learner = L.Learner(start, layout)
    before = L.log_probabilities(start, layout, docs).sum()
    learner.learn(docs)
    assert learner.tokens == sum(len(d) - 1 for d in docs)
    assert L.log_probabilities(learner.w, layout, docs).sum() > 0.7 * before


def test_shapes_and_words_of_bytes():
    assert [L.shape(w) for w in (b"a", b"abcd", b"abcde", b"x" * 99, "é".encode(), b"the.", b"a1b", b"|")] == [0, 0, 4, 12, 1, 2, 3, 3]
    assert [w for p in L.words_of("ÀB c\x0bD\x1cE F".encode()) for w in p] == ["Àb".encode(), b"c", "d\x1ce f".encode()]


def test_held_out_documents_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    scored, model = run(docs)
    scored = scored.withColumn("held", L.held_out("doc_id"))
    rows = {r.held: r for r in scored.groupBy("held").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).collect()}
    assert rows[True].s / rows[True].n > rows[True].b / rows[True].n + 0.1
    again = L.score(docs, model).agg(F.sum("score")).first()[0]
    assert abs(again - rows[True].s - rows[False].s) < 1e-3 * abs(again)


def test_long_document_and_rare_words_cross_groups(spark):
    rows = [(i, " ".join(f"r{i}x{j}" for j in range(20)) + " the of and" * 30, "en", "s", 1) for i in range(60)] + [(99, "long " * 50_000 + "tail", "en", "s", 1)]
    df = frame(spark, rows).coalesce(1)
    model = L.fit(df.where(~L.held_out("doc_id")), head_words=10, group_tokens=300)
    got = sorted((tuple(r) for r in L.score(df, model, group_tokens=300).collect()), key=str)
    assert all(abs(a[5] - b[5]) < 1e-4 * abs(a[5]) for a, b in zip(got, sorted((tuple(r) for r in L.score(df, model).collect()), key=str)))
    assert [g[:4] for g in got] == [w[:4] for w in brute(rows)] and all(abs(g[4] - w[4]) < 1e-6 * abs(w[4]) for g, w in zip(got, brute(rows)))


def test_scoring_holds_one_step_of_gates_and_limits_only_what_needs_it():
    import tracemalloc

    counts = np.arange(1001, 0, -1, dtype=np.float64)
    layout = L.Layout.by_mass(counts)
    assert layout.class_of.dtype.itemsize == 2  # sorts by radix
    w = L.begin(layout, counts, np.ones(L.SHAPES))
    inputs = np.random.default_rng(5).integers(0, layout.n_words, (L.WINDOW, L.SCORE_LANES)).astype(np.int16)
    h = np.zeros((L.HIDDEN, L.SCORE_LANES), dtype=np.float32)
    turned = L._turned(w)
    assert turned[2]  # nothing comes near the limit
    tracemalloc.start()
    states = L._recur(turned, inputs, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * states.nbytes
    assert np.allclose(states, L._recur((turned[0], turned[1], False), inputs, h, keep=True)[0], atol=1e-6)
    wild = {k: v * 1000 for k, v in w.items()}  # far beyond it
    assert not L._turned(wild)[2]
    with np.errstate(over="raise"):
        assert np.isfinite(L.log_probabilities(wild, layout, [inputs[:, 0], inputs[:, 1]])).all()
