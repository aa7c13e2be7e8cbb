"""Document scoring by a gated recurrent language model.

Tokens of a document are its words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one
end. The model gives a whole document its log10 probability:

* A gated recurrent unit (numpy, float32) reads the tokens; its state is carried from
  window to window to the end of the document, however long.
* The output is factored by classes: a softmax over classes, then a softmax over the words
  of the class. The :data:`LM_WORDS` most frequent words and the end are split into classes
  by frequency. All other words fall into 16 further classes by length and shape;
  there a word has its share of the class's counts, ``(c + 0.5) / (N + 0.5 (V + 1))``, so
  every word, seen or not, has a probability.
* The weights are learned by truncated backpropagation through time: gradients end at the edge
  of a window of 32 tokens, the state does not.

Beside it stands the base score, the sum over tokens of ``log10((c + 0.5) / (N + 0.5 (V + 1)))``.

What is learned from: all training documents. Counts (words, classes, N, V) cover them and
grow with them. The weights see each training document once: documents are dealt into
``rounds`` by a hash of the text, in each round every task goes on from the common weights
with its own documents, and the weights are averaged by tokens. So nothing is sampled, and
learning is spread over the tasks.

Plan and bounds:

* Counting sums in each task before the shuffle by word. A task's table is flushed at
  ``FLUSH_WORDS`` words.
* Words that stand often go to the tasks in a table of at most ``HEAD_WORDS`` words of at most
  64 bytes (9 MB): the cut is the least count that at most so many words reach, found from a
  histogram of counts. The other words of a document, each rare, meet their counts in a join
  by word, and sums come back by row number. Frequent words never travel, rare ones have no hot key.
* A round's weights (about 0.13 MB a task) are summed in ``SUMMANDS`` tasks as they stream by,
  then on the driver. The driver holds the frequent words and the weights, nothing else.
* Texts are split into words a megabyte at a time and held as 2 bytes a token. These codes are
  written to the shared folder once, for all rounds of learning and for scoring, with row
  numbers that are thereby fixed; a lost executor repeats tasks of the pass it was in.
* Scoring batches documents in lanes, the longest first; a lane that ends takes the next.

Edge cases: a null text is empty and has the end alone. A row without an id is not held out.
Rows that repeat an id are documents each. Without training documents all counts are 0 and the
weights are as they begin. An empty table gives no rows. Only the columns that ``keep`` names
pass through; they must not be named like results.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.llm.filter_audit import pieces
from voltframe.session import materialize

LM_WORDS = 1023
CLASSES = 16
SHAPES = 16
HEAD_WORDS = 1 << 17
HEAD_BYTES = 64
FLUSH_WORDS = 200_000
HIDDEN = 16
EMBED = 12
WINDOW = 32  # tokens of a lane scored together, and through which gradients go back
TRAIN_LANES = 128
SCORE_LANES = 256
GROUP_TOKENS = 2_000_000
PART_TOKENS = 1024  # of a document in training
RATE = 0.012
ROUNDS = 2
SUMMANDS = 16
END = 0  # code of the end; it also stands before the first token


def shape(word: bytes) -> int:
    """Class of a word that is not of the model's own: four lengths times letters only, letters
    beyond ASCII, letters and a last other character, or anything else."""
    kind = 0 if word.isalpha() else 1 if not word.isascii() else 2 if word[:-1].isalpha() else 3
    return min((len(word) - 1) // 4, 3) * 4 + kind


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a megabyte at a time; ``bytes`` lower-cases A-Z only and splits at ASCII white space."""
    for piece in pieces(text):
        yield piece.lower().split()


# ---------------------------------------------------------------- network


@dataclass
class Layout:
    """Codes of the output: the end and ``n_words`` words in classes, then one code for each shape."""

    class_of: np.ndarray  # of every code; 2 bytes each, which sort by radix
    first: np.ndarray  # first code of each word class, and the end of the last

    @classmethod
    def by_mass(cls, counts: np.ndarray, classes: int = CLASSES) -> "Layout":
        """Classes of like sums of square roots of counts; code 0 and then falling counts."""
        mass = np.sqrt(counts + 1.0)
        at = (np.cumsum(mass) - mass / 2) / mass.sum() * classes
        own = np.minimum(at.astype(np.int64), classes - 1)
        own = np.unique(np.maximum.accumulate(own), return_inverse=True)[1]  # no class is empty
        n = int(own[-1]) + 1
        return cls(np.concatenate([own, n + np.arange(SHAPES)]).astype(np.int16), np.searchsorted(own, np.arange(n + 1)))

    @property
    def n_words(self) -> int:
        return int(self.first[-1])

    @property
    def n_classes(self) -> int:
        return len(self.first) - 1 + SHAPES


def begin(layout: Layout, counts: np.ndarray, shape_counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights to begin with: small random ones, and biases that give every class and word its share."""
    rng = np.random.default_rng(seed)
    k, h = layout.n_words, HIDDEN
    smooth = counts + 0.5
    total = np.add.reduceat(smooth, layout.first[:-1])
    by_class = np.concatenate([total, shape_counts + 0.5])
    small = lambda *s: rng.normal(0, 0.05, s)
    w = {
        "emb": rng.normal(0, 0.3, (EMBED, k + SHAPES)), "wx": rng.normal(0, EMBED**-0.5, (3 * h, EMBED)), "b": np.zeros((3 * h, 1)),
        "wh": rng.normal(0, 0.5 * h**-0.5, (3 * h, h)), "wc": small(layout.n_classes, h), "bc": np.log(by_class / by_class.sum())[:, None],
        "wo": small(k, h), "bo": np.log(smooth / np.repeat(total, np.diff(layout.first)))[:, None],
    }
    return {name: v.astype(np.float32) for name, v in w.items()}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, x in like.items():
        out[name] = v[at:at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def _within(w: np.ndarray, b: np.ndarray, limit: float = 80) -> bool:
    """Whether ``w @ h + b`` stays within the limit for every state, as states lie between -1 and 1."""
    return float((np.abs(w).sum(axis=1) + np.abs(b).max(axis=1)).max()) < limit


def _squash(x: np.ndarray, within: bool) -> None:
    """``1 / (1 + exp(x))`` in place; ``within``: no x is over 80."""
    if not within:
        np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _turned(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the unit: what each input code and the state before add to the gates, and whether no gate's input is over 80.

    1 / (1 + exp(x)) of inputs turned round is the logistic function; of the candidate's, doubled, half of tanh + 1."""
    turn = np.full((3 * HIDDEN, 1), -1, dtype=w["b"].dtype)
    turn[2 * HIDDEN:] = -2
    table, wh = (w["wx"] @ w["emb"] + w["b"]) * turn, w["wh"] * turn
    return np.ascontiguousarray(table.T), wh, _within(wh, table)


def _recur(turned: tuple[np.ndarray, np.ndarray, bool], inputs: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each step (steps x hidden x lanes); with ``keep`` also the gates (update, reset and
    candidate, after their functions) and the candidate's share of the state before."""
    n, kind = HIDDEN, h.dtype
    table, wh, within = turned
    steps, width = inputs.shape
    # Without ``keep`` one step's gates are all there is, so they stay in the processor's cache.
    held = steps if keep else 1
    states, inner, gates = np.empty((steps, n, width), kind), np.empty((held, n, width), kind), np.empty((held, 3 * n, width), kind)
    u, tmp = np.empty((3 * n, width), kind), np.empty((n, width), kind)
    for t in range(steps):
        a, own = gates[t if keep else 0], inner[t if keep else 0]
        a[:] = np.take(table, inputs[t], axis=0).T
        np.matmul(wh, h, out=u)
        zr, c = a[:2 * n], a[2 * n:]
        zr += u[:2 * n]
        _squash(zr, within)
        own[:] = u[2 * n:]
        np.multiply(zr[n:], own, out=tmp)
        c += tmp
        _squash(c, within)
        c *= 2
        c -= 1
        s = states[t]
        np.subtract(h, c, out=s)  # z h + (1 - z) c
        s *= zr[:n]
        s += c
        h = s
    return (states, gates, inner) if keep else states


def _softmax(logits: np.ndarray, own: np.ndarray, rows: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the shares ``own`` of the columns ``rows``, and the sums that turn ``logits``, which hold
    powers from here on, into shares. Logits end at +-80 (``within``: they are), so nothing overflows and no share is zero."""
    if not within:
        np.clip(logits, -80, 80, out=logits)
    found = logits[own, rows]
    np.exp(logits, out=logits)
    total = np.ones(len(logits), dtype=logits.dtype) @ logits
    return found - np.log(total), total


def _output(w: dict[str, np.ndarray], layout: Layout, h: np.ndarray, codes: np.ndarray, at: np.ndarray, grad: bool = False):
    """Natural log probability of the codes (shapes: of their class) of the tokens ``at``, after the states
    ``h`` (hidden x tokens); with ``grad`` also the gradients of their negative sum over weights and ``h``."""
    own = layout.class_of[codes[at]]
    order = np.argsort(own, kind="stable")
    own, at_sorted = own[order], at[order]
    codes, h, n_all = codes[at_sorted], np.ascontiguousarray(np.take(h.T, at_sorted, axis=0).T), h.shape[1]
    within = _within(w["wc"], w["bc"]) and _within(w["wo"], w["bo"])
    share = w["wc"] @ h
    share += w["bc"]
    rows = np.arange(len(codes))
    found, total = _softmax(share, own, rows, within)
    found = found.astype(np.float64)
    g = {}
    if grad:
        share /= total
        share[own, rows] -= 1
        g = {"wc": share @ h.T, "bc": share.sum(axis=1, keepdims=True), "wo": np.zeros_like(w["wo"]), "bo": np.zeros_like(w["bo"])}
        dh = w["wc"].T @ share
    bounds = np.searchsorted(own, np.arange(len(layout.first)))
    for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        a, b = layout.first[c], layout.first[c + 1]
        if lo == hi or b - a == 1:
            continue
        part = h[:, lo:hi]
        share = w["wo"][a:b] @ part
        share += w["bo"][a:b]
        place, here = codes[lo:hi] - a, rows[:hi - lo]
        logp, total = _softmax(share, place, here, within)
        found[lo:hi] += logp
        if grad:
            share /= total
            share[place, here] -= 1
            g["wo"][a:b] = share @ part.T
            g["bo"][a:b] = share.sum(axis=1, keepdims=True)
            dh[:, lo:hi] += w["wo"][a:b].T @ share
    out = np.empty_like(found)
    out[order] = found
    if not grad:
        return out
    back = np.zeros((n_all, len(dh)), dtype=dh.dtype)
    back[at_sorted] = dh.T
    return out, g, back.T


def _tokens(x: np.ndarray) -> np.ndarray:
    """(steps x features x lanes) as features x tokens."""
    return x.transpose(1, 0, 2).reshape(x.shape[1], -1)


def _by_token(x: np.ndarray) -> np.ndarray:
    """(steps x features x lanes) as tokens x features, where a token's features are gathered at once."""
    return x.transpose(0, 2, 1).reshape(-1, x.shape[1])


def loss_and_gradient(w: dict[str, np.ndarray], layout: Layout, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h0: np.ndarray):
    """Negative log probability of a window (steps x lanes; ``live`` marks real tokens), its gradient
    by backpropagation through the window, and the states after it."""
    n, (steps, width) = HIDDEN, inputs.shape
    states, gates, inner = _recur(_turned(w), inputs, h0, keep=True)
    at = np.flatnonzero(live.ravel())
    logp, g, d_out = _output(w, layout, _by_token(states).T, targets.ravel(), at, grad=True)
    into = np.ascontiguousarray(d_out.T.reshape(steps, width, n).transpose(0, 2, 1))
    z, r, c = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
    before = np.concatenate([h0[None], states[:-1]])
    da, du, tmp = np.empty_like(gates), np.empty_like(gates), np.empty_like(h0)
    dh, back = np.zeros_like(h0), np.ascontiguousarray(w["wh"].T)
    for t in range(steps - 1, -1, -1):
        dh += into[t]
        d, e = da[t], du[t]
        to_z, to_r, to_c = d[:n], d[n:2 * n], d[2 * n:]  # slopes, then gradients, a step at a time in the cache
        np.subtract(1, z[t], out=tmp)
        np.subtract(before[t], c[t], out=to_z)
        to_z *= z[t]
        to_z *= tmp
        to_z *= dh
        np.multiply(c[t], c[t], out=to_c)
        np.subtract(1, to_c, out=to_c)
        to_c *= tmp
        to_c *= dh
        np.subtract(r[t], 1, out=tmp)
        np.multiply(inner[t], r[t], out=to_r)
        to_r *= tmp
        to_r *= 0.5  # inner is turned round
        to_r *= to_c
        e[:2 * n] = d[:2 * n]
        np.multiply(d[2 * n:], r[t], out=e[2 * n:])
        dh *= z[t]
        dh += back @ e
    g["wh"] = _tokens(du) @ _tokens(before).T
    codes = inputs.ravel()
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=-1))
    d_table = np.zeros((3 * n, w["emb"].shape[1]), dtype=h0.dtype)
    d_table[:, codes[order][first]] = np.add.reduceat(np.ascontiguousarray(np.take(_by_token(da), order, axis=0).T), first, axis=1)
    g["wx"] = d_table @ w["emb"].T
    g["emb"] = w["wx"].T @ d_table
    g["b"] = d_table.sum(axis=1, keepdims=True)
    return -float(logp.sum()), g, states[-1]


def each_window(docs: list[np.ndarray], order: list[int], width: int, steps: int, run) -> None:
    """``run(inputs, targets, live, doc, h) -> h`` for window after window (steps x lanes) of all documents,
    taken in ``order``.

    A document is its codes behind the code that stands before them. ``live`` marks real tokens, ``doc``
    has the document of each lane, ``h`` its state. A lane whose document ends takes the next one and
    a state of zeros.
    """
    if not docs:
        return
    codes = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    begins = ends - [len(d) for d in docs]
    queue = order[::-1]
    doc = np.array([queue.pop() for _ in range(min(width, len(queue)))], dtype=np.int64)
    at = begins[doc]  # of each lane's next input; the last code of a document is a target only
    h = np.zeros((HIDDEN, len(doc)), dtype=np.float32)
    while len(doc):
        here = at + np.arange(steps + 1)[:, None]
        window = codes[np.minimum(here, len(codes) - 1)]
        h = run(window[:-1], window[1:], here[1:] < ends[doc], doc, h)
        at = at + steps
        stays = np.ones(len(doc), dtype=bool)
        for j in np.flatnonzero(at >= ends[doc] - 1).tolist():
            stays[j] = bool(queue)
            if queue:
                doc[j] = queue.pop()
                at[j], h[:, j] = begins[doc[j]], 0
        if not stays.all():
            doc, at, h = doc[stays], at[stays], np.ascontiguousarray(h[:, stays])


class Learner:
    """Adam over windows of documents."""

    def __init__(self, weights: dict[str, np.ndarray], layout: Layout, rate: float = RATE) -> None:
        self.w = {k: v.copy() for k, v in weights.items()}
        self.layout, self.rate, self.step, self.tokens = layout, rate, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}

    def learn(self, docs: list[np.ndarray]) -> None:
        """Every token of ``docs`` once, in mixed order, long documents in parts, so that lanes stay filled."""
        parts = [d[k:k + PART_TOKENS + 1] for d in docs for k in range(0, len(d) - 1, PART_TOKENS)]
        order = np.random.default_rng(self.step).permutation(len(parts)).tolist()
        each_window(parts, order, TRAIN_LANES, WINDOW, self._window)

    def _window(self, inputs, targets, live, doc, h):
        n = int(live.sum())
        _, grads, after = loss_and_gradient(self.w, self.layout, inputs, targets, live, h)
        self.tokens += n
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
        scale = min(1.0, 1.0 / max(norm, 1e-9)) / n
        rate = self.rate * min(1.0, self.step / 10) / (1 + self.step / 1000) ** 0.5
        for k, g in grads.items():
            m, v = self.moments[k]
            g = g * np.float32(scale)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.w[k] -= np.float32(rate / (1 - 0.9**self.step)) * m / (np.sqrt(v / np.float32(1 - 0.99**self.step)) + np.float32(1e-7))
        return after


def log_probabilities(w: dict[str, np.ndarray], layout: Layout, docs: list[np.ndarray], width: int = SCORE_LANES) -> np.ndarray:
    """Natural log probability of each document's codes, the state carried to its end."""
    total, turned = np.zeros(len(docs)), _turned(w)

    def run(inputs, targets, live, doc, h):
        states = _recur(turned, inputs, h)
        at = np.flatnonzero(live.ravel())
        logp = _output(w, layout, _by_token(states).T, targets.ravel(), at)
        np.add.at(total, doc, np.bincount(at % len(doc), logp, len(doc)))
        return states[-1]

    each_window(docs, sorted(range(len(docs)), key=lambda i: -len(docs[i])), width, WINDOW, run)
    return total


# ---------------------------------------------------------------- corpus


@dataclass
class Counts:
    """Counts of the training tokens. ``head`` has the frequent words, the most frequent first."""

    head: list[bytes]
    head_n: np.ndarray
    docs: int  # of training: the count of the end
    tokens: int  # N
    distinct: int  # V
    shape_n: np.ndarray  # counts of the words beyond the model's own, by shape
    shape_v: np.ndarray  # and how many they are
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells counts apart in workers

    @property
    def own(self) -> int:
        """Words with a code of their own."""
        return min(LM_WORDS, len(self.head))

    def layout(self) -> Layout:
        return Layout.by_mass(np.concatenate([[self.docs], self.head_n[:self.own]]).astype(np.float64))

    def code_of(self) -> np.ndarray:
        """Code of each frequent word."""
        rest = [self.own + 1 + shape(w) for w in self.head[self.own:]]
        return np.concatenate([np.arange(1, self.own + 1), rest]).astype(np.int16)

    def weights(self, layout: Layout) -> dict[str, np.ndarray]:
        return begin(layout, np.concatenate([[self.docs], self.head_n[:self.own]]).astype(np.float64), self.shape_n.astype(np.float64))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, shape, n`` of all documents, one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([shape(w) for w in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "shape", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                for words in words_of(text.as_buffer().to_pybytes()):
                    held.update(words)
                    if len(held) >= FLUSH_WORDS:
                        yield flush()
        if held:
            yield flush()

    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(run, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def summarise(counts: DataFrame, n_docs: int, head_words: int = HEAD_WORDS) -> Counts:
    """Totals of ``counts`` (:func:`word_counts`) and its frequent words: at most ``head_words``."""
    by_shape = {r["shape"]: (r["n"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    size = F.floor(F.log2("n") * 16)  # some hundred sizes at most
    short = counts.where(F.length("word") <= HEAD_BYTES)
    cut, room = 1 << 20, head_words
    for r in sorted(short.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        room -= r["count"]
        if room < 0:
            break
        cut = r["size"]
    rows = sorted(short.where(size >= cut).select("word", "shape", "n").collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    shape_n, shape_v = (np.array([by_shape.get(s, (0, 0))[i] for s in range(SHAPES)], dtype=np.int64) for i in (0, 1))
    words, n = sum(shape_n.tolist()), sum(shape_v.tolist())
    for r in rows[:LM_WORDS]:
        shape_n[r["shape"]] -= r["n"]
        shape_v[r["shape"]] -= 1
    return Counts([bytes(r["word"]) for r in rows], np.array([r["n"] for r in rows], dtype=np.int64), n_docs, words + n_docs, n + (n_docs > 0), shape_n, shape_v)


class Encoder:
    """Words to codes, in a task."""

    def __init__(self, counts: Counts) -> None:
        self.at = {w: i for i, w in enumerate(counts.head)}
        self.code_of = np.concatenate([counts.code_of(), [0]]).astype(np.int16)  # the last: not frequent
        self.first_shape = counts.own + 1
        self.log_c = np.concatenate([np.log10(counts.head_n + 0.5), [0.0]])

    def encode(self, text: bytes) -> tuple[np.ndarray, float, float, Counter]:
        """Codes between two ends; sums of log10(c + 0.5) over frequent words and over those of them that
        only have a shape; the other words."""
        end = np.array([END], dtype=np.int16)
        parts, all_log, shape_log, tail = [end], 0.0, 0.0, Counter()
        for words in words_of(text):
            at = np.fromiter(map(self.at.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            codes = self.code_of[at]
            logs = self.log_c[at]
            all_log += float(logs.sum())
            shape_log += float(logs[codes >= self.first_shape].sum())
            far = np.flatnonzero(at < 0)
            if len(far):
                others = [words[j] for j in far.tolist()]
                tail.update(others)
                codes[far] = [self.first_shape + shape(w) for w in others]
            parts.append(codes)
        return np.concatenate([*parts, end]), all_log, shape_log, tail


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of broadcast counts, built once in a worker and kept until other counts come."""
    counts = shared.value
    if counts.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[counts.key] = Encoder(counts)
    return _ENCODERS[counts.key]


def encode(docs: DataFrame, counts: Counts, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents as codes, written to the shared folder: texts are split into words once, for learning and for scoring.

    A row number (``__row``), ``keep`` columns, ``codes`` (2 bytes each, an end before and behind), sums of ``log10(c + 0.5)`` over the
    frequent words (``logs``) and over those of them without a code of their own (``shape_logs``), and the other
    words with how often they stand there (``tail``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)

        def group(part: pa.RecordBatch, held: list) -> pa.RecordBatch:
            tails = [h[3] for h in held]
            flat_words = pa.StructArray.from_arrays(
                [pa.array([w for t in tails for w in t], pa.binary()), pa.array([n for t in tails for n in t.values()], pa.int64())], names=["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tails])]), pa.int32()), flat_words)
            made = [pa.array([h[0].tobytes() for h in held], pa.binary()), pa.array([h[1] for h in held]), pa.array([h[2] for h in held]), tail]
            return pa.RecordBatch.from_arrays([part.column(c) for c in ("__row", *keep)] + made, names=["__row", *keep, "codes", "logs", "shape_logs", "tail"])

        for batch in batches:
            text, at, held, size = batch.column("__text"), 0, [], 0
            for i in range(batch.num_rows):
                held.append(encoder.encode(text[i].as_buffer().to_pybytes()))
                size += len(held[-1][0])
                if size >= GROUP_TOKENS:
                    yield group(batch.slice(at, len(held)), held)
                    at, held, size = i + 1, [], 0
            if held:
                yield group(batch.slice(at, len(held)), held)
            del batch, text
            pa.default_memory_pool().release_unused()

    wanted = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = "".join(f"`{n}` {wanted.schema[n].dataType.simpleString()}, " for n in keep)
    made = wanted.mapInArrow(run, f"__row long, {kept}codes binary, logs double, shape_logs double, tail array<struct<word: binary, n: bigint>>")
    return materialize(made, "lm-codes")


def _grouped(batches: Iterator[pa.RecordBatch], group_tokens: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with their codes, about ``group_tokens`` tokens at a time."""
    for batch in batches:
        codes, at, held, size = batch.column("codes"), 0, [], 0
        for i in range(batch.num_rows):
            held.append(np.frombuffer(codes[i].as_buffer(), dtype=np.int16))
            size += len(held[-1])
            if size >= group_tokens or i == batch.num_rows - 1:
                yield batch.slice(at, len(held)), held
                at, held, size = i + 1, [], 0


def train_round(codes: DataFrame, layout: Layout, weights: dict[str, np.ndarray], group_tokens: int = GROUP_TOKENS) -> dict[str, np.ndarray]:
    """Weights after every task went on from ``weights`` with its own documents, averaged by tokens."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, held, size = Learner(weights, layout), [], 0
        for _, docs in _grouped(batches, group_tokens):
            held += docs
            size += sum(len(d) for d in docs)
            if size >= group_tokens:
                learner.learn(held)
                held, size = [], 0
        learner.learn(held)
        if learner.tokens:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % SUMMANDS], pa.int32()), pa.array([task], pa.int32()), pa.array([learner.tokens], pa.int64()), pa.array([flat(learner.w).tobytes()], pa.binary())], names=["slot", "task", "tokens", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens, first = None, 0, None
        for batch in batches:
            for task, n, row in zip(batch.column("task").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights")):
                part = np.frombuffer(row.as_buffer(), dtype=np.float32) * float(n)
                total, tokens, first = part if total is None else total + part, tokens + n, task if first is None else first
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([tokens], pa.int64()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["task", "tokens", "weights"])

    found = codes.mapInArrow(learn, "slot int, task int, tokens long, weights binary").repartition(SUMMANDS, "slot").sortWithinPartitions("task")
    rows = sorted(found.mapInArrow(add, "task int, tokens long, weights binary").collect(), key=lambda r: r["task"])
    if not rows:
        return weights
    total = np.sum([np.frombuffer(r["weights"], dtype=np.float64) for r in rows], axis=0)
    return unflat(total / sum(r["tokens"] for r in rows), weights)


@dataclass
class Model:
    """What scoring needs: counts (frequent words and totals; all words as a table), classes, weights."""

    counts: Counts
    table: DataFrame
    layout: Layout
    weights: dict[str, np.ndarray]


def learn_counts(docs: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS) -> Model:
    """Counts of all words of ``docs``, and weights as they begin."""
    table = materialize(word_counts(docs, text_col), "lm-counts")
    counts = summarise(table, docs.select(text_col).count(), head_words)
    layout = counts.layout()
    return Model(counts, table, layout, counts.weights(layout))


def learn_weights(encoded: DataFrame, model: Model, rounds: int = ROUNDS, group_tokens: int = GROUP_TOKENS) -> Model:
    """``model`` after learning from all documents of ``encoded``, each in one of ``rounds``."""
    weights = model.weights
    for k in range(rounds):
        part = encoded.where(F.pmod(F.xxhash64("codes"), F.lit(rounds)) == k).select("codes")
        weights = train_round(part, model.layout, weights, group_tokens)
    return Model(model.counts, model.table, model.layout, weights)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, head_words: int = HEAD_WORDS, group_tokens: int = GROUP_TOKENS) -> Model:
    """Counts and weights from all of ``docs``."""
    model = learn_counts(docs, text_col, head_words)
    return learn_weights(encode(docs, model.counts, text_col, ()), model, rounds, group_tokens)


def _log10(x: np.ndarray | float) -> np.ndarray:
    return np.log10(np.asarray(x, dtype=np.float64))


def score_encoded(encoded: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``keep`` columns and ``n_tokens, n_known, train_tokens, base_score, score`` of every document of
    :func:`encode`."""
    c, layout, weights = model.counts, model.layout, model.weights
    shape_total, first_shape = _log10(c.shape_n + 0.5 * (c.shape_v + 1)), c.own + 1
    end_log, all_total = float(_log10(c.docs + 0.5)), float(_log10(c.tokens + 0.5 * (c.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, codes in _grouped(batches, group_tokens):
            net = log_probabilities(weights, layout, codes) / np.log(10)
            rare = np.array([np.bincount(x[x >= first_shape] - first_shape, minlength=SHAPES) @ shape_total for x in codes])
            n = np.array([len(x) - 1 for x in codes])
            logs, shape_logs, others = (np.asarray(part.column(x)) for x in ("logs", "shape_logs", "n_tail"))
            made = [pa.array(n, pa.int64()), pa.array(n - others - (c.docs == 0), pa.int64()), pa.array(logs + end_log - n * all_total), pa.array(net + shape_logs - rare)]
            yield pa.RecordBatch.from_arrays([part.column("__row"), *[part.column(x) for x in keep], *made], names=["__row", *keep, "n_tokens", "__known", "__base", "__net"])

    rare = encoded.where(F.size("tail") > 0).select(F.col("__row").alias("__at"), F.inline("tail")).join(model.table.select("word", F.col("n").alias("__c")), "word", "left")
    # Decimal sums do not depend on the order of rows.
    log_c = (F.log10(F.coalesce(F.col("__c"), F.lit(0)) + 0.5) * F.col("n")).cast("decimal(30,12)")
    sums = rare.groupBy("__at").agg(F.sum(log_c).cast("double").alias("__logs"), F.sum(F.when(F.col("__c").isNotNull(), F.col("n")).otherwise(0)).alias("__more"))
    n_tail = F.aggregate("tail", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tail")
    wanted = encoded.select("__row", *keep, "codes", "logs", "shape_logs", n_tail)
    kept = "".join(f"`{n}` {wanted.schema[n].dataType.simpleString()}, " for n in keep)
    scored = wanted.mapInArrow(run, f"__row long, {kept}n_tokens long, __known long, __base double, __net double")
    met = scored.join(sums, F.col("__row") == F.col("__at"), "left").na.fill(0, ["__logs", "__more"])
    return met.select(
        *keep, "n_tokens", (F.col("__known") + F.col("__more")).alias("n_known"), F.lit(c.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + F.col("__logs")).alias("base_score"), (F.col("__net") + F.col("__logs")).alias("score"))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """:func:`score_encoded` of documents with texts."""
    return score_encoded(encode(docs, model.counts, text_col, keep), model, keep, group_tokens)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
