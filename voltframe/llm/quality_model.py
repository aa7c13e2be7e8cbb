"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is encoded
(shares of character classes, shape and repetition of its words, hashed words), a learned
layer maps the encoding to a hidden vector h, gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the weighted sum of
the hidden vectors is scored by a logistic unit (Ilse et al., 2018). Labels of documents
thus teach the model which passages decide, without passage labels.

Whole texts are read: a document has ``PASSAGE_WORDS`` words to a passage, or longer
passages if that would make more than ``MAX_PASSAGES``, so a bag is bounded and nothing
is cut off.

Fitting uses a bounded sample, ``max_training_docs`` labelled documents chosen by a hash
of the id (the bound is a parameter; the labels come first, the texts of the chosen ones
by a join). Their passage encodings, a few kilobytes each at most, are fitted on the
driver. Scoring maps over all documents with the fitted weights (a few kilobytes);
nothing is shuffled.

Inputs of a score are the text alone. Scores are rounded to six digits.

Edge cases: a null or blank text is one passage without words and gets a score like any
other. Labels that are null are ignored; an id labelled more than once has the label of
its mean (0.5 counts as 1); an id that several rows carry trains on the smallest text.
Without labels of both kinds every score is the mean label (1 without any label). An
empty table gives no rows. An input column named like the score is replaced; others pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_WORDS = 128
MAX_PASSAGES = 64
HASHED = 32
STEP_BYTES = 250_000  # characters encoded together
LONG_WORD = 24  # bytes; longer words are hashed by sums, shorter ones byte by byte
MAX_TRAINING_DOCS = 4000

_CLASS = np.full(256, 8, dtype=np.int64)  # other punctuation
_CLASS[128:] = 0  # bytes of letters beyond ASCII, mostly
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[ord(" ")] = 5
_CLASS[[ord(c) for c in "#*$%&|<>@^~=+_{}[]\\/"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
CLASSES = 9
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
SHAPES = 9
WIDTH = CLASSES + SHAPES + HASHED
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of all bytes of the ranges, modulo 2^64."""
    base = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        size = ends - starts
        total = np.zeros(len(starts), dtype=np.uint64)
        live = np.flatnonzero(size <= LONG_WORD)
        for k in range(int(size[live].max(initial=0))):
            live = live[size[live] > k]
            total[live] = total[live] * base + data[starts[live] + k]
        far = np.flatnonzero(size > LONG_WORD)
        for part in np.array_split(far, max(1, int(size[far].sum()) // STEP_BYTES)) if len(far) else []:
            if not len(part):
                continue
            first = np.cumsum(size[part]) - size[part]
            within = np.arange(int(size[part].sum())) - np.repeat(first, size[part])
            power = np.cumprod(np.full(int(size[part].max()), base, dtype=np.uint64))
            terms = power[within] * (data[np.repeat(starts[part], size[part]) + within].astype(np.uint64) + np.uint64(1))
            total[part] = np.add.reduceat(terms, first)
        total = (total ^ (size.astype(np.uint64) << np.uint64(56))) * _ODD
        return total ^ (total >> np.uint64(29))


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values in each group."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    first = np.ones(len(g), dtype=bool)
    first[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[first], minlength=n)


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages and the number of passages of each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(ends_of, starts, side="right")
    n_words = np.bincount(doc, minlength=len(raw))
    per = np.maximum(PASSAGE_WORDS, -(-n_words // MAX_PASSAGES))
    count = np.maximum(1, -(-n_words // per))
    first = np.cumsum(count) - count
    within = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = first[doc] + within // per[doc] if len(starts) else np.zeros(0, dtype=np.int64)
    n = int(count.sum())
    words = np.bincount(passage, minlength=n)
    some = np.maximum(words, 1)

    # A byte belongs to the passage of the last word that began before it, or to its text's first.
    last = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
    doc_of = np.repeat(np.arange(len(raw)), [len(r) + 1 for r in raw])
    own = np.maximum(passage[np.maximum(last, 0)] if len(passage) else 0, first[doc_of])
    mix = np.bincount(own * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    out[:, :CLASSES] = mix / np.maximum(mix.sum(axis=1, keepdims=True), 1)

    size = (ends - starts).astype(np.float64)
    h = _word_hashes(data, starts, ends)
    upper = np.add.reduceat(np.concatenate([(_CLASS[data] == 2).astype(np.int64), [0]]), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0)
    letter = np.add.reduceat(np.concatenate([(_CLASS[data] < 3).astype(np.int64), [0]]), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0)
    mean = np.bincount(passage, size, n) / some
    pair = (passage[1:] == passage[:-1]) if len(passage) else np.zeros(0, dtype=bool)
    again = pair & (h[1:] == h[:-1]) if len(passage) else pair
    with np.errstate(over="ignore"):
        two = h[:-1] * np.uint64(31) + h[1:] if len(passage) else h
    shape = [
        mean / 10,
        np.sqrt(np.maximum(np.bincount(passage, size**2, n) / some - mean**2, 0)) / 10,
        _distinct(passage, h, n) / some,
        np.bincount(passage[1:][again], minlength=n) / some if len(passage) else np.zeros(n),
        _distinct(passage[1:][pair], two[pair], n) / some if len(passage) else np.zeros(n),
        np.bincount(passage, (upper == size) & (size > 1), n) / some,
        np.bincount(passage, letter == 0, n) / some,
        np.bincount(passage, letter < size, n) / some,
        np.log1p(words) / 5,
    ]
    out[:, CLASSES:CLASSES + SHAPES] = np.stack(shape, axis=1)
    bag = np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, CLASSES + SHAPES:] = np.sqrt(bag / some[:, None])
    return out, count


@dataclass
class Model:
    """Weights of the bag scorer; ``constant`` is set where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Scores of bags: ``count`` passages of ``x`` each."""
        if self.constant is not None:
            return np.full(len(count), self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, count)[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray):
    starts = np.cumsum(count) - count
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * s) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
    a = e / np.repeat(np.add.reduceat(e, starts), count)
    z = np.add.reduceat(a[:, None] * h, starts)
    return _sigmoid(z @ w["c"] + w["d"]), h, t, s, a, z


def loss(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, label: np.ndarray) -> float:
    """Mean cross-entropy of the bags' scores."""
    p = _forward(w, x, count)[0]
    return float(-np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))


def gradient(w: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of :func:`loss`, through the weighted sum and the attention back to the encodings."""
    starts = np.cumsum(count) - count
    p, h, t, s, a, z = _forward(w, x, count)
    dp = (p - label) / len(label)
    dz = np.repeat(dp[:, None] * w["c"], count, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
    dt, ds = de[:, None] * w["w"] * s * (1 - t**2), de[:, None] * w["w"] * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ w["V"].T + ds @ w["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dp, "d": dp.sum(keepdims=True)}


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 200,
          rate: float = 0.02, decay: float = 0.1, seed: int = 3) -> Model:
    """Fit the bag scorer by Adam on all bags at once; ``label`` is 0 or 1."""
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float(label.mean()) if len(label) else 1.0)
    x = x.astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, WIDTH**-0.5, (x.shape[1], hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
         "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, epochs + 1):
        grad = gradient(w, x, count, label)
        for k, g in grad.items():
            if g.ndim == 2:
                g = g + decay * w[k] / len(label) ** 0.5
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_training_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Fit on at most ``max_training_docs`` of the ids in ``labels``."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("__label"))
        .orderBy(F.xxhash64("__id", F.lit(17)), "__id").limit(max_training_docs)
    )
    bags = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .join(F.broadcast(chosen), "__id")  # at most max_training_docs ids
        .groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, count = encode_passages([batch.column("__text")[i].as_py()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").slice(i, 1).cast(pa.string()), batch.column("__label").slice(i, 1), pa.array([int(count[0])], pa.int64()), pa.array([x.tobytes()], pa.binary())],
                    names=["id", "label", "n", "x"])

    rows = sorted(bags.mapInArrow(run, "id string, label double, n long, x binary").collect(), key=lambda r: r["id"])
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]) if rows else np.zeros((0, WIDTH))
    return train(x, np.array([r["n"] for r in rows], dtype=np.int64), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``score_col`` (0 to 1, higher: label 1 likelier)."""
    kept = [f for f in docs.schema if f.name.lower() != score_col and (keep_text or f.name != text_col)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, held = 0, [], 0
            for i in range(batch.num_rows + 1):
                text = batch.column(text_col)[i].as_py() if i < batch.num_rows else None
                if i == batch.num_rows or (texts and held + len(text or "") > STEP_BYTES):
                    if texts:
                        part = batch.slice(at, len(texts))
                        found = np.round(model.score(*encode_passages(texts)), 6)
                        yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(found, pa.float64())], names=[*names, score_col])
                    at, texts, held = i, [], 0
                texts.append(text)
                held += len(text or "")
            del batch
            pa.default_memory_pool().release_unused()  # workers stay; a large batch's memory should not

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str):
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
