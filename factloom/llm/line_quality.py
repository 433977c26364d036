"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are counts of its characters and words,
whether it repeats, and the same features of the lines before and after it; the
chain adds a weight for each pair of neighbouring labels. Training takes the
document's label for all its lines and climbs the likelihood with the gradient
from forward-backward. A document's quality is the mean of its lines' marginals
weighted by their length, put on the scale of the labels by a logistic curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import samples
from factloom.llm import textkit as tk

#: Labelled documents that the model is fitted on, about; their lines, and those of one of them, at most.
SAMPLE, SAMPLE_LINES, DOCUMENT_LINES = 3000, 300_000, 2000
ITERATIONS, RATE, DECAY = 150, 0.1, 1e-3

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_CLASSES = [
    _table(bytes(range(0x41, 0x5B))),
    _table(bytes(range(0x61, 0x7B))),
    _table(bytes(range(0x30, 0x3A))),
    _table(b".,;:?'\"()-"),
    _table(b"#$%&*!|<>{}[]~^_=+\\/@`"),
    _table(bytes(range(0x80, 0x100))),
]
FEATURES = len(_CLASSES) + 7


class Lines(NamedTuple):
    """Lines of a run of documents: those of document d are first[d]:first[d + 1]."""

    first: np.ndarray
    size: np.ndarray
    features: np.ndarray


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines (an empty document is one empty line) and their features."""
    n = len(buf)
    docs = len(offsets) - 1
    breaks = np.flatnonzero(_NEWLINE[buf])
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    of = np.concatenate((np.arange(docs), np.searchsorted(offsets, breaks, "right") - 1))
    first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=docs))))
    line_doc = np.repeat(np.arange(docs), np.diff(first))
    end = np.append(start[1:], n)
    end = np.minimum(end, offsets[line_doc + 1])
    size = (end - start).astype(np.float64)
    safe = np.maximum(size, 1)
    bounds = np.minimum(start, max(0, n - 1))

    def total(values: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(len(at))
        return np.where(counts > 0, np.add.reduceat(values, np.minimum(at, len(values) - 1)), 0)

    columns = [total(c[buf], bounds, size) / safe for c in _CLASSES]
    w = tk.Words(buf, offsets, tk.SPACE, lower=True)
    word_at = np.searchsorted(w.start, start)
    words = np.diff(np.append(word_at, len(w))).astype(np.float64)
    some = np.maximum(words, 1)
    line_of = np.repeat(np.arange(len(start)), words.astype(np.int64))

    def new(group: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w), np.float32)
        out[np.unique(tk.mix(w.hash + group.astype(tk.U64) * tk.U64(0x9E3779B97F4A7C15)), return_index=True)[1]] = 1
        return out

    same = np.zeros(len(w), np.float32)
    if len(w) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (line_of[1:] == line_of[:-1])
    columns += [
        np.log1p(size) / 8, np.log1p(words) / 6, np.minimum((w.end - w.start).sum() and total((w.end - w.start).astype(np.float64), word_at, words) / some / 10, 3),
        total(same, word_at, words) / some, 1 - total(new(line_of), word_at, words) / some, 1 - total(new(w.doc), word_at, words) / some,
    ]
    sums = np.zeros(len(w) + 1, tk.U64)
    np.cumsum(w.hash * (np.arange(len(w), dtype=tk.U64) - np.repeat(word_at, words.astype(np.int64)).astype(tk.U64) * tk.U64(1) + tk.U64(1)), out=sums[1:], dtype=tk.U64)
    line_hash = tk.mix(sums[np.append(word_at[1:], len(w))] - sums[word_at] + line_doc.astype(tk.U64) * tk.U64(0xD1B54A32D192ED03))
    repeated = np.ones(len(start))
    repeated[np.unique(line_hash, return_index=True)[1]] = 0
    columns.append(np.where(words > 0, repeated, 0))
    return Lines(first, size, np.column_stack(columns))


class _Chains:
    """Documents of different length side by side: step t has those with more than t lines."""

    def __init__(self, first: np.ndarray) -> None:
        counts = np.diff(first)
        by = np.argsort(-counts, kind="stable")
        self.start = first[:-1][by]
        self.active = np.searchsorted(-counts[by], -np.arange(1, (counts.max() if len(counts) else 0) + 1), "right")

    def run(self, emission: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of label 1 of each line, expected pairs of neighbouring labels).

        emission: the log weight of label 1 against 0; moves: 2 x 2 log weights.
        """
        n = len(emission)
        forward, backward = np.zeros((n, 2)), np.ones((n, 2))
        local = np.column_stack((1 / (1 + np.exp(np.clip(emission, -30, 30))), 1 / (1 + np.exp(-np.clip(emission, -30, 30)))))
        step = np.exp(moves)
        steps = len(self.active)
        for t in range(steps):
            at = self.start[: self.active[t]] + t
            value = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
            forward[at] = value / value.sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            at = self.start[: self.active[t + 1]] + t
            value = (local[at + 1] * backward[at + 1]) @ step.T
            backward[at] = value / value.sum(1, keepdims=True)
        both = forward * backward
        pairs = np.zeros((2, 2))
        for t in range(steps - 1):
            at = self.start[: self.active[t + 1]] + t
            joint = forward[at][:, :, None] * step[None] * (local[at + 1] * backward[at + 1])[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return both[:, 1] / both.sum(1), pairs


class Model(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float


def _emissions(lines: Lines, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(features with the neighbours' and a constant, emission of each line)."""
    own = (lines.features - model.center) / model.scale
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = np.ones(n, bool)
    inner[lines.first[:-1]] = False
    before[inner] = own[np.flatnonzero(inner) - 1]
    after[np.flatnonzero(inner) - 1] = own[inner]
    wide = np.column_stack((own, before, after, np.ones(n)))
    return wide, wide @ model.weights


def _document_means(lines: Lines, marginals: np.ndarray) -> np.ndarray:
    weight = lines.size + 1
    return np.add.reduceat(marginals * weight, lines.first[:-1]) / np.add.reduceat(weight, lines.first[:-1])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(lines: Lines, labels: np.ndarray) -> Model:
    """Fits the chain's weights and the curve of document scores."""
    labels = labels.astype(np.float64)
    model = Model(lines.features.mean(0) if len(labels) else np.zeros(FEATURES), lines.features.std(0) + 1e-3 if len(labels) else np.ones(FEATURES), np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, 0.0)
    if not len(labels):
        return model
    prior = float(_log_odds(np.array([(labels.sum() + 1) / (len(labels) + 2)]))[0])
    if labels.min() == labels.max():
        return model._replace(offset=prior)
    chains, counts = _Chains(lines.first), np.diff(lines.first)
    each = np.repeat(labels, counts)
    kept = np.zeros((2, 2))
    for y in (0, 1):
        kept[y, y] = (counts - 1)[labels == y].sum()
    wide, _ = _emissions(lines, model)
    vector = np.zeros(wide.shape[1] + 4)
    m, v = np.zeros_like(vector), np.zeros_like(vector)
    for i in range(1, ITERATIONS + 1):
        marginals, pairs = chains.run(wide @ vector[:-4], vector[-4:].reshape(2, 2))
        slope = np.concatenate((wide.T @ (each - marginals), (kept - pairs).reshape(-1))) / len(each) - DECAY * vector
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        vector = vector + RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    model = model._replace(weights=vector[:-4], moves=vector[-4:].reshape(2, 2))
    x = _log_odds(_document_means(lines, chains.run(wide @ model.weights, model.moves)[0]))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        q = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * x).sum() - 0.1 * (slope - 1), (labels - p).sum()])
        h = np.array([[(q * x * x).sum() + 0.1, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
        change = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + change[0], offset + change[1]
    return model._replace(slope=float(slope), offset=float(offset))


def predict(lines: Lines, model: Model) -> np.ndarray:
    """The quality of each document, 0 to 1."""
    _, emission = _emissions(lines, model)
    marginals, _ = _Chains(lines.first).run(emission, model.moves)
    return 1 / (1 + np.exp(-np.clip(model.slope * _log_odds(_document_means(lines, marginals)) + model.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labels (1 good, 0 bad) of documents outside the held-out
    fold, fitted on about ``sample`` of them (at most twice as many), half of
    them good if there are enough. Of several labels of one document the lowest
    counts. Without labels, or with labels of one kind, scores are constant.
    The sample ends where its lines exceed ``SAMPLE_LINES``, and a document of
    it gives its middle ``DOCUMENT_LINES`` at most (with features from the whole
    text), so what the driver holds is bounded.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(~samples.held_out(F.col("doc_id")))
    chosen = samples.labelled_sample(known, sample)
    rows = tk.narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most 2 * sample rows

    @tk.tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text"):
            x = lines_of(buf, offsets)
            flat = np.column_stack((x.size, x.features)).astype(np.float32)
            packed = [flat[_run(i, j)].tobytes() for i, j in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True)]
            yield tk.batch(rows, ("doc_id", "label"), lines=pa.array(packed, pa.binary()))

    found = rows.mapInArrow(features, "doc_id long, label int, lines binary").select(F.xxhash64("doc_id").alias("draw"), "label", "lines")
    lines, y, total = [], [], 0
    for r in found.orderBy("draw", "label", "lines").toLocalIterator():
        x = np.frombuffer(r["lines"], np.float32).reshape(-1, FEATURES + 1)
        total += len(x)
        if y and total > SAMPLE_LINES:
            break
        lines.append(x)
        y.append(r["label"])
    values = np.concatenate([np.zeros((0, FEATURES + 1), np.float32), *lines]).astype(np.float64)
    first = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
    return train(Lines(first, values[:, 0], values[:, 1:]), np.array(y))


def _run(i: int, j: int) -> slice:
    """The middle DOCUMENT_LINES of lines i to j - 1."""
    spare = max(0, j - i - DOCUMENT_LINES)
    return slice(i + spare // 2, j - (spare - spare // 2))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1, the higher the likelier good) and
    the carried columns in struct ``row``.

    A null or empty text is one empty line. Only the text counts. A task holds
    a few MB of text, or one document, at a time.
    """
    rows = tk.narrow(docs, id_col, text_col, carry)
    names = ("doc_id", "row")

    @tk.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text"):
            yield tk.batch(rows, names, score=pa.array(predict(lines_of(buf, offsets), model)))

    return rows.mapInArrow(score, tk.schema_of(rows, names, "score double"))
