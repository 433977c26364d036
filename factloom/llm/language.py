"""Language identification by averaged subword embeddings and a linear softmax.

A text's subwords are the runs of 3 and of 4 bytes of its lower-cased letters
(with one blank for whatever separates words), hashed into buckets. Each bucket
has an embedding; a text is the mean of its subwords' embeddings, and a linear
softmax turns that into languages. Both layers are trained together by
stochastic gradient descent. A temperature fitted on texts kept out of the
descent calibrates the probabilities, and a score below the level that only one
in a hundred right answers falls under is marked as not reliable.

Since mean and linear layer commute, prediction looks up a row of language
scores for each subword and needs no embedding of the text.
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

#: Labelled documents that the model is fitted on, about.
SAMPLE = 2000
BUCKETS, WIDTH = 1 << 14, 16
EPOCHS, BATCH, RATE = 12, 32, 0.05
UNKNOWN = "und"

#: Letters in lower case; anything else of ASCII separates words.
_CODES = np.arange(256, dtype=np.uint32)
_CODES[0x41:0x5B] += 32
_CODES[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def subwords(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-byte and the 4-byte subwords that begin at each byte."""
    c = _CODES[buf]
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    longer = (h[:-1] * np.uint32(0x27D4EB2F)) ^ (c[3:] * np.uint32(0x165667B1))
    return _spread(h), _spread(longer)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def _packed(buf: np.ndarray) -> np.ndarray:
    """The text's buckets, then their counts on a scale up to 65,535: at most 64 KB whatever the text's length."""
    if len(buf) < 4:
        return np.zeros(0, np.uint16)
    counts = np.bincount(np.concatenate(subwords(buf)), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    counts = counts[buckets]
    return np.concatenate((buckets, np.maximum(1, np.rint(counts * min(1.0, 65535 / counts.max()))))).astype(np.uint16)


def _has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
    out = np.diff(seen[offsets]) > 0
    for d in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[d] = any(c.isalpha() for c in buf[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # a row of language scores for each bucket
    bias: np.ndarray
    temperature: float
    reliable: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[np.ndarray], labels: list[str], seed: int = 5) -> Model:
    """texts: the counted buckets of each, as packed by _packed(); a fifth of them only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(y))
    kept, used = order[: len(y) // 5], order[len(y) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    speeds = [np.full_like(x, 1e-6) for x in (embed, out, bias)]

    def rows(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for i, d in enumerate(which):
            buckets, weights = texts[d].reshape(2, -1)
            if len(buckets):
                x[i, buckets] = weights / weights.sum(dtype=np.float64)
        return x

    for _ in range(EPOCHS):
        for i in range(0, len(used), BATCH):
            which = used[i : i + BATCH]
            x = rows(which)
            mean = x @ embed
            wrong = _softmax(mean @ out + bias)
            wrong[np.arange(len(which)), y[which]] -= 1
            wrong /= len(which)
            for value, speed, slope in zip((embed, out, bias), speeds, (x.T @ (wrong @ out.T), mean.T @ wrong, wrong.sum(0)), strict=True):
                speed += slope**2  # steps shrink with the slopes so far
                value -= RATE * slope / np.sqrt(speed)
        used = rng.permutation(used)
    held = kept if len(kept) else used
    scores = np.concatenate([rows(held[i : i + BATCH]) @ embed @ out + bias for i in range(0, len(held), BATCH)])
    loss = [(-np.log(_softmax(scores / t)[np.arange(len(held)), y[held]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 41)]
    temperature = float(min(loss)[1])
    p = _softmax(scores / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    return Model(languages, embed @ out, bias, temperature, float(np.quantile(right, 0.01)) if len(right) else 1.0)


def predict(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Calibrated probabilities, a row for each document."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    total, count = np.zeros((docs, len(model.languages))), np.zeros(docs)
    if len(buf) >= 4:
        for k, buckets in zip((3, 4), subwords(buf), strict=True):
            n = np.maximum(size - k + 1, 0)
            some = np.flatnonzero(n)
            at = np.repeat(offsets[:-1][some], n[some]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            total[some] += np.add.reduceat(model.table[buckets[at]], np.cumsum(n[some]) - n[some], axis=0) if len(some) else 0
            count += n
    return _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of documents outside the held-out fold, fitted
    on about ``sample`` of them (at most twice as many), in equal parts. Null
    languages and texts are left out. Without any, nothing is ever predicted.
    The driver gets at most 64 KB for each of them, as packed bytes.
    """
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").alias("label")).where(~samples.held_out(F.col("doc_id")))
    chosen = samples.labelled_sample(known, sample)
    rows = tk.narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most 2 * sample rows

    @tk.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text"):
            found = [_packed(buf[i:j]).tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield tk.batch(rows, ("doc_id", "label"), text=pa.array(found, pa.binary()))

    found = rows.mapInArrow(count, tk.schema_of(rows, ("doc_id", "label"), "text binary")).collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    return train([np.frombuffer(r["text"], np.uint16) for r in found], [r["label"] for r in found])


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (its calibrated probability),
    reliable (the score is not rejected) and the carried columns in ``row``.

    A null text or one without a letter is ``und`` with score 0, and so is
    every text if the model knows no language. Only the text counts. A task
    holds a few MB of text, or one document, at a time.
    """
    rows = tk.narrow(docs, id_col, text_col, carry)
    names = ("doc_id", "row")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows

    @tk.tidy
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = np.array([*model.languages, UNKNOWN], object)
        for rows, buf, offsets in tk.pieces(batches, "text"):
            some = _has_letter(buf, offsets) & bool(model.languages)
            p = predict(buf, offsets, model) if model.languages else np.zeros((len(some), 1))
            best = np.where(some, p.argmax(1), len(known) - 1)
            score = np.where(some, p.max(1), 0.0)
            yield tk.batch(rows, names, lang_pred=pa.array(known[best], pa.string()), score=pa.array(score), reliable=pa.array(some & (score >= model.reliable)))

    return rows.mapInArrow(guess, tk.schema_of(rows, names, "lang_pred string, score double, reliable boolean"))
