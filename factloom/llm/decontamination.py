"""Benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item gives windows of ``window`` consecutive words (a shorter item
is one window). A window is contained in a document only if all its words are,
so by the prefix principle one word of each window is enough to join on: the
rarest one, by counts over all documents. Each place of that word in a document
proposes one start (positional bound), the window has to end within the
document (length bound), and the proposal is then verified word by word.

The benchmark is the query side. It is read in blocks of at most
``block_windows`` windows, each broadcast, so what is broadcast is bounded
whatever the benchmark's size; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as tk

#: Windows in a broadcast block: about 20 MB.
BLOCK_WINDOWS = 200_000
#: Proposals verified at once.
_PROPOSALS = 1 << 20
RESULT = "n_words long, n_hit long, hits array<int>, items array<string>"


class _Block:
    """Windows of some items: length, words' hashes, text and item of each."""

    def __init__(self) -> None:
        self.words: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.texts: list[bytes] = []
        self.items: list[str] = []

    def add(self, item: str, text: bytes | None, window: int) -> None:
        buf, offsets = tk.arrays(pa.array([text or b""], pa.binary()))
        w = tk.Words(buf, offsets, tk.NON_ALNUM, lower=True)
        if not len(w):
            return
        size = min(window, len(w))
        at, hashes = w.runs(size)
        for i, h in zip(at, hashes, strict=True):
            self.words.append(w.hash[i : i + size])
            self.hashes.append(h)
            self.texts.append(w.text(i, i + size))
            self.items.append(item)

    def by_prefix(self, vocabulary: np.ndarray, counts: np.ndarray) -> tuple:
        """The windows in order of their rarest word."""
        token, offset = [], []
        for words in self.words:
            order = counts[np.searchsorted(vocabulary, words)]
            best = int(np.lexsort((np.arange(len(words)), words, order))[0])
            token.append(words[best])
            offset.append(best)
        by = np.argsort(np.array(token, tk.U64), kind="stable")
        pick = lambda x, t: np.array(x, t)[by]
        return (pick(token, tk.U64), pick(offset, np.int64), pick([len(x) for x in self.words], np.int64), pick(self.hashes, tk.U64), [self.texts[i] for i in by], [self.items[i] for i in by])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[_Block]:
    block = _Block()
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary")).where(F.col(f"`{item_col}`").isNotNull())
    for item, text in rows.toLocalIterator():
        block.add(item, text, window)
        if len(block.items) >= most:
            yield block
            block = _Block()
    if block.items:
        yield block


def _document_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tk.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = shared.value, None
        for _, buf, offsets in tk.pieces(batches, "text"):
            h = tk.Words(buf, offsets, tk.NON_ALNUM, lower=True).hash
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            seen = np.bincount(at[vocab[at] == h], minlength=len(vocab))
            total = seen if total is None else total + seen
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    for word, n in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():  # at most a block's words
        counts[word] = n
    return counts


def _verified(w: tk.Words, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence."""
    token, offset, size, hashes, texts, _ = table
    lo, hi = np.searchsorted(token, w.hash, "left"), np.searchsorted(token, w.hash, "right")
    places = np.flatnonzero(hi > lo)
    doc_of = w.doc
    found_at, found = [], []
    ends = np.cumsum(hi[places] - lo[places])
    i = 0
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PROPOSALS, "right")))
        p = places[i:j]
        n = hi[p] - lo[p]
        window = np.repeat(lo[p] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place = np.repeat(p, n)
        start = place - offset[window]
        d = doc_of[place]
        fits = (start >= w.first[d]) & (start + size[window] <= w.first[d + 1])
        start, window = start[fits], window[fits]
        same = w.run_hash(start, size[window]) == hashes[window]
        for s, k in zip(start[same], window[same], strict=True):
            if w.text(s, s + size[k]) == texts[k]:
                found_at.append(s)
                found.append(k)
        i = j
    return np.array(found_at, np.int64), np.array(found, np.int64)


def _ranges(covered: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of covered words, none across documents."""
    step = np.flatnonzero(covered)
    if not len(step):
        return step, step
    new = np.concatenate(([True], (np.diff(step) > 1) | (np.diff(doc_of[step]) > 0)))
    return step[new], step[np.concatenate((new[1:], [True]))] + 1


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, hits (start and end of each run
    of hit words, one after the other), items (distinct, sorted item ids whose
    windows occur), and the carried columns in struct ``row``.

    A null or empty text has no words and no hits. Rows are judged one by one,
    so repeated rows or doc_ids give as many results. Items with a null id or
    without words have no windows; an empty benchmark hits nothing. Texts and
    items of any length are read whole; columns that aren't carried play no
    part, whatever their names. One task
    holds at most a few MB of text, or one document.
    """
    out = tk.narrow(docs, id_col, text_col, carry)
    plain = out.select("text")
    out = out.withColumns({"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>"), "n_words": F.lit(None).cast("long"), "n_hit": F.lit(0).cast("long")})
    blocks = 0
    for block in _blocks(benchmark, item_col, item_text_col, window, block_windows):
        out = _search(out, plain, block)
        blocks += 1
    if not blocks:
        out = _search(out, plain, None)
    return out.drop("text")


def _search(out: DataFrame, plain: DataFrame, block: _Block | None) -> DataFrame:
    table = None
    if block is not None:
        vocabulary = np.unique(np.concatenate(block.words))
        table = block.by_prefix(vocabulary, _document_counts(plain, vocabulary))
    shared = out.sparkSession.sparkContext.broadcast(table)
    names = ("doc_id", "text", "row")

    @tk.tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for rows, buf, offsets in tk.pieces(batches, "text"):
            w = tk.Words(buf, offsets, tk.NON_ALNUM, lower=True)
            doc_of = w.doc
            depth = np.zeros(len(w) + 1, np.int32)
            items = [set(x) for x in rows.column("items").to_pylist()]
            for d, seen in enumerate(rows.column("hits").to_pylist()):
                for s, e in zip(seen[::2], seen[1::2], strict=True):
                    depth[w.first[d] + s] += 1
                    depth[w.first[d] + e] -= 1
            if table is not None and len(w):
                at, which = _verified(w, table)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + table[2][which], -1)
                for d, k in zip(doc_of[at], which, strict=True):
                    items[d].add(table[5][k])
            s, e = _ranges(np.cumsum(depth[:-1]) > 0, doc_of)
            d = doc_of[s]
            flat = np.column_stack((s - w.first[d], e - w.first[d])).reshape(-1).astype(np.int32)
            yield tk.batch(
                rows, names,
                n_words=pa.array(w.counts.astype(np.int64)),
                n_hit=pa.array(np.bincount(d, weights=e - s, minlength=w.docs).astype(np.int64)),
                hits=tk.lists(2 * np.bincount(d, minlength=w.docs), pa.array(flat)),
                items=pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            )

    return out.mapInArrow(search, tk.schema_of(out, names, RESULT))
