"""Removal of repeated passages with repeated-phrase automata.

A window is ``window`` consecutive words. A word goes if a window that covers
it also starts earlier in the corpus (smaller doc_id, or earlier in the same
document); so of every repeated passage the first copy stays.

1. Phrases. A word is a symbol of a small alphabet, so that a phrase of
   ``phrase`` words fits into 60 bits. Among the phrases inside a window, the
   one with the smallest mixed value is its anchor: equal windows have equal
   anchors at equal offsets, and only about a sixth of all positions are
   anchors. They are counted over all documents; those seen more than once are
   confirmed. Texts with equal symbols but other words only cost a look.
2. Automata. Documents are dealt into groups of about GROUP_BYTES of text. A
   group gets the confirmed phrases that its documents hold, as symbols, and
   compiles them, a shard at a time, into Aho-Corasick automata. All its
   documents then stream through them; where a phrase occurs is known from the
   automata alone. A repeated window must hold an occurrence.
3. Windows. The windows that hold a located phrase meet by hash; the smallest
   (doc_id, start) of each hash is its first occurrence, all others go. Each
   task sends only its own first occurrence of a window, so a window that
   stands in a third of all documents costs a row per task.
4. The documents meet the starts of their removed windows.

Rows of step 1 and 3 travel as packed blobs, a few per task and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import blobs
from factloom.llm import textkit as tk

U64 = np.uint64
#: Bytes of a group's text, about, and phrases of an automaton.
GROUP_BYTES, SHARD = 8 << 20, 500_000
_FIRST_SYMBOL = 0x100


def _bits(phrase: int) -> int:
    """Bits of a word's symbol; those of a phrase fit into 60."""
    if phrase > 60:
        raise ValueError("a phrase has at most 60 words")
    return max(1, min(16, 60 // phrase))


def _symbols(w: tk.Words, phrase: int) -> np.ndarray:
    return w.hash >> U64(64 - _bits(phrase))


def _anchors(w: tk.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, mixed symbols) of the anchors of all windows; of equal ones the leftmost."""
    at = np.flatnonzero(np.arange(len(w)) <= np.repeat(w.first[1:], w.counts) - phrase)
    symbols, h = _symbols(w, phrase), np.zeros(len(at), U64)
    for k in range(phrase):
        h = (h << U64(_bits(phrase))) | symbols[at + k]
    h = tk.mix(h)
    span = window - phrase + 1
    if len(at) < span:
        return at[:0], h[:0]
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    chosen = np.arange(len(views)) + views.argmin(1)
    inside = at[span - 1 :] - at[: len(views)] == span - 1  # not across documents
    chosen = np.unique(chosen[inside])
    return at[chosen], h[chosen]


def repeated_starts(docs: DataFrame, window: int = 20, phrase: int = 10, groups: int | None = None) -> DataFrame:
    """Blobs (group, 0, packed (doc_id, start)) of windows that start earlier elsewhere.

    docs: doc_id and text, as from textkit.narrow().
    """
    n = tk.partitions(docs.sparkSession)
    groups = groups or _group_count(docs, n)
    buckets, shard = groups, SHARD

    @tk.tidy
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(hashes: list[np.ndarray], group: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
            h, g = np.concatenate(hashes), np.concatenate(group)
            by = np.lexsort((g, h))
            h, g = h[by], g[by]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
            times = np.minimum(np.diff(np.append(new, len(h))), 2).astype(np.uint8)
            h, g = h[new], g[new]
            yield from blobs.sent(blobs.bucket_of(h, buckets), 0, h, g.astype(np.uint32), times)

        def sent() -> Iterator[tuple[int, int, bytes]]:
            hs, gs, size = [], [], 0
            for rows, buf, offsets in tk.pieces(batches, "text"):
                w = tk.Words(buf, offsets, tk.SPACE, lower=False)
                at, h = _anchors(w, window, phrase)
                group = blobs.group_of(_ids(rows), groups)
                hs.append(h)
                gs.append(group[w.doc[at]])
                size += len(h)
                if size > blobs.FLUSH // 2:
                    yield from flush(hs, gs)
                    hs, gs, size = [], [], 0
            if size:
                yield from flush(hs, gs)

        return blobs.batches_of(sent())

    @tk.tidy
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple[int, int, bytes]]:
            for held in blobs.by_bucket(batches):
                columns = [tk.unpack(x[2]) for x in held]
                h = np.concatenate([tk.ungaps(c[0]) for c in columns])
                g = np.concatenate([c[1] for c in columns])
                times = np.concatenate([c[2] for c in columns])
                by = np.argsort(h, kind="stable")
                h, g, times = h[by], g[by], times[by]
                new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                many = np.repeat(np.add.reduceat(times.astype(np.int64), new) > 1, np.diff(np.append(new, len(h))))
                h, g = h[many], g[many]
                by = np.lexsort((h, g))
                h, g = h[by], g[by]
                if len(g):
                    yield from blobs.sent(g.astype(np.int64), 0, h)

        return blobs.batches_of(sent())

    @tk.tidy
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
            h, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((s, d, h))
            h, d, s = h[by], d[by], s[by]
            first = np.concatenate(([True], h[1:] != h[:-1]))
            own = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(h))))
            later = (d != d[own]) | (s != s[own])
            tie = ~later & ~first  # a repeated row: neither is earlier, and both are sent
            to = blobs.bucket_of(h, buckets)
            yield from blobs.sent(to[first | tie], 0, h[first | tie], d[first | tie], s[first | tie])
            yield from blobs.sent(to[later], 1, h[later], d[later], s[later])

        def sent() -> Iterator[tuple[int, int, bytes]]:
            found, size = [], 0
            for rows, buf, offsets, machines in _with_automata(batches, phrase, shard):
                if not machines:
                    continue
                w = tk.Words(buf, offsets, tk.SPACE, lower=False)
                at = _candidates(w, machines, window, phrase)
                ids = _ids(rows)
                of = w.doc[at]
                found.append((w.run_hash(at, window), ids[of], (at - w.first[of]).astype(np.uint32)))
                size += len(at)
                if size > blobs.FLUSH:
                    yield from flush(found)
                    found, size = [], 0
            if size:
                yield from flush(found)

        return blobs.batches_of(sent())

    @tk.tidy
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple[int, int, bytes]]:
            for held in blobs.by_bucket(batches):
                known = [tk.unpack(x[2]) for x in held if x[1] == 1]
                own = [tk.unpack(x[2]) for x in held if x[1] == 0]
                d, s = ([c[i] for c in known] for i in (1, 2))
                if own:
                    h = np.concatenate([tk.ungaps(c[0]) for c in own])
                    doc, start = np.concatenate([c[1] for c in own]).view(np.int64), np.concatenate([c[2] for c in own])
                    by = np.lexsort((start, doc, h))
                    h, doc, start = h[by], doc[by], start[by]
                    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    first = np.repeat(new, np.diff(np.append(new, len(h))))
                    gone = (doc != doc[first]) | (start != start[first])
                    d, s = [*(x.view(np.int64) for x in d), doc[gone]], [*s, start[gone]]
                d, s = np.concatenate([x.view(np.int64) for x in d]), np.concatenate(s)
                g = blobs.group_of(d, groups)
                by = np.lexsort((s, d, g))
                d, s, g = d[by], s[by], g[by]
                if len(g):
                    yield from blobs.sent(g, 0, d.view(U64), s)

        return blobs.batches_of(sent())

    counted = blobs.dealt(docs.select("doc_id", "text").mapInArrow(anchors, blobs.SCHEMA), n).mapInArrow(confirmed, blobs.SCHEMA)
    found = _beside(docs, counted, groups, n).mapInArrow(located, blobs.SCHEMA)
    return blobs.dealt(found, n).mapInArrow(later, blobs.SCHEMA)


def _group_count(docs: DataFrame, partitions: int) -> int:
    """A multiple of the partitions, by which groups hold GROUP_BYTES of text at most, about."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return partitions * max(1, -(-size // (partitions * GROUP_BYTES)))


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    ids = rows.column("doc_id")
    return (ids.fill_null(np.iinfo(np.int64).min) if ids.null_count else ids).to_numpy()


def _beside(docs: DataFrame, packed: DataFrame, groups: int, partitions: int) -> DataFrame:
    """Each group's blobs, then its documents, in one partition."""

    @tk.tidy
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(blobs.group_of(_ids(b), groups)), *b.columns], names=["to", *b.schema.names])

    rows = docs.mapInArrow(dealt, T.StructType([T.StructField("to", T.LongType()), *docs.schema.fields]))
    rows = rows.withColumns({"kind": F.lit(1), "blob": F.lit(None).cast("binary")})
    both = packed.drop("kind").withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return blobs.dealt(both, partitions, "kind", "doc_id")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes] | None, pa.RecordBatch | None]]:
    """(group, its blobs, None), then (group, None, documents) one or more times."""
    group, packed, told = None, [], False
    for b in batches:
        to, kind = b.column("to").to_numpy(), b.column("kind").to_numpy()
        edges = np.flatnonzero((np.diff(to, prepend=to[0] - 1) != 0) | (np.diff(kind, prepend=-1) != 0)) if len(to) else []
        for i, j in zip(edges, [*edges[1:], len(to)], strict=True):
            if to[i] != group:
                if group is not None and not told:
                    yield group, packed, None
                group, packed, told = int(to[i]), [], False
            if kind[i] == 0:
                packed += b.column("blob").slice(i, j - i).to_pylist()
                continue
            if not told:
                yield group, packed, None
                told = True
            yield group, None, b.slice(i, j - i)


def _with_automata(batches: Iterator[pa.RecordBatch], phrase: int, shard: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[ahocorasick.Automaton]]]:
    """A group's documents, a few at a time, with the group's automata."""
    machines: list[ahocorasick.Automaton] = []
    for _, packed, docs in _parts(batches):
        if packed is not None:
            machines = []  # the last group's go first
            machines = _automata(np.unique(np.concatenate([np.zeros(0, U64), *(tk.ungaps(tk.unpack(x)[0]) for x in packed)])), phrase, shard)
        else:
            for rows, buf, offsets in tk.pieces(iter([docs]), "text"):
                yield rows, buf, offsets, machines


def _automata(confirmed: np.ndarray, phrase: int, shard: int = SHARD) -> list[ahocorasick.Automaton]:
    """Automata of the confirmed phrases, ``shard`` in each."""
    out = []
    for k in range(0, len(confirmed), shard):
        value, bits = tk.unmix(confirmed[k : k + shard]), _bits(phrase)
        shifts = np.arange(phrase - 1, -1, -1).astype(U64) * U64(bits)
        symbols = (value[:, None] >> shifts) & U64((1 << bits) - 1)
        text = _text(symbols.reshape(-1))
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in range(0, len(text), phrase):
            machine.add_word(text[i : i + phrase])
        machine.make_automaton()
        out.append(machine)
    return out


def _text(symbols: np.ndarray) -> str:
    code = symbols.astype(np.uint32) + np.uint32(_FIRST_SYMBOL)
    return (code + np.uint32(0x800) * (code >= 0xD800)).astype(np.uint32).tobytes().decode("utf-32-le")  # no surrogates


def _candidates(w: tk.Words, machines: list[ahocorasick.Automaton], window: int, phrase: int) -> np.ndarray:
    """First words of the windows that hold an occurrence of a confirmed phrase."""
    text = _text(_symbols(w, phrase))
    hits: list[int] = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if j - i >= window:
            for machine in machines:
                hits += [e for e, _ in machine.iter(text, i, j)]
    start = np.array(hits, np.int64) - phrase + 1
    marks = np.zeros(len(w) + 1, np.int32)
    low = np.maximum(start - (window - phrase), w.first[w.doc[start]])
    np.add.at(marks, low, 1)
    np.add.at(marks, start + 1, -1)
    last = np.repeat(w.first[1:], w.counts) - window
    return np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (np.arange(len(w)) <= last))


RESULT = "n_words long, n_removed long, kept binary"


def without_repeats(docs: DataFrame, window: int = 20, phrase: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the words that stay,
    joined by one space) and the carried columns in struct ``row``.

    A null or empty text has no words. Rows with the same doc_id are taken for
    the same document: a window at the same start in both is not repeated.
    An empty table gives an empty one. However long a text, it is read whole; a
    task holds the phrases of one bucket or of one group of documents, a few MB
    of text, and one document at most.
    """
    spark = docs.sparkSession
    n = tk.partitions(spark)
    rows = tk.narrow(docs, id_col, text_col, carry)
    groups = _group_count(rows, n)
    starts = repeated_starts(rows, window, phrase, groups)
    names = ("doc_id", "row")

    @tk.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, packed, docs in _parts(batches):
            if packed is not None:
                columns = [tk.unpack(x) for x in packed]
                doc = np.concatenate([np.zeros(0, np.int64), *(tk.ungaps(c[0]).view(np.int64) for c in columns)])
                start = np.concatenate([np.zeros(0, np.int64), *(c[1].astype(np.int64) for c in columns)])
                by = np.argsort(doc, kind="stable")
                doc, start = doc[by], start[by]
                continue
            for rows, buf, offsets in tk.pieces(iter([docs]), "text"):
                w = tk.Words(buf, offsets, tk.SPACE, lower=False)
                ids = _ids(rows)
                lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                marks = np.zeros(len(w) + 1, np.int32)
                for d in np.flatnonzero(hi > lo):
                    s = w.first[d] + start[lo[d] : hi[d]]
                    s = s[s + window <= w.first[d + 1]]
                    np.add.at(marks, s, 1)
                    np.add.at(marks, s + window, -1)
                gone = np.cumsum(marks[:-1]) > 0
                of = w.doc
                removed = np.bincount(of[gone], minlength=w.docs)
                yield tk.batch(rows, names, n_words=pa.array(w.counts.astype(np.int64)), n_removed=pa.array(removed.astype(np.int64)), kept=_joined(w, ~gone))

    return _beside(rows, starts, groups, n).mapInArrow(cut, tk.schema_of(rows, names, RESULT)).withColumn("kept", F.col("kept").cast("string"))


def _joined(w: tk.Words, stays: np.ndarray) -> pa.Array:
    """For each document the words that stay, joined by one space."""
    start, end, of = w.start[stays], w.end[stays], w.doc[stays]
    size = end - start + 1  # with a space
    to = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(to[-1]), 0x20, np.uint8)
    source = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    body = np.ones(len(out), bool)
    body[to[1:] - 1] = False
    out[body] = w.buf[source[body]]
    counts = np.bincount(of, minlength=w.docs)
    ends = to[np.concatenate(([0], np.cumsum(counts)))]
    raw = out.tobytes()
    return pa.array([raw[i : max(i, j - 1)] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
