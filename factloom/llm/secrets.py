"""Secrets in text: known shapes, and strings of high entropy.

Three base kinds have a pattern: an assignment to a secret's name, an access
key, a long run of lower-case hexadecimal digits. The others are found by
entropy. For each class of characters, candidates are the maximal runs of its
characters; a window slides over each one, and its Shannon entropy is kept up
by counts: a character that comes in as the k-th of its kind adds
``k log k - (k - 1) log (k - 1)``, one that leaves takes that away again. Sums
are integers (a table of ``k log2 k`` in units of 2**-20), so they don't depend
on the order of the steps. Windows that reach the class's entropy, and hold both
digits and letters, are merged into spans. A list of allowed words, places and
values suppresses spans, and says why.

All candidates of a megabyte of text are measured at once: how many characters
of its kind a character meets when it comes in or leaves is a difference of two
places in the sorted list of (character, place).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import textkit as tk

#: Base kinds in the order in which spans that start together are listed.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE = ("assign", "access", "hex")
_UNIT = 1 << 20


class CharacterClass(NamedTuple):
    """Characters, how many of them a window has, and the bits of entropy a character from which it counts."""

    name: str
    characters: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of ``k log2 k`` at which a window has the entropy."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * _UNIT)


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Most special first: a span that overlaps one of an earlier class is dropped.
CLASSES = (CharacterClass("hex_entropy", _DIGITS + "abcdefABCDEF", 20, 3.0), CharacterClass("base64_entropy", _DIGITS + _LOWER + _LOWER.upper() + "+/", 20, 3.8))
#: Digits and letters that a window has at least, of each.
LEAST_MIXED = 2
#: A candidate of at most SHORT characters that holds one of these (in either case) is a placeholder.
SHORT = 100
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxx", "123456789", "abcdefgh", "qwertyui")
#: A candidate within NEAR characters after one of these is a published digest or name.
DIGESTS = ("sha1", "sha256", "sha512", "md5", "checksum", "digest", "commit", "integrity", "etag", "uuid")
NEAR = 24
#: A candidate that stands in an address (``://`` and no blank before it, within so many characters) is a path.
IN_ADDRESS = 100

_CODES = np.array([0, *(round(k * math.log2(k) * _UNIT) for k in range(1, 4096))], np.int64)
_ADDRESS = re.compile(r"://[^\x20\x09-\x0D]*\Z")


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_TABLES = {c.name: _table(c.characters) for c in CLASSES}
_HEX, _DIGIT = _table(_DIGITS + "abcdef"), _table(_DIGITS)
_LETTER = _table(_LOWER + _LOWER.upper())


def window_sums(codes: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """For each character, the sum of ``k log2 k`` (in 2**-20) over the counts of
    the ``width`` characters that end with it, or of fewer where its run begins.

    ``run`` numbers the runs, ascending. Places of different runs are ``width``
    apart, so that no window reaches into another run.
    """
    n = len(codes)
    at = np.arange(n) + run * width
    key = codes.astype(np.int64) * (int(at[-1]) + 2 * width + 1 if n else 1) + at + width
    every = np.sort(key)
    place = np.searchsorted(every, key)
    came = place + 1 - np.searchsorted(every, key - width, "right")  # as the k-th of its kind
    left = np.searchsorted(every, key + width, "left") - place  # was the k-th of its kind
    steps = np.concatenate(([0], np.cumsum(_CODES[came] - _CODES[came - 1])))
    gone = np.concatenate(([0], np.cumsum(_CODES[left] - _CODES[left - 1])))
    first = np.searchsorted(run, run)
    return steps[1:] - steps[first] - (gone[np.maximum(np.arange(n) + 1 - width, first)] - gone[first])


def hot_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kind: CharacterClass) -> list[tuple[int, int, int, int]]:
    """(run, first byte, end, least sum of a window) of the merged windows of high entropy in the runs start:end."""
    size = end - start
    if not len(size):
        return []
    run = np.repeat(np.arange(len(size)), size)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    chars = buf[at]
    sums = window_sums(chars, run, kind.window)
    into = at - start[run] + 1
    mixed = np.ones(len(at), bool)
    for table in (_DIGIT, _LETTER):
        seen = np.concatenate(([0], np.cumsum(table[chars])))
        mixed &= seen[1:] - seen[np.maximum(np.arange(len(at)) + 1 - kind.window, 0)] >= LEAST_MIXED
    hot = np.flatnonzero((into >= kind.window) & mixed & (sums <= kind.most))
    if not len(hot):
        return []
    cuts = np.flatnonzero((np.diff(at[hot]) > kind.window) | (np.diff(run[hot]) > 0)) + 1
    parts = np.split(hot, cuts)
    return [(int(run[p[0]]), int(at[p[0]]) + 1 - kind.window, int(at[p[-1]]) + 1, int(sums[p].min())) for p in parts]


def _reason(data: bytes, begin: int, start: int, end: int, allowed: frozenset[bytes]) -> str | None:
    """Why the candidate start:end of the text from begin is allowed."""
    candidate = data[start:end]
    if candidate in allowed:
        return "value"
    low = candidate.lower()
    if len(low) <= SHORT and any(p.encode() in low for p in PLACEHOLDERS):
        return "placeholder"
    before = data[max(begin, start - 4 * IN_ADDRESS) : start].decode("utf-8", "ignore")[-IN_ADDRESS:]
    near = before[-NEAR:].encode().lower()
    if any(d.encode() in near for d in DIGESTS):
        return "digest"
    return "address" if _ADDRESS.search(before) else None


def _base(data: bytes, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    for m in ASSIGN.finditer(data, begin, end):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for m in ACCESS.finditer(data, begin, end):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield "access", m.start(), m.end()


_ORDER = {k: i for i, k in enumerate((*BASE, *(c.name for c in CLASSES)))}


def find(buf: np.ndarray, offsets: np.ndarray, allowed: frozenset[bytes] = frozenset()) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """For each text (kind, start, end, bits) of its spans and (kind, start, end,
    reason) of those suppressed, by start and then by kind; places are code points."""
    data = buf.tobytes()
    place = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    found: list[list[tuple]] = [[] for _ in offsets[1:]]
    kept_back: list[list[tuple]] = [[] for _ in offsets[1:]]
    edges = offsets.tolist()
    for d, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        found[d] += [(k, s, e, None) for k, s, e in _base(data, i, j)]
    runs = tk.Words(buf, offsets, ~_HEX, False)
    long = np.flatnonzero(runs.end - runs.start >= LEAST_HEX)
    for d, s, e in zip((np.searchsorted(runs.first, long, "right") - 1).tolist(), runs.start[long].tolist(), runs.end[long].tolist(), strict=True):
        found[d].append(("hex", s, e, None))
    taken: list[list[tuple[int, int]]] = [[] for _ in found]
    for kind in CLASSES:
        runs = tk.Words(buf, offsets, ~_TABLES[kind.name], False)
        long = np.flatnonzero(runs.end - runs.start >= kind.window)
        doc = np.searchsorted(runs.first, long, "right") - 1
        for r, s, e, least in hot_spans(buf, runs.start[long], runs.end[long], kind):
            d = int(doc[r])
            if any(s < y and x < e for x, y in taken[d]):
                continue
            taken[d].append((s, e))
            why = _reason(data, edges[d], int(runs.start[long[r]]), int(runs.end[long[r]]), allowed)
            if why:
                kept_back[d].append((kind.name, s, e, why))
            else:
                found[d].append((kind.name, s, e, round(math.log2(kind.window) - least / _UNIT / kind.window, 4)))

    def told(rows: list[tuple], d: int) -> list[tuple]:
        return [(k, int(place[s] - place[edges[d]]), int(place[e] - place[edges[d]]), x) for k, s, e, x in sorted(rows, key=lambda r: (r[1], _ORDER[r[0]]))]

    return [told(rows, d) for d, rows in enumerate(found)], [told(rows, d) for d, rows in enumerate(kept_back)]


_SPAN = "struct<kind:string,`start`:bigint,`end`:bigint,{}>"
_OUT = f"doc_id long, spans array<{_SPAN.format('bits:double')}>, suppressed array<{_SPAN.format('reason:string')}>"


def _spans(rows: list[list[tuple]], last: str, kind: pa.DataType) -> pa.Array:
    flat = [r for row in rows for r in row]
    columns = list(zip(*flat, strict=True)) if flat else [()] * 4
    structs = pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], kind)], names=["kind", "start", "end", last])
    return tk.lists(np.array([len(r) for r in rows], np.int64), structs)


def _scan(allowed: frozenset[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text"):
            found, kept_back = find(buf, offsets, allowed)
            yield tk.batch(rows, ("doc_id",), spans=_spans(found, "bits", pa.float64()), suppressed=_spans(kept_back, "reason", pa.string()))

    return tk.tidy(run)


def find_secrets(docs: DataFrame, allowed: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, bits) and suppressed (kind, start, end,
    reason) of every row, by start and then by kind; places are code points, the
    end exclusive. ``bits`` is the highest entropy of a window, null for base
    kinds. ``allowed`` are values that the caller knows (sent to every task).

    Base spans stay whatever is allowed. A null or empty text has none. Texts of
    any length are read whole, a megabyte or one text at a time; rows are judged
    one by one, so repeated rows give the same, a null doc_id stays null, an
    empty table gives an empty one, and other columns, whatever their names,
    play no part.
    """
    values = frozenset(v.encode() for v in allowed)
    return tk.narrow(docs, id_col, text_col).mapInArrow(_scan(values), _OUT)
