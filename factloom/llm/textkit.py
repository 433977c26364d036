"""Vectorised words, word hashes and rolling windows over Arrow text batches.

Everything works on the UTF-8 bytes of a whole batch of documents at once: a
byte table says which bytes separate words, a polynomial prefix sum gives the
64-bit hash of any word (and of any run of words) in constant time. Hashes are
the same on every executor. Two different words (or runs) get one hash with a
chance of about 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of text handled at once; one longer document is handled alone.
CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WORD_BASE = 0xD1B54A32D192ED03
_WORD_BASE_INV = pow(_WORD_BASE, -1, 2**64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separators of "words between white space": 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of "letters and digits after lower-casing A-Z": all other ASCII.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class _Powers:
    """Powers of an odd base and of its inverse, grown as needed."""

    def __init__(self, base: int, inverse: int) -> None:
        self.bases = (base, inverse)
        self.up, self.down = _powers(base, 1024), _powers(inverse, 1024)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = (_powers(b, max(n + n // 8, CHUNK_BYTES)) for b in self.bases)
        return self.up, self.down


_BYTE_POWERS = _Powers(_BASE, _BASE_INV)
_WORD_POWERS = _Powers(_WORD_BASE, _WORD_BASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """What mix() was given."""
    h = h.astype(U64, copy=True)
    h ^= (h >> U64(31)) ^ (h >> U64(62))
    h *= U64(pow(0x94D049BB133111EB, -1, 2**64))
    h ^= (h >> U64(27)) ^ (h >> U64(54))
    h *= U64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    h ^= (h >> U64(30)) ^ (h >> U64(60))
    return h


class Words:
    """The words of a run of documents.

    ``start``/``end`` are byte positions in ``buf`` (lower-cased where asked
    for), ``hash`` the word hashes; the words of document d are
    ``first[d]:first[d + 1]``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> None:
        self.offsets = offsets
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        inside = ~separators[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = slice_hash(self.buf, self.start, self.end)
        return self._hash

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.docs), self.counts)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of k words in a document."""
        last = np.repeat(self.first[1:], self.counts) - k
        at = np.flatnonzero(np.arange(len(self)) <= last)
        return at, self.run_hash(at, k)

    def run_hash(self, at: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Hash of the k words from each index; runs of different length differ."""
        n = len(self)
        up, down = _WORD_POWERS.get(n)
        if self._prefix is None:
            self._prefix = np.zeros(n + 1, U64)
            np.cumsum(self.hash * up[:n], out=self._prefix[1:], dtype=U64)
        return mix((self._prefix[at + k] - self._prefix[at]) * down[at] + np.asarray(k).astype(U64))

    def text(self, i: int, j: int, joiner: bytes = b" ") -> bytes:
        """Words i to j - 1, joined."""
        return joiner.join(self.buf[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def slice_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each run of bytes buf[start:end]."""
    up, down = _BYTE_POWERS.get(len(buf))
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:], dtype=U64)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into (rows, bytes, offsets) of at most ``most`` bytes of text, a longer document alone."""
    for batch in batches:
        buf, offsets = arrays(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only doc_id and the text's bytes, and the columns to carry as struct
    ``row``: no other column can clash. Python gets batches of 256 rows, so
    that a batch of very long texts fits.
    """
    small_batches(docs.sparkSession)
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *kept)


def give_back() -> None:
    """Memory that this worker no longer uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow; when it ends, memory that its worker no longer uses goes
    back to the system, since the worker stays and other tasks need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def schema_of(df: DataFrame, names: tuple[str, ...], more: str) -> T.StructType:
    """The schema of these columns of df and of those in the DDL string."""
    return T.StructType([df.schema[n] for n in names if n in df.columns] + list(T.StructType.fromDDL(more)))


def batch(rows: pa.RecordBatch, names: tuple[str, ...], **more: pa.Array) -> pa.RecordBatch:
    """These columns of rows, as far as there are, and more."""
    kept = [n for n in names if n in rows.schema.names]
    return pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), *more.values()], names=[*kept, *more])


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the length of each list and all values in order."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: Bytes of an Arrow batch to Python, about.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches to Python of at most this many rows and about BATCH_BYTES
    (or one row): memory follows them, not the partition. Plans read these two
    settings when they run, which is after an operator has returned, so they
    stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns as one blob, each by byte planes, so that the shuffle's
    compression removes the bytes that hardly change."""
    out = [np.array([len(columns)], np.uint32).tobytes()]
    for c in columns:
        out.append(np.array([len(c), c.dtype.itemsize], np.uint32).tobytes())
        out.append(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() if len(c) else b"")
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """What pack() packed, as unsigned columns."""
    raw = np.frombuffer(blob, np.uint8)
    n, at, out = int(raw[:4].view(np.uint32)[0]), 4, []
    for _ in range(n):
        size, width = map(int, raw[at : at + 8].copy().view(np.uint32))
        at += 8
        planes = raw[at : at + size * width].reshape(width, size) if size else np.zeros((width, 0), np.uint8)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}"))
        at += size * width
    return out


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of ascending values (the first one whole); undo with cumsum."""
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def ungaps(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def spans(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal values; none for no values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(values) else []


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
