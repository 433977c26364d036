"""Rows of numbers that travel between tasks as packed blobs.

A task packs what it has for a bucket into one blob: a few bytes a row in the
shuffle, and numpy on both sides. Buckets are dealt to partitions by number and
come out one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkit as tk

U64 = np.uint64
#: Rows gathered by a task before they are packed and sent.
FLUSH = 1 << 20
#: bucket, kind of blob (for the receiver), packed columns
SCHEMA = "to long, kind int, blob binary"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes: sorted hashes have sorted buckets."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def group_of(doc_ids: np.ndarray, groups: int) -> np.ndarray:
    return (tk.mix(doc_ids.astype(np.int64).view(U64)) % U64(groups)).astype(np.int64)


def sent(bucket_of: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """A blob for each bucket; rows are in order of their buckets. The first column holds ascending hashes."""
    for i, j in tk.spans(bucket_of):
        yield int(bucket_of[i]), kind, tk.pack(tk.gaps(columns[0][i:j]), *(c[i:j] for c in columns[1:]))


def batches_of(blobs: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in blobs:
        held.append(x)
        size += len(x[2])
        if size > 4 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["to", "kind", "blob"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """The blobs of one bucket after the other; the partition is sorted by bucket."""
    held: list[tuple[int, int, bytes]] = []
    for b in batches:
        for row in zip(b.column("to").to_pylist(), b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def dealt(rows: DataFrame, partitions: int, *order: str) -> DataFrame:
    """Rows by bucket: bucket ``to`` in partition to mod partitions, sorted by bucket and order."""
    return rows.repartitionById(partitions, F.col("to").cast("int")).sortWithinPartitions("to", *order)
