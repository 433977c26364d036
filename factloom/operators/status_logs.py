"""Logs of status changes, however long, reduced in blocks.

A step of a log is a function of the state that a claim is in: where the change
is allowed it gives the next state, else it is refused and the state stays. Such
functions compose, and composing is associative. So a log is cut into blocks in
its order, each block becomes one function of all states (with how many steps it
refuses, and the first of them), and a claim's blocks are composed to the end.
No claim's log is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.claims import TRANSITIONS
from factloom.operators.shared import gathered

#: Fixed value: the only reason for which a superseded claim may become active again.
REVERSIBLE = "DUPLICATE_MERGED"
#: The states: no claim yet, the statuses, and a superseded claim that may come back.
STATES = (None, "ACTIVE", "INCONSISTENCY", "PROVENANCE_STALE", "SUPERSEDED", "RETRACTED", f"SUPERSEDED {REVERSIBLE}")
_BACK = len(STATES) - 1
#: Steps of a block, about.
BLOCK_ROWS = 1 << 14
_NONE = np.iinfo(np.int64).max


def _step_table() -> np.ndarray:
    """next[change, state]; -1 where the change is refused. Changes are the states to come to, the last row any other."""
    table = np.full((len(STATES) + 1, len(STATES)), -1, np.int8)
    place = {s: i for i, s in enumerate(STATES)}
    for old, new in TRANSITIONS:
        for to in [place[new]] + ([_BACK] if new == "SUPERSEDED" else []):
            froms = [_BACK] if (old, new) == ("SUPERSEDED", "ACTIVE") else [place[old]] + ([_BACK] if old == "SUPERSEDED" else [])
            for f in froms:
                table[to, f] = to
    return table


_NEXT = _step_table()


def composed(to: np.ndarray, refused: np.ndarray, first: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One function for each run of rows from ``starts``: neighbours are composed pair by pair,
    so the rounds are the logarithm of the longest run. Arrays are (row, state)."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(to))))
    while len(to) > len(starts):
        at = np.arange(len(to)) - np.searchsorted(run, run)
        left = np.flatnonzero(at % 2 == 0)
        paired = np.append(run[1:] == run[:-1], False)[left]
        a, b = left[paired], left[paired] + 1
        middle = to[a]
        rows = np.arange(len(a))[:, None]
        joined = to[b][rows, middle], refused[a] + refused[b][rows, middle], np.minimum(first[a], first[b][rows, middle])
        to, refused, first = to[left].copy(), refused[left].copy(), first[left].copy()
        to[paired], refused[paired], first[paired] = joined
        run = run[left]
    return to, refused, first


def _batch(claims: pa.Array, place: np.ndarray, steps: np.ndarray, to: np.ndarray, refused: np.ndarray, first: np.ndarray, name: str) -> pa.RecordBatch:
    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATES), pa.int32()), pa.array(x.ravel(), kind))

    return pa.RecordBatch.from_arrays([claims, pa.array(place), pa.array(steps), lists(to, pa.int8()), lists(refused, pa.int64()), lists(first, pa.int64())], names=[name, "place", "steps", "to", "refused", "first"])


def _starts(claims: pa.Array) -> np.ndarray:
    """Where runs of one claim begin; null is a claim like any other."""
    if len(claims) < 2:
        return np.zeros(len(claims), np.int64)
    changes = pa.compute.not_equal(claims.slice(1), claims.slice(0, len(claims) - 1)).fill_null(False)
    told = claims.is_valid().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(changes.to_numpy(zero_copy_only=False) | (told[1:] != told[:-1])) + 1))


def _reduced(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each claim of a batch of steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for b in gathered(batches, BLOCK_ROWS):
            change = b.column("change").to_numpy()
            to = _NEXT[change]
            refused = (to < 0).astype(np.int64)
            first = np.where(to < 0, b.column("seq").to_numpy()[:, None], _NONE)
            to = np.where(to < 0, np.arange(len(STATES), dtype=np.int8), to)
            starts = _starts(b.column(name))
            steps = np.diff(np.append(starts, b.num_rows))
            yield _batch(b.column(name).take(pa.array(starts)), place + np.arange(len(starts)), steps, *composed(to, refused, first, starts), name)
            place += len(starts)

    return run


def _finished(name: str) -> Callable[[pa.Table], pa.Table]:
    """The end of a claim's log from its blocks."""

    def run(blocks: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        blocks = blocks.take(pa.compute.sort_indices(blocks, [("place", "ascending")])).combine_chunks()
        wide = lambda c: np.asarray(blocks.column(c).chunk(0).flatten()).reshape(-1, len(STATES))
        to, refused, first = composed(wide("to"), wide("refused"), wide("first"), np.zeros(1, np.int64))
        end, at = STATES[int(to[0, 0])], int(first[0, 0])
        return pa.table({
            name: blocks.column(name).slice(0, 1), "status": pa.array([end.split(" ")[0] if end else None], pa.string()), "steps": pa.array([int(np.sum(blocks.column("steps").to_numpy()))], pa.int64()),
            "refused": pa.array([int(refused[0, 0])], pa.int64()), "first_refused": pa.array([None if at == _NONE else at], pa.int64()),
        })

    return run


def statuses(log: DataFrame, claim: str, seq: str, to: str, reason: str | None = None, ranges: int | None = None, nulls: bool = False) -> DataFrame:
    """claim, status, steps, refused, first_refused of log(claim, seq, to, reason).

    Steps are taken by seq (a whole number), then by to and reason; the first
    one finds no claim. A step that isn't allowed, or leads to no status, is
    refused: it changes nothing, and the first one's seq is told. A superseded
    claim becomes active again only if it was superseded as a merged duplicate.
    Steps without a claim or a seq are left out; with ``nulls``, those without
    a claim are the log of a null claim, and those without a seq come last (none
    of them is told as the first refused). Status is null where no step was
    taken. The log is cut into ranges of (claim, seq), so that a claim with
    most of the rows is spread over tasks; its blocks, of BLOCK_ROWS steps
    or more, meet at the end.
    """
    spark = log.sparkSession
    why = F.col(reason) if reason else F.lit(None).cast("string")
    change = F.lit(len(STATES))
    for i, s in enumerate(STATES):
        if s and i != _BACK:
            change = F.when(F.col(to) == s, i).otherwise(change)
    change = F.when((F.col(to) == "SUPERSEDED") & (why == REVERSIBLE), _BACK).otherwise(change)
    at = F.col(seq).cast("long")
    rows = log.select(F.col(claim), (F.coalesce(at, F.lit(int(_NONE))) if nulls else at).alias("seq"), change.cast("int").alias("change"), F.monotonically_increasing_id().alias("row"))
    rows = rows if nulls else rows.where(F.col(claim).isNotNull() & F.col("seq").isNotNull())
    order = (claim, "seq", "change", "row")
    dealt = rows.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select(claim, "seq", "change")
    wide = [T.StructField(n, T.ArrayType(t)) for n, t in (("to", T.ByteType()), ("refused", T.LongType()), ("first", T.LongType()))]
    blocks = dealt.mapInArrow(_reduced(claim), T.StructType([log.schema[claim], T.StructField("place", T.LongType()), T.StructField("steps", T.LongType()), *wide]))
    out = [T.StructField("status", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("steps", "refused", "first_refused")]]
    return blocks.groupBy(claim).applyInArrow(_finished(claim), T.StructType([log.schema[claim], *out]))
