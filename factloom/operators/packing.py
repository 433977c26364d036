"""Greedy packs of ordered rows, for groups of any length.

A pack takes rows in order until the next one would make it larger than a bound.
Where packs begin follows from what comes before, but of a block of rows only
how full the open pack is when the block begins matters. For each row at which
the block's first pack can begin, a block tells how full its last pack is at the
end and how many packs it begins, found with prefix sums and pointers that jump
over twice as many packs each round. A group's blocks are then gone through in
order, and every block numbers its rows. No group is a row, and no task has more
than a block's rows or a group's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.shared import Tables, gathered

#: Rows of a block, about.
BLOCK_ROWS = 1 << 14


def next_starts(costs: np.ndarray, most: int) -> np.ndarray:
    """For a pack that begins at each row, where the next one begins; the length if none does."""
    ends = np.cumsum(costs)
    before = ends - costs
    # the pack takes its first rows whatever they cost, up to the first one that costs something
    some = np.append(costs, 1) > 0
    at = np.where(some, np.arange(len(some)), len(some))
    first_cost = np.minimum.accumulate(at[::-1])[::-1][: len(costs)]
    return np.maximum(np.searchsorted(ends, before + most, "right"), np.minimum(first_cost + 1, len(costs)))


def block_ends(costs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(how full the last pack is at the end, packs begun) for a first pack that begins at each row."""
    n = len(costs)
    jump, begun = np.append(next_starts(costs, most), n), np.append(np.ones(n, np.int64), 0)
    last = np.where(jump < n, jump, np.arange(n + 1))  # the last pack of a block points to itself
    while (jump < n).any():
        begun = begun + begun[jump]
        jump, last = jump[jump], last[last]
    full = np.append(int(costs.sum()) - (np.cumsum(costs) - costs), 0)
    return full[last[:n]], begun[:n]


def first_start(ends: np.ndarray, used: int, most: int) -> int:
    """The first row that doesn't fit into a pack that is this full; the length if all do."""
    if used <= 0:
        some = np.flatnonzero(ends > 0)
        if not len(some):
            return len(ends)
        return max(int(np.searchsorted(ends, most, "right")), int(some[0]) + 1) if len(ends) else 0
    return int(np.searchsorted(ends, most - used, "right"))


def packs(rows: DataFrame, group: str, place: str, cost: str, most: int, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with pack; group, packs, total): the greedy packs of each group's rows in the order of ``place``.

    Packs are numbered from 0. A pack has a total of at most ``most``, or one
    row that costs more. Costs are whole numbers from 0; a null one is 0. Rows
    equal in place are taken in any order, and a null group or place is one like
    any other. Rows are written once, then
    travel to ranges of (group, place); numbers and costs travel by block.
    """
    spark = rows.sparkSession
    store = Tables(spark)
    # the numbers of rows are drawn once: a second run of what comes before may give its rows in another order
    numbered = store.written(rows.withColumn("_cost", F.coalesce(F.col(cost).cast("long"), F.lit(0))).withColumn("_row", F.monotonically_increasing_id()))
    order = (F.asc_nulls_first(group), F.asc_nulls_first(place), F.asc("_row"))
    dealt = numbered.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    slim = dealt.select(group, "_row", "_cost")
    schema = T.StructType([rows.schema[group], T.StructField("_row", T.LongType()), T.StructField("_cost", T.LongType()), T.StructField("_block", T.LongType()), T.StructField("_at", T.LongType())])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in gathered(batches, BLOCK_ROWS):
            keys = b.column(0)
            same = pa.compute.fill_null(pa.compute.equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False).to_numpy(zero_copy_only=False) | (pa.compute.is_null(keys.slice(1)).to_numpy(zero_copy_only=False) & pa.compute.is_null(keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
            run = np.concatenate(([0], np.cumsum(~same)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block + run), pa.array(np.arange(len(keys)) - np.searchsorted(run, run))], names=[*b.schema.names, "_block", "_at"])
            block += int(run[-1]) + 1

    placed = store.written(slim.mapInArrow(blocked, schema))
    summary = T.StructType([rows.schema[group], T.StructField("_block", T.LongType()), T.StructField("total", T.LongType()), *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("heads", "full", "begun")]])

    def summed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        costs = table.column("_cost").to_numpy()[np.argsort(table.column("_at").to_numpy())]
        ends = np.cumsum(costs)
        head = min(len(costs), int(np.searchsorted(ends, most, "right")) + 2)  # the first pack begins among these, or none does
        full, begun = block_ends(costs, most)
        lists = [pa.array([x[:head].tolist()], pa.list_(pa.int64())) for x in (ends, full, begun)]
        return pa.Table.from_arrays([table.column(group).slice(0, 1), table.column("_block").slice(0, 1), pa.array([int(ends[-1])]), *lists], names=[group, "_block", "total", "heads", "full", "begun"])

    blocks = store.written(placed.groupBy("_block").applyInArrow(summed, summary))
    entered = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_used", T.LongType()), T.StructField("_pack", T.LongType()), rows.schema[group], T.StructField("total", T.LongType()), T.StructField("packs", T.LongType())])

    def through(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(pa.compute.sort_indices(table, [("_block", "ascending")])).combine_chunks()
        totals, used, pack, out = table.column("total").to_numpy(), 0, 0, []
        for i in range(table.num_rows):
            out.append((used, pack))
            ends, full, begun = (np.asarray(table.column(c)[i].values) for c in ("heads", "full", "begun"))
            s = first_start(ends, used, most)
            if s < len(ends):
                used, pack = int(full[s]), pack + int(begun[s])
            else:
                used += int(totals[i])
        n = table.num_rows
        return pa.Table.from_arrays([table.column("_block"), pa.array([u for u, _ in out], pa.int64()), pa.array([p for _, p in out], pa.int64()), table.column(group), pa.array(np.full(n, totals.sum())), pa.array(np.full(n, pack + 1))], names=["_block", "_used", "_pack", group, "total", "packs"])

    entries = store.written(blocks.groupBy(group).applyInArrow(through, entered))
    told = T.StructType([T.StructField("_row", T.LongType()), T.StructField("pack", T.LongType())])

    def marked(table: pa.Table, entry: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("_at").to_numpy())
        costs = table.column("_cost").to_numpy()[order]
        used, pack = entry.column("_used")[0].as_py(), entry.column("_pack")[0].as_py()
        follow, s = next_starts(costs, most), first_start(np.cumsum(costs), used, most)
        begins = np.zeros(len(costs), np.int64)
        while s < len(costs):
            begins[s] = 1
            s = int(follow[s])
        return pa.Table.from_arrays([pa.array(table.column("_row").to_numpy()[order]), pa.array(pack + np.cumsum(begins))], names=["_row", "pack"])

    found = placed.groupBy("_block").cogroup(entries.select(F.col("_block").alias("_of"), "_used", "_pack").groupBy("_of")).applyInArrow(marked, told)
    return numbered.join(found, "_row").drop("_row", "_cost"), entries.groupBy(group).agg(F.max("packs").alias("packs"), F.max("total").alias("total"))
