from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import packing
from factloom.operators.shared import bounded_batches


def greedy(costs, most):
    out, used, pack = [], 0, 0
    for c in costs:
        if used > 0 and used + c > most:
            used, pack = 0, pack + 1
        used += c
        out.append(pack)
    return out


def test_blocks_compose_to_the_fold():
    rng = random.Random(1)
    for _ in range(300):
        n, most = rng.randrange(1, 60), rng.choice([1, 5, 10, 37])
        costs = [rng.choice([0, 0, 1, 2, 3, 9, 50]) for _ in range(n)]
        cuts = sorted({0, n, *(rng.randrange(n + 1) for _ in range(4))})
        used, pack, got = 0, 0, []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            block = np.array(costs[i:j])
            ends, (full, begun) = np.cumsum(block), packing.block_ends(block, most)
            s = packing.first_start(ends, used, most)
            follow, at, begins = packing.next_starts(block, most), s, np.zeros(len(block), int)
            while at < len(block):
                begins[at] = 1
                at = int(follow[at])
            got += (pack + np.cumsum(begins)).tolist()
            used, pack = (int(full[s]), pack + int(begun[s])) if s < len(block) else (used + int(block.sum()), pack)
        assert got == greedy(costs, most), (costs, most, cuts)


def test_groups_of_all_sizes(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0, 1, 5, 8, 40, None])) for g, n in (("a", 400), ("b", 1), ("c", 90), (None, 30), ("d", 3)) for i in range(n)]
    monkeypatch.setattr(packing, "BLOCK_ROWS", 16)
    bounded_batches(spark, 16)
    found, sizes = packing.packs(spark.createDataFrame(rows, "g string, i int, c int").repartition(5), "g", "i", "c", 20, ranges=6)
    got = {(r.g, r.i): r["pack"] for r in found.collect()}
    ends = {r.g: (r.packs, r.total) for r in sizes.collect()}
    bounded_batches(spark)
    for g in {r[0] for r in rows}:
        costs = [c or 0 for k, _, c in rows if k == g]
        assert [got[g, i] for i in range(len(costs))] == greedy(costs, 20) and ends[g] == (greedy(costs, 20)[-1] + 1, sum(costs))
    assert packing.packs(spark.createDataFrame([], "g string, i int, c int"), "g", "i", "c", 20)[0].collect() == []


def test_a_thread_of_a_million_rows(spark):
    """One group in many ranges equals the greedy fold."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("g"), (F.lit(n) - F.col("id")).alias("i"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 20).alias("c"))
    found, sizes = packing.packs(rows, "g", "i", "c", 10_000, ranges=12)
    table = found.select("i", "c", "pack").toPandas().sort_values("i")
    want = greedy(table["c"].tolist(), 10_000)
    assert table["pack"].tolist() == want and sizes.first().packs == want[-1] + 1


def test_rows_that_come_in_another_order_each_time(spark):
    """A plan that runs twice needn't give its rows in one order; none is lost, and the packs are those of the fold."""

    def shuffled(batches):
        for b in batches:
            yield b.take(np.random.default_rng().permutation(b.num_rows))

    n = 3000
    rows = spark.range(n).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.col("id") * 7 % 13 + 1).alias("c")).repartition(5).mapInArrow(shuffled, "g long, i long, c long")
    found = packing.packs(rows.where("g < 2"), "g", "i", "c", 40, ranges=3)[0].select("g", "i", "pack").collect()
    assert len(found) == n // 3 * 2
    for g in (0, 1):
        mine = sorted((r.i, r["pack"]) for r in found if r.g == g)
        assert [p for _, p in mine] == greedy([i * 7 % 13 + 1 for i, _ in mine], 40)
