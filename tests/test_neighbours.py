from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from factloom.functions import vectors as v
from factloom.operators import neighbours
from factloom.plans.registry import QUERIES


def brute(rows, k, weight, bonus):
    """By the column expression of every pair."""
    q = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = q.crossJoin(rows).where("query_id <> vec_id").select("query_id", "vec_id", F.round(weight * v.cosine(F.col("query"), F.col("embedding")) + bonus, 6).alias("sim")).collect()
    by = defaultdict(list)
    for r in pairs:
        by[r.query_id].append((-r.sim, r.vec_id))
    return {(q, i + 1): (x, -s) for q, found in by.items() for i, (s, x) in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("odd", [False, True])
def test_against_all_pairs(spark, monkeypatch, odd):
    """Copies, zeros, near ties, several blocks and parts; with vectors that are null, too short, or hold a null or no number."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "PART", 7)
    monkeypatch.setattr(neighbours, "STRIPE", 3)
    monkeypatch.setattr(neighbours, "PAIRS", 64)
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    rows = [(i, rng.choice(some) if i % 3 else [x + rng.choice([0, 1e-6, -1e-6]) for x in some[0]]) for i in range(240)] + [(240, [0.0] * 8), (241, [0.0] * 8)]
    if odd:
        rows += [(250, None), (251, [1.0, 2.0]), (252, [1.0, None, *[0.5] * 6]), (253, [float("inf"), *[0.5] * 7]), (260, None), (None, some[1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = table.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for k, weight, bonus in ((4, 1.0, F.lit(0.0)), (9, 0.6, 0.4 * F.pmod(F.col("vec_id") * 37, F.lit(11)) / 11.0), (300, 1.0, F.lit(0.0))):
        got = {(r.query_id, r.place): (r.vec_id, r.sim) for r in neighbours.top_by_cosine(q, table, k, weight, bonus, blocks=2).collect()}
        assert got == brute(table, k, weight, bonus)


def test_no_query_makes_its_pairs_as_rows(spark):
    for name in ("embedding_topk", "combined_rank", "relevance_note"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
