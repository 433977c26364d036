from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import sharding, winnowing
from factloom.llm.ranges import range_of
from tests.llm import odd


@pytest.mark.parametrize("hot", [0, 3000])
def test_shards_are_even_and_gapless(spark, hot):
    docs = [(i, ("t%d " % (i % 4000)) * (i % 40)) for i in range(6000)] + [(10**6 + i, "copy " * 30) for i in range(hot)] + odd.rows(3)
    got = [r.asDict() for r in sharding.shards(odd.frame(spark, docs), 7).collect()]
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(7)]
    assert max(total) - min(total) <= 2 * max(size(t) for _, t in docs)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    docs = [(i, "x" * (i % 50)) for i in range(4000)]
    got = sharding.shards(odd.frame(spark, docs), 5).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    assert max(r.b for r in got) - min(r.b for r in got) <= 200 and all(r.m == r.n - 1 for r in got)


def test_few_rows(spark):
    assert sharding.shards(odd.empty(spark)).count() == 0
    assert [tuple(r) for r in sharding.shards(odd.frame(spark, [(4, None)])).collect()] == [(4, 8, 0, 12, 0)]


def test_range_of(spark):
    cuts = [-5, 0, 3, 3, 10]
    got = spark.range(-8, 14).select("id", range_of(F.col("id"), cuts).alias("r"), range_of(F.col("id"), []).alias("z")).collect()
    assert all(r.r == sum(c <= r.id for c in cuts) and r.z == 0 for r in got)


def test_winnowing_equals_brute_force(spark):
    docs = odd.plain(odd.rows(7))
    words = lambda t: (t or "").lower().strip(" \t\n\x0b\f\r")
    frame = odd.frame(spark, docs)
    clean = F.lower(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")))
    rolled = frame.select("doc_id", F.col("text"), winnowing.fingerprint(F.col("text")).alias("m"), winnowing._rolling(F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[ \t-\r]+", -1))).alias("h")).collect()
    low = (1 << 33) - 1
    for r in rolled:
        h = [x & low for x in r.h]
        n = len([x for x in words(r.text).split() if x]) if r.text else 0
        assert len(h) == (0 if not words(r.text) else max(1, len(h)))
        marks = [(m >> 30, (1 << 30) - 1 - (m & ((1 << 30) - 1))) for m in r.m]
        want = []
        for i in range(max(1, len(h) - winnowing.WINDOW + 1) if h else 0):
            window = h[i : i + winnowing.WINDOW]
            best = min(window)
            at = i + max(j for j, x in enumerate(window) if x == best)
            if (best, at) not in want:
                want.append((best, at))
        assert marks == want, n


def test_shared_runs_are_always_found(spark):
    run = " ".join(f"r{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    texts = [f"a b c d {run} e f g", f"q {run} x y z u v w", f"{run}", run.upper(), "a b c d e f g h i j"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", winnowing.hashes_of(winnowing.fingerprint(F.col("t"))).alias("h"))
    h = {r.i: set(r.h) for r in rows.collect()}
    assert h[0] & h[1] and h[0] & h[2] and h[1] & h[2] and h[2] == h[3] and not h[0] & h[4]


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_every_row_meets_the_next(spark, buckets):
    docs = sorted(((i, t) for i, t in odd.rows(9)), key=lambda x: (-(2**63) if x[0] is None else x[0], x[1] or ""))
    got = winnowing.beside_next(odd.frame(spark, docs), buckets=buckets).select("doc_id", "text", "next_text").collect()
    want = [(i, t or "", docs[(k + 1) % len(docs)][1] or "") for k, (i, t) in enumerate(docs)]
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_fingerprints_of_odd_rows(spark):
    assert winnowing.fingerprints(odd.empty(spark)).count() == 0
    assert winnowing.beside_next(odd.empty(spark)).count() == 0
    one = winnowing.beside_next(odd.frame(spark, [(7, "a b")])).collect()[0]
    assert one.next_text == "a b" and one.next_hashes == one.hashes
    both = spark.range(1).select(winnowing.likeness(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")).alias("e"), winnowing.likeness(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.array(F.lit(2)).cast("array<bigint>")).alias("h")).first()
    assert (both.e, both.h) == (1.0, 0.5)
