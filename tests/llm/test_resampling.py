"""Importance resampling against a plain computation."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries, resampling
from factloom.llm import textkit as tk
from tests.llm import odd


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def buckets_of(text, n, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1))


def brute(rows, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    held = [buckets_of(t, n, buckets) for _, t in rows]
    s, t = sum(held, Counter()), sum((buckets_of(x, n, buckets) for x in target), Counter())
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        weight = sum(gain[b] * c for b, c in h.items()) // h.total() if h else 0
        x = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, h.total(), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))), len(words(text))))
    ready = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = ready[: percent * len(ready) // 100]
    ranks: dict[tuple, list[int]] = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], ranks[r[:4]].pop() if ranks.get(r[:4]) and r[4] >= least else None) for r in out), key=str)


TARGET = ["Ab0 Ab1 word the word", None, "", "é3 日本4 x", "x1 x2 x3"]


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (1, 7, 100), (2, 50, 35), (3, 1000, 0)])
def test_against_brute_force(spark, n, buckets, percent):
    rows = odd.rows(seed=4, n=150)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(odd.frame(spark, rows, 5), target, n=n, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, TARGET, n, buckets, percent=percent)


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda b, f=zlib.crc32: calls.append(b) or f(b))
    text = b"a b a b c a b a b c"
    found = tk.Words(np.frombuffer(text, np.uint8), np.array([0, 9, 19]), tk.NON_ALNUM, True)
    resampling.bucket_counts(found, 2, 100)
    assert sorted(calls) == sorted({b"a", b"b", b"c", b"a b", b"b a", b"b c"})


def test_hot_rows_take_ranks_in_many_ranges(spark):
    """Half of all rows are one row, without an id: their ranks are whole and lie in several ranges."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    got = resampling.resample(rows, target, percent=100)
    ranks = sorted(r["rank"] for r in got.collect())
    assert ranks == list(range(1, 6001))
    by_score = [r.score for r in got.orderBy("rank").collect()]
    assert by_score == sorted(by_score, reverse=True)


def test_long_texts_and_empty_tables(spark):
    target = spark.createDataFrame([(1, "word1")], "item_id long, text string")
    long = " ".join(f"word{i % 20011}" for i in range(800_000))
    got = {r.doc_id: r.n_features for r in resampling.resample(odd.frame(spark, [(1, long), (2, "x"), (3, None)]), target).collect()}
    assert got == {1: 800_000, 2: 1, 3: 0}
    assert resampling.resample(odd.empty(spark), target).collect() == []
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = odd.rows(seed=6)
    assert sorted((tuple(r) for r in resampling.resample(odd.frame(spark, rows), nothing).collect()), key=str) == brute(rows, [])


def test_sql_on_a_fixture(spark, tmp_path):
    rows = [(i, t) for i, t in odd.rows(seed=9, n=200) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(TARGET)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(str, map(tuple, queries.op13_importance_resampling(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, brute(rows, TARGET)))
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert sorted(map(str, con.execute(queries.oracle_sql()["op13_importance_resampling"]).fetchall())) == got
