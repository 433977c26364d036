from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from factloom.functions.claims import TRANSITIONS
from factloom.operators import status_logs
from factloom.plans.registry import QUERIES, SQL


def fold(steps):
    """(status, steps, refused, first refused) by taking one step after the other."""
    state, reason, refused, first = None, None, 0, None
    for seq, to, why in sorted(steps, key=lambda s: (s[0], status_logs.STATES.index(s[1]) if s[1] in status_logs.STATES and s[1] else 9, s[2] or "")):
        if (state, to) in TRANSITIONS and ((state, to) != ("SUPERSEDED", "ACTIVE") or reason == status_logs.REVERSIBLE):
            state, reason = to, why
        else:
            refused, first = refused + 1, seq if first is None else first
    return state, len(steps), refused, first


NAMES = ["ACTIVE", "ACTIVE", "INCONSISTENCY", "PROVENANCE_STALE", "SUPERSEDED", "SUPERSEDED", "RETRACTED", "unheard", None]


def random_log(seed, claims, n, weights=(9, 9, 2, 3, 9, 9, 0.02, 1, 1)):
    rng = random.Random(seed)
    return [(rng.choice(claims), 2 * i + 7, rng.choices(NAMES, weights)[0], rng.choice([status_logs.REVERSIBLE, "other", None])) for i in range(n)]


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


SCHEMA = "claim string, seq long, to string, why string"


def test_against_the_fold(spark):
    rows = random_log(1, list("abcdefg"), 2000) + [("once", 1, "RETRACTED", None), ("tie", 5, "SUPERSEDED", None), ("tie", 5, "ACTIVE", None)]
    frame = spark.createDataFrame([*rows, (None, 1, "ACTIVE", None), ("a", None, "ACTIVE", None)], SCHEMA).repartition(5)
    want = {c: fold([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got(status_logs.statuses(frame, "claim", "seq", "to", "why")) == want
    assert want["once"] == (None, 1, 1, 1) and want["tie"] == ("SUPERSEDED", 2, 0, None)
    assert status_logs.statuses(frame.limit(0), "claim", "seq", "to", "why").collect() == []


def test_superseded_comes_back_only_as_a_duplicate(spark):
    rows = [("a", 1, "ACTIVE", None), ("a", 2, "SUPERSEDED", status_logs.REVERSIBLE), ("a", 3, "ACTIVE", None), ("b", 1, "ACTIVE", None), ("b", 2, "SUPERSEDED", "JUDGED"), ("b", 3, "ACTIVE", None)]
    assert got(status_logs.statuses(spark.createDataFrame(rows, SCHEMA), "claim", "seq", "to", "why")) == {"a": ("ACTIVE", 3, 0, None), "b": ("SUPERSEDED", 3, 1, 3)}
    assert got(status_logs.statuses(spark.createDataFrame(rows, SCHEMA), "claim", "seq", "to"))["a"] == ("SUPERSEDED", 3, 1, 3)


def test_composing_is_associative():
    rng = np.random.default_rng(2)
    change = rng.integers(0, len(status_logs.STATES) + 1, 300)
    to = status_logs._NEXT[change]
    refused, first = (to < 0).astype(np.int64), np.where(to < 0, np.arange(300)[:, None], status_logs._NONE)
    to = np.where(to < 0, np.arange(len(status_logs.STATES)), to)
    one = status_logs.composed(to, refused, first, np.array([0]))
    for cuts in ([0, 1], [0, 150], [0, 7, 8, 299], list(range(300))):
        parts = status_logs.composed(to, refused, first, np.array(cuts))
        again = status_logs.composed(*parts, np.array([0]))
        assert all((x == y).all() for x, y in zip(one, again, strict=True))


def test_a_hot_claim_of_a_million_steps(spark):
    """One claim has nearly all rows: its log is cut into many ranges, and ends as the fold does."""
    n = 1_000_000
    k = F.pmod(F.xxhash64("id"), F.lit(11))
    names = F.array(*[F.lit(x) for x in ("ACTIVE", "SUPERSEDED", "ACTIVE", "PROVENANCE_STALE", "SUPERSEDED", "INCONSISTENCY", "ACTIVE", "SUPERSEDED", "SUPERSEDED", "ACTIVE", "ACTIVE")])
    log = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(-1).alias("claim"), F.col("id").alias("seq"), F.element_at(names, (k + 1).cast("int")).alias("to"), F.when(F.col("id") % 3 > 0, status_logs.REVERSIBLE).alias("why"))
    rows = [(r.seq, r.to, r.why) for r in log.where("claim = -1").orderBy("seq").collect()]
    found = status_logs.statuses(log, "claim", "seq", "to", "why", ranges=16)
    assert got(found.where("claim = -1"))[-1] == fold(rows)
    where = log.repartitionByRange(16, "claim", "seq").where("claim = -1").groupBy(F.spark_partition_id()).count().collect()
    assert len(where) >= 12 and max(r["count"] for r in where) < n / 5


def test_steps_without_a_claim_or_a_seq(spark):
    """They are a null claim's log, and the last steps of a log."""
    rows = [(None, 2, "SUPERSEDED", None), (None, 1, "ACTIVE", None), ("a", None, "RETRACTED", None), ("a", 4, "ACTIVE", None), ("b", None, "unheard", None), ("", 1, "ACTIVE", None)]
    found = status_logs.statuses(spark.createDataFrame(rows, SCHEMA).repartition(3), "claim", "seq", "to", "why", ranges=1, nulls=True)
    assert got(found) == {None: ("SUPERSEDED", 2, 0, None), "a": ("RETRACTED", 2, 0, None), "b": (None, 1, 1, None), "": ("ACTIVE", 1, 0, None)}


def test_the_query_on_lines_with_nulls(spark, tmp_path):
    """Every kind of line that has a null, and suppliers below 0, as in the SQL. No two steps of a part have one number."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    lines = [(n, rng.choice([None, *range(12)]), rng.choice([None, *range(-9, 40)]), n % 7 + 1, float(rng.choice([50, 50, 3]))) for n in range(600)]
    lines += [(None, p, s, 6, 50.0 if s % 2 else None) for p, s in ((1, 3), (2, 0), (50, 2), (None, 1))] + [(9000, 3, 5, None, 50.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(SQL["status_logs_reduced"]).fetchall()
    assert len(want) == 14 and got(QUERIES["status_logs_reduced"](spark, str(tmp_path))) == {r[0]: r[1:] for r in want}
