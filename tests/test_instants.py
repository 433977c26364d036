"""Point-in-time joins against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from factloom.operators.instants import visible_at_instants, visible_counts

DAY = timedelta(days=1)
ZERO = datetime(2020, 1, 1)
CLAIMS = "claim_id long, who string, asserted_at timestamp, retired_at timestamp, worth double, claim string, _at int"
ASKED = "ask long, who string, moment timestamp, instant string, t int"


def tables(seed, n, hot=None):
    """Claims and instants with ties, nulls, repeats, empty and endless intervals."""
    r = random.Random(seed)
    who = lambda: hot if hot and r.random() < 0.7 else r.choice(["a", "b", "c", None])
    time = lambda: r.choice([ZERO, ZERO + r.randrange(900) * DAY, ZERO + timedelta(microseconds=r.randrange(10**14)), None])
    claims = [(i, who(), time(), time(), r.choice([None, 1.25, -3.5, 100.0]), "x", i) for i in range(n)]
    asked = [(i, who(), time(), "y", i) for i in range(n)]
    return claims + claims[:5], asked + asked[:5]


def stands(claim, moment):
    return claim[2] is not None and moment is not None and claim[2] <= moment and (claim[3] is None or claim[3] > moment)


@pytest.mark.parametrize(("seed", "by", "width"), [(1, ("who",), 86_400), (2, (), 3_600), (3, ("who",), 10**9), (4, ("who",), 977)])
def test_each_claim_that_stands(spark, seed, by, width):
    claims, asked = tables(seed, 120, "hot")
    met = visible_at_instants(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(asked, ASKED), "moment", by, width=width)
    got = Counter((r.instant.ask, r.claim.claim_id) for r in met.collect())
    want = Counter((a[0], c[0]) for a in asked for c in claims if stands(c, a[2]) and (not by or (a[1] is not None and a[1] == c[1])))
    assert got == want
    assert len(want) > 50


@pytest.mark.parametrize(("seed", "by"), [(5, ("who",)), (6, ())])
def test_counts_and_sums(spark, seed, by):
    claims, asked = tables(seed, 150, "hot")
    out = visible_counts(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(asked, ASKED), "moment", by, "worth")
    assert out.columns == ["ask", "who", "moment", "instant", "t", "visible", "total"]
    got = Counter((r.ask, r.visible, r.total) for r in out.collect())
    want = Counter()
    for a in asked:
        seen = [c for c in claims if stands(c, a[2]) and (not by or (a[1] is not None and a[1] == c[1]))]
        want[a[0], len(seen), sum(c[4] or 0 for c in seen)] += 1
    assert got == want


def test_empty_tables(spark):
    claims, asked = tables(7, 10)
    none, some = spark.createDataFrame([], CLAIMS), spark.createDataFrame(asked, ASKED)
    assert visible_at_instants(none, some, "moment", ("who",)).count() == 0
    assert visible_at_instants(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame([], ASKED), "moment").count() == 0
    assert {r.visible for r in visible_counts(none, some, "moment").collect()} == {0}
    assert visible_counts(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame([], ASKED), "moment", ("who",)).count() == 0


def test_an_interval_costs_few_rows_and_no_nested_loop(spark):
    claims = spark.range(1000).selectExpr("id AS claim_id", "'hot' AS who", "timestamp'2000-01-01' + make_dt_interval(id) AS asserted_at", "CAST(NULL AS timestamp) AS retired_at")
    asked = spark.range(1000).selectExpr("id AS ask", "'hot' AS who", "timestamp'2000-01-01' + make_dt_interval(id) AS moment")
    met = visible_at_instants(claims, asked, "moment", ("who",))
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert met.count() == 1000 * 1001 // 2


def test_keys_of_few_claims_take_no_tree(spark, monkeypatch):
    """An instant of such a key travels once; with a bound between the keys' sizes both ways meet."""
    claims, asked = tables(8, 120, "hot")
    frames = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(asked, ASKED)
    want = Counter((a[0], c[0]) for a in asked for c in claims if stands(c, a[2]) and a[1] is not None and a[1] == c[1])
    for few, tree in ((1000, False), (30, True), (0, True)):
        monkeypatch.setattr("factloom.operators.instants.FEW", few)
        met = visible_at_instants(*frames, "moment", ("who",))
        assert Counter((r.instant.ask, r.claim.claim_id) for r in met.collect()) == want
        assert ("Generate" in met._jdf.queryExecution().toString()) == tree
