"""Every query that has SQL gives DuckDB's rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from factloom.plans.registry import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test tables")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ("none", 0)
    if isinstance(x, bool):
        return ("bool", x)
    if isinstance(x, int | float | decimal.Decimal):
        return ("number", round(float(x), 5) + 0.0)
    if isinstance(x, datetime.datetime | datetime.date):
        return ("time", x.isoformat())
    return (type(x).__name__, str(x))


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER))
    want = duck.execute(SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
