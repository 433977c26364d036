"""Field paths against a walk of the values."""

from __future__ import annotations

import pytest

from factloom.functions import paths

SCHEMA = "a struct<b:array<struct<c:string,d:array<struct<e:int,f:map<string,string>>>>>,g:double,h:string,`x.y`:int>, l array<array<string>>, m map<string,string>, `p.q` int, s string"
ROWS = [
    ({"b": [{"c": "1", "d": [{"e": 0, "f": {"k": ""}}, {"e": 2, "f": {"k": "v"}}]}, {"c": "2", "d": [{"e": 3, "f": {"k": "v"}}]}], "g": 0.0, "h": "", "x.y": 1}, [["a"], ["b", "c"]], {"k": ""}, 1, "s"),
    ({"b": [{"c": "", "d": []}, None], "g": None, "h": "x", "x.y": None}, [["a"], []], {}, None, ""),
    ({"b": [], "g": float("nan"), "h": None, "x.y": None}, [], None, 0, None),
    (None, None, None, None, " "),
    ({"b": None, "g": 1.0, "h": "0", "x.y": 0}, [["a", None]], {"k": None}, 5, "s"),
    ({"b": [{"c": "1", "d": [{"e": None, "f": None}]}], "g": 1.0, "h": "0", "x.y": 0}, [None], {"k": "v"}, 5, "s"),
]
PATHS = ["a", "a.b", "a.b[]", "a.b[].c", "a.b[].d", "a.b[].d[]", "a.b[].d[].e", "a.b[].d[].f", "a.b[].zzz", "a.g", "a.h", "a.b.c", "a.g[]", "l", "l[]", "m", "m.k", "s", "s.t", "zzz", "zzz[].a", "a.b[].d[].e.x"]


def walked(row, path):
    """What a path gives of nested dictionaries and lists."""
    first, *rest = path.split(".")
    name, every = first.removesuffix("[]"), first.endswith("[]")
    value = row.get(name) if isinstance(row, dict) else None
    if every and not isinstance(value, list):
        return None
    if not rest or value is None:
        return value
    return [walked(x, ".".join(rest)) for x in value] if every else walked(value, ".".join(rest))


def said(value):
    if isinstance(value, list):
        return bool(value) and all(map(said, value))
    return value is not None and value != "" and value != {}


def test_paths(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    names = df.columns
    dicts = [dict(zip(names, r, strict=True)) for r in ROWS]
    got = df.select(*[paths.populated(df, p).alias(str(i)) for i, p in enumerate(PATHS)]).collect()
    maps = {"m.k"}  # the keys of a map are no fields
    for row, d in zip(got, dicts, strict=True):
        for i, p in enumerate(PATHS):
            if p.startswith("a.b[].zzz") or p in maps or p.endswith("e.x"):
                assert row[i] is False, p
            else:
                assert row[i] == said(walked(d, p)), (p, d)
    value, _ = paths.compiled(df.schema, "a.b[].d[].e")
    assert [r[0] for r in df.select(value).collect()] == [[[0, 2], [3]], [[], None], [], None, None, [[None]]]


def test_what_is_no_path(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ("", "a..b", "a.[]", "a[0].b", "a[].", "a[][]"):
        with pytest.raises(ValueError, match="no field path"):
            paths.compiled(df.schema, bad)
    assert df.select(paths.texts(df, "a.h"), paths.texts(df, "zzz"), paths.texts(df, "a.b[].c")).first()[:] == (None, None, "1,2")


def test_plans_hold_no_python(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert "Python" not in df.select(*[paths.populated(df, p) for p in PATHS])._jdf.queryExecution().toString()
