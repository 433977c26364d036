"""Queries over whole tables against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from factloom.operators import identity, render
from factloom.plans.registry import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test tables")


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


@needs_tables
def test_pages_of_all_parts(spark):
    clean = lambda x: re.sub("[^a-z0-9]+", "-", x.lower())
    same = defaultdict(list)
    for key, name, brand, size in rows(spark, "part", "p_partkey", "p_name", "p_brand", "p_size"):
        same[clean(name.strip())].append((key, brand, size))
    want = {}
    for slug, parts in same.items():
        for key, brand, size in parts:
            tiers = ((clean(brand), {b for _, b, _ in parts}), (size, {z for _, _, z in parts}), (key, parts))
            want[key] = slug if len(parts) == 1 else f"{slug}-{next(x for x, some in tiers if len(some) == len(parts))}"
    assert max(want) >= 60
    assert dict(map(tuple, QUERIES["subject_pages"](spark, str(FOLDER)).collect())) == want


@needs_tables
def test_fingerprints_of_all_documents(spark):
    ids = defaultdict(list)
    for i, lang in rows(spark, "documents", "doc_id", "lang"):
        ids[lang].append(str(i))
    want = {lang: hashlib.sha256("".join(sorted(x)).encode()).hexdigest() for lang, x in ids.items()}
    assert dict(map(tuple, QUERIES["context_fingerprint"](spark, str(FOLDER)).collect())) == want


@needs_tables
def test_chain_of_all_orders(spark):
    keys = [k for (k,) in rows(spark, "orders", "o_orderkey")]
    first, want = {}, Counter()
    for k in sorted(keys):
        first[k] = first.get(k - 1, k - 1)
        want[k, first[k], k - first[k]] += 1
    got = Counter(tuple(r) for r in QUERIES["supersession_chain"](spark, str(FOLDER)).select("claim_id", "root", "depth").collect())
    assert got == want and max(d for _, _, d in got) > 64


def test_long_and_branched_chains(spark):
    n = 5000
    links = [(i, i - 1) for i in range(1, n)] + [(10_000 + i, 17) for i in range(50)]
    got = {tuple(r) for r in identity.supersession_roots(spark.createDataFrame(links, "claim_id long, supersedes long")).select("claim_id", "root", "depth").collect()}
    assert got == {(i, 0, i) for i in range(1, n)} | {(10_000 + i, 0, 18) for i in range(50)}


def joined(parts):
    """Documents by group, from the parts in order; part numbers have no gaps."""
    by = defaultdict(dict)
    for r in parts:
        by[r.source][r.part] = r.document
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    return {s: "\n\n".join(p[i] for i in sorted(p)) for s, p in by.items()}


@needs_tables
def test_rendering_of_whole_texts(spark):
    lines = defaultdict(list)
    for i, source, text in sorted(rows(spark, "documents", "doc_id", "source", "text")):
        flat = re.sub(r"[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*", " ", text)
        lines[source].append(f"> [!note] {flat}\n> confidence {i * 37 % 101 / 100:.2f}")
    assert max(len(x) for some in lines.values() for x in some) > 1000
    assert joined(QUERIES["rendered_documents_whole"](spark, str(FOLDER)).collect()) == {s: "\n\n".join(x) for s, x in lines.items()}


def test_parts_are_bounded(spark):
    claims = [("hot", i, f"line {i}" + "x" * (i % 7)) for i in range(2000)] + [(None, 1, "a"), (None, 2, None), (None, 3, "b" * 500), ("one", 5, "c")]
    df = spark.createDataFrame(claims, "source string, k int, line string").repartition(5)
    parts = render.document_parts(df, ["source"], "line", ["k"], most=100).collect()
    assert joined(parts) == {s: "\n\n".join(x for g, _, x in claims if g == s and x is not None) for s in ("hot", None, "one")}
    assert all(len(r.document) <= 100 or r.lines == 1 for r in parts) and sum(r.source == "hot" for r in parts) > 100


@needs_tables
def test_reading_triples_has_a_small_plan(spark):
    """Each term is parsed once: no expression stands in the plan again and again."""
    plan = QUERIES["triples_read"](spark, str(FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000 and plan.count("from_json") <= 4
