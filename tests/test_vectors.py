"""Published values of the scoring formulas and of the conflict ladder."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import claims as c
from factloom.functions import confidence as conf
from factloom.functions import text as t
from factloom.functions import url as u
from factloom.functions import vectors as v
from factloom.operators import documents, identity, scoring, shared


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("x,e,s,r,want", [(0.8, 1.0, 0.9, 1.0, 0.72), (0.5, 0.8, 1.0, 0.5, 0.2), (0.9, 1.0, 1.0, 1.0, 0.9), (0.95, 1.5, 1.0, 1.0, 1.0)])
def test_effective_confidence(spark, x, e, s, r, want):
    assert value(spark, conf.effective_confidence(F.lit(x), F.lit(e), F.lit(s), F.lit(r))) == pytest.approx(want, abs=1e-9)


def test_cap_and_missing_weights(spark):
    none = F.lit(None).cast("double")
    assert value(spark, conf.effective_confidence(F.lit(0.9), none, none, none, F.lit("EXTRACTOR_DIRECT"), 0.7)) == 0.7
    assert value(spark, conf.effective_confidence(F.lit(0.9), none, none, none, F.lit("DERIVED"), 0.7)) == 0.9
    assert value(spark, conf.effective_confidence(none, none, none, none)) is None


@pytest.mark.parametrize("age,half,floor,want", [(60.0, 60.0, 0.1, 0.5), (600.0, 60.0, 0.1, 0.1), (0.0, 60.0, 0.1, 1.0), (365.0, 365.0, 0.4, 0.5)])
def test_recency(spark, age, half, floor, want):
    assert value(spark, conf.recency_of_age(F.lit(age), F.lit(half), F.lit(floor))) == pytest.approx(want, abs=1e-9)


def test_recency_by_source(spark):
    now, then = F.lit("2024-03-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    assert value(spark, conf.recency(then, F.lit("REDDIT_POST"), now)) == pytest.approx(0.5)
    assert value(spark, conf.recency(then, F.lit("WEB_PAGE"), now)) == 1.0
    assert value(spark, conf.recency(F.lit(None).cast("timestamp"), F.lit("REDDIT_POST"), now)) == 1.0


@pytest.mark.parametrize("raw,temperature,want", [(0.97, 10.0, 0.5860378586300931), (0.8, 1.0, 0.8), (0.8, 0.5, 0.9411764705882353), (1.0, 3.0, 1.0), (0.0, 0.25, 0.0)])
def test_calibration(spark, raw, temperature, want):
    assert value(spark, conf.calibrated(F.lit(raw), F.lit(temperature))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("entries,want", [([(0.6, "A"), (0.5, "B")], 0.8), ([(0.6, "A")] * 3, 0.776), ([(0.7, "A"), (0.5, "A"), (0.6, "B")], 0.91), ([(0.8, "A")], 0.8), ([(1.0, "A"), (0.5, "B")], 1.0)])
def test_noisy_or(spark, entries, want):
    rows = spark.createDataFrame([(1, *e) for e in entries], "g int, confidence double, source string")
    assert scoring.merged_confidence(rows, ["g"], "source", "confidence").first().merged == pytest.approx(want, abs=1e-9)


F1, C1, V1 = "FALSIFIABLE", "CONSTITUTIVE", "EVALUATIVE"
#: old modality, new modality, old nature, new over old, old over new, contradiction, trusts, threshold, one order, verdict
LADDER = [
    (F1, F1, "ALEATORY", True, False, True, 0.2, 0.9, 0.15, True, "INCONSISTENT"), (C1, C1, "EPISTEMIC", True, False, True, None, None, 0.15, True, "DOCUMENT_SUPERSEDES"),
    (F1, F1, "EPISTEMIC", True, False, True, 0.9, 0.2, 0.15, True, "DOCUMENT_SUPERSEDES"), (F1, F1, "EPISTEMIC", False, True, True, None, None, 0.15, True, "DOCUMENT_SUPERSEDED_BY_EXISTING"),
    (F1, F1, "EPISTEMIC", True, True, True, None, None, 0.15, True, "INCONSISTENT"), (C1, C1, "EPISTEMIC", True, False, False, None, None, 0.15, True, "CORROBORATES"),
    (V1, F1, "EPISTEMIC", False, False, True, 0.2, 0.9, 0.15, True, "CORROBORATES"), (F1, F1, "EPISTEMIC", False, False, False, 0.2, 0.9, 0.15, True, "CORROBORATES"),
    (F1, F1, "EPISTEMIC", False, False, True, 0.2, 0.9, 0.15, True, "SUPERSEDES"), (F1, F1, "EPISTEMIC", False, False, True, 0.75, 0.5, 0.25, True, "SUPERSEDED_BY_EXISTING"),
    (F1, F1, "EPISTEMIC", False, False, True, 0.7, 0.6, 0.15, True, "INCONSISTENT"), (F1, F1, "EPISTEMIC", False, False, True, 0.2, 0.9, 0.15, False, "INCONSISTENT"),
]


def test_ladder(spark):
    rows = spark.createDataFrame(LADDER, "om string, nm string, nature string, nso boolean, osn boolean, con boolean, ot double, nt double, th double, single boolean, want string")
    got = rows.select("want", c.verdict(F.col("om"), F.col("nm"), F.col("nature"), F.lit("EPISTEMIC"), F.col("con"), F.col("nso"), F.col("osn"), F.col("ot"), F.col("nt"), F.col("th"), F.col("single")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_fingerprint(spark):
    ids = ["b91f4c33-2d7e-4a15-8c60-9e4d2b1a7f83", "0f2b6c1e-7a4d-4c9b-8f31-2a5e6d7c8b90", "7d3e9a12-4b6c-4f80-9a2d-1c5b3e7f0a44"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    assert identity.fingerprint(rows, "id").first().fingerprint == "7dc2c1b11629b09745301c73e4581f0bcc6d5a2dac4b7cadbd2628d26c775d44"
    assert identity.fingerprint(rows.limit(0), "id").first().fingerprint == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("provenance,n,want", [("OPERATOR_DIRECT", 0, True), ("REGISTRY_ENDORSED", 0, True), ("REVIEWER_DERIVED", 2, False), ("REVIEWER_DERIVED", 3, True), ("REVIEWER_DERIVED", 9, True)])
def test_cascade(spark, provenance, n, want):
    assert value(spark, c.cascades(F.lit(provenance), F.lit(n), F.lit(3))) is want


def test_claim_matching(spark):
    see = lambda v_, d, **f: value(spark, c.match(F.lit("p"), F.lit(v_), F.lit(d), c.Filters(**f)))
    assert see("12", "xsd:integer", above="5", below="20") == "MATCHED" and see("12", None, above="5") == "NOT_COMPARABLE"
    assert see("12", None, predicate="q", above="5") == "UNMATCHED" and see("2", "xsd:integer", above="5", below="2020-01-01") == "UNMATCHED"
    assert see("2020-05-01", "xsd:date", above="2020-01-01T00:00:00Z") == "MATCHED" and see("12.0", "xsd:decimal", equals="12") == "MATCHED"
    assert see("Abc", None, equals="aBC") == "MATCHED" and see("xyz", "xsd:integer", above="1") == "NOT_COMPARABLE" and not c.Filters()


def test_texts(spark):
    assert value(spark, t.normalized_content(F.lit("  a  b\n c.!\"  "))) == "a b c" and value(spark, t.dedup_key(F.lit("A-b  C!"))) == "a b c"
    assert value(spark, t.sentence_count(F.lit("One. Two! Three?"))) == 3 and value(spark, t.granularity_violation(F.lit("a. b. c."), 100, 2)) == "sentences"
    names = {"ADR-12": "reference_code", "a.md": "filename", "a_b": "snake_case", "TCP/IP": None, "tool run --x": "cli_command", "3M": None, "ACTIVE": "self_vocabulary", " ": None}
    assert {n: value(spark, t.non_entity_class(F.lit(n), ("ACTIVE",), ("tool",))) for n in names} == names
    assert value(spark, t.pretty_local_name(F.lit("http://x/y#hasBirthPlace"))) == "has birth place" and value(spark, t.file_name(F.lit("../a:b"))) == "-a-b"
    assert value(spark, t.ticker(F.lit("I think THE NVDA is"), ("I", "THE"))) == "NVDA" and value(spark, t.ticker(F.lit("none"), ("A",))) is None


@pytest.mark.parametrize("url,want", [
    ("HTTP://User:pw@Example.COM:80/a/b/?utm_source=x&b=2&a=1&b=2#f", "http://example.com/a/b?b=2&a=1&b=2"), ("https://example.com", "https://example.com/"), ("https://example.com:8443/x).", "https://example.com:8443/x"),
    ("ftp://example.com/x", None), ("https://www.google.com/url?sa=t&q=https%3A%2F%2Fexample.com%2Fy&ved=1", "https://example.com/y"), ("https://x-org.cdn.ampproject.org/c/s/x.org/z", "https://x.org/z"),
])
def test_urls(spark, url, want):
    assert value(spark, u.canonical(u.unwrapped(F.lit(url)))) == want


def test_harvest_keeps_order(spark):
    assert value(spark, u.harvested(F.lit("see https://b.org/x, (http://a.org) and https://B.org/x?fbclid=1"))) == ["https://b.org/x", "http://a.org/"]


def test_cosine(spark):
    get = lambda a, b: value(spark, v.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert get([1.0, 0.0], [1.0, 0.0]) == pytest.approx(1) and get([1.0, 0.0], [-1.0, 0.0]) == 0 and get([0.0, 0.0], [1.0, 0.0]) == 0


def test_chunks_and_packs(spark):
    assert documents.paragraph_chunks("aa\n\nbb\ncc\n\ndddddddd", 6) == ["aa", "bb\ncc", "ddddd", "ddd"]
    assert value(spark, documents.packed(F.array(*[F.lit(x).cast("long") for x in (5, 5, 1, 20, 3)]), 10)) == [0, 0, 1, 2, 3]
    assert value(spark, documents.html_text(F.lit("<nav>x</nav><p>a&amp;b<br>c</p><script>y</script>d"))) == "a&b\nc\n\nd"


def test_temperature_recovers(spark):
    import random

    rng = random.Random(3)
    rows = [(p, rng.random() < 1 / (1 + (((1 - p) / p) ** (1 / 2.0)))) for p in (rng.uniform(0.02, 0.98) for _ in range(20000))]
    assert scoring.fit_temperature(spark.createDataFrame(rows, "p double, ok boolean"), "p", "ok") == pytest.approx(2.0, abs=0.15)


def test_supersession_chains(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(101, 100)], "claim_id long, supersedes long")
    assert sorted(map(tuple, identity.supersession_roots(links).collect())) == [(i, 0, i, False) for i in range(1, 30)] + [(101, 100, 1, False)]


def test_cycles_of_chains_are_told(spark):
    """Cycles of every length to 9, one into itself, tails that lead into them, and chains beside them."""
    links = [(100 * n + i, 100 * n + (i + 1) % n) for n in range(1, 10) for i in range(n)] + [(5000 + i, 5001 + i) for i in range(20)] + [(5020, 302)] + [(7000 + i, 7001 + i) for i in range(33)] + [(None, 1), (1, None)]
    frame = spark.createDataFrame(links, "claim_id long, supersedes long")
    got = {r.claim_id: (r.root, r.depth, r.cyclic) for r in identity.supersession_roots(frame).collect()}
    cyclic = {c for c, _ in links if c and c != 1 and (c < 1000 or 5000 <= c <= 5020)}
    assert got == {c: (None, None, True) for c in cyclic} | {7000 + i: (7033, 33 - i, False) for i in range(33)}
    assert identity.supersession_roots(frame.limit(0)).collect() == []


def test_chains_are_followed_in_ranges_first(spark, monkeypatch):
    """A long chain takes few rounds, and no round has rows that stand at an end, which all share it."""
    made = []
    monkeypatch.setattr(shared.Tables, "only", lambda self, df, keep=shared.Tables.only: made.append(1) or keep(self, df))
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 20_000)], "claim_id long, supersedes long")
    assert {tuple(r) for r in identity.supersession_roots(links).collect()} == {(i, 0, i, False) for i in range(1, 20_000)}
    assert len(made) <= 4


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("as_text", [False, True])
def test_chains_across_ranges(spark, monkeypatch, several, as_text):
    """Chains in any order, trees and cycles, in ranges of about 50 claims, against a walk."""
    import random

    r = random.Random(4)
    to = {i: {r.randrange(i) if r.random() < 0.5 else i - 1} for i in range(1, 600) if r.random() < 0.9} | {i: {r.randrange(600, 700)} for i in range(600, 700)}
    if several:
        for i in (40, 200, 333):
            to[i] = {i - 1, i - 7}
    monkeypatch.setattr(identity, "LINKS_PER_BLOCK", 50)
    monkeypatch.setattr(identity, "MOST_SENT", 10)
    want = set()
    for i in to:
        at, gone = {i}, 0
        while at and gone <= 700:
            want |= {(i, x, gone, False) for x in at if x not in to}
            at, gone = {y for x in at for y in to.get(x, ())}, gone + 1
        want |= {(i, None, None, True)} if at else set()
    kind, told = ("string", str) if as_text else ("long", int)
    frame = spark.createDataFrame([(told(i), told(x)) for i, some in to.items() for x in some], f"claim_id {kind}, supersedes {kind}")
    got = identity.supersession_roots(frame).collect()
    assert len(got) == len(want) and {(int(r.claim_id), r.root if r.root is None else int(r.root), r.depth, r.cyclic) for r in got} == want


def test_tasks_of_edges_follow_from_rows_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(identity, "ROWS_PER_TASK", 100, raising=False)
    monkeypatch.setattr(identity, "PAIRS_PER_TASK", 100, raising=False)
    bridge = [(i // 5, (i * 7) % 60) for i in range(1000)] + [(3, 21), (None, 4), (4, None)]
    edges = identity.subject_edges(spark.createDataFrame(bridge, "c long, s long"), "c", "s")
    of = {}
    for c_, s in bridge:
        if c_ is not None and s is not None:
            of.setdefault(c_, set()).add(s)
    want = {}
    for some in of.values():
        for a in some:
            for b in some:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.claims for r in edges.collect()} == want
    assert edges.rdd.getNumPartitions() == 1 + sum(len(x) * (len(x) - 1) // 2 for x in of.values()) // 100
    assert identity.subject_edges(spark.createDataFrame([], "c long, s long"), "c", "s").collect() == []
