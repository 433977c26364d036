from __future__ import annotations

import json

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import url as u
from factloom.operators import catalogues, chunks, documents, extract, identity, passes, render, threads
from factloom.sources import interchange

def now():
    return F.lit("2024-03-01").cast("timestamp")


def test_listing_pages(spark):
    piece = lambda n, extra="": f'<div class="description_piece"><a href="/x"><img src="/design/pays/ddr.png" title="East"></a><strong><a href="/{n}/">1 Mark</a></strong><br>1948-1950<br><em>Coins › Standard</em><br>{extra}</div>'
    pages = [(f"<html>{piece(7, 'Aluminium • 1.5 g • ⌀ 17 mm<br>KM# 1')}{piece('no')}<div>else</div></html>",), ("<p>none</p>",), (None,)]
    got = [tuple(r) for r in catalogues.listing_claims(spark.createDataFrame(pages, "html string"), "html", {"ddr": "GDR"}).collect()]
    assert got == [("7", "infobox", "1 Mark (1948-1950) GDR: made of aluminium, weight 1.5g, diameter 17.0mm.", ["1 Mark (1948-1950) GDR", "East", "Standard", "Aluminium"], 0.92)]


def notes_of(spark, blobs, schema):
    rows = spark.createDataFrame([(str(i), b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(blobs)], "entry_id string, blob string")
    return [(r.artefact, r.note) for r in sorted(catalogues.artefacts(rows, "blob", schema).collect(), key=lambda r: int(r.entry_id))]


def test_taxonomies(spark):
    good = {"name": "Coins", "version": "1.0", "author": "me", "tags": [{"tag": "a", "aliases": ["b"], "description": "d"}, {"tag": "a/b", "parent": "a"}, {"tag": "a/b/c", "parent": "a/b"}]}
    tags = lambda *t: good | {"tags": list(t)}
    cases = [
        (good, None), (good | {"author": ""}, "no author"), ({k: v for k, v in good.items() if k != "version"}, "no version"), ("{", "no name"), (None, "no object"), ("[1]", "no object"), ({k: v for k, v in good.items() if k != "tags"}, "no tags"), (tags({"tag": ""}), "a tag without a name"),
        (tags({"tag": "a", "parent": "b"}), "a tag whose parent isn't its path"), (tags({"tag": "a/b"}), "a tag whose parent isn't its path"), (tags({"tag": "a/b/c", "parent": "a"}), "a tag whose parent isn't its path"), (tags(), None),
    ]
    got = notes_of(spark, [c for c, _ in cases], catalogues.TAXONOMY)
    assert [n for _, n in got] == [n for _, n in cases] and all((a is None) == (n is not None) for a, n in got)
    assert [tuple(t) for t in got[0][0].tags] == [("a", None, ["b"], "d"), ("a/b", "a", None, None), ("a/b/c", "a/b", None, None)]


def test_trust_lenses(spark):
    good = {
        "kind": "TrustLensDefinition", "name": "l", "version": 2, "publisher": "p", "statements": [{"domain": "d", "source_type": "s", "trust_rank": 0.4}], "extractor_weights": {"x": 0.8, "y": 1},
        "url_rules": [{"scope": "domain", "pattern": "h", "score": 0.2}, {"scope": "url_pattern", "pattern": "/x/", "modifier": -0.3}], "decay_rules": [{"scope": "source_type", "pattern": "s", "half_life_days": 3, "floor": 0}], "utility_rules": [{"half_life_uses_days": 1, "rank_lift": 0}],
    }
    url, weight = "a URL rule that isn't one of domain and score or pattern and modifier", "extractor weight out of range"
    decay = lambda **x: good | {"decay_rules": [good["decay_rules"][0] | x]}
    cases = [
        (good, None), (good | {"version": 0}, "version below 1"), (good | {"kind": "x"}, "another kind"), (good | {"name": ""}, "no name"), ({"name": "l"}, "no version"), ({"name": "l", "version": 1}, None), (good | {"extractor_weights": {"x": 1.5}}, weight),
        (good | {"statements": [{"domain": "d", "source_type": "s", "trust_rank": 7}]}, "trust rank out of range"), (good | {"statements": [{"domain": "d", "trust_rank": 0.7}]}, "a statement without domain or source type"),
        *[(good | {"url_rules": [r]}, url) for r in ({"scope": "domain", "pattern": "h", "score": 7}, {"scope": "domain", "pattern": "h", "modifier": 0.1}, {"scope": "domain", "pattern": "h", "score": 0.1, "modifier": 0.1}, {"scope": "url_pattern", "pattern": "", "modifier": 1}, {"scope": "else", "pattern": "h", "score": 0.1})],
        (decay(scope="default"), "a decay rule that can't hold"), (decay(half_life_days=0), "a decay rule that can't hold"), (decay(floor=2), "a decay rule that can't hold"),
        (good | {"utility_rules": [{"scope": "default", "pattern": "x", "half_life_uses_days": 1, "rank_lift": 0}]}, "a utility rule that can't hold"), (good | {"utility_rules": [{"scope": "url_pattern", "half_life_uses_days": 1, "rank_lift": 0}]}, "a utility rule that can't hold"),
    ]
    got = notes_of(spark, [c for c, _ in cases], catalogues.TRUST_LENS)
    assert [n for _, n in got] == [n for _, n in cases]
    lens = got[0][0]
    assert lens.extractor_weights == {"x": 0.8, "y": 1.0} and [tuple(r) for r in lens.url_rules] == [("domain", "h", 0.2, None), ("url_pattern", "/x/", None, -0.3)] and lens.decay_rules[0].half_life_days == 3.0


def test_docstrings_and_modules(spark):
    code = 'def f(a):\n    """Adds.\n\n    More.\n\n    Args:\n        a (int): the first\n            one\n        *b: rest\n    Returns:\n        a sum\n        of all\n    Raises:\n        ValueError: never\n    """\nclass K:\n    """Attributes:\n        x: y\n    """\n'
    files = spark.createDataFrame([("r/pkg/sub/m.py", code), ("r/pkg/__init__.py", '"""Top."""'), ("r/bad.py", "def (")], "path string, code string")
    packages = spark.createDataFrame([("r/pkg",), ("r/pkg/sub",)], "path string")
    got = {(r.module, r.symbol): r for r in extract.documented_symbols(files, "path", "code", packages).collect()}
    assert set(got) == {("pkg.sub.m", "f"), ("pkg.sub.m", "K"), ("pkg", "")}
    f = got["pkg.sub.m", "f"]
    assert (f.summary, f.args, f.raises, f.returns, f.yields) == ("Adds.", {"a": "the first one", "*b": "rest"}, {"ValueError": "never"}, "a sum of all", None)
    assert got["pkg.sub.m", "K"].attributes == {"x": "y"} and got["pkg.sub.m", "K"].summary == "Attributes: x: y"


def test_abstractions_and_suggestions(spark):
    claims = [(i, 0.9 - i / 100, "2024-01-01" if i != 5 else "2024-02-28", 0 if i != 6 else 1, i == 7, i == 2) for i in range(12)]
    rows = spark.createDataFrame(claims, "id long, confidence double, asserted_at string, depth int, anchored boolean, stale boolean").withColumn("asserted_at", F.col("asserted_at").cast("timestamp"))
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.6), (2, 3, 0.5), (3, 5, 0.9), (3, 6, 0.9), (3, 7, 0.9), (8, 9, 0.9), (9, 10, 0.55), (10, 11, 0.7)], "a long, b long, sim double")
    got = {r.cluster: (r["size"], round(r.confidence, 6), round(r.support, 6)) for r in passes.abstraction_clusters(rows, pairs, now()).collect()}
    assert got == {0: (3, 0.88, round((0.9 + 0.89 + 0.44) / 3, 6)), 8: (4, 0.79, round((0.82 + 0.81 + 0.80 + 0.79) / 4, 6))}
    verdicts, linked = spark.createDataFrame([(8, 9, "PARAPHRASE")], "a long, b long, verdict string"), spark.createDataFrame([(3, 5)], "a long, b long")
    merges = {(r.cluster, r.a, r.b, r.verdict) for r in passes.suggested_merges(pairs, verdicts, linked, least=0.9).collect()}
    assert merges == {(0, 0, 1, None), (3, 3, 6, None), (3, 3, 7, None), (8, 8, 9, "PARAPHRASE")}
    assert spark.range(1).select(passes.premise_confidence(F.array(F.lit(1.4), F.lit(0.3)))).first()[0] == 0.3


def test_regions(spark):
    mark = lambda name, body: f"<!-- BEGIN PROJECTED: {name} (manifest: m.yaml) -->\n{body}\n<!-- END PROJECTED: {name} -->"
    text = f"top\n\n{mark('a', 'same')}\n\nmiddle\n{mark('b', 'edited')}\n<!-- BEGIN PROJECTED: c (manifest: x) -->\nopen"
    files = spark.createDataFrame([("f", text), ("g", "plain"), ("h", None)], "path string, text string")
    got = [(r.region, r.manifest, r.body, text[r.start : r.end][:21]) for r in render.projected_regions(files, "path", "text").collect()]
    assert got == [("a", "m.yaml", "same", "<!-- BEGIN PROJECTED:"), ("b", "m.yaml", "edited", "<!-- BEGIN PROJECTED:")]
    snapshots = spark.createDataFrame([("f", "a", "same\n"), ("f", "b", "as it was")], "path string, region string, body string")
    clean = {r.path: r.text for r in render.without_regions(files, "path", "text", snapshots).collect()}
    assert clean == {"f": "top\n\nmiddle\nedited\n\n<!-- BEGIN PROJECTED: c (manifest: x) -->\nopen", "g": "plain", "h": None}


def test_interchange_files(spark, tmp_path):
    units = spark.createDataFrame([('{"b":1,"a":[1,2]}',), ('{"c":"ä"}',)], "unit string").coalesce(1)
    interchange.write_yaml_units(units, "unit", str(tmp_path / "y"))
    got = sorted(r.unit for r in interchange.read_yaml_units(spark, str(tmp_path / "y" / "part-*")).where("unit IS NOT NULL").collect())
    assert got == ['{"b": 1, "a": [1, 2]}', '{"c": "ä"}']
    for name, text in (("bad.yaml", "{a"), ("map.yaml", "a: 1"), ("none.yaml", "")):
        (tmp_path / name).write_text(text)
    assert sorted(r.problem for r in interchange.read_yaml_units(spark, str(tmp_path / "*.yaml")).collect()) == ["no YAML", "no sequence of mappings"]
    (tmp_path / "u.jsonl").write_text('{"@type": "Claim", "content": "x"}\n\n{"@type": "Claim", "content": "y"}\n')
    assert interchange.read_units(spark, str(tmp_path / "u.jsonl")).count() == 2
    with pytest.raises(ValueError, match="2 units"):
        interchange.read_units(spark, str(tmp_path / "u.jsonl"), most_units=1)


def test_trees_that_repeat_ids_are_an_error(spark):
    rows = [("t", 1, None, 0), ("t", 2, 1, 0), ("t", 1, 2, 0)]
    with pytest.raises(ValueError, match="below level"):
        threads.tree_paths(spark.createDataFrame(rows, "thread string, id int, parent int, ordinal int"))
    deep = [("t", i, i - 1 if i else None, 0) for i in range(12)]
    assert threads.tree_paths(spark.createDataFrame(deep, "thread string, id int, parent int, ordinal int")).agg(F.max("depth")).first()[0] == 11


def test_status_claims(spark):
    schema = "thread long, id string, account string, instance string, favourites long, boosts long, replies long, warning string, language string, card_url string, parent string, root string, boosted struct<id:string,account:string,uri:string>"
    rows = [(1, "9", "me", "x.social", 3, None, 1, " cw ", "en", None, "8", "", ("5", "you", None)), (2, None, "me", None, 0, 0, 0, None, None, None, None, None, None)]
    got = chunks.status_claims(spark.createDataFrame(rows, schema)).collect()
    assert [r.content for r in got] == ["Mastodon status by mastodon/me on x.social (boost) [CW: cw] received 3 favourites, 0 boosts, 1 replies."]
    assert '"thread:hasRootId":"8"' in got[0].properties and '"mastodon:reblogOfAccountAcct":"you"' in got[0].properties and "hasUrl" not in got[0].properties


def test_overlapping_chunks():
    text = "\n".join(f"line {i}" for i in range(40))
    got = documents.overlapping_chunks(text, 60, 2)
    assert all(a.split("\n")[-2:] == b.split("\n")[:2] or a.split("\n")[-1] in b for a, b in zip(got, got[1:]))
    assert documents.overlapping_chunks(None, 5, 1) == [] and documents.overlapping_chunks("abc" * 9, 10, 0) == ["abcabcabca", "bcabcabcab", "cabcabc"]


def test_many_queries_meet_blocks(spark, monkeypatch):
    monkeypatch.setattr(identity, "MOST_BROADCAST", 2)
    rng = random.Random(2)
    points = [(i, rng.random()) for i in range(60)]
    rows = spark.createDataFrame(points, "vec_id long, x double")
    queries = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    got = {(r.query_id, r.place): r.vec_id for r in identity.top_neighbours(queries, rows, -F.abs(F.col("x") - F.col("q")), 3, blocks=4).collect()}
    want = {(q, n + 1): i for q, x in points[:9] for n, (_, i) in enumerate(sorted((abs(y - x), i) for i, y in points if i != q)[:3])}
    assert got == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://me:pw@Example.COM:80/a/b/?utm_source=x&b=1&a=%20c&ref=q#f", "http://example.com/a/b?b=1&a=+c"), ("https://www.google.com/url?q=https%3A%2F%2Fexample.com%2Fx%3Fy%3D1&sa=D", "https://example.com/x?y=1"),
        ("https://www.google.com/amp/s/example.com/a", "https://example.com/a"), ("https://www.google.com/amp/example.com/a?x=1", "http://example.com/a?x=1"), ("https://a.cdn.ampproject.org/c/ex.com/p", "http://ex.com/p"),
        ("https://a.cdn.ampproject.org/v/s/ex.com/p", "https://a.cdn.ampproject.org/v/s/ex.com/p"), ("https://google.de/url?q=http://a.com", "https://google.de/url?q=http%3A%2F%2Fa.com"), ("https://google.com/url?q=javascript:1", "https://google.com/url?q=javascript%3A1"),
        ("https://www.google.com/url?q=https%3A%2F%2Fwww.google.com%2Famp%2Fs%2Fe.org%2F%3Fgclid%3D1", "https://e.org/"), ("https://ex.com:8443/a/).'", "https://ex.com:8443/a"), ("(https://ex.com)", None), ("ftp://x.org", None), ("https:///path", None), ("", None), ("https://ex.com./?a", "https://ex.com/?a="),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.range(1).select(u.canonical(F.lit(url))).first()[0] == want
