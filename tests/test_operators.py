from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.operators import extract, render, threads


def test_coin_entry(spark):
    coin = {"id": 7, "title": "Mark", "min_year": 1975, "issuer": {"code": "gdr", "name": "East Germany"}, "weight": 2.5, "obverse": {"description": "Wreath"}, "mints": [{"id": 1, "name": "Berlin"}], "references": [{"catalogue": {"code": "KM"}, "number": "35"}, {"catalogue": {"code": "J"}, "number": "1514"}], "comments": "Thin."}
    rows = spark.createDataFrame([(json.dumps(coin),), ("{",), (None,)], "blob string")
    got = {(r.predicate, r.object, r.confidence) for r in extract.coin_claims(rows, "blob").collect()}
    assert got == {("title", "Mark", 0.95), ("issuer", "East Germany", 0.95), ("weight", "2.5", 0.95), ("obverse", "Wreath", 0.95), ("mint", "Berlin", 0.95), ("reference", "KM# 35", 0.95), ("reference", "J# 1514", 0.95), ("comments", "Thin.", 0.85)}


def test_entity_statements(spark):
    s = lambda rank, kind, content: {"rank": rank, "property": {"id": "P", "data_type": kind}, "value": {"type": "value", "content": content}}
    time = lambda t, p: {"time": t, "precision": p}
    entity = {"id": "Q1", "statements": {
        "P31": [s("preferred", "wikibase-item", "Q5"), s("normal", "wikibase-item", "Q404")], "P18": [s("normal", "string", "x.jpg")], "P3": [s("normal", "commonsMedia", "x.jpg")],
        "P569": [s("normal", "time", time("+1949-10-07T00:00:00Z", 11)), s("normal", "time", time("+1949-10-00T00:00:00Z", 10)), s("normal", "time", time("-0044-00-00T00:00:00Z", 9))], "P1": [s("deprecated", "string", "old")],
        "P2": [s("normal", "quantity", {"amount": "+12"}), s("normal", "quantity", {"amount": "-1.50"})], "P4": [s("normal", "monolingualtext", {"text": "Hut", "language": "de"})], "P5": [s("normal", "url", "http://x.org")],
    }}
    labels = spark.createDataFrame([("Q1", "Ada"), ("Q5", "human"), ("P31", "instance of")], "id string, label string")
    got = {(r.name, r.value, r.confidence, *(r.term or ())) for r in extract.entity_claims(spark.createDataFrame([(json.dumps(entity),)], "blob string"), "blob", labels).collect()}
    xsd = extract.XSD
    assert got == {
        ("instance of", "human", 0.99, "URI", extract.ENTITY + "Q5", None, None), ("P569", "7 October 1949", 0.85, "LITERAL", "1949-10-07T00:00:00Z", xsd + "dateTime", None), ("P569", "October 1949", 0.85, "LITERAL", "1949-10-01T00:00:00Z", xsd + "dateTime", None),
        ("P569", "-44", 0.85, "LITERAL", "-0044-01-01T00:00:00Z", xsd + "dateTime", None), ("P2", "12", 0.85, "LITERAL", "12", xsd + "decimal", None), ("P2", "-1.50", 0.85, "LITERAL", "-1.50", xsd + "decimal", None),
        ("P4", "Hut (de)", 0.85, "LITERAL", "Hut", None, "de"), ("P5", "http://x.org", 0.85, "URI", "http://x.org", None, None),
    }


def test_documented_symbols(spark):
    code = '"""Top.\n\nMore."""\nclass A:\n    """An A\n    of two lines."""\n    def f(self):\n        """Does f."""\n    def g(self): pass\nasync def h():\n    """Does h."""\n'
    got = [(r.symbol, r.kind, r.summary) for r in extract.documented_symbols(spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.py", None)], "path string, code string"), "path", "code").collect()]
    assert got == [("", "module", "Top."), ("A", "class", "An A of two lines."), ("A.f", "function", "Does f."), ("h", "function", "Does h.")]


def test_trees(spark):
    rows = [("t", 1, None, 0, 5, False), ("t", 2, 1, 1, 0, True), ("t", 3, 1, 0, 9, False), ("t", 4, 2, 0, 7, False), ("t", 5, 99, 0, 9, False)]
    c = spark.createDataFrame(rows, "thread string, id int, parent int, ordinal int, score int, hidden boolean")
    tree = threads.tree_paths(c)
    assert [(r.id, r.depth) for r in threads.shown(tree, ~F.col("hidden")).collect()] == [(1, 0), (3, 1), (4, 2)]
    assert sorted(r.id for r in threads.tree_paths(c, prune=~F.col("hidden")).collect()) == [1, 3]
    assert [r.id for r in threads.top_scored(tree, 1).collect()] == [3, 4, 1]


def test_rendering(spark):
    row = spark.range(1).select(
        render.claim_line(F.lit("a\n b"), F.lit("RETRACTED"), F.lit(0.456), F.lit("p1")).alias("line"), render.memory_bullet(F.lit(" x  y "), F.lit("0123abcd"), F.array(F.lit("stance"), F.lit("divergence"))).alias("bullet"),
        render.sources_trailer(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("trailer"), render.sources_trailer(F.array().cast("array<string>")).alias("none"),
    ).first()
    assert tuple(row) == ("> [!failure] a b\n> confidence 0.46\n> source p1", "- [contested: divergence, stance] x y (p-0123abcd)", "Sources: p-a, p-b", None)


def test_entry_without_the_language_model_part(tmp_path):
    """The driver removes the llm folders and the pipeline; the rest still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)
