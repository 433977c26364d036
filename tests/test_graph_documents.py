from __future__ import annotations

from factloom.operators import graph_claims


def test_limit_labels_and_statements_hold_within_a_document(spark):
    rdf, label = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", graph_claims.LABELS[0]
    lines = [(d, f"<http://x/{d}{i}> <http://x/p> <http://x/shared> .") for d, n in (("a", 300), ("b", 2), ("c", 5)) for i in range(n)]
    lines += [("a", f'<http://x/shared> <{label}> "of a" .'), ("b", f'<http://x/shared> <{label}> "of b" .')]
    for d, level in (("a", "0.5"), ("b", "0.7")):
        for p, o in (("type", f"<{rdf}Statement>"), ("subject", f"<http://x/{d}0>"), ("predicate", "<http://x/p>"), ("object", "<http://x/shared>")):
            lines.append((d, f"_:s <{rdf}{p}> {o} ."))
        lines.append((d, f'_:s <http://example.org/confidence> "{level}" .'))
    df = spark.createDataFrame(lines, "document string, value string").repartition(4)
    got = graph_claims.triple_claims(graph_claims.line_triples(df), most=5).collect()
    label_of = {"a": "of a", "b": "of b", "c": "shared"}
    kept = {"a": sorted(f"a{i}" for i in range(300))[:5], "b": ["b0", "b1"], "c": [f"c{i}" for i in range(5)]}
    level_of = {"a0": 0.5, "b0": 0.7}
    want = {(d, f"http://x/{s}", f"{s} p: {label_of[d]}", level_of.get(s, 0.95), 295 if d == "a" else 0) for d, some in kept.items() for s in some}
    assert len(got) == 12 and {(r.document, r.s, r.content, r.confidence, r.left_out) for r in got} == want
