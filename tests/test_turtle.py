from __future__ import annotations

import random

import pytest

from factloom.operators import graph_claims
from factloom.sources import turtle

EX, RDF, XSD = "http://x/", turtle.RDF, turtle.XSD


def read(spark, texts, name=None, **more):
    rows = [(str(i), t if isinstance(t, bytes) or t is None else t.encode(), name) for i, t in enumerate(texts)]
    return turtle.read_graphs(spark.createDataFrame(rows, "k string, b binary, n string"), "k", "b", "n", **more)


def one(text, **more):
    """(s, p, o, datatype or language, graph if any) of each triple."""
    return [(s.value, p.value, o.value, o.datatype or o.lang, *([g] if g else [])) for s, p, o, g in turtle.Document("@prefix : <http://x/> . " + text, **more).triples]


def test_lists_of_predicates_and_objects():
    got = one(":a :b :c , <d> ; a :e ; . <s> :p <#q>.", base="http://y/z")
    assert got == [(EX + "a", EX + "b", EX + "c", None), (EX + "a", EX + "b", "http://y/d", None), (EX + "a", RDF + "type", EX + "e", None), ("http://y/s", EX + "p", "http://y/z#q", None)]


def test_literals():
    text = r""":a :b 1, -2.5, 3e4, .5, true, 'x'@EN-us, "y"^^:t, 'qé\n', '''a'b""" + "\n" + r"""''', """ + '""""c""", ' + "''."
    want = [("1", XSD + "integer"), ("-2.5", XSD + "decimal"), ("3e4", XSD + "double"), (".5", XSD + "decimal"), ("true", XSD + "boolean"), ("x", "en-us"), ("y", EX + "t"), ("qé\n", None), ("a'b\n", None), ('"c', None), ("", None)]
    assert [t[2:] for t in one(text)] == want


def test_names_and_directives():
    got = one(r":a.b :c\,d%20 :e:f. PREFIX p-q: <u:> BASE <http://b/> p-q:x p-q: <r> . # end")
    assert got == [(EX + "a.b", EX + "c,d%20", EX + "e:f", None), ("u:x", "u:", "http://b/r", None)]


def test_nested_nodes_and_lists():
    got = one("[] :p [ :q 1 ; :r [] ] . [ :s _:x.y ] . :a :b () .")
    assert got == [("_:.2", EX + "q", "1", XSD + "integer"), ("_:.2", EX + "r", "_:.3", None), ("_:.1", EX + "p", "_:.2", None), ("_:.4", EX + "s", "_:x.y", None), (EX + "a", EX + "b", RDF + "nil", None)]
    triples = [t[:3] for t in one(":a :b ( 1 (2) 3 ) .")]
    first, rest = ({s: o for s, p, o in triples if p == RDF + x} for x in ("first", "rest"))

    def told(node):
        return [] if node == RDF + "nil" else [told(first[node]) if first[node] in first else first[node], *told(rest[node])]

    assert told(next(o for s, p, o in triples if p == EX + "b")) == ["1", ["2"], "3"]


def test_graphs_and_quads():
    got = one(":g { :a :b :c . :d :e :f } GRAPH _:h { [ :p 1 ] } { :x :y :z. }")
    assert got == [(EX + "a", EX + "b", EX + "c", None, EX + "g"), (EX + "d", EX + "e", EX + "f", None, EX + "g"), ("_:.1", EX + "p", "1", XSD + "integer", "_:h"), (EX + "x", EX + "y", EX + "z", None)]
    assert one(":a :b :c <http://x/g> . :a :b 'd' .", quads=True) == [(EX + "a", EX + "b", EX + "c", None, EX + "g"), (EX + "a", EX + "b", "d", None)]


@pytest.mark.parametrize("bad", [":a :b .", ":a :b :c", "no:p :a :b .", ":a :b 'x", r":a :b '\q' .", ":a 'b' :c .", "@prefix x <y> .", "{ :a :b :c", r":a :b '\ud800' .", "]", ":a :b (1 .", ":a :b :c :d .", ":a :b :c :d :e .", "[" * 5000])
def test_broken_documents(bad):
    with pytest.raises((turtle.Unreadable, RecursionError)):
        turtle.Document("@prefix : <http://x/> . " + bad)


def test_unreadable_documents_say_why(spark):
    texts = [None, b"", b"\xff\xfe", "<?xml version='1.0'?><rdf:RDF/>", '{"@context": "http://remote/", "a": 1}', "<u:a> <u:b> <u:c> .", "x" * 300, "<u:a> <u:b> <u:c> <u:g> ."]
    got = {r.document: r for r in read(spark, texts, most_bytes=200).collect()}
    assert {k for k, r in got.items() if r.note is None} == {"5", "7"} and got["7"].graph == "u:g"
    assert "xml: not read" in got["3"].note and "json: not read" in got["4"].note and got["6"].note == "300 bytes, over the limit of 200" and "no triples" in got["1"].note
    assert turtle.syntaxes("http://h/a.nq?x#y", b"") == ["quads", "turtle"] and turtle.syntaxes("b.TTL", b"") == ["turtle", "quads"] and turtle.syntaxes(None, b'  [{"@context"') == ["json", "turtle", "quads"]
    assert read(spark, [""]).limit(0).count() == 0


TEXT = """@prefix c: <http://h/coins/> . @prefix o: <http://www.w3.org/2002/07/owl#> . @prefix l: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix w: <http://www.wikidata.org/entity/> . @prefix u: <urn:isbn:> .
c: a o:Ontology ; o:versionInfo "2" . c:five l:label "5 Mark", "Fünf"@de ; c:wasStruckIn c:EastMint ; c:hasMass 2.5 ; c:says "Glück"@de, "luck"@en-GB ; c:issuedBy w:Q1 ; c:isIn c:, u:n12 ; c:next [] .
w:Q1 l:label "State"@en . _:b c:p c:q . _:s a r:Statement ; r:subject c:five ; r:predicate c:ended ; r:object 1990 ; <http://example.org/confidence> 0.72 .
_:t a r:Statement ; r:subject c:five ; r:predicate c:hasMass ; r:object 2.5 ; <http://example.org/confidence> 7 .
c:g1 { c:five c:hasMass 2.5 . c:five c:hasMass 2.5 } c:g2 { c:g1 <http://example.org/confidence> 0.3 . c:g1 c:by w:Q1 }"""


def test_claims_of_a_graph(spark):
    rows = read(spark, [TEXT, TEXT.replace("0.72", "2").replace("0.3", "'x'")])
    claims = graph_claims.triple_claims(rows).collect()
    got = {(r.content, r.confidence, r.graph, tuple(r.refs)) for r in claims if r.document == "0"}
    g1, g2, me = "http://h/coins/g1", "http://h/coins/g2", "5 Mark "
    want = {
        (me + "was struck in: East mint", 0.95, None, ()), (me + "has mass: 2.5", 0.95, None, ()), (me + "has mass: 2.5", 0.3, g1, ()), (me + "says: Glück (de)", 0.95, None, ()), (me + "says: luck", 0.95, None, ()), (me + "issued by: State", 0.95, None, ("wikidata:Q1",)),
        (me + "is in: coins/", 0.95, None, ()), (me + "is in: u:n12", 0.95, None, ()), (me + "ended: 1990", 0.72, None, ()), ("g1 by: State", 0.95, g2, ("wikidata:Q1",)),
    }
    want = {(c if c != me + "is in: coins/" else me + "is in: http://h/coins/", *rest) for c, *rest in want}
    assert got == want
    assert {(r.content, r.confidence) for r in claims if r.document == "1"} == {(c, 0.95) for c, *_ in want}
    ended = next(r for r in claims if r.content.endswith("1990"))
    assert tuple(ended.claim.object) == ("LITERAL", "1990", XSD + "integer", None) and ended.subjects == ["5 Mark"] and ended.left_out == 0


def test_blank_subjects(spark):
    rows = read(spark, ["_:b <http://h/isBig> 1 . _:b <http://www.w3.org/2000/01/rdf-schema#label> 'B' . _:c <http://h/isBig> 2 ."])
    assert graph_claims.triple_claims(rows).isEmpty()
    assert [(r.content, r.claim.subject.kind) for r in graph_claims.triple_claims(rows, blank_subjects=True).collect()] == [("B is big: 1", "TOKEN")]


def test_a_large_document_equals_its_lines(spark):
    """100,000 triples in Turtle's short forms and line by line."""
    rng = random.Random(4)
    short, lines = ["@prefix e: <http://x/e#> ."], []
    for s in range(20_000):
        parts = []
        for k in range(5):
            o = rng.choice([f"e:o{rng.randrange(500)}", f'"t{rng.randrange(900)}"@de', rf'"q \"{k}\""'])
            parts.append(f"e:p{k} {o}")
            lines.append(("0", f"<http://x/e#s{s}> <http://x/e#p{k}> {f'<http://x/e#{o[2:]}>' if o.startswith('e:') else o} ."))
        short.append(f"e:s{s} " + " ;\n  ".join(parts) + " .")
    columns = ["document", "s", "p", "o", "kind", "datatype", "lang", "graph"]
    whole = read(spark, ["\n".join(short)]).where("kind <> 'prefix'").select(*columns)
    by_line = graph_claims.line_triples(spark.createDataFrame(lines, "document string, value string")).select(*columns)
    assert whole.count() == by_line.count() == 100_000 and whole.exceptAll(by_line).isEmpty()


def test_documents_are_spread_and_read_once(spark):
    """Bodies made from one partition are dealt over tasks; the claims' joins read a table, not the documents."""
    docs = spark.range(0, 12_000, 1, 1).selectExpr("id AS k", "concat('<http://x/', id, '> <http://x/p> ', id, ' .') AS b")
    rows = turtle.read_graphs(docs, "k", "b")
    assert rows.rdd.getNumPartitions() >= 3
    claims = graph_claims.triple_claims(rows)
    assert "MapInArrow" in rows._jdf.queryExecution().toString() and "MapInArrow" not in claims._jdf.queryExecution().toString()
    assert claims.where("content = document || ' p: ' || document AND left_out = 0").count() == 12_000
