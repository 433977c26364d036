"""Shapes over triples against a walk of each document."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from factloom.operators import shapes
from factloom.sources import turtle

HEAD = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <urn:> . "
SHAPES = HEAD + r"""
:Outer a sh:NodeShape ; sh:targetClass :outer ;
  sh:property [ sh:path :id ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 2 ; sh:maxLength 4 ] ;
  sh:property [ sh:path :share ; sh:maxCount 1 ; sh:datatype xsd:float ; sh:minInclusive 0.0 ; sh:maxInclusive 1.0 ] ;
  sh:property [ sh:path :at ; sh:datatype xsd:dateTime ] ;
  sh:property [ sh:path :state ; sh:in ( "ON" "OFF"@en :none 1 ) ; sh:severity sh:Warning ] ;
  sh:property [ sh:path :version ; sh:pattern "^\\d+\\.\\d+$" ] ;
  sh:property [ sh:path :about ; sh:nodeKind sh:IRIOrLiteral ] ;
  sh:property [ sh:path :part ; sh:maxCount 2 ; sh:node :Middle ] .
:Middle a sh:NodeShape ; sh:property [ sh:path :term ; sh:minCount 1 ; sh:node :Inner ] .
:Inner a sh:NodeShape ; sh:property [ sh:path :kind ; sh:minCount 1 ; sh:in ( "A" "B" ) ] .
"""
GOOD = """:x a :outer ; :id "abc" ; :share "0.5"^^xsd:float ; :at "2024-01-02T03:04:05Z"^^xsd:dateTime ; :state "ON", "OFF"@en, :none, 1 ; :version "1.20" ; :about :y, "z" ;
 :part [ :term [ :kind "A" ] ], [ :term [ :kind "B" ], [ :kind "A", "B" ] ] ."""


def found(spark, texts, rules=SHAPES):
    rows = spark.createDataFrame([(str(i), (HEAD + t).encode()) for i, t in enumerate(texts)], "k string, b binary")
    return shapes.violations(turtle.read_graphs(rows, "k", "b"), shapes.rules(rules))


def told(rows):
    short = lambda x: x.replace("urn:", "") if x else x
    return sorted((r.document, short(r.path), r.constraint, r.nested) for r in rows.collect())


def test_a_good_document(spark):
    assert told(found(spark, [GOOD])) == []


CHANGES = [
    ((':id "abc" ;', ""), [("id", "minCount", False)]), (('"abc"', '"abc", "abd"'), [("id", "maxCount", False)]), (('"abc"', '"a"'), [("id", "minLength", False)]), (('"abc"', '"abcde"'), [("id", "maxLength", False)]),
    (('"abc"', '"abc"@en'), [("id", "datatype", False)]), (('"abc"', ":abc"), [("id", "datatype", False), ("id", "maxLength", False)]), (('"0.5"^^xsd:float', '"0.5"'), [("share", "datatype", False)]), (('"0.5"^^', '"1.5"^^'), [("share", "maxInclusive", False)]),
    (('"0.5"^^', '"-1e-3"^^'), [("share", "minInclusive", False)]), (('"0.5"^^', '"half"^^'), [("share", "datatype", False), ("share", "maxInclusive", False), ("share", "minInclusive", False)]), (('"0.5"^^', '"NaN"^^'), [("share", "maxInclusive", False), ("share", "minInclusive", False)]),
    (('"2024-01-02T03:04:05Z"', '"2024-13-02T03:04:05Z"'), [("at", "datatype", False)]), (('"ON"', '"on"'), [("state", "in", False)]), (('"OFF"@en', '"OFF"'), [("state", "in", False)]), ((":none", '"none"'), [("state", "in", False)]), (('"1.20"', '"1.20x"'), [("version", "pattern", False)]),
    (('"1.20"', "[]"), [("version", "pattern", False)]), ((":about :y", ":about []"), [("about", "nodeKind", False)]), (('[ :kind "B" ],', '[ :kind "C" ],'), [("kind", "in", True), ("part", "node", False), ("term", "node", True)]),
    (('[ :kind "B" ],', "[ :other 1 ],"), [("kind", "minCount", True), ("part", "node", False), ("term", "node", True)]), (('[ :kind "B" ],', '"text",'), [("part", "node", False), ("term", "node", True)]), (("[ :term [ :kind", "[], [ :term [ :kind"), [("part", "maxCount", False), ("part", "node", False), ("term", "minCount", True)]),
]


def test_each_constraint(spark):
    """One change to the good document each, all in one job."""
    assert all(old in GOOD for (old, _), _ in CHANGES)
    got = told(found(spark, [GOOD.replace(*change, 1) for change, _ in CHANGES]))
    assert got == sorted((str(i), *w) for i, (_, want) in enumerate(CHANGES) for w in want)


def test_a_triple_counts_once_and_documents_stand_apart(spark):
    rows = spark.createDataFrame([(d, "urn:x", p, o, k, None, None) for d in ("a", "b", None) for p, o, k in ((turtle.RDF + "type", "urn:outer", "iri"), ("urn:id", "one", "literal"), ("urn:id", "one", "literal"))] + [("b", "urn:x", "urn:id", "two", "literal", None, None)], "document string, s string, p string, o string, kind string, datatype string, lang string")
    assert [(r.document, r.constraint) for r in shapes.violations(rows, shapes.rules(SHAPES)).collect()] == [("b", "maxCount")]
    assert shapes.violations(rows.limit(0), shapes.rules(SHAPES)).count() == 0
    assert shapes.violations(rows, []).count() == 0


TRIPLES = "document string, s string, p string, o string, kind string, datatype string, lang string"


def moved(spark):
    """Rows that stages have written for others, so far."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_triples_are_moved_once_at_most(spark):
    """Values that nothing asks for stay where they are; the others go to their document, once."""
    types = spark.range(500).selectExpr("cast(id % 50 as string) document", "concat('urn:x', id) s", f"'{turtle.RDF}type' p", "'urn:outer' o", "'iri' kind", "cast(null as string) datatype", "cast(null as string) lang")
    facts = spark.range(20_000).selectExpr("cast(id % 500 % 50 as string) document", "concat('urn:x', id % 500) s", "if(id < 10000, 'urn:part', 'urn:version') p", "if(id < 10000, concat('urn:m', id), concat(id, '.0')) o", "if(id < 10000, 'iri', 'literal') kind", "cast(null as string) datatype", "cast(null as string) lang")
    before = moved(spark)
    got = Counter((r.path, r.constraint, r.nested) for r in shapes.violations(types.unionByName(facts), shapes.rules(SHAPES)).collect())
    assert got == {("urn:id", "minCount", False): 500, ("urn:part", "maxCount", False): 500, ("urn:term", "minCount", True): 10_000, ("urn:part", "node", False): 10_000}
    # parts are sent and counted
    assert 20_000 <= moved(spark) - before < 25_000


def test_documents_that_are_too_large_for_a_task(spark):
    """The same is found, whether documents stay together or not."""
    key, r = "spark.sql.requireAllClusterKeysForCoPartition", random.Random(5)
    rows = []
    for d, n in (("large", 60), ("large too", 40), (None, 20), *((str(i), 2) for i in range(30))):
        for i in range(n):
            rows += [(d, f"urn:n{i}", turtle.RDF + "type", "urn:outer", "iri", None, None)] + [(d, f"urn:n{i}", "urn:id", "x" * r.randrange(1, 6), "literal", None, None)] * r.randrange(3)
            rows += [(d, f"urn:n{i}", "urn:part", *r.choice(((f"urn:m{r.randrange(n)}", "iri"), ("text", "literal"))), None, None) for _ in range(3)]
            rows += [(d, f"urn:m{i}", "urn:term", f"urn:t{r.randrange(n)}", "iri", None, None), (d, f"urn:t{i}", "urn:kind", r.choice("ABC"), "literal", None, None)]
    triples, rules, before = spark.createDataFrame(rows, TRIPLES), shapes.rules(SHAPES), spark.conf.get(key)
    whole = Counter(map(tuple, shapes.violations(triples, rules).collect()))
    assert {d for d, *_ in whole} >= {"large", "large too", None, "7"} and {x[4] for x in whole} >= {"minCount", "maxCount", "node", "in", "minLength"}
    for n in (1, 100, 500):
        assert Counter(map(tuple, shapes.violations(triples, rules, rows=n).collect())) == whole
    assert spark.conf.get(key) == before


def test_two_rules_of_one_path_count_it_once_each(spark):
    rules = shapes.rules(HEAD + ":S a sh:NodeShape ; sh:targetClass :c, :d ; sh:property [ sh:path :p ; sh:maxCount 1 ; sh:minLength 1 ], [ sh:path :p ; sh:maxCount 1 ; sh:maxLength 2 ] .")
    rows = spark.createDataFrame([("a", "urn:x", p, o, k, None, None) for p, o, k in ((turtle.RDF + "type", "urn:c", "iri"), (turtle.RDF + "type", "urn:d", "iri"), ("urn:p", "long", "literal"))], TRIPLES)
    assert [(r.constraint, r.value) for r in shapes.violations(rows, rules).collect()] == [("maxLength", "long")]


def test_shapes_that_are_not_understood():
    shape = lambda body: HEAD + ":S a sh:NodeShape ; sh:targetClass :c ; sh:property [ " + body + " ] ."
    for body, why in (("sh:path :p ; sh:lessThan :q", "lessThan"), ("sh:path [ sh:inversePath :p ]", "no predicate"), ("sh:minCount 1", "no predicate"), ("sh:path :p ; sh:node :S", "reaches itself"), ("sh:path :p ; sh:node :T", "no rules"), ("sh:path :p ; sh:nodeKind :k", "kind of node")):
        with pytest.raises(ValueError, match=why):
            shapes.rules(shape(body))
    assert [r[:5] for r in shapes.rules(shape("sh:path :p ; sh:minCount 1"))] == [("urn:S", "urn:c", "urn:p", 1, None)]


def test_random_documents_against_a_walk(spark):
    """Every document's nodes, walked one by one."""
    r = random.Random(11)
    texts = []
    for _ in range(40):
        lines = []
        for n in range(r.randrange(1, 4)):
            lines.append(f":n{n} a :outer .")
            lines += [f':n{n} :id "{"x" * r.randrange(6)}" .' for _ in range(r.randrange(3))]
            lines += [f":n{n} :part :m{r.randrange(3)} ." for _ in range(r.randrange(4))]
        for m in range(3):
            lines += [f":m{m} :term :t{r.randrange(3)} ." for _ in range(r.randrange(3))]
            lines += [f':t{m} :kind "{r.choice("ABC")}" .' for _ in range(r.randrange(2))]
        texts.append("\n".join(lines))
    got = Counter((r.document, r.focus, r.path, r.constraint, r.value) for r in found(spark, texts).collect())
    want = Counter()
    for d, text in enumerate(texts):
        facts = set(re.findall(r":(\w+) (:\w+|a) :?\"?(\w*)\"? \.", text))
        of = lambda s, p, facts=facts: sorted({o for a, b, o in facts if a == s and b == p})
        kinds, done = {}, set()

        def inner(t):
            bad = [("minCount", None)] * (not of(t, ":kind")) + [("in", x) for x in of(t, ":kind") if x not in "AB"]
            kinds.setdefault(("kind", t), bad)
            return bool(bad)

        def middle(m):
            bad = [("minCount", None)] * (not of(m, ":term")) + [("node", "urn:" + t) for t in of(m, ":term") if inner(t)]
            kinds.setdefault(("term", m), bad)
            return bool(bad)

        for n in sorted({a for a, b, _ in facts if b == "a"}):
            ids = of(n, ":id")
            kinds["id", n] = [("minCount", None)] * (not ids) + [("maxCount", None)] * (len(ids) > 1) + [("minLength", x) for x in ids if len(x) < 2] + [("maxLength", x) for x in ids if len(x) > 4]
            kinds["part", n] = [("maxCount", None)] * (len(of(n, ":part")) > 2) + [("node", "urn:" + m) for m in of(n, ":part") if middle(m)]
        for (path, node), bad in kinds.items():
            done.update((str(d), "urn:" + node, "urn:" + path, *b) for b in bad)
        want.update(done)
    assert got == want and len(want) > 50
