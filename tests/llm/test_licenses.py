"""Every rule is reached: alone, and through the gate of a scan."""

from __future__ import annotations

import random
import re
from re import _constants as sre
from re import _parser

from factloom.llm import licenses


def example(pattern: str, rng: random.Random) -> str:
    """A text that the pattern matches, its choices drawn at random."""

    def some(items) -> str:
        return "".join(one(*x) for x in items)

    def one(op, arg) -> str:
        if op is sre.LITERAL:
            return chr(arg)
        if op is sre.ANY:
            return rng.choice("ax ")
        if op is sre.IN:
            return one(*rng.choice(arg))
        if op is sre.RANGE:
            return chr(rng.randint(*arg))
        if op is sre.CATEGORY:
            assert arg is sre.CATEGORY_SPACE
            return rng.choice(" \t\n")
        if op is sre.SUBPATTERN:
            return some(arg[-1])
        if op is sre.BRANCH:
            return some(rng.choice(arg[1]))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, items = arg
            return "".join(some(items) for _ in range(rng.randint(low, min(high, low + 3))))
        assert op is sre.ASSERT_NOT, op
        return ""

    return some(_parser.parse(pattern))


def cases():
    rng = random.Random(5)
    return [(rule, example(rule.pattern.pattern, rng)) for rule in licenses.rules() for _ in range(12)]



def test_each_rule_alone():
    for rule, text in cases():
        assert rule.keyword and rule.keyword in text and rule.pattern.search(text), (rule, text)
        assert (rule.label, 0, len(text)) in {x[:3] for x in licenses.detect(text, [rule])}, (rule, text)


def test_each_rule_through_scan(spark):
    texts = [t for _, t in cases()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(d) for d in r.detections] for r in licenses.scan(df).collect()}
    for i, (rule, text) in enumerate(cases()):
        assert any(s == 0 and e == len(text) and p >= rule.priority for _, s, e, p, _ in got[i]), (rule, text, got[i])
    every = licenses.rules()
    open_ = [r._replace(keyword="") for r in every]
    assert all(got[i] == licenses.detect(t, open_) for i, t in enumerate(texts))


def test_texts_that_hold_no_other_gate(spark):
    texts = ["attribution-noncommercial", "attribution sharealike", "attribution-noderivs", "mit no attribution", "developed by the openssl project", "postgresql global development group", "released under\nthe BSD", "apache software foundation (asf) under one or more contributor"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {d.label for d in r.detections} for r in licenses.scan(df).collect()}
    want = ["cc-by-nc", "cc-by-sa", "cc-by-nd", "mit-0", "openssl", "postgresql", "bsd", "apache-2"]
    assert all(w in got[i] for i, w in enumerate(want)), got


def test_gate_words_are_plain_text():
    assert not any(re.search(r"\\|\0", r.keyword) for r in licenses.rules())


def test_most_rules_are_written_by_hand():
    hand = {t for _, _, texts in licenses.LICENSES for t in texts} | {t for texts in licenses.TEXTS.values() for t in texts}
    assert len(hand) >= 220 and len({r.pattern.pattern for r in licenses.rules()}) == len(licenses.rules())


def test_a_notice_over_several_lines(spark):
    notice = "Permission is hereby\ngranted, free of charge,\tto any person\robtaining a copy"
    df = spark.createDataFrame([(1, notice), (2, "licensed under\n\nthe Apache License,\nVersion 2.0")], "doc_id long, text string")
    got = {r.doc_id: {d.label for d in r.detections} for r in licenses.scan(df).collect()}
    assert got == {1: {"mit"}, 2: {"apache-2"}}
