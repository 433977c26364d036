from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.operators import replies

def now():
    return F.lit("2024-01-01").cast("timestamp")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, r string")


def test_arrays_whole_and_broken(spark):
    texts = ['```json\n[{"content": "a", "confidence_value": 2}, {"content": " "}, 5]\n```', '[{"content": "b", "subjects": ["x", " "]}, {"content": "c", "conf', "no json", None, '{"content": "d"}', "[]"]
    found = replies.items(table(spark, texts), "r", "k")
    assert sorted((r.k, r.ordinal, r.note) for r in found.collect() if r.ordinal is None) == [(2, None, "unreadable"), (3, None, "unreadable"), (4, None, "no array"), (5, None, None)]
    got = sorted((r.k, r.ordinal, r.content, r.confidence, r.uncertainty_nature, r.subjects) for r in replies.candidates(found, "k", now()).collect())
    assert got == [(0, 0, "a", 1.0, "EPISTEMIC", []), (1, 0, "b", 0.5, "EPISTEMIC", ["x"])]
    assert {r.note for r in found.where("k = 1").collect()} == {"truncated"}


def test_bare_numbers_that_are_none(spark):
    """NaN and infinite numbers as JSON's writers put them: the item stays, its confidence is the default."""
    text = '[{"content": "a", "confidence_value": NaN}, {"content": "b", "confidence_value": -Infinity}, {"content": "c", "confidence_value": 1e999}, {"content": "d", "confidence_value": 0.7, "extra": [NaN]}]'
    found = replies.items(table(spark, [text]), "r", "k")
    got = [(r.content, r.confidence, r.notes) for r in replies.candidates(found, "k", now()).orderBy("ordinal").collect()]
    assert got == [(c, 0.5, ["confidence_value defaulted"]) for c in "abc"] + [("d", 0.7, [])]
    entry = replies.items(table(spark, ['{"narrative_label": "x", "claims": [{"content": "a", "confidence_value": NaN}]}']), "r", "k", journal=True)
    assert [(r.kind, r.confidence) for r in replies.journal_candidates(entry, "k").orderBy("place").collect()] == [("CLAIM", 0.5), ("NARRATIVE", 0.9)]


def test_elements_of_broken_arrays():
    assert replies.elements('x[1, {"a": "b]", "c": [2, 3]}, "q, \\" r"] tail', 1) == (["1", ' {"a": "b]", "c": [2, 3]}', ' "q, \\" r"'], True)
    assert replies.elements('[{"a": "he said "no" to it"}, {"b": 1}') == (['{"a": "he said "no" to it"}', ' {"b": 1}'], False)
    for reply, n, note in (('[{"content": "a"}, {"content": "b"}', 2, "truncated"), ('[{"content": "a"}, {"content": "b", "x', 1, "truncated"), ('[{"content": "a" "b"}, {"content": "c"}, {"con', 0, "unreadable"), ('[{"con', 0, "unreadable"), ("```\n[1]\n```", 1, None), ("``` json\n[1, 2]", 2, None), ('{"a": {"b": 1}, "c', 0, "unreadable")):
        items, _, said = replies._array(reply)
        assert (len(items), said) == (n, note), reply
    broken = '{"claims": [{"content": "one"}, {"content": "he said "yes", then"}, {"content": "two"}, {"content": "three", "x": {"y": 1}}, {"con'
    assert [x["content"] for x in replies._journal(broken)[0]] == ["one", "two", "three"]


def test_what_an_item_says(spark):
    item = {
        "content": "Rates fall", "confidence_value": "NaN", "uncertainty_nature": "odd", "assertion_modality": " evaluative ", "polarity": "declined", "scope": "document_meta", "stance_kind": "endorses", "stance_target": 3,
        "stance_magnitude": 1.5, "valid_until": "2025-01-01T00:00:00Z", "validity_confidence": 0.9, "validity_basis": "until 2025", "structured_claim": {"subject": "a"},
    }
    found = replies.items(table(spark, [json.dumps([item, {"content": "x", "stance_kind": "DISPUTES", "stance_target": "no", "valid_until": "2020-01-01", "validity_confidence": 1}])]), "r", "k")
    one, two = sorted(replies.candidates(found, "k", now()).collect(), key=lambda r: r.ordinal)
    assert (one.confidence, one.uncertainty_nature, one.assertion_modality, one.stance, one.target, one.magnitude) == (0.5, "EPISTEMIC", "EVALUATIVE", "ENDORSES", 3, 1.0)
    assert one.properties == {"extraction:scope": "DOCUMENT_META", "extraction:polarity": "DECLINED", "extraction:validity_basis": "until 2025", "extraction:validity_confidence": "0.9"}
    assert one.valid_until.year == 2025 and json.loads(one.claim) == {"subject": "a"} and len(one.notes) == 4
    assert two.stance is None and two.valid_until is None and set(two.notes) == {"stance dropped", "valid_until past"} and two.properties == {}
    assert replies.candidates(found, "k", now(), scope_mode="suppress").count() == 1
    assert replies.candidates(found, "k", now(), scope_mode="passthrough").where("ordinal = 0").first().properties["extraction:scope_action"] == "observe"


def test_journals(spark):
    entry = {"narrative_label": " A day ", "claims": [{"content": "Ran", "subject_scope": "self"}, {"content": "Met Bo", "subjects": ["Bo"], "subject_scope": "SELF", "confidence_value": 0.9}, "x"]}
    broken = '{"narrative_label": "Half\\" day", "claims": [{"content": "one"}, {"content": "bad "quote""}, {"content": "two"}, {"cont'
    texts = [json.dumps(entry), broken, "nothing", '{"claims": [{"content": "no label"}]}', "[1]"]
    found = replies.items(table(spark, texts), "r", "k", journal=True)
    got = [(r.k, r.place, r.kind, r.content, r.confidence, r.subjects, r.properties) for r in replies.journal_candidates(found, "k").orderBy("k", "place").collect()]
    assert got == [
        (0, 0, "CLAIM", "Ran", 0.5, [], {"extraction:subject_scope": "SELF"}), (0, 1, "CLAIM", "Met Bo", 0.9, ["Bo"], None), (0, 2, "NARRATIVE", "A day", 0.9, [], None),
        (1, 0, "CLAIM", "one", 0.5, [], None), (1, 1, "CLAIM", "two", 0.5, [], None), (1, 2, "NARRATIVE", 'Half" day', 0.9, [], None), (3, 0, "CLAIM", "no label", 0.5, [], None),
    ]
    assert {(r.k, r.note) for r in found.collect()} == {(0, None), (1, "salvaged"), (2, "unreadable"), (3, None), (4, "no object with claims")}
    assert replies.items(table(spark, ["x"]).limit(0), "r", "k").count() == 0
