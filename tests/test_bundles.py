"""Bundles: all fields there and back, what is refused, ranges, writes that fail."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
import pytest

from factloom.sources import bundles as b

AT = datetime(2024, 5, 6, 7, 8, 9, 123456, tzinfo=UTC)
TERM = {"kind": "URI", "value": "http://x.org/a", "datatype": None, "language": None}
FULL = {
    "schema_version": "1.0.0", "claim_id": "c1", "claim_type": "REVIEW", "assertion_modality": "EVALUATIVE", "canonical_form": "STRUCTURED", "content": "Grüße   \U0001f600 \"quoted\"\nsecond line", "confidence": 0.1 + 0.2,
    "calibration_source": "HUMAN_REVIEW", "uncertainty_nature": "ALEATORY", "asserted_by": "someone", "asserted_at": AT, "status": "SUPERSEDED",
    "provenance": [{"type": "SOURCE", "corpus_entry_id": "e1", "snapshot_id": "s1", "location": "p. 3", "chunk_hash": "abc"}, {"type": "AGENT", "corpus_entry_id": "e2", "snapshot_id": None, "location": None, "chunk_hash": None}],
    "subjects": [
        {"source_subject_id": "s-1", "canonical_name": "Thing", "external_refs": [{"namespace": "wikidata", "id": "Q1", "uri": "http://x/Q1", "confidence": 1.0}, {"namespace": "n", "id": "2", "uri": None, "confidence": 0.5}], "aliases": ["T", ""], "subject_class": "CONCEPT"},
        {"source_subject_id": "s-2", "canonical_name": None, "external_refs": [], "aliases": [], "subject_class": None},
    ],
    "variance": 0.0, "calibration_method": "temperature", "calibration_ref": "r1", "status_reason": "DUPLICATE_MERGED", "uncertainty_kind": "k", "valid_until": AT, "supersedes": "c0", "basis": '{"premises": ["a", 1.5, null]}',
    "extractor": {"name": "x", "version": "1.2.3"}, "extraction_model": "m", "sequence_context": ["before", "after"], "tags": [], "context_fingerprint": "f", "properties": {"a": '"text"', "b": "[1, {\"c\": null}]", "d": "false"},
    "contributors": [{"id": "p:1", "role": "author", "at": AT}],
    "structured_claim": {"subject": TERM, "predicate": {**TERM, "kind": "TOKEN"}, "object": {"kind": "LITERAL", "value": "1", "datatype": "xsd:int", "language": None}, "structurizer_id": "z", "structurizer_version": "2", "generated_at": AT},
}
LEAST = {"content": "", "confidence": 1.0, "calibration_source": "DERIVED", "uncertainty_nature": "EPISTEMIC", "asserted_by": "a", "asserted_at": AT, "status": "ACTIVE"}
UNIT = {"@context": "x", "@type": "Claim", "formatVersion": "1.0", "content": "c", "confidenceValue": 1, "calibrationSource": "DERIVED", "uncertaintyNature": "EPISTEMIC", "assertedBy": "a", "assertedAt": "2024-01-01T02:00:00+02:00", "status": "ACTIVE"}


@pytest.fixture
def folder(spark, tmp_path):
    b.register(spark)
    return str(tmp_path / "bundle")


def load(spark, path, **options):
    return spark.read.format("claimbundle").options(path=path, **options).load()


def save(df, path, mode="append", **options):
    df.write.format("claimbundle").options(path=path, **options).mode(mode).save()


def lines(tmp_path, units):
    (tmp_path / "m").mkdir(exist_ok=True)
    path = tmp_path / "m" / f"{uuid.uuid4().hex}.jsonl"
    path.write_text("\n\n".join(json.dumps(u, ensure_ascii=False) if isinstance(u, dict) else u for u in units))
    return str(path)


def plain(row):
    d = row.asDict(recursive=True)
    return {k: v.replace(tzinfo=UTC) if isinstance(v, datetime) and not v.tzinfo else v for k, v in d.items()}


@pytest.mark.parametrize("container", ["jsonl", "yaml"])
def test_every_field_comes_back(spark, folder, container):
    rows = spark.createDataFrame([FULL, {**dict.fromkeys(FULL), **LEAST}], b.struct_of(b.CLAIM))
    save(rows, folder, container=container)
    back = load(spark, folder, container=container)
    assert back.schema == rows.schema
    full, least = sorted(back.collect(), key=lambda r: r.content, reverse=True)
    assert full == rows.where("claim_id = 'c1'").first()
    assert (least.claim_type, least.canonical_form, least.assertion_modality, least.schema_version, least.provenance, least.subjects, least.tags) == ("CLAIM", "PROSE", "FALSIFIABLE", "1.0.0", [], [], None)
    assert b.encoded(FULL, b.CLAIM)["subjects"][0]["externalRefs"][0] == {"namespace": "wikidata", "externalId": "Q1", "uri": "http://x/Q1"}


def test_subjects_and_nouns(spark, folder, tmp_path):
    rows = spark.createDataFrame([("s", "Name", "me", [("n", "1", None, 0.5)], "text", ["a"], "CONCEPT"), (None, "Other", None, None, None, None, None)], b.struct_of(b.SUBJECT))
    save(rows, folder, kind="subjects")
    assert {r.canonical_name: r.asserted_by for r in load(spark, folder, kind="subjects").collect()} == {"Name": "me", "Other": "interchange-import"}
    path = lines(tmp_path, [{**UNIT, "@type": "Fact", "sourceFactId": "7"}])
    assert load(spark, path, noun="Fact").first().claim_id == "7"


@pytest.mark.parametrize(
    ("unit", "why"),
    [
        ({**UNIT, "surprise": 1}, "surprise: unknown key"), ({**UNIT, "@type": "Subject"}, "@type"), ({k: v for k, v in UNIT.items() if k != "content"}, "content: missing"), ({**UNIT, "confidenceValue": 1.5}, "not from 0.0 to 1.0"),
        ({**UNIT, "confidenceValue": True}, "no finite number"), ({**UNIT, "status": "GONE"}, "'GONE' is none of"), ({**UNIT, "assertedAt": "soon"}, "no time"), ({**UNIT, "contributors": [{"id": "a", "role": "b", "at": "2024-01-01", "x": 1}]}, "contributors[].x"),
        ({**UNIT, "provenance": {}}, "no list"), ({**UNIT, "tags": [1]}, "no list of strings"), ({**UNIT, "extractorRef": {"extractorName": "x"}}, "extractorRef.extractorVersion: missing"), ("[1]", "no object"), ("{", "Expecting"),
        (json.dumps(UNIT).replace(": 1,", ": NaN,"), "NaN"), ({**UNIT, "properties": [1]}, "properties: no object"), ({**UNIT, "content": 5}, "no string"),
    ],
)
def test_what_is_refused(spark, folder, tmp_path, unit, why):
    path = lines(tmp_path, [UNIT, unit, UNIT])
    rows = load(spark, path, mode="permissive").collect()
    assert [r.problem is None for r in rows] == [True, False, True]
    assert why in rows[1].problem and rows[1].content is None


def test_failfast_and_lenient(spark, folder, tmp_path):
    path = lines(tmp_path, [UNIT, {**UNIT, "surprise": 1}])
    with pytest.raises(Exception, match="surprise: unknown key"):
        load(spark, path).collect()
    assert load(spark, path, strict="false").count() == 2


def test_old_keys_of_properties_and_times_without_a_zone(spark, folder, tmp_path):
    path = lines(tmp_path, [{**UNIT, "properties": {"polarity": "DECLINED", "scope": "old", "extraction:scope": "new"}, "assertedAt": "2024-01-01T00:00:00"}, UNIT])
    first, second = load(spark, path).collect()
    assert first.properties == {"extraction:polarity": '"DECLINED"', "extraction:scope": '"new"'}
    assert first.asserted_at == second.asserted_at


def test_bounds_of_members(spark, folder, tmp_path):
    rows = spark.range(25).selectExpr("CAST(id AS string) AS content", "1.0D AS confidence", "'DERIVED' AS calibration_source", "'EPISTEMIC' AS uncertainty_nature", "'a' AS asserted_by", "timestamp'2024-01-01' AS asserted_at", "'ACTIVE' AS status").coalesce(1)
    save(rows, folder, mostunits="10")
    listed = json.loads((Path(folder) / b.MANIFEST).read_text())
    assert sorted(m["units"] for m in listed["members"]) == [5, 10, 10] and listed["units"] == 25
    for m in listed["members"]:
        raw = (Path(folder) / m["name"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (m["bytes"], m["sha256"])
    assert load(spark, folder, mostunits="10").count() == 25
    with pytest.raises(Exception, match="more than 9 units"):
        load(spark, folder, mostunits="9").count()
    with pytest.raises(Exception, match="at most 100"):
        load(spark, folder, mostbytes="100").count()


@pytest.mark.parametrize("split", [1, 7, 100, 1000])
def test_ranges_give_each_line_once(spark, folder, tmp_path, split):
    units = [{**UNIT, "content": "é" * (i * 37 % 50), "sourceClaimId": str(i)} for i in range(12)]
    raw = b"\n\n" + b"\r\n".join(json.dumps(u, ensure_ascii=False).encode() for u in units) + b"\n   \n"
    path = tmp_path / "x.jsonl"
    path.write_bytes(raw)
    system, _ = b._opened(str(path))
    ranges = [b._Range(str(path), a, min(a + split, len(raw)), False) for a in range(0, len(raw), split)]
    got = [json.loads(line)["sourceClaimId"] for r in ranges for _, line in b._lines(system, r, 11)]
    assert got == [str(i) for i in range(12)]
    if split > 90:
        assert sorted(int(r.claim_id) for r in load(spark, str(path), mostunits="none", split=str(split)).collect()) == list(range(12))


def test_writes_that_fail_leave_nothing_behind(spark, folder):
    good = spark.createDataFrame([LEAST], b.struct_of(b.CLAIM).fromDDL("content string, confidence double, calibration_source string, uncertainty_nature string, asserted_by string, asserted_at timestamp, status string"))
    save(good, folder)
    (Path(folder) / f"{uuid.uuid4().hex}.jsonl").write_text("left by a lost task")
    with pytest.raises(Exception, match="not from 0.0 to 1.0"):
        save(good.unionByName(good.selectExpr("content", "2.0D AS confidence", "calibration_source", "uncertainty_nature", "asserted_by", "asserted_at", "status")), folder)
    assert load(spark, folder).count() == 1
    assert not list(Path(folder).glob("_staged-*"))
    save(good, folder)
    assert load(spark, folder).count() == 2
    save(good, folder, "overwrite")
    assert load(spark, folder).count() == 1
    with pytest.raises(Exception, match="no place in a unit for column other"):
        save(good.selectExpr("*", "1 AS other"), folder)
    with pytest.raises(Exception, match="column status is missing"):
        save(good.drop("status"), folder)


def test_nothing(spark, folder):
    none = spark.createDataFrame([], b.struct_of(b.CLAIM))
    save(none, folder)
    assert load(spark, folder).count() == 0


def test_values_by_columns():
    """Nested values with nulls, whole and in slices, are what Arrow's own scalars say."""
    at = datetime(1960, 2, 3, 4, 5, 6, 7, tzinfo=UTC)
    one = pa.struct([("a", pa.string()), ("at", pa.timestamp("us", "UTC")), ("many", pa.list_(pa.struct([("x", pa.float64())])))])
    rows = [
        {"s": "ü", "n": 1.5, "t": at.replace(tzinfo=None), "o": {"a": None, "at": at, "many": [{"x": 1.0}, None, {"x": None}]}, "m": [("k", "1"), ("l", None)], "l": ["a", None], "e": None, "i": 3},
        {"s": None, "n": None, "t": None, "o": None, "m": None, "l": None, "e": None, "i": None},
        {"s": "", "n": 0.0, "t": None, "o": {"a": "b", "at": None, "many": []}, "m": [], "l": [], "e": None, "i": 4},
    ]
    schema = pa.schema([("s", pa.string()), ("n", pa.float64()), ("t", pa.timestamp("us")), ("o", one), ("m", pa.map_(pa.string(), pa.string())), ("l", pa.list_(pa.string())), ("e", pa.string()), ("i", pa.int64())])
    batch = pa.RecordBatch.from_pylist(rows * 3, schema=schema)
    for some in (batch, batch.slice(1, 5), batch.slice(2, 1), batch.slice(0, 0)):
        assert list(b._rows_of(some)) == some.to_pylist()
    assert b._named(b.CLAIM, "Claim")[0] is b._named(b.CLAIM, "Claim")[0]
