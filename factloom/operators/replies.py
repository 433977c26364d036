"""Replies of models as candidate claims, and candidates as claims.

A reply is a JSON array of claims, or for a journal an object with claims and a
label. Only reading broken JSON needs Python; what the items say is judged in SQL.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import claims as c
from factloom.functions import structure as st
from factloom.functions.confidence import calibrated, clamp01
from factloom.operators.shared import bounded_batches

#: What a claim can be.
MODALITIES, NATURES, NON_ASSERTED, STANCES = ("FALSIFIABLE", "EVALUATIVE", "EXPERIENTIAL", "CONSTITUTIVE"), ("EPISTEMIC", "ALEATORY"), ("DECLINED", "HYPOTHETICAL"), ("ENDORSES", "DISPUTES")
#: Confidence of a journal's label, and from which an end of validity counts.
NARRATIVE_CONFIDENCE, VALIDITY_FLOOR = 0.9, 0.75

_FENCED = re.compile(r"\A\s*```[^\n]*\n(.*?)(?:\n[ \t]*```)?\s*\Z", re.DOTALL)
_CLAIMS, _LABEL = re.compile(r'"claims"\s*:\s*(?=\[)'), re.compile(r'"narrative_label"\s*:\s*("(?:[^"\\]|\\.)*")')
_MARKS, _AFTER_TEXT, _BETWEEN = re.compile(r'\\.|["{}\[\],]', re.DOTALL), re.compile(r"\s*(?:[,:}\]]|\Z)"), re.compile(r"(?<=\})\s*,\s*(?=\{)")


def _bare(reply: str) -> str:
    """The reply without the code fence around it."""
    fenced = _FENCED.match(reply)
    return (fenced[1] if fenced else reply).strip()


def _number(digits: str) -> float | str:
    """A number, or its digits where it has no finite value."""
    value = float(digits)
    return value if math.isfinite(value) else digits


def _loads(text: str) -> Any:
    """JSON, in which NaN and infinite numbers are their names: they go on as JSON and are judged later."""
    return json.loads(text, parse_constant=str, parse_float=_number)


def elements(text: str, at: int = 0) -> tuple[list[str], bool]:
    """(texts between the commas of the array that opens at a place, whether it
    is closed). A quotation mark closes a string only before a mark of JSON, so
    that one inside a sentence stays part of it."""
    out, start, depth, quoted = [], at + 1, 0, False
    for m in _MARKS.finditer(text, at + 1):
        mark = m[0]
        if quoted:
            quoted = mark != '"' or not _AFTER_TEXT.match(text, m.end())
        elif mark == '"':
            quoted = True
        elif mark in "{[":
            depth += 1
        elif mark in "}]" and depth:
            depth -= 1
        elif mark == "]" or mark == "," and not depth:
            out.append(text[start : m.start()])
            start = m.end()
            if mark == "]":
                return out, True
    return [*out, text[start:]], False


def _read(texts: list[str]) -> tuple[list[Any], list[str]]:
    """(values, texts that are none)."""
    values, rest = [], []
    for x in texts:
        try:
            values.append(_loads(x))
        except json.JSONDecodeError:
            rest.append(x)
    return values, rest


def _array(reply: str) -> tuple[list[Any], str, str | None]:
    """(items, label, note) of an array; one that breaks off keeps its whole items."""
    text = _bare(reply)
    try:
        found = _loads(text)
    except json.JSONDecodeError:
        parts, closed = elements(text) if text.startswith("[") else ([], True)
        whole, rest = _read(parts[:-1])
        if closed or rest:
            return [], "", "unreadable"
        whole += [x for x in _read(parts[-1:])[0] if isinstance(x, dict)]
        return (whole, "", "truncated") if whole else ([], "", "unreadable")
    return (found, "", None) if isinstance(found, list) else ([], "", "no array")


def _journal(reply: str) -> tuple[list[Any], str, str | None]:
    """(claims, label, note) of a journal's entry; a broken one keeps every claim that can be read."""
    text = _bare(reply)
    try:
        entry = _loads(text)
    except json.JSONDecodeError:
        start, label = _CLAIMS.search(text), _LABEL.search(text)
        found = []
        for part in elements(text, start.end())[0] if start else []:
            read, broken = _read([part])
            found += read or [x for b in broken for x in _read(_BETWEEN.split(b))[0]]
        found = [x for x in found if isinstance(x, dict) and str(x.get("content", "")).strip()]
        return found, str(json.loads(label[1], strict=False)).strip() if label else "", "salvaged" if found else "unreadable"
    if not isinstance(entry, dict) or not isinstance(entry.get("claims", []), list):
        return [], "", "no object with claims"
    return entry.get("claims", []), str(entry.get("narrative_label", "")).strip(), None


def items(replies: DataFrame, reply: str, key: str, journal: bool = False) -> DataFrame:
    """key, ordinal, item (JSON), label, note of every item of every reply; ordinal and
    item are null for a reply without any. note: truncated, salvaged, unreadable, no array."""
    read = _journal if journal else _array

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some, label, note = read(text or "")
                out += [(k, i, json.dumps(x), label, note) for i, x in enumerate(some)] or [(k, None, None, label, note)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [b.schema.types[0], pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[key, "ordinal", "item", "label", "note"])

    bounded_batches(replies.sparkSession)
    rows = replies.select(key, reply)
    more = [T.StructField("ordinal", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("item", "label", "note")]]
    return rows.mapInArrow(found, T.StructType([rows.schema[key], *more]))


def _finite(number: Column) -> Column:
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))


def candidates(found: DataFrame, key: str, now: Column, scope_mode: str = "label", floor: float = VALIDITY_FLOOR) -> DataFrame:
    """key, ordinal, content, confidence, uncertainty_nature, subjects,
    assertion_modality, stance, target, magnitude, valid_until, properties (a
    map), claim (JSON of the triple) and notes of items().

    Items that are no objects or have no content are left out. What can't be read
    gets its default and a note. scope_mode: what happens to claims about their
    own document: suppress, label or passthrough.
    """
    said = lambda name: F.get_json_object("item", f"$.{name}")
    word = lambda name: F.upper(F.trim(said(name)))
    number = said("confidence_value").try_cast("double")
    finite = _finite(number)
    given = said("confidence_value").isNotNull()
    nature, modality, polarity = said("uncertainty_nature"), word("assertion_modality"), word("polarity")
    meta = F.coalesce(word("scope") == "DOCUMENT_META", F.lit(False))
    subjects = F.filter(F.coalesce(F.from_json(said("subjects"), "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    stance, target = word("stance_kind"), said("stance_target")
    held = stance.isin(*STANCES) & target.rlike(r"^-?\d+$")
    until = c.valid_until(said("valid_until"), said("validity_confidence").try_cast("double"), floor, now)
    declined = F.coalesce(polarity.isin(*NON_ASSERTED), F.lit(False))
    entries = [
        (meta, st.SCOPE, F.lit("DOCUMENT_META")), (meta & F.lit(scope_mode == "passthrough"), st.SCOPE_ACTION, F.lit("observe")), (declined, st.POLARITY, polarity),
        (until["until"].isNotNull() & said("validity_basis").isNotNull(), "extraction:validity_basis", said("validity_basis")), (until["until"].isNotNull(), "extraction:validity_confidence", said("validity_confidence")),
    ]
    properties = F.map_from_entries(F.filter(F.array(*[F.when(when, F.struct(F.lit(k).alias("key"), v.alias("value"))) for when, k, v in entries]), lambda e: e.isNotNull()))
    notes = F.array_compact(F.array(
        F.when(given & ~F.coalesce(finite, F.lit(False)), "confidence_value defaulted"), F.when(nature.isNotNull() & ~nature.isin(*NATURES), "uncertainty_nature defaulted"),
        F.when(modality.isNotNull() & ~modality.isin(*MODALITIES), "assertion_modality defaulted"), F.when(polarity.isNotNull() & ~polarity.isin("ASSERTED", *NON_ASSERTED), "polarity defaulted"),
        F.when(meta, F.lit(f"document meta: {scope_mode}")), F.when(declined, F.concat(F.lit("not asserted: "), polarity)), F.when(stance.isin(*STANCES) & ~F.coalesce(target.rlike(r"^-?\d+$"), F.lit(False)), "stance dropped"),
        F.when(until["note"].isNotNull(), F.concat(F.lit("valid_until "), until["note"])),
    ))
    rows = found.where(F.col("item").startswith("{") & (F.trim(F.coalesce(said("content"), F.lit(""))) != ""))
    if scope_mode == "suppress":
        rows = rows.where(~meta)
    return rows.select(
        key, "ordinal", F.trim(said("content")).alias("content"), F.when(finite, clamp01(number)).otherwise(0.5).alias("confidence"), F.when(nature.isin(*NATURES), nature).otherwise("EPISTEMIC").alias("uncertainty_nature"), subjects.alias("subjects"),
        F.when(modality.isin(*MODALITIES), modality).otherwise("FALSIFIABLE").alias("assertion_modality"), F.when(held, stance).alias("stance"), F.when(held, target.try_cast("int")).alias("target"), F.when(held, clamp01(said("stance_magnitude").try_cast("double"))).alias("magnitude"),
        until["until"].alias("valid_until"), properties.alias("properties"), said("structured_claim").alias("claim"), notes.alias("notes"),
    )


def journal_candidates(found: DataFrame, key: str) -> DataFrame:
    """key, kind, place, content, confidence, assertion_modality, subjects, properties of items(journal=True).

    The claims in order, then one NARRATIVE for an entry with a label and claims.
    A claim without subjects that says SELF is marked as one of its author.
    """
    said = lambda name: F.get_json_object("item", f"$.{name}")
    subjects = F.filter(F.coalesce(F.from_json(said("subjects"), "array<string>"), F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    modality, content, level = F.upper(F.trim(said("assertion_modality"))), F.trim(F.coalesce(said("content"), F.lit(""))), said("confidence_value").try_cast("double")
    rows = found.where(F.col("item").startswith("{") & (content != "")).select(
        key, "ordinal", "label", content.alias("content"), F.when(_finite(level), clamp01(level)).otherwise(0.5).alias("confidence"),
        F.when(modality.isin(*MODALITIES), modality).otherwise("FALSIFIABLE").alias("assertion_modality"), subjects.alias("subjects"), st.self_scope(said("subject_scope"), subjects).alias("properties"),
    )
    entry = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.lit("CLAIM").alias("kind"), "content", "confidence", "assertion_modality", "subjects", F.map_entries("properties").alias("p")))).alias("rows"), F.first("label").alias("label"), F.count("*").alias("n"))
    none = F.lit(None).cast("array<struct<key:string,value:string>>")
    last = F.struct(F.col("n").cast("int").alias("ordinal"), F.lit("NARRATIVE").alias("kind"), F.col("label").alias("content"), F.lit(NARRATIVE_CONFIDENCE).alias("confidence"), F.lit("FALSIFIABLE").alias("assertion_modality"), F.array().cast("array<string>").alias("subjects"), none.alias("p"))
    both = F.when(F.col("label") != "", F.concat("rows", F.array(last))).otherwise(F.col("rows"))
    return entry.select(key, F.posexplode(both).alias("place", "r")).select(key, "r.kind", "place", "r.content", "r.confidence", "r.assertion_modality", "r.subjects", F.map_from_entries("r.p").alias("properties"))


def as_claims(rows: DataFrame, fits: DataFrame, extractor: str, version: str) -> DataFrame:
    """Candidates as claims: content, confidence struct(value, source, method),
    provenance, canonical_form, claim, subject_id and the columns that stay.

    rows(entry_id, snapshot_id, chunk_hash, content, confidence, subjects,
    subject_ids, claim (struct or null), canonical_form, model, ...), fits(model,
    transform, temperature): the fit of the model a candidate came from, if it
    is one of the logit. A structured candidate without a triple is prose.
    """
    rows = rows.join(fits.select("model", "transform", "temperature"), "model", "left")
    raw = F.col("confidence")
    value = st.claim_confidence(raw, F.col("temperature"), F.col("transform"), calibrated(raw, F.col("temperature")))
    form = F.when((F.col("canonical_form") == "STRUCTURED") & F.col("claim").isNull(), "PROSE").otherwise(F.coalesce("canonical_form", F.lit("PROSE")))
    bound = F.when(F.col("claim").isNotNull(), st.bound_subject(F.col("claim.subject"), F.col("subjects"), F.col("subject_ids")))
    provenance = F.array(F.struct(F.lit("SOURCE").alias("type"), "entry_id", "snapshot_id", "chunk_hash"))
    ref = F.struct(F.lit(extractor).alias("name"), F.lit(version).alias("version"))
    return rows.withColumns({"confidence": value, "canonical_form": form, "subject_id": bound, "provenance": provenance, "extractor": ref}).drop("transform", "temperature", "entry_id", "snapshot_id", "chunk_hash")
