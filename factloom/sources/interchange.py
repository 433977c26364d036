"""Claim units as JSON lines: one JSON-LD object a line."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "`@type` string, sourceClaimId string, content string, confidence struct<value:double,calibrationSource:string>, status string, tags array<string>, contentPublishedAt string"


def to_unit(claim_id: Column, content: Column, value: Column, calibration: Column, status: Column, tags: Column, published: Column) -> Column:
    """A claim as JSON; missing optional fields are absent, an empty list stays."""
    unit = F.struct(
        F.lit("Claim").alias("@type"), claim_id.cast("string").alias("sourceClaimId"), content.alias("content"),
        F.struct(value.alias("value"), calibration.alias("calibrationSource")).alias("confidence"), status.alias("status"), tags.alias("tags"), published.cast("string").alias("contentPublishedAt"),
    )
    return F.to_json(unit)


def from_unit(line: Column) -> Column:
    return F.from_json(line, UNIT)


#: What an import takes at most, and old names of property keys.
MOST_BYTES, MOST_UNITS = 256 << 20, 500_000
RENAMED = {"scope": "extraction:scope", "scope_action": "extraction:scope_action", "polarity": "extraction:polarity"}
CONTRIBUTOR = ("id", "role", "at")


def check_caps(lines: DataFrame, line: str = "value", most_bytes: int = MOST_BYTES, most_units: int = MOST_UNITS) -> None:
    """Raises ValueError if the lines that aren't blank, or their bytes, are too many for one import."""
    n, size = lines.agg(F.count_if(F.trim(line) != ""), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0))).first()
    if n > most_units or size > most_bytes:
        raise ValueError(f"an import of {n} units and {size} bytes; at most {most_units} and {most_bytes}")


def read_units(spark: SparkSession, path: str, most_bytes: int | None = MOST_BYTES, most_units: int | None = MOST_UNITS) -> DataFrame:
    """line, unit (null where it can't be read) of each line that isn't blank.

    An import above the caps is refused whole; None is no cap, for one's own tables.
    """
    lines = spark.read.text(path)
    if most_bytes is not None or most_units is not None:
        check_caps(lines, "value", most_bytes or 1 << 62, most_units or 1 << 62)
    return lines.where(F.trim("value") != "").select(F.col("value").alias("line"), from_unit(F.col("value")).alias("unit"))


def read_yaml_units(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, most_units: int = MOST_UNITS) -> DataFrame:
    """path, ordinal, unit (JSON), problem of YAML files that hold a sequence of units each.

    An empty file has none; a file that is too large, isn't YAML or holds
    something else gives one row with its problem. A file is one task's: it is
    read whole, up to ``most_bytes``.
    """
    import yaml

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, size, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                units, problem = [], None
                if size > most_bytes:
                    problem = "too many bytes"
                else:
                    try:
                        units = yaml.safe_load(raw.decode("utf-8", "replace")) or []
                    except yaml.YAMLError:
                        problem = "no YAML"
                if problem is None and (not isinstance(units, list) or not all(isinstance(u, dict) for u in units)):
                    problem = "no sequence of mappings"
                elif len(units) > most_units:
                    problem = "too many units"
                out += [(p, None, None, problem)] if problem else [(p, i, json.dumps(u, ensure_ascii=False, default=str), None) for i, u in enumerate(units)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "ordinal", "unit", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    return files.mapInArrow(read, "path string, ordinal int, unit string, problem string")


def write_yaml_units(units: DataFrame, column: str, path: str) -> None:
    """JSON units as YAML, one item of a sequence each, in files of a folder: a part of the table is one file."""
    import yaml

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [yaml.safe_dump([json.loads(u)], sort_keys=False, allow_unicode=True).rstrip("\n") for u in b.column(0).to_pylist() if u]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    units.select(column).mapInArrow(text, "value string").write.text(path)


def external_ref(namespace: Column, ref_id: Column, uri: Column, confidence: Column) -> Column:
    """A reference of a subject to another catalogue; a confidence of 1 is left out."""
    return F.struct(namespace.alias("namespace"), ref_id.alias("externalId"), uri.alias("uri"), F.when(confidence != 1.0, confidence).alias("confidence"))


def subject_unit(subject_id: Column, name: Column, asserted_by: Column, refs: Column, description: Column, aliases: Column, kind: Column, context: str, version: str) -> Column:
    """A subject as JSON; what isn't known is left out, references are always there."""
    some = F.when(F.size(aliases) > 0, aliases)
    return F.to_json(F.struct(F.lit(context).alias("@context"), F.lit("Subject").alias("@type"), F.lit(version).alias("formatVersion"), subject_id.alias("sourceSubjectId"), name.alias("canonicalName"), asserted_by.alias("assertedBy"), refs.alias("externalRefs"), description.alias("description"), some.alias("aliases"), kind.alias("subjectClass")))


def with_subject_refs(claims: DataFrame, subjects: DataFrame, claim_id: str = "claim_id") -> DataFrame:
    """claim_id, subjects (an array of structs in the order of claims.subject_ids): id, name and references
    of each subject; of one that subjects(subject_id, name, refs) doesn't know only the id."""
    rows = claims.select(claim_id, F.posexplode("subject_ids").alias("at", "subject_id")).join(subjects, "subject_id", "left")
    ref = F.struct("at", F.col("subject_id").alias("sourceSubjectId"), F.col("name").alias("canonicalName"), F.col("refs").alias("externalRefs"))
    return rows.groupBy(claim_id).agg(F.transform(F.array_sort(F.collect_list(ref)), lambda r: r.dropFields("at")).alias("subjects"))


def renamed_properties(properties: Column, names: Mapping[str, str] = RENAMED) -> Column:
    """Properties (a map) under their present keys; where both are there, the present one counts."""
    old = F.map_from_arrays(F.lit(list(names)), F.lit(list(names.values())))
    kept = F.map_filter(properties, lambda k, v: ~F.map_contains_key(old, k))
    moved = F.map_filter(properties, lambda k, v: F.map_contains_key(old, k) & ~F.map_contains_key(properties, F.coalesce(F.try_element_at(old, k), F.lit(""))))
    return F.map_concat(kept, F.transform_keys(moved, lambda k, v: F.coalesce(F.try_element_at(old, k), k)))


def unknown_keys(contributor: Column, known: Sequence[str] = CONTRIBUTOR) -> Column:
    """Keys of a contributor (JSON) that aren't known, sorted: a unit with any is refused."""
    return F.array_sort(F.array_except(F.json_object_keys(contributor), F.lit(list(known)).cast("array<string>")))


def linked_data(prefix: str, kind: str, plain: Mapping[str, Column], typed: Mapping[str, tuple[Column, str]], context: str) -> Column:
    """A row as JSON-LD: every key with the prefix, numbers and times as value objects
    with their datatype; what is null is left out."""
    fields = [F.lit(context).alias("@context"), F.lit(f"{prefix}:{kind}").alias("@type"), *[c.alias(f"{prefix}:{n}") for n, c in plain.items()]]
    fields += [F.when(c.isNotNull(), F.struct(c.cast("string").alias("@value"), F.lit(t).alias("@type"))).alias(f"{prefix}:{n}") for n, (c, t) in typed.items()]
    return F.to_json(F.struct(*fields))


def write_units(units: DataFrame, column: str, path: str) -> None:
    units.select(F.col(column).alias("value")).write.text(path)
