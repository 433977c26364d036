"""Bundles of claims or subjects as a Spark data source.

    register(spark)
    claims.write.format("claimbundle").option("path", folder).mode("append").save()
    spark.read.format("claimbundle").option("path", folder).load()

A bundle is a folder of members: JSON lines (one unit a line) or YAML (one
sequence of units). All that a unit holds has a column; ``CLAIM`` and
``SUBJECT`` say which. Options:

path        the folder, or one member; a local path or an address that pyarrow opens
kind        claims (default) or subjects
container   jsonl (default) or yaml
noun        what a claim is called in units: their @type, and source<noun>Id (default Claim)
context     address of the JSON-LD context that written units name
mode        failfast (default): the first unit that can't be read ends the job;
            permissive: it is a row whose columns are null and whose ``problem`` says why
strict      true (default): keys that no column has are refused; false: at the top of a unit they are passed over
mostbytes   of a member (default 256 MiB); none: no bound
mostunits   of a member (default 500,000); none: no bound
split       bytes of a task's range, where a member may be divided (default 32 MiB)

A member above its bounds is refused before any of its units is given out; what
is written keeps them, since a task goes on to its next member. A JSON-lines
member without a bound on units is read in ranges by many tasks; a line belongs
to the range in which it starts. With the bound, a member is counted by one
task, which the bound on bytes keeps small.

A write is staged in a folder of its own. The driver moves the members that
successful tasks report, then writes ``_bundle.json``, which lists them with
their units, bytes and SHA-256; readers go by it. Members of lost or repeated
tasks are never listed. Overwriting lists the new members only, then deletes
those that the old list had.

Times are instants in UTC; a time without a zone is one. Values of properties
are JSON text, so that any of them comes back as it was. Lists of a subject
that are absent are empty.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from factloom.sources.interchange import MOST_BYTES, MOST_UNITS, RENAMED


@dataclass(frozen=True)
class Item:
    """A column and its key in a unit.

    kind: string, double, time, strings, json (any value as its text), texts (a
    map to JSON text), one (a struct) or many (an array of structs).
    """

    column: str
    key: str
    kind: str = "string"
    needed: bool = False
    default: object = None
    quiet: bool = False  # left out where it is the default
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    items: tuple[Item, ...] = ()


# Keys and vocabularies of units.
FORMAT_VERSION = "1.0"
_REFS = (Item("namespace", "namespace", needed=True), Item("id", "externalId", needed=True), Item("uri", "uri"), Item("confidence", "confidence", "double", default=1.0, quiet=True, low=0.0, high=1.0))
_TERM = (Item("kind", "termKind", needed=True, values=("URI", "TOKEN", "LITERAL")), Item("value", "termValue", needed=True), Item("datatype", "datatype"), Item("language", "language"))
_PROVENANCE = (
    Item("type", "refType", needed=True, values=("SOURCE", "PARTICLE", "AGENT")), Item("corpus_entry_id", "corpusEntryId", needed=True), Item("snapshot_id", "snapshotId"), Item("location", "location"), Item("chunk_hash", "chunkHash"),
)
_SUBJECT_REF = (
    Item("source_subject_id", "sourceSubjectId"), Item("canonical_name", "canonicalName"), Item("external_refs", "externalRefs", "many", default=(), items=_REFS),
    Item("aliases", "aliases", "strings", default=(), quiet=True), Item("subject_class", "subjectClass"),
)
_STRUCTURED = (
    Item("subject", "subject", "one", True, items=_TERM), Item("predicate", "predicate", "one", True, items=_TERM), Item("object", "object", "one", True, items=_TERM),
    Item("structurizer_id", "structurizerId", needed=True), Item("structurizer_version", "structurizerVersion", needed=True), Item("generated_at", "generatedAt", "time", True),
)
CLAIM = (
    Item("schema_version", "schemaVersion", default="1.0.0"), Item("claim_id", "source{noun}Id"),
    Item("claim_type", "particleType", default="CLAIM", values=("CLAIM", "REVIEW", "NARRATIVE", "ACTION", "ANNOTATION")),
    Item("assertion_modality", "assertionModality", default="FALSIFIABLE", values=("FALSIFIABLE", "EVALUATIVE", "EXPERIENTIAL", "CONSTITUTIVE")),
    Item("canonical_form", "canonicalForm", default="PROSE", values=("PROSE", "STRUCTURED")), Item("content", "content", needed=True), Item("confidence", "confidenceValue", "double", True, low=0.0, high=1.0),
    Item("calibration_source", "calibrationSource", needed=True, values=("EXTRACTOR_DIRECT", "AGENT_ASSERTED", "CALIBRATED_BENCHMARK", "HUMAN_REVIEW", "DERIVED")),
    Item("uncertainty_nature", "uncertaintyNature", needed=True, values=("ALEATORY", "EPISTEMIC")), Item("asserted_by", "assertedBy", needed=True), Item("asserted_at", "assertedAt", "time", True),
    Item("status", "status", needed=True, values=("ACTIVE", "SUPERSEDED", "RETRACTED", "PROVENANCE_STALE", "INCONSISTENCY")),
    Item("provenance", "provenance", "many", default=(), items=_PROVENANCE), Item("subjects", "subjects", "many", default=(), items=_SUBJECT_REF),
    Item("variance", "variance", "double"), Item("calibration_method", "calibrationMethod"), Item("calibration_ref", "calibrationRef"),
    Item("status_reason", "statusReason", values=(
        "RETRACTED_DEPENDENCY", "CORPUS_ENTRY_MISSING", "TRUST_DEMOTED", "LOWER_TRUST_SOURCE", "SUPERSEDED_BY_REINDEX", "VALIDITY_EXPIRED", "CONFLICT_RESOLVED", "CONFLICT_PENDING", "EXPLICIT_RETRACTION", "SOURCE_RETRACTED", "EXPLICIT_SUPERSESSION", "DOCUMENT_SUPERSEDED", "DUPLICATE_MERGED")),
    Item("uncertainty_kind", "uncertaintyKind"), Item("valid_until", "validUntil", "time"), Item("supersedes", "supersedes"), Item("basis", "basis", "json"),
    Item("extractor", "extractorRef", "one", items=(Item("name", "extractorName", needed=True), Item("version", "extractorVersion", needed=True))), Item("extraction_model", "extractionProviderModel"),
    Item("sequence_context", "sequenceContext", "strings"), Item("tags", "tags", "strings"), Item("context_fingerprint", "contextFingerprint"), Item("properties", "properties", "texts"),
    Item("contributors", "contributors", "many", items=(Item("id", "id", needed=True), Item("role", "role", needed=True), Item("at", "at", "time", True))), Item("structured_claim", "structuredClaim", "one", items=_STRUCTURED),
)
SUBJECT = (
    Item("subject_id", "sourceSubjectId"), Item("canonical_name", "canonicalName", needed=True), Item("asserted_by", "assertedBy", default="interchange-import"), Item("external_refs", "externalRefs", "many", default=(), items=_REFS),
    Item("description", "description"), Item("aliases", "aliases", "strings", default=(), quiet=True), Item("subject_class", "subjectClass"),
)
CONTEXT = "context.jsonld"
SPLIT = 32 << 20
MANIFEST = "_bundle.json"
_BATCH_UNITS, _BATCH_BYTES = 1000, 4 << 20
_PLAIN = {"string": T.StringType(), "double": T.DoubleType(), "time": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "json": T.StringType(), "texts": T.MapType(T.StringType(), T.StringType())}


class Refused(ValueError):
    """A unit, or a member, that isn't taken; the text says where and why."""


def struct_of(items: tuple[Item, ...]) -> T.StructType:
    """The columns of units."""

    def of(i: Item) -> T.DataType:
        if i.kind in _PLAIN:
            return _PLAIN[i.kind]
        return struct_of(i.items) if i.kind == "one" else T.ArrayType(struct_of(i.items))

    return T.StructType([T.StructField(i.column, of(i)) for i in items])


_MADE: dict[tuple, tuple] = {}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _named(items: tuple[Item, ...], noun: str, known: tuple[str, ...] = ()) -> tuple[dict[str, Item], frozenset[str]]:
    """(items by their keys, all keys that a unit may have). Every unit and every part of one asks for
    them: they are made once, and found by identity, since items are slow to hash."""
    found = _MADE.get((id(items), noun, known))
    if found is None or found[0] is not items:
        by = {i.key.format(noun=noun): i for i in items}
        found = _MADE[id(items), noun, known] = (items, by, frozenset(by) | frozenset(known))
    return found[1], found[2]


def values(a: pa.Array) -> list:
    """What to_pylist() gives, by columns: it makes a scalar of every value, which took longer than to code them."""
    kind = a.type
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, x, strict=True)) for x in zip(*(values(c) for c in a.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        at, inner = a.offsets.to_numpy(), values(a.values)
        out = [inner[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    elif pa.types.is_map(kind):
        at, inner = a.offsets.to_numpy(), list(zip(values(a.keys), values(a.items), strict=True))
        out = [inner[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    elif pa.types.is_string(kind):
        return a.to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_timestamp(kind):
        return [None if x is None else (_EPOCH if kind.tz else _EPOCH.replace(tzinfo=None)) + timedelta(microseconds=x) for x in a.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()).to_pylist()]
    elif pa.types.is_floating(kind) and not a.null_count:
        return a.to_numpy().tolist()
    else:
        return a.to_pylist()
    if a.null_count:
        out = [x if there else None for x, there in zip(out, a.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return out


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    return (dict(zip(names, x, strict=True)) for x in zip(*map(values, batch.columns), strict=True))


def _checked(i: Item, value: object, at: str) -> None:
    """Raises if a plain value isn't one that the item allows."""
    if i.values and value not in i.values:
        raise Refused(f"{at}: {value!r} is none of {', '.join(i.values)}")
    if i.kind == "double":
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise Refused(f"{at}: no finite number")
        if i.low is not None and not i.low <= value <= i.high:
            raise Refused(f"{at}: {value} is not from {i.low} to {i.high}")
    if i.kind == "string" and not isinstance(value, str):
        raise Refused(f"{at}: no string")
    if i.kind == "strings" and not (isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)):
        raise Refused(f"{at}: no list of strings")


def encoded(row: dict, items: tuple[Item, ...], noun: str = "Claim", at: str = "") -> dict:
    """A row as what JSON says of it; what is null is left out."""
    out = {}
    for key, i in _named(items, noun)[0].items():
        value = row.get(i.column)
        if value is None:
            value = i.default
            if value is None and not i.needed:
                continue
        if value.__class__ is str and i.kind == "string" and not i.quiet and (not i.values or value in i.values):
            out[key] = value
            continue
        place = f"{at}{i.column}"
        if value is None:
            raise Refused(f"{place}: missing")
        if i.quiet and (not value if i.default == () else value == i.default):
            continue
        if i.kind == "one":
            out[key] = encoded(value, i.items, noun, f"{place}.")
        elif i.kind == "many":
            out[key] = [encoded(x, i.items, noun, f"{place}[].") if x is not None else _gone(place) for x in value]
        elif i.kind == "time":
            out[key] = (value if value.tzinfo else value.replace(tzinfo=UTC)).astimezone(UTC).isoformat()
        elif i.kind == "json":
            out[key] = _parsed(value, place)
        elif i.kind == "texts":
            out[key] = {k: _parsed(v, f"{place}.{k}") for k, v in (value.items() if isinstance(value, dict) else value)}
        else:
            _checked(i, value, place)
            out[key] = list(value) if i.kind == "strings" else value
    return out


def _gone(place: str) -> dict:
    raise Refused(f"{place}[]: null")


def _parsed(text: str | None, place: str) -> object:
    try:
        return None if text is None else json.loads(text, parse_constant=_no_number)
    except ValueError as e:
        raise Refused(f"{place}: no JSON text") from e


def _no_number(word: str) -> object:
    raise Refused(f"{word} is no JSON number")


def decoded(unit: object, items: tuple[Item, ...], noun: str = "Claim", at: str = "", known: tuple[str, ...] = (), strict: bool = True) -> dict:
    """The row of a unit; raises Refused where it is none."""
    if not isinstance(unit, dict):
        raise Refused(f"{at.rstrip('.') or 'unit'}: no object")
    named, keys = _named(items, noun, known)
    if strict and not unit.keys() <= keys:
        raise Refused(f"{at}{min(map(str, set(unit) - keys))}: unknown key")
    out = {}
    for key, i in named.items():
        value = unit.get(key)
        if value is None and not i.needed:
            out[i.column] = [] if i.default == () else i.default
        elif value.__class__ is str and i.kind == "string" and (not i.values or value in i.values):
            out[i.column] = value
        else:
            out[i.column] = _value(i, value, f"{at}{key}", noun)
    return out


def _value(i: Item, value: object, at: str, noun: str) -> object:
    if value is None:
        if i.needed:
            raise Refused(f"{at}: missing")
        return list(i.default) if i.default == () else i.default
    if i.kind == "one":
        return decoded(value, i.items, noun, f"{at}.")
    if i.kind == "many":
        if not isinstance(value, list):
            raise Refused(f"{at}: no list")
        return [decoded(x, i.items, noun, f"{at}[].") for x in value]
    if i.kind == "time":
        try:
            time = value if isinstance(value, datetime) else datetime.fromisoformat(value)
        except (TypeError, ValueError) as e:
            raise Refused(f"{at}: no time") from e
        return (time if time.tzinfo else time.replace(tzinfo=UTC)).astimezone(UTC)
    if i.kind == "json":
        return json.dumps(value, ensure_ascii=False, default=str)
    if i.kind == "texts":
        if not isinstance(value, dict):
            raise Refused(f"{at}: no object")
        present = {k: v for k, v in value.items() if k not in RENAMED}
        present |= {RENAMED[k]: v for k, v in value.items() if k in RENAMED and RENAMED[k] not in value}
        return [(k, json.dumps(v, ensure_ascii=False, default=str)) for k, v in present.items()]
    _checked(i, value, at)
    return float(value) if i.kind == "double" else value


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class _Settings:
    path: str
    items: tuple[Item, ...]
    subjects: bool
    yaml: bool
    noun: str
    context: str
    permissive: bool
    strict: bool
    most_bytes: int | None
    most_units: int | None
    split: int

    @property
    def type(self) -> str:
        return "Subject" if self.subjects else self.noun

    def unit(self, row: dict) -> dict:
        return {"@context": self.context, "@type": self.type, "formatVersion": FORMAT_VERSION} | encoded(row, self.items, self.noun)

    def row(self, unit: object) -> dict:
        if isinstance(unit, dict) and unit.get("@type") != self.type:
            raise Refused(f"@type: {unit.get('@type')!r} is not {self.type!r}")
        return decoded(unit, self.items, self.noun, known=("@context", "@type", "formatVersion"), strict=self.strict)


def _settings(options: dict[str, str]) -> _Settings:
    o = {k.lower(): v for k, v in options.items()}
    if "path" not in o:
        raise ValueError("claimbundle: no path")
    for key, allowed in (("kind", ("claims", "subjects")), ("container", ("jsonl", "yaml")), ("mode", ("failfast", "permissive")), ("strict", ("true", "false"))):
        if o.get(key, allowed[0]).lower() not in allowed:
            raise ValueError(f"claimbundle: {key} is one of {', '.join(allowed)}")
    bound = lambda key, default: None if o.get(key, "").lower() == "none" else int(o.get(key, default))
    subjects = o.get("kind", "claims").lower() == "subjects"
    return _Settings(
        o["path"].rstrip("/"), SUBJECT if subjects else CLAIM, subjects, o.get("container", "jsonl").lower() == "yaml", o.get("noun", "Claim"), o.get("context", CONTEXT), o.get("mode", "failfast").lower() == "permissive",
        o.get("strict", "true").lower() == "true", bound("mostbytes", MOST_BYTES), bound("mostunits", MOST_UNITS), int(o.get("split", SPLIT)),
    )


class ClaimBundle(DataSource):
    """Bundles as tables: see this module."""

    @classmethod
    def name(cls) -> str:
        return "claimbundle"

    def schema(self) -> T.StructType:
        s = _settings(self.options)
        columns = struct_of(s.items)
        return T.StructType([*columns.fields, T.StructField("problem", T.StringType())]) if s.permissive else columns

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_settings(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        s = _settings(self.options)
        known = {i.column for i in s.items}
        if extra := [c for c in schema.names if c not in known]:
            raise ValueError(f"claimbundle: no place in a unit for column {extra[0]}")
        if lost := [i.column for i in s.items if i.needed and i.column not in schema.names]:
            raise ValueError(f"claimbundle: column {lost[0]} is missing")
        return _Writer(s, overwrite)


@dataclass
class _Range(InputPartition):
    member: str
    start: int
    end: int
    whole: bool


class _Reader(DataSourceReader):
    def __init__(self, settings: _Settings, schema: T.StructType) -> None:
        self.settings, self.wanted = settings, schema

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        s, out = self.settings, []
        system, path = _opened(s.path)
        listed = _listed(system, path)
        if listed is not None:
            infos = system.get_file_info([posixpath.join(path, m["name"]) for m in listed])
        elif system.get_file_info(path).type == fs.FileType.File:
            infos = [system.get_file_info(path)]
        else:
            infos = [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        for i in sorted(infos, key=lambda i: i.path):
            if i.type != fs.FileType.File:
                raise Refused(f"{i.path}: listed, but not there")
            if s.most_bytes is not None and i.size > s.most_bytes:
                raise Refused(f"{i.path}: {i.size} bytes; at most {s.most_bytes}")
            whole = s.yaml or (s.most_units is not None and i.size > 2 * s.most_units)  # a unit and its end are more than two bytes
            step = max(1, i.size if whole else s.split)
            out += [_Range(i.path, a, min(a + step, i.size), whole) for a in range(0, i.size, step)]
        return out or [_Range("", 0, 0, True)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.member:
            return
        s, schema = self.settings, to_arrow_schema(self.wanted)
        system, _ = _opened(s.path)
        if partition.whole and s.most_units is not None and not s.yaml:
            n = sum(1 for _, _ in _lines(system, partition))
            if n > s.most_units:
                raise Refused(f"{partition.member}: more than {s.most_units} units")
        held, size = [], 0
        for place, weight, unit in _units(system, partition, s):
            try:
                row = s.row(unit() if callable(unit) else unit)
            except ValueError as e:
                if not s.permissive:
                    raise Refused(f"{partition.member}, {place}: {e}") from e
                row = {"problem": f"{place}: {e}"}
            held.append(row)
            size += weight
            if len(held) >= _BATCH_UNITS or size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def _listed(system: pa.fs.FileSystem, path: str) -> list[dict] | None:
    """The members that the bundle's list names; none without a list."""
    from pyarrow import fs

    at = posixpath.join(path, MANIFEST)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at) as f:
        return json.loads(f.read())["members"]


def _lines(system: pa.fs.FileSystem, part: _Range, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the lines that start in a range and aren't blank."""
    with system.open_input_file(part.member) as f:
        at = part.start
        rest = b""
        skip = part.start > 0
        if skip:
            at -= 1  # a line starts here if the byte before ends one
        f.seek(at)
        while True:
            more = f.read(block)
            rest += more
            lines = rest.split(b"\n")
            rest = lines.pop() if more else b""
            for line in lines:
                start, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if start >= part.end:
                    return
                if line.strip():
                    yield start, line
            if not more:
                return


def _units(system: pa.fs.FileSystem, part: _Range, s: _Settings) -> Iterator[tuple[str, int, object]]:
    """(place, bytes, unit, or what gives it) of a range."""
    if not s.yaml:
        for place, line in _lines(system, part):
            yield f"byte {place}", len(line), lambda line=line: json.loads(line, parse_constant=_no_number)
        return
    import yaml

    with system.open_input_stream(part.member) as f:
        raw = f.read()
    try:
        units = yaml.load(raw.decode(), getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or []
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise Refused(f"{part.member}: no YAML") from e
    if not isinstance(units, list):
        raise Refused(f"{part.member}: no sequence of units")
    if s.most_units is not None and len(units) > s.most_units:
        raise Refused(f"{part.member}: {len(units)} units; at most {s.most_units}")
    for i, unit in enumerate(units):
        yield f"unit {i}", len(raw) // len(units), unit


@dataclass
class _Members(WriterCommitMessage):
    members: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, settings: _Settings, overwrite: bool) -> None:
        self.settings, self.overwrite = settings, overwrite
        self.staged = f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Members:
        s = self.settings
        system, path = _opened(s.path)
        folder = posixpath.join(path, self.staged)
        system.create_dir(folder, recursive=True)
        members, out, now = [], None, {}

        def close() -> None:
            if out is not None:
                out.close()
                members.append({"name": now["name"], "units": now["units"], "bytes": now["bytes"], "sha256": now["digest"].hexdigest()})

        for batch in iterator:
            for row in _rows_of(batch):
                raw = _written(s.unit(row), s.yaml)
                if s.most_bytes is not None and len(raw) > s.most_bytes:
                    raise Refused(f"a unit of {len(raw)} bytes; at most {s.most_bytes} in a member")
                full = out is not None and ((s.most_bytes is not None and now["bytes"] + len(raw) > s.most_bytes) or (s.most_units is not None and now["units"] >= s.most_units))
                if out is None or full:
                    close()
                    now = {"name": f"{uuid.uuid4().hex}.{'yaml' if s.yaml else 'jsonl'}", "units": 0, "bytes": 0, "digest": hashlib.sha256()}
                    out = system.open_output_stream(posixpath.join(folder, now["name"]))
                out.write(raw)
                now["units"] += 1
                now["bytes"] += len(raw)
                now["digest"].update(raw)
        close()
        return _Members(members)

    def commit(self, messages: list[_Members | None]) -> None:
        system, path = _opened(self.settings.path)
        system.create_dir(path, recursive=True)
        old = _listed(system, path) or []
        new = [m for x in messages if x is not None for m in x.members]
        for m in new:
            system.move(posixpath.join(path, self.staged, m["name"]), posixpath.join(path, m["name"]))
        members = sorted(new if self.overwrite else old + new, key=lambda m: m["name"])
        at = posixpath.join(path, f"{self.staged}.json")
        with system.open_output_stream(at) as f:
            f.write(json.dumps({"formatVersion": FORMAT_VERSION, "units": sum(m["units"] for m in members), "members": members}, indent=1).encode())
        system.move(at, posixpath.join(path, MANIFEST))
        if self.overwrite:
            for m in old:
                with contextlib.suppress(OSError):  # isn't listed any more
                    system.delete_file(posixpath.join(path, m["name"]))
        self._clear()

    def abort(self, messages: list[_Members | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = _opened(self.settings.path)
        with contextlib.suppress(OSError):
            system.delete_dir(posixpath.join(path, self.staged))


def _written(unit: dict, as_yaml: bool) -> bytes:
    if not as_yaml:
        return (json.dumps(unit, ensure_ascii=False, allow_nan=False) + "\n").encode()
    import yaml

    return yaml.dump([unit], Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True).encode()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(ClaimBundle)
