"""How far an extractor's claims keep the contract: fields, shapes, similarity bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import paths

#: Fields of a claim by tier.
REQUIRED = ("id", "content", "confidence.value", "provenance", "asserted_by", "status", "schema_version", "particle_type", "subject_ids", "uncertainty_nature")
RECOMMENDED = ("confidence.calibration_source", "provenance[].snapshot_id", "extractor_ref")
OPTIONAL = (
    "confidence.variance", "confidence.calibration_method", "uncertainty_kind", "valid_until", "supersedes", "tags", "context_fingerprint", "properties",
    "structured_claim", "canonical_form", "sequence_context", "basis", "contributors",
)
CONTRACT = {**dict.fromkeys(REQUIRED, "REQUIRED"), **dict.fromkeys(RECOMMENDED, "RECOMMENDED"), **dict.fromkeys(OPTIONAL, "OPTIONAL")}
#: Fields whose values are counted, and the least number of different ones that is advised.
ENUM_FIELDS = ("uncertainty_nature", "particle_type", "status", "confidence.calibration_source", "canonical_form")
DIVERSITY = {"uncertainty_nature": 2}


def populated(value: Column, kind: str = "plain") -> Column:
    """Whether a value says something: not null, no empty text, list or map; a
    list only if all of its elements do. 0 and false say something.

    kind: plain, text, list or map.
    """
    if kind == "text":
        return F.coalesce(value != "", F.lit(False))
    if kind == "list":
        return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & (x.cast("string") != "")), F.lit(False))
    if kind == "map":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()


def field_report(claims: DataFrame, fields: Mapping[str, Column], values: Mapping[str, Column], exempt: Mapping[str, Column] | None = None, least: float = 0.8, diversity: Mapping[str, int] | None = None) -> DataFrame:
    """field, tier, populated, total, excluded, rate, distinct, passes, advised of each field.

    fields: whether a claim has it; values: what enumerated ones say; exempt:
    claims that a field isn't measured on. Required fields have to be there on
    all claims, recommended ones on a share of ``least``; a field that no claim
    is measured on passes only if it is optional. advised is false where a
    passing field has too few different values.
    """
    exempt, rules = exempt or {}, DIVERSITY if diversity is None else diversity
    none = F.lit(None).cast("string")
    each = []
    for f, has in fields.items():
        measured = ~F.coalesce(exempt.get(f, F.lit(False)), F.lit(False))
        each.append(F.struct(F.lit(f).alias("field"), F.lit(CONTRACT[f]).alias("tier"), F.coalesce(has, F.lit(False)).alias("has"), values.get(f, none).cast("string").alias("value"), measured.alias("measured")))
    rows = claims.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    counts = rows.groupBy("field", "tier").agg(
        F.count_if(F.col("measured") & F.col("has")).alias("populated"), F.count_if("measured").alias("total"), F.count_if(~F.col("measured")).alias("excluded"), F.count_distinct(F.when(F.col("measured"), F.col("value"))).alias("distinct")
    )
    rate = F.when(F.col("total") > 0, F.col("populated") / F.col("total")).otherwise(0.0)
    enough = F.when(F.col("tier") == "OPTIONAL", True).when(F.col("total") == 0, False).when(F.col("tier") == "REQUIRED", F.col("populated") == F.col("total")).otherwise(rate >= least)
    need = F.coalesce(*[F.when(F.col("field") == f, n) for f, n in rules.items()], F.lit(0))
    return counts.withColumn("rate", rate).withColumn("passes", enough).withColumn("advised", ~(F.col("passes") & (F.col("tier") != "OPTIONAL") & (F.col("distinct") < need)))


def contract_of(claims: DataFrame, exempt: Mapping[str, Column] | None = None, least: float = 0.8, diversity: Mapping[str, int] | None = None) -> DataFrame:
    """field_report of all fields of the contract, found in claims by their paths.

    A field that the schema doesn't have is one that no claim has.
    """
    fields = {path: paths.populated(claims, path) for path in CONTRACT}
    values = {path: paths.texts(claims, path) for path in ENUM_FIELDS}
    return field_report(claims, fields, values, exempt, least, diversity)


def evaluable_failure(report: DataFrame) -> DataFrame:
    """One row, failed: whether a required field falls short on claims that there are."""
    return report.agg(F.coalesce(F.bool_or((F.col("tier") == "REQUIRED") & ~F.col("passes") & (F.col("total") + F.col("excluded") > 0)), F.lit(False)).alias("failed"))


def capped_trust(trust: Column, failed: Column, exempt: Column, cap: float = 0.5) -> Column:
    """Trust in an extractor: at most the cap while it fails the contract, unless it is exempt."""
    return F.when(F.coalesce(failed, F.lit(False)) & ~F.coalesce(exempt, F.lit(False)), F.least(trust, F.lit(cap))).otherwise(trust)


def routed(fixtures: DataFrame, route: Column, extractor: str, accepted: Column | None = None) -> DataFrame:
    """The fixtures an extractor is measured on: those that routing gives it, or all that it accepts."""
    return fixtures.where(route == extractor if accepted is None else accepted)


def corpus_hash(fixtures: DataFrame) -> DataFrame:
    """One row, corpus_hash: a digest over (id, content, snapshot) in order of id, each closed by a NUL.

    One digest over everything has to pass one row: for a set of test fixtures.
    """
    nul = F.lit(b"\x00")
    one = F.concat(F.col("id").cast("binary"), nul, F.col("content").cast("binary"), nul, F.col("snapshot").cast("binary"), nul)
    rows = fixtures.agg(F.array_sort(F.collect_list(F.struct("id", one.alias("bytes")))).alias("rows"))
    return rows.select(F.sha2(F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["bytes"])), "")), 256).alias("corpus_hash"))


@dataclass(frozen=True)
class Rule:
    """What a shape asks of a property; ``one`` is exactly one value, else at most one."""

    path: str
    one: bool = False
    least_length: int = 0
    values: tuple[str, ...] = ()
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    warning: bool = False


#: Shapes of a claim, its extractor, contributors and terms, a subject and a trust statement.
SHAPES: dict[str, tuple[Rule, ...]] = {
    "claim": (
        Rule("id", True), Rule("content", True, 1), Rule("confidenceValue", True, low=0.0, high=1.0), Rule("uncertaintyNature", True, values=("ALEATORY", "EPISTEMIC")), Rule("assertedBy", True), Rule("assertedAt", True),
        Rule("status", True, values=("ACTIVE", "SUPERSEDED", "RETRACTED", "PROVENANCE_STALE", "INCONSISTENCY")), Rule("particleType", values=("CLAIM", "REVIEW", "NARRATIVE", "ACTION", "ANNOTATION")),
        Rule("assertionModality", values=("FALSIFIABLE", "EVALUATIVE", "EXPERIENTIAL", "CONSTITUTIVE")), Rule("canonicalForm", values=("PROSE", "STRUCTURED")), Rule("extractionProviderModel", least_length=1), Rule("schemaVersion", True, pattern=r"^\d+\.\d+\.\d+$"),
    ),
    "extractor": (Rule("extractorName", True, 1), Rule("extractorVersion", True, pattern=r"^\d+\.\d+\.\d+")),
    "contributor": (Rule("id", True, 1), Rule("role", True, 1, values=("author", "extractor", "curator", "reviewer", "importer", "agent"), warning=True), Rule("at", True)),
    "subject": (Rule("id", True), Rule("canonicalName", True, 1), Rule("assertedBy", True), Rule("createdAt", True)),
    "statement": (Rule("statementId", True), Rule("domain", True, 1), Rule("sourceRef", True), Rule("trustRank", True, low=0.0, high=1.0), Rule("policyProvenance", True, values=("OPERATOR_DIRECT", "REVIEWER_DERIVED", "REGISTRY_ENDORSED")), Rule("assertedBy", True), Rule("assertedAt", True)),
}


def shape_violations(shape: str, properties: Mapping[str, Column], warnings: bool = False) -> Column:
    """Sorted names of the rules of a shape that a row's properties break, as
    path:rule; properties that aren't given are absent. Only warnings, if asked for."""
    found = []
    for r in SHAPES[shape]:
        if r.warning != warnings:
            continue
        x = properties.get(r.path, F.lit(None).cast("string"))
        checks = {"missing": x.isNull() if r.one else F.lit(False)}
        if r.least_length:
            checks["length"] = F.length(x.cast("string")) < r.least_length
        if r.values:
            checks["in"] = ~x.isin(*r.values)
        if r.pattern:
            checks["pattern"] = ~x.rlike(r.pattern)
        if r.low is not None:
            checks["range"] = ~x.between(r.low, r.high)
        found += [F.when(c, f"{r.path}:{name}") for name, c in checks.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def in_band(similarity: Column, low: float, high: float) -> Column:
    """Whether a similarity lies where the vectors say, both ends included."""
    return similarity.between(low, high)


def holds_expected(found: DataFrame, expected: DataFrame, query: str, item: str) -> DataFrame:
    """query, missing, passes: whether the found items of each query hold all expected ones, in any order."""
    lost = expected.join(found.select(query, item).distinct().withColumn("_found", F.lit(True)), [query, item], "left")
    return lost.groupBy(query).agg(F.count_if(F.col("_found").isNull()).alias("missing")).withColumn("passes", F.col("missing") == 0)


def selects(route: Column, extractor: str, source_types: Sequence[str], source_type: Column) -> Column:
    """Whether a row's source type is one of these and routing gives it to the extractor."""
    return source_type.isin(*source_types) & (route == extractor)
