"""Typed claim terms, tri-state claim matching and predicates on claims."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Datatypes that are numbers and times.
NUMBERS, TIMES = ("decimal", "integer", "float", "double"), ("date", "dateTime")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_ISO_BOUND = _ISO


def xsd_name(datatype: Column) -> Column:
    return F.when(F.startswith(datatype, F.lit(XSD)), F.substring(datatype, F.lit(len(XSD) + 1), F.length(datatype))).when(F.startswith(datatype, F.lit("xsd:")), F.substring(datatype, F.lit(5), F.length(datatype)))


def as_number(value: Column, datatype: Column) -> Column:
    """The term as DECIMAL(38,18), or null if its datatype or value says otherwise."""
    return F.when(xsd_name(datatype).isin(*NUMBERS), value.try_cast("decimal(38,18)"))


def as_time(value: Column, datatype: Column) -> Column:
    """The term as TIMESTAMP in UTC, or null if its datatype or value says otherwise."""
    return F.when(xsd_name(datatype).isin(*TIMES) & value.rlike(_ISO), value.try_cast("timestamp"))


@dataclass(frozen=True)
class Filters:
    """Conditions on a claim; None is no condition. Bounds are text."""

    predicate: str | None = None
    contains: str | None = None
    equals: str | None = None
    above: str | None = None
    below: str | None = None

    def __bool__(self) -> bool:
        return any(x is not None for x in (self.predicate, self.contains, self.equals, self.above, self.below))


def match(predicate: Column, value: Column, datatype: Column, filters: Filters) -> Column:
    """MATCHED, UNMATCHED or NOT_COMPARABLE.

    Conditions on text come first; a bound of another type than the object is
    not comparable; a failing lower bound decides before the upper one is read.
    """
    number, time = as_number(value, datatype), as_time(value, datatype)

    def bound(text: str) -> tuple[Column, Column]:
        b = F.lit(text)
        return b.try_cast("decimal(38,18)"), F.when(b.try_cast("decimal(38,18)").isNull() & b.rlike(_ISO_BOUND), b.try_cast("timestamp"))

    cases: list[tuple[Column, str]] = []
    if filters.predicate is not None:
        cases.append((F.lower(predicate) != filters.predicate.lower(), "UNMATCHED"))
    if filters.contains is not None:
        cases.append((~F.contains(F.lower(value), F.lit(filters.contains.lower())), "UNMATCHED"))
    if filters.equals is not None:
        n, t = bound(filters.equals)
        same = F.when(number.isNotNull() & n.isNotNull(), number == n).when(time.isNotNull() & t.isNotNull(), time == t).otherwise(F.lower(value) == filters.equals.lower())
        cases.append((~same, "UNMATCHED"))
    for text, low in ((filters.above, True), (filters.below, False)):
        if text is None:
            continue
        n, t = bound(text)
        inside = F.when(number.isNotNull() & n.isNotNull(), number > n if low else number < n).when(time.isNotNull() & t.isNotNull(), time > t if low else time < t)
        cases += [(inside.isNull(), "NOT_COMPARABLE"), (~inside, "UNMATCHED")]
    if not cases:
        return F.lit("MATCHED")
    first, *rest = cases
    return reduce(lambda c, x: c.when(*x), rest, F.when(*first)).otherwise("MATCHED")


def truth_apt(modality: Column) -> Column:
    return modality == "FALSIFIABLE"


def non_asserted(polarity: Column) -> Column:
    return F.coalesce(polarity.isin("DECLINED", "HYPOTHETICAL"), F.lit(False))


def excluded_meta(scope: Column, action: Column) -> Column:
    """Whether a claim about its own document is left out."""
    return F.coalesce((scope == "DOCUMENT_META") & ~F.coalesce(action.isin("observe", "source_exempt"), F.lit(False)), F.lit(False))


def subject_expected(kind: Column, scope: Column, polarity: Column, subject_scope: Column) -> Column:
    return (kind == "CLAIM") & ~F.coalesce(scope == "DOCUMENT_META", F.lit(False)) & ~non_asserted(polarity) & ~F.coalesce(subject_scope == "SELF", F.lit(False))


def valid_until(raw: Column, confidence: Column, floor: float, now: Column) -> Column:
    """struct(until, note): the end of validity, or null and why there is none."""
    at = F.when(raw.rlike(_ISO), raw.try_cast("timestamp"))
    note = F.when(raw.isNull(), None).when(at.isNull(), "unparsable").when(F.coalesce(confidence, F.lit(0.0)) < floor, "below_floor").when(at <= now, "past")
    return F.struct(F.when(note.isNull(), at).alias("until"), note.alias("note"))


def verdict(old_modality: Column, new_modality: Column, old_nature: Column, new_nature: Column, contradiction: Column, new_over_old: Column, old_over_new: Column, old_trust: Column, new_trust: Column, threshold: Column, single_order: Column) -> Column:
    """What becomes of two claims that may conflict."""
    settled = single_order & ~((old_nature == "ALEATORY") | (new_nature == "ALEATORY"))
    gap = new_trust - old_trust
    return (
        F.when(settled & contradiction & new_over_old & ~old_over_new, "DOCUMENT_SUPERSEDES")
        .when(settled & contradiction & old_over_new & ~new_over_old, "DOCUMENT_SUPERSEDED_BY_EXISTING")
        .when(~(truth_apt(old_modality) & truth_apt(new_modality)) | ~contradiction, "CORROBORATES")
        .when(settled & (F.abs(gap) >= threshold) & (gap > 0), "SUPERSEDES")
        .when(settled & (F.abs(gap) >= threshold), "SUPERSEDED_BY_EXISTING")
        .otherwise("INCONSISTENT")
    )


def cascades(provenance: Column, confirmations: Column, least: Column) -> Column:
    return F.when(provenance.isin("OPERATOR_DIRECT", "REGISTRY_ENDORSED"), True).when(provenance == "REVIEWER_DERIVED", confirmations >= least).otherwise(False)


#: Allowed changes of status; None is a new claim.
TRANSITIONS = (
    (None, "ACTIVE"), (None, "INCONSISTENCY"), (None, "PROVENANCE_STALE"), ("ACTIVE", "SUPERSEDED"), ("ACTIVE", "RETRACTED"), ("ACTIVE", "PROVENANCE_STALE"),
    ("INCONSISTENCY", "PROVENANCE_STALE"), ("INCONSISTENCY", "RETRACTED"), ("INCONSISTENCY", "INCONSISTENCY"), ("PROVENANCE_STALE", "SUPERSEDED"), ("PROVENANCE_STALE", "RETRACTED"), ("SUPERSEDED", "ACTIVE"),
)


def allowed_transition(old: Column, new: Column) -> Column:
    return reduce(lambda a, b: a | b, [(old.isNull() if a is None else F.coalesce(old == a, F.lit(False))) & (new == b) for a, b in TRANSITIONS])
