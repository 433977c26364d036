"""Claims as triples: terms read from replies, subjects bound to their ids, marks of scope and stance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.binding import let

#: What an absolute IRI starts with, and kinds of terms.
ABSOLUTE_IRI = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"
KINDS = ("URI", "TOKEN", "LITERAL")
#: Property keys, and what they say.
SCOPE, SCOPE_ACTION, POLARITY, SUBJECT_SCOPE = "extraction:scope", "extraction:scope_action", "extraction:polarity", "extraction:subject_scope"
STANCE_HOLDER, STANCE_MAGNITUDE = "stance:holder", "stance:magnitude"
#: Tags of sources whose own claims about themselves count.
EXEMPT_TAGS = ("rule-file",)


def published_curie(value: Column, prefixes: Sequence[str]) -> Column:
    """Whether a name starts with a published prefix and a colon."""
    return F.exists(F.lit(list(prefixes)).cast("array<string>"), lambda p: F.startswith(value, F.concat(p, F.lit(":"))))


def is_uri(value: Column, prefixes: Sequence[str] = ()) -> Column:
    return value.rlike(ABSOLUTE_IRI) | published_curie(value, prefixes)


_TERM = "kind string, value string, datatype string, language string"


def _built(text: Column, told: Column, position: str, prefixes: Sequence[str]) -> Column:
    """A term from a string, or from what an object tells (the other is null)."""
    some = lambda name: F.nullif(told[name], F.lit(""))

    def with_value(value: Column) -> Column:
        said = F.upper(F.trim(told["kind"]))
        guess = F.when(is_uri(value, prefixes), "URI").when(text.isNotNull() & F.lit(position == "object"), "LITERAL").otherwise("TOKEN")
        kind = F.when(text.isNull() & said.isin(*KINDS), said).otherwise(guess)
        return F.when(value != "", let(kind if position == "object" else F.regexp_replace(kind, "^LITERAL$", "TOKEN"), lambda k: with_kind(value, k)))

    def with_kind(value: Column, kind: Column) -> Column:
        literal = kind == "LITERAL"
        return F.struct(kind.alias("kind"), value.alias("value"), F.when(literal, some("datatype")).alias("datatype"), F.when(literal & some("datatype").isNull(), some("language")).alias("language"))

    return let(F.trim(F.coalesce(text, told["value"], F.lit(""))), with_value)


def _parts(plain: Column) -> Column:
    """struct(text, told): a string, or the fields of an object's JSON."""
    is_object = plain.startswith("{")
    return F.struct(F.when(~is_object, plain).alias("text"), F.from_json(F.when(is_object, plain), _TERM).alias("told"))


def term(raw: Column, position: str, prefixes: Sequence[str] = ()) -> Column:
    """struct(kind, value, datatype, language) of a term in a JSON reply; null if it has no value.

    raw: JSON of a string, whose kind is inferred, or of an object with kind,
    value, datatype and language. Only objects are literals, and only literals
    have a datatype or, without one, a language.
    """
    plain = let(raw, lambda r: F.when(r.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), r, F.lit("}")), "$.v")).otherwise(r))
    return let(plain, lambda p: let(_parts(p), lambda x: _built(x["text"], x["told"], position, prefixes)))


def triple(raw: Column, structurizer: str, version: str, prefixes: Sequence[str] = ()) -> Column:
    """struct(subject, predicate, object, structurizer, version) of a reply's JSON object; null unless all three terms are there.

    The reply is parsed once, each term once; every name in the expression is
    bound, so that the plan doesn't repeat them.
    """
    positions = ("subject", "predicate", "object")

    def one(reply: Column, position: str) -> Column:
        return let(_parts(reply[position]), lambda x: _built(x["text"], x["told"], position, prefixes)).alias(position)

    def read(reply: Column) -> Column:
        return F.struct(*[one(reply, p) for p in positions])

    def whole(parts: Column) -> Column:
        there = reduce(and_, [parts[p].isNotNull() for p in positions])
        return F.when(there, F.struct(*[parts[p].alias(p) for p in positions], F.lit(structurizer).alias("structurizer"), F.lit(version).alias("version")))

    return let(F.from_json(raw, "subject string, predicate string, object string"), lambda r: let(read(r), whole))


def bound_subject(subject: Column, names: Column, ids: Column, refs: Column | None = None) -> Column:
    """The id of a triple's subject term: that of the first name that is the same
    in any case, else, for an IRI, of the first name whose reference (refs: map
    of name to IRI) is exactly it; null if there is none. Names and ids go
    together as far as both reach."""
    pairs = F.transform(F.slice(names, 1, F.least(F.size(names), F.size(ids))), lambda n, i: F.struct(n.alias("name"), F.get(ids, i).alias("id")))
    wanted = F.trim(subject["value"])
    by_name = F.get(F.filter(pairs, lambda p: F.lower(F.trim(p["name"])) == F.lower(wanted)), F.lit(0))["id"]
    if refs is None:
        return by_name
    by_iri = F.get(F.filter(pairs, lambda p: F.coalesce(F.try_element_at(refs, p["name"]) == wanted, F.lit(False))), F.lit(0))["id"]
    return F.coalesce(by_name, F.when(subject["kind"] == "URI", by_iri))


def predicate_kind(predicate: Column, prefixes: Sequence[str]) -> Column:
    return F.when(published_curie(predicate, prefixes), "URI").otherwise("TOKEN")


def entity_iri(base: str, entity_id: Column) -> Column:
    return F.concat(F.lit(base), entity_id)


def holder(properties: Column) -> Column:
    """Who takes a stance, from a claim's properties (JSON); null if nobody or if it isn't text."""
    key = F.get_json_object(properties, f"$['{STANCE_HOLDER}']")
    text = F.regexp_like(properties, F.lit(rf'"{STANCE_HOLDER}"\s*:\s*"'))
    return F.when(text & (key != ""), key)


def has_stance(properties: Column) -> Column:
    return F.coalesce(holder(properties).isNotNull(), F.lit(False))


def magnitude(properties: Column) -> Column:
    """How strong a stance is; null without a number (true and false are none)."""
    number = F.regexp_like(properties, F.lit(rf'"{STANCE_MAGNITUDE}"\s*:\s*-?[0-9]'))
    return F.when(number, F.get_json_object(properties, f"$['{STANCE_MAGNITUDE}']").try_cast("double"))


def exempt_source(tags: Column, exempt: Sequence[str] = EXEMPT_TAGS) -> Column:
    """Whether a source's tags let its claims about itself count."""
    return F.coalesce(F.arrays_overlap(tags, F.lit(list(exempt)).cast("array<string>")), F.lit(False)) if exempt else F.lit(False)


def with_exemption(properties: Column) -> Column:
    """Properties (a map) with the exemption noted on a claim about its document; others and noted ones stay."""
    meta = F.coalesce(F.try_element_at(properties, F.lit(SCOPE)) == "DOCUMENT_META", F.lit(False))
    open_ = F.try_element_at(properties, F.lit(SCOPE_ACTION)).isNull()
    rest = F.map_filter(properties, lambda k, v: k != SCOPE_ACTION)
    return F.when(meta & open_, F.map_concat(rest, F.create_map(F.lit(SCOPE_ACTION), F.lit("source_exempt")))).otherwise(properties)


def self_scope(said: Column, subjects: Column) -> Column:
    """Properties (a map) of a claim that only its author is the subject of; null for others."""
    own = (F.size(subjects) == 0) & (F.upper(F.trim(said)) == "SELF")
    return F.when(F.coalesce(own, F.lit(False)), F.create_map(F.lit(SUBJECT_SCOPE), F.lit("SELF")))


def fenced(text: Column, nonce: Column, label: str = "source") -> Column:
    """Text of others between marks that it can't know: the nonce is drawn for each batch."""
    mark = F.concat(F.lit(f'{label} nonce="'), nonce, F.lit('">'))
    return F.concat(F.lit("<"), mark, F.lit("\n"), text, F.lit("\n</"), mark)


def scrubbed(body: Column, most: int = 500) -> Column:
    """A reply's body for a log: without bearer tokens, then cut at ``most`` characters."""
    return F.left(F.regexp_replace(body, r"(?i)(authorization\s*:\s*)?bearer\s+\S+", "Bearer [REDACTED]"), F.lit(most))


def suites(name: Column) -> Column:
    """The set of suites that a name joins with +, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(name, r"\+"), lambda s: F.trim(s)), lambda s: s != "")))


def same_suites(a: Column, b: Column) -> Column:
    return suites(a) == suites(b)


def claim_confidence(raw: Column, temperature: Column, transform: Column, calibrated: Column) -> Column:
    """struct(value, source, method): calibrated where a fit of the logit is known, else as it is."""
    known = F.coalesce((transform == "logit") & temperature.isNotNull(), F.lit(False))
    return F.struct(
        F.when(known, calibrated).otherwise(raw).alias("value"), F.when(known, "CALIBRATED_BENCHMARK").otherwise("EXTRACTOR_DIRECT").alias("source"), F.when(known, "temperature_scaling").alias("method"),
    )
