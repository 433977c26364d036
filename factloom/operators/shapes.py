"""Shapes over triples: what the nodes of many documents break, in one job.

Shapes are read from Turtle into a table of rules, one a property. Nodes of a
rule's class, and the values that a rule sends to another shape, are focus
nodes. Values are checked where they are read; only types, values that are sent
or counted and broken values are moved, to their document, where all that
follows takes place: counts by (document, node, path), focus nodes, and the
values whose own shape is broken, which count against the node that points to
them. Documents that are too large for a task meet by their nodes instead.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import Tables
from factloom.sources.turtle import RDF, XSD, Document, Term

SH = "http://www.w3.org/ns/shacl#"
RULES = "shape string, target string, path string, least int, most int, datatype string, node_kind string, pattern string, allowed array<string>, least_length int, most_length int, low double, high double, node string, severity string"
#: Rules at most: they go to every task.
MOST_RULES = 10_000
#: Triples of a task of whole documents, about (more than WIDE bytes of a value count as more triples), and ranges of documents that they are counted in.
ROWS, WIDE, RANGES = 1_000_000, 200, 16
#: Kinds of nodes by their names, and how values of a datatype are written.
NODE_KINDS = {
    "IRI": ("iri",), "Literal": ("literal",), "BlankNode": ("blank",), "IRIOrLiteral": ("iri", "literal"), "BlankNodeOrIRI": ("blank", "iri"), "BlankNodeOrLiteral": ("blank", "literal"),
}
_NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)"
FORMS = {
    "integer": r"[+-]?\d+", "decimal": _NUMBER, "double": rf"({_NUMBER}([eE][+-]?\d+)?|[+-]?INF|NaN)", "float": rf"({_NUMBER}([eE][+-]?\d+)?|[+-]?INF|NaN)", "boolean": r"(true|false|0|1)",
    "date": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-]\d\d:\d\d)?", "dateTime": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)(Z|[+-]\d\d:\d\d)?",
}
_KNOWN = {"path", "minCount", "maxCount", "datatype", "nodeKind", "pattern", "in", "minLength", "maxLength", "minInclusive", "maxInclusive", "node", "severity", "message", "description", "name", "order"}


def _key(kind: str, value: str, datatype: str | None, lang: str | None) -> str:
    return "\x1f".join((kind, value, (datatype or XSD + "string") if kind == "literal" and not lang else "", lang or ""))


def rules(text: str) -> list[tuple]:
    """The rules of shapes in Turtle, in the order of RULES.

    Raises ValueError for what isn't understood: a constraint that isn't known,
    a path that is no predicate, a shape that isn't there or reaches itself.
    """
    said: dict[Term, dict[str, list[Term]]] = {}
    for s, p, o, _ in Document(text).triples:
        said.setdefault(s, {}).setdefault(p.value, []).append(o)

    def listed(at: Term) -> list[Term]:
        out = []
        while at.value != RDF + "nil":
            out.append(said[at][RDF + "first"][0])
            at = said[at][RDF + "rest"][0]
        return out

    out = []
    for shape, facts in said.items():
        if not any(x.value == SH + "NodeShape" for x in facts.get(RDF + "type", ())):
            continue
        for target in [x.value for x in facts.get(SH + "targetClass", ())] or [None]:
            for p in facts.get(SH + "property", ()):
                own = {k.removeprefix(SH): v for k, v in said[p].items() if k.startswith(SH)}
                if odd := sorted(set(own) - _KNOWN):
                    raise ValueError(f"{shape.value}: no constraint {odd[0]} is known")
                if "path" not in own or own["path"][0].kind != "iri":
                    raise ValueError(f"{shape.value}: a path that is no predicate")
                get = lambda k, own=own: own[k][0].value if k in own else None
                number = lambda k, as_type, get=get: None if get(k) is None else as_type(get(k))
                kind = get("nodeKind")
                if kind is not None and kind.removeprefix(SH) not in NODE_KINDS:
                    raise ValueError(f"{shape.value}: no kind of node {kind}")
                allowed = [_key(*x) for x in listed(own["in"][0])] if "in" in own else None
                out.append((
                    shape.value, target, get("path"), number("minCount", int), number("maxCount", int), get("datatype"), kind and kind.removeprefix(SH), get("pattern"), allowed, number("minLength", int), number("maxLength", int),
                    number("minInclusive", float), number("maxInclusive", float), get("node"), (get("severity") or SH + "Violation").removeprefix(SH),
                ))
    if len(out) > MOST_RULES:
        raise ValueError(f"{len(out)} rules; at most {MOST_RULES}")
    _depth(out)
    return out


def _depth(found: list[tuple]) -> int:
    """How often a rule sends to another shape, at most."""
    to: dict[str, set[str]] = {}
    for r in found:
        to.setdefault(r[0], set()).update([r[13]] if r[13] else [])

    def deep(shape: str, above: tuple[str, ...]) -> int:
        if shape in above:
            raise ValueError(f"{shape} reaches itself")
        if shape not in to:
            raise ValueError(f"{shape} has no rules")
        return max((1 + deep(x, (*above, shape)) for x in to[shape]), default=0)

    return max((deep(x, ()) for x in to), default=0)


def _broken() -> Column:
    """Names of the constraints that the value o of a row breaks."""
    is_literal, blank = F.col("kind") == "literal", F.col("kind") == "blank"
    datatype = F.when(is_literal, F.when(F.col("lang").isNotNull(), RDF + "langString").otherwise(F.coalesce("data_type", F.lit(XSD + "string"))))
    written = reduce(lambda a, b: a.when(F.col("datatype") == XSD + b[0], F.col("o").rlike(f"^{b[1]}$")), list(FORMS.items())[1:], F.when(F.col("datatype") == XSD + "integer", F.col("o").rlike(f"^{FORMS['integer']}$"))).otherwise(True)
    kinds = reduce(lambda a, b: a.when(F.col("node_kind") == b[0], F.col("kind").isin(*b[1])), list(NODE_KINDS.items())[1:], F.when(F.col("node_kind") == "IRI", F.col("kind") == "iri"))
    key = F.concat_ws("\x1f", "kind", "o", F.when(is_literal & F.col("lang").isNull(), F.coalesce("data_type", F.lit(XSD + "string"))).otherwise(""), F.coalesce("lang", F.lit("")))
    number = F.when(is_literal, F.expr("try_cast(o AS double)"))
    checks = {
        "datatype": F.col("datatype").isNotNull() & ~F.coalesce((datatype == F.col("datatype")) & written, F.lit(False)), "nodeKind": ~kinds, "pattern": F.col("pattern").isNotNull() & (blank | ~F.expr("regexp_like(o, coalesce(pattern, ''))")),
        "in": ~F.array_contains("allowed", key), "minLength": F.col("least_length").isNotNull() & (blank | (F.length("o") < F.col("least_length"))), "maxLength": F.col("most_length").isNotNull() & (blank | (F.length("o") > F.col("most_length"))),
        "node": F.col("node").isNotNull() & is_literal,  # a literal has no properties: it breaks the shape it is sent to
        "minInclusive": F.col("low").isNotNull() & ~F.coalesce((number >= F.col("low")) & ~F.isnan(number), F.lit(False)), "maxInclusive": F.col("high").isNotNull() & ~F.coalesce((number <= F.col("high")) & ~F.isnan(number), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in checks.items()]))


def rule_table(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, RULES)


def violations(triples: DataFrame, found: list[tuple], rows: int = ROWS) -> DataFrame:
    """document, focus, shape, path, constraint, value, severity, nested of all that is broken.

    triples(document, s, p, o, kind, datatype, lang), as a reader of graphs gives
    them; a triple that stands twice, in one graph or in two, is one. constraint
    is the published name of what is broken: minCount and maxCount have no
    value, node has the value whose own shape is broken, whatever that one's
    severity. nested tells what a node breaks only because another one points to
    it. Lists, blank nodes and IRIs have no length or pattern but IRIs; numbers
    are compared as doubles. A node is checked once for each shape that reaches it.
    Documents of at most about ``rows`` triples stay together.
    """
    spark = triples.sparkSession
    if not found:
        return spark.createDataFrame([], "document string, focus string, shape string, path string, constraint string, value string, severity string, nested boolean")
    store, coded = Tables(spark), _Coded(spark, found)
    key = F.coalesce(F.concat(F.lit("="), "document"), F.lit(""))  # not null: joins by it are joins by one column
    triples = triples.select(key.alias("d"), "s", F.col("p").alias("path"), "o", "kind", F.col("datatype").alias("data_type"), "lang").where("s IS NOT NULL AND o IS NOT NULL")
    links = store.written(triples.join(F.broadcast(coded.paths), "path").drop("path"))

    weight = F.sum(1 + F.floor(F.octet_length("o") / WIDE))
    tasks = max(2, -(-(links.agg(weight).head()[0] or 0) // rows))  # two at least: a union keeps no single partition
    place = F.pmod(F.xxhash64("d"), F.lit(tasks * RANGES))
    large = F.broadcast(store.written(links.groupBy(place.alias("range")).agg(weight.alias("weight")).where(F.col("weight") > rows).select("range")))  # one in so many rows at most
    together = lambda df: df.repartition(tasks, "d")
    if large.isEmpty():
        out = _broken_by(links, coded, together)
    else:
        small, rest = (links.join(large, place == F.col("range"), how) for how in ("left_anti", "left_semi"))
        out = _broken_by(small, coded, together).unionByName(_broken_by(rest, coded, lambda df: df))
    with _documents_together(spark):
        out = store.written(out)
    document = F.when(F.col("d") != "", F.expr("substring(d, 2)"))
    return out.join(F.broadcast(coded.places), "place").select(document.alias("document"), F.col("s").alias("focus"), "shape", "path", "constraint", "value", "severity", "nested")


@contextlib.contextmanager
def _documents_together(spark: SparkSession) -> Iterator[None]:
    """Joins by (document, node) take rows as they lie by document."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Coded:
    """Rules by numbers: at most MOST_RULES rows in each table, which go to every task."""

    def __init__(self, spark: SparkSession, found: list[tuple]) -> None:
        # of a shape with several classes each rule stands once
        own = list(dict.fromkeys((r[0], None, *r[2:8], None if r[8] is None else tuple(r[8]), *r[9:]) for r in found))
        self.depth = _depth(found)
        number = {p: i for i, p in enumerate(dict.fromkeys([RDF + "type", *(r[2] for r in own)]))}
        shape = {s: i for i, s in enumerate(dict.fromkeys(r[0] for r in own))}
        place = {k: i for i, k in enumerate(dict.fromkeys((r[0], r[2], r[14]) for r in own))}
        at = [(shape[r[0]], number[r[2]], place[r[0], r[2], r[14]]) for r in own]
        some = lambda rows, schema: spark.createDataFrame(list(dict.fromkeys(rows)), schema)
        self.paths = some(number.items(), "path string, p int")
        self.places = some(((*k, i) for k, i in place.items()), "shape string, path string, severity string, place int")
        self.classes = some(((r[1], shape[r[0]]) for r in found if r[1] is not None), "target string, shape int")
        self.ways = some(((*a, shape[r[13]]) for a, r in zip(at, own, strict=True) if r[13]), "shape int, p int, place int, node int")
        limits = [(*a, r[3], r[4]) for a, r in zip(at, own, strict=True) if r[3] or r[4] is not None]
        self.limits = some(limits, "shape int, p int, place int, least int, most int")
        self.rules = some(((i, a[1], *r) for i, (a, r) in enumerate(zip(at, own, strict=True))), f"rule int, p int, {RULES}")
        self.homes = some(((i, a[0], a[2]) for i, a in enumerate(at)), "rule int, shape int, place int")
        self.type = number[RDF + "type"]
        self.sent = [number[r[2]] for r in own if r[13]]
        self.counted = [p for _, p, *_ in limits]
        #: Paths of which it is only asked whether there is a value.
        self.single = sorted(set(self.counted) - {p for _, p, _, least, most in limits if most is not None or least > 1})


def _broken_by(links: DataFrame, rules: _Coded, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """d, s, place, constraint, value, nested of what the nodes of links(d, s, p, o, kind, data_type, lang) break.

    ``spread`` brings rows to their documents: no join or count after it moves them again.
    """
    p, term = F.col("p"), ("o", "kind", "data_type", "lang")
    links = links.where("d IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")  # as joins would ask, each for its columns: what is moved for one is read by all
    ways = F.broadcast(rules.ways)
    types = spread(links.where(p == rules.type).join(F.broadcast(rules.classes), F.col("o") == F.col("target")).select("d", "s", "shape"))
    sends = spread(links.where(p.isin(rules.sent) & (F.col("kind") != "literal")).select("d", "s", "p", "o"))
    counted = spread(links.where(p.isin(rules.counted)).select("d", "s", "p", *[F.when(~p.isin(rules.single), F.col(c)).alias(c) for c in term]))
    counts = counted.distinct().groupBy("d", "s", "p").agg(F.count(F.lit(1)).alias("n"))
    wrong = spread(links.join(F.broadcast(rules.rules.drop("shape", "target", "path", "least", "most", "severity")), "p").select("d", "s", "rule", *term, F.explode(_broken()).alias("constraint"))).distinct()

    once = lambda df: df.groupBy("d", "s", "shape").agg(F.min("nested").alias("nested"))  # noqa: E731  a node of the class itself isn't nested
    level, focus = types, types.withColumn("nested", F.lit(False))
    above = focus
    for i in range(rules.depth):
        above = once(focus) if i else focus  # the shapes of the last level send nothing
        level = level.distinct() if i else level
        level = sends.join(level.join(ways, "shape").select("d", "s", "p", "node"), ["d", "s", "p"]).select("d", F.col("o").alias("s"), F.col("node").alias("shape"))
        focus = focus.union(level.withColumn("nested", F.lit(True)))
    focus = once(focus)

    n = F.coalesce("n", F.lit(0))
    limit = F.explode(F.array_compact(F.array(F.when(n < F.col("least"), "minCount"), F.when(n > F.col("most"), "maxCount"))))
    off = focus.join(F.broadcast(rules.limits), "shape").join(counts, ["d", "s", "p"], "left").select("d", "s", "shape", "place", limit.alias("constraint"), F.lit(None).cast("string").alias("value"), "nested")
    values = focus.join(wrong.join(F.broadcast(rules.homes), "rule"), ["d", "s", "shape"]).select("d", "s", "shape", "place", "constraint", F.col("o").alias("value"), "nested")
    out = off.union(values)

    sent = sends.join(above.join(ways, "shape"), ["d", "s", "p"]).select("d", "s", "shape", "place", F.lit("node").alias("constraint"), F.col("o").alias("value"), "nested", "node")
    bad, against = out, []
    for _ in range(rules.depth):
        broken = bad.select("d", F.col("s").alias("value"), F.col("shape").alias("node"))
        bad = sent.join(broken, ["d", "value", "node"], "left_semi").select(out.columns).distinct()
        against.append(bad)
    if against:
        out = out.union(reduce(DataFrame.union, against).distinct() if rules.depth > 1 else against[0])
    return out.drop("shape")
