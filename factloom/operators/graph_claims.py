"""Claims of graph documents: triples with words, confidence and provenance.

rows are those of turtle.read_graphs or of line_triples; all joins are by
document and term, and what one document says of a term holds in it alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.shared import written

RDF, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2002/07/owl#"
#: Predicates that name a thing, in their order; those that say nothing of the world; namespaces of subjects.
LABELS = ("http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/terms/title", "http://purl.org/dc/elements/1.1/title", "http://xmlns.com/foaf/0.1/name")
SILENT = (*LABELS, RDF + "first", RDF + "rest", OWL + "imports", OWL + "versionInfo")
NAMESPACES = {"http://www.wikidata.org/entity/": "wikidata", "https://www.wikidata.org/wiki/": "wikidata", "http://nomisma.org/id/": "nomisma"}
#: Confidence of a triple that says nothing of its own, and triples that a document gives at most.
CONFIDENCE, MOST = 0.95, 5000
#: Parts that a document's triples are cut in before its first ones are sought.
BLOCKS = 64

_TERM = r"(<[^>]*>|_:\S+)"
_TRIPLE = rf'^\s*{_TERM}\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*$'


def line_triples(lines: DataFrame, line: str = "value", document: str = "document") -> DataFrame:
    """document, s, p, o, kind, datatype, lang, graph of N-Triples or N-Quads lines, read without Python; others are left out."""
    part = lambda i: F.regexp_extract(line, _TRIPLE, i)
    raw = lines.select(F.col(document).alias("document"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), part(4).alias("g")).where("p <> ''")
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.col("o").startswith('"')
    value = F.regexp_replace(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(["\\])', "$1")
    none = lambda c: F.when(c != "", c)
    return raw.select(
        "document", bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), F.when(literal, value).otherwise(bare(F.col("o"))).alias("o"),
        F.when(literal, "literal").when(F.col("o").startswith("_:"), "blank").otherwise("iri").alias("kind"),
        none(F.regexp_extract("o", r"\^\^<([^>]*)>$", 1)).alias("datatype"), none(F.regexp_extract("o", r'"@([A-Za-z-]+)$', 1)).alias("lang"), none(bare(F.col("g"))).alias("graph"),
    )


def _english(lang: Column) -> Column:
    return F.substring_index(lang, "-", 1) == "en"


def best_labels(rows: DataFrame) -> DataFrame:
    """document, s, label: what a document calls each of its terms: by language (English, none, other), then by predicate."""
    language = F.when(_english(F.col("lang")), 0).when(F.col("lang").isNull(), 1).otherwise(2)
    predicate = F.array_position(F.lit(list(LABELS)), F.col("p"))
    named = rows.where(F.col("p").isin(*LABELS) & (F.col("kind") == "literal")).withColumn("o", F.trim("o")).where("o <> ''")
    return named.groupBy("document", "s").agg(F.min_by("o", F.struct(language, predicate, F.col("o"))).alias("label"))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def _level(confidence: Sequence[str]) -> Column:
    """A confidence that a triple tells, if it is one."""
    value = F.col("o").try_cast("double")
    return F.when(F.col("p").isin(*confidence) & (F.col("kind") == "literal") & value.between(0, 1), value)


_PARTS = ("document", "s", "p", "o", "kind", "datatype", "lang")


def rated_triples(rows: DataFrame, confidence: Sequence[str], default: float = CONFIDENCE) -> DataFrame:
    """document, s, p, o, kind, datatype, lang, graph, confidence of what the documents claim.

    A statement about a statement (of type rdf:Statement) lends its confidence
    to the triple it describes, which is claimed even if it stands nowhere else;
    its own triples say nothing more. Else a confidence told of a graph holds
    for the graph's triples, else the default. Labels, list cells and ontology
    headers are no claims.
    """
    return _rated(rows.select(*_PARTS, "graph").distinct(), confidence, default)


def _rated(rows: DataFrame, confidence: Sequence[str], default: float) -> DataFrame:
    each = rows.where(F.col("kind").isin("iri", "blank", "literal")).select(*_PARTS, "graph")
    bundles = each.where((F.col("p") == RDF + "type") & (F.col("o") == RDF + "Statement") & (F.col("kind") == "iri")).select("document", F.col("s").alias("node")).distinct()
    about = each.alias("t").join(bundles.alias("b"), (F.col("t.document").eqNullSafe(F.col("b.document"))) & (F.col("t.s") == F.col("b.node"))).select("t.*")
    term = F.struct("o", "kind", "datatype", "lang")
    part = lambda name: F.min(F.when(F.col("p") == RDF + name, term))
    told = about.groupBy("document", F.col("s").alias("node")).agg(part("subject").alias("s"), part("predicate").alias("p"), part("object").alias("x"), F.max(_level(confidence)).alias("level"))
    told = told.where("s IS NOT NULL AND p IS NOT NULL AND x IS NOT NULL").select("document", F.col("s.o").alias("s"), F.col("p.o").alias("p"), "x.*", "level")
    told = told.groupBy(*_PARTS).agg(F.max("level").alias("level"))
    graphs = each.where("graph IS NOT NULL").select("document", F.col("graph").alias("s")).distinct().withColumn("is_graph", F.lit(True))
    plain = each.alias("t").join(bundles.alias("b"), F.col("t.document").eqNullSafe(F.col("b.document")) & (F.col("t.s") == F.col("b.node")), "left_anti")
    plain = plain.alias("t").join(graphs.alias("g"), _same("t", "g", ("document", "s")), "left").select("t.*", "g.is_graph")
    annotates = F.coalesce(F.col("is_graph"), F.lit(False)) & F.col("p").isin(*confidence)
    levels = plain.where(annotates).groupBy("document", F.col("s").alias("graph")).agg(F.max(_level(confidence)).alias("graph_level"))
    header = (F.col("p") == RDF + "type") & (F.col("o") == OWL + "Ontology") & (F.col("kind") == "iri")
    said = plain.where(~annotates & ~F.col("p").isin(*SILENT) & ~header).drop("is_graph")
    said = said.alias("t").join(levels.alias("l"), _same("t", "l", ("document", "graph")), "left").select("t.*", "l.graph_level")
    said = said.alias("t").join(told.alias("r"), _same("t", "r", _PARTS), "left").select(*[f"t.{c}" for c in (*_PARTS, "graph")], F.coalesce("r.level", "t.graph_level").alias("level"))
    # a triple that no graph asserts but a statement describes
    only = told.alias("r").join(said.alias("t"), _same("r", "t", _PARTS), "left_anti").where(~F.col("p").isin(*SILENT)).withColumn("graph", F.lit(None).cast("string"))
    return said.unionByName(only.select(*said.columns)).withColumn("confidence", F.coalesce("level", F.lit(default))).drop("level")


def _words(term: Column, label: Column, prefixes: Column) -> Column:
    """An IRI in words: its label, its last part, its short form by the document's prefixes, or itself."""
    tail = F.when(F.contains(term, F.lit("#")) & (F.substring_index(term, "#", -1) != ""), F.substring_index(term, "#", -1)).when(F.contains(term, F.lit("/")), F.substring_index(term, "/", -1)).otherwise("")
    name = F.regexp_extract(term, r"([A-Za-z_][\w.\-]*)$", 1)
    prefix = prefixes[F.left(term, F.length(term) - F.length(name))]
    short = F.when((name != "") & (prefix != ""), F.concat(prefix, F.lit(":"), name))
    return F.coalesce(label, F.when(tail != "", F.coalesce(F.nullif(text.pretty_local_name(term), F.lit("")), tail)), short, term)


def triple_claims(rows: DataFrame, default: float = CONFIDENCE, most: int = MOST, confidence: Sequence[str] = ("http://example.org/confidence",), namespaces: Mapping[str, str] = NAMESPACES, blank_subjects: bool = False) -> DataFrame:
    """document, s, p, o, graph, content, confidence, subjects, refs, claim, left_out of the documents' triples.

    ``content`` is "subject predicate: object" in words; a literal in another
    language than English says so. ``refs`` names subject and object by known
    namespaces. Blank nodes without a label can't be told, and blank subjects
    are claims only where asked for. A document keeps its first ``most`` claims
    by (graph, s, p, o); left_out tells how many it loses. The rows are read
    once, into a table in the shared folder; only documents of more than ``most``
    triples are ordered.
    """
    whole_documents = "note" in rows.columns
    rows = written(rows.select(*_PARTS, "graph").distinct())
    rated = _rated(rows, confidence, default)
    if not blank_subjects:
        rated = rated.where(~F.col("s").startswith("_:"))
    labels = best_labels(rows)
    for c in ("s", "p", "o"):
        named = labels.select("document", F.col("s").alias(c), F.col("label").alias(f"{c}_label"))
        rated = rated.alias("t").join(named.alias("n"), _same("t", "n", ("document", c)), "left").select("t.*", f"n.{c}_label")
    if whole_documents:  # they bring their prefixes
        bound = rows.where("kind = 'prefix'").groupBy("document", "o").agg(F.min("s").alias("s")).groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("o", "s"))).alias("prefixes"))
        rated = rated.alias("t").join(bound.alias("m"), F.col("t.document").eqNullSafe(F.col("m.document")), "left").select("t.*", "m.prefixes")
    else:
        rated = rated.withColumn("prefixes", F.lit(None).cast("map<string,string>"))
    blank = lambda c: F.col(c).startswith("_:")
    subject = F.when(blank("s"), F.coalesce("s_label", F.lit(""))).otherwise(_words(F.col("s"), F.col("s_label"), F.col("prefixes")))
    foreign = F.col("lang").isNotNull() & ~_english(F.col("lang"))
    literal = F.when(foreign, F.concat("o", F.lit(" ("), F.col("lang"), F.lit(")"))).otherwise(F.col("o"))
    value = F.when(F.col("kind") == "literal", literal).when(F.col("kind") == "blank", F.coalesce("o_label", F.lit(""))).otherwise(_words(F.col("o"), F.col("o_label"), F.col("prefixes")))
    told = rated.withColumns({"subject": subject, "predicate": _words(F.col("p"), F.col("p_label"), F.col("prefixes")), "value": value}).where("subject <> '' AND value <> ''")
    longest = sorted(namespaces.items(), key=lambda x: (-len(x[0]), x[0]))
    known = lambda c: F.coalesce(F.lit(None).cast("string"), *[F.when(c.startswith(iri) & (F.length(c) > len(iri)), F.concat(F.lit(f"{name}:"), F.substring(c, len(iri) + 1, 1 << 30))) for iri, name in longest])
    edge = (F.col("kind") == "iri") & (F.col("value") != F.col("subject"))
    none = F.lit(None).cast("string")
    term = lambda kind, v, datatype=none, lang=none: F.struct(kind.alias("kind"), v.alias("value"), datatype.alias("datatype"), lang.alias("language"))
    node = lambda c: F.when(blank(c), "TOKEN").otherwise("URI")
    thing = F.when(F.col("kind") == "literal", "LITERAL").otherwise(node("o"))
    out = told.select(
        "document", "s", "p", "o", "graph", "kind", "datatype", "lang", F.concat("subject", F.lit(" "), F.col("predicate"), F.lit(": "), F.col("value")).alias("content"), "confidence",
        F.when(edge, F.array("subject", "value")).otherwise(F.array("subject")).alias("subjects"),
        F.array_compact(F.array(known(F.col("s")), F.when(edge, known(F.col("o"))))).alias("refs"),
        F.struct(term(node("s"), F.col("s")).alias("subject"), term(F.lit("URI"), F.col("p")).alias("predicate"), term(thing, F.col("o"), F.col("datatype"), F.when(F.col("datatype").isNull(), F.col("lang"))).alias("object")).alias("claim"),
    )
    # every claim is told by a triple of its own, or by three of a statement
    large = written(rows.groupBy("document").count().where(F.col("count") > most).select(F.col("document").alias("d")))
    result = ("document", "s", "p", "o", "graph", "content", "confidence", "subjects", "refs", "claim")
    if large.isEmpty():
        return out.select(*result, F.lit(0).cast("long").alias("left_out"))
    inside = F.col("document").eqNullSafe(F.col("d"))
    small = out.join(large, inside, "left_anti").withColumn("left_out", F.lit(0).cast("long"))
    order = [F.asc_nulls_first("graph"), *[F.asc(c) for c in ("s", "p", "o")], *[F.asc_nulls_first(c) for c in ("kind", "datatype", "lang")]]
    block = out.join(large, inside, "left_semi").withColumn("block", F.pmod(F.xxhash64("graph", "s", "p", "o"), F.lit(BLOCKS)))
    w = W.partitionBy("document", "block")
    first = block.withColumn("n", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= most)
    whole = W.partitionBy("document")
    total = F.sum(F.when(F.col("place") == 1, F.col("n"))).over(whole)
    kept = first.withColumn("total", total).withColumn("place", F.row_number().over(whole.orderBy(*order))).where(F.col("place") <= most)
    kept = kept.withColumn("left_out", F.greatest(F.col("total") - most, F.lit(0)))
    return small.select(*result, "left_out").unionByName(kept.select(*result, "left_out"))
