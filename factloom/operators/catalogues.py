"""Catalogue records as claims: concepts of coinage, issuers' lists, listing pages, and artefacts that are no claims."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.binding import let
from factloom.operators.shared import bounded_batches

#: Classes of concepts, and where concepts and pieces live.
CONCEPTS = ("nmo:Material", "nmo:Denomination", "nmo:Mint", "nmo:Authority", "nmo:Issuer", "nmo:ObjectType", "nmo:NumismaticObject", "nmo:Region", "nmo:Collection")
CONCEPT_BASE = "http://nomisma.org/id/"
PIECE_PAGE = "https://en.numista.com/catalogue/pieces"

_NODE = "array<struct<`@id`:string,`@type`:string,`skos:prefLabel`:string,`skos:definition`:string,`skos:exactMatch`:string,`skos:closeMatch`:string,`geo:lat`:string,`geo:long`:string>>"


def _listed(raw: Column) -> Column:
    """A JSON value as an array of the JSON of its elements: one that isn't a list alone, none for null."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def english(raw: Column) -> Column:
    """The first English value that isn't empty, from one value object or a list of them; null without any."""
    fits = F.filter(_listed(raw), lambda x: (F.get_json_object(x, "$['@language']") == "en") & (F.get_json_object(x, "$['@value']") != ""))
    return F.get_json_object(F.get(fits, F.lit(0)), "$['@value']")


def references(raw: Column) -> Column:
    return F.array_compact(F.transform(_listed(raw), lambda x: F.get_json_object(x, "$['@id']")))


def expanded(name: Column, prefixes: Column) -> Column:
    """A prefixed name as an IRI by a map of prefixes; others stay."""
    base = F.try_element_at(prefixes, F.substring_index(name, ":", 1))
    rest = F.substring(name, F.length(F.substring_index(name, ":", 1)) + 2, F.length(name))
    return F.when(name.rlike("^https?://") | base.isNull(), name).otherwise(F.concat(base, rest))


def _number(raw: Column) -> Column:
    return F.coalesce(F.get_json_object(raw, "$['@value']"), raw).try_cast("double")


def concept_claims(records: DataFrame, blob: str) -> DataFrame:
    """iri, label, class, content, definition, exact_match, close_match, lat, long, predicate, object, confidence: one claim on each concept.

    The concept is the first node below CONCEPT_BASE (or the prefix nm) without a
    fragment; its place is the node with the fragment #this. Of exact matches one
    of Wikidata is preferred, of close ones one of Getty. Records without a
    concept give none.
    """
    doc = F.col(blob)
    nodes = F.from_json(F.when(doc.startswith("["), doc).otherwise(F.coalesce(F.get_json_object(doc, "$['@graph']"), F.lit("[]"))), _NODE)
    prefixes = F.coalesce(F.from_json(F.get_json_object(doc, "$['@context']"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = records.select(nodes.alias("nodes"), prefixes.alias("prefixes"))
    base = F.coalesce(F.try_element_at("prefixes", F.lit("nm")), F.lit(CONCEPT_BASE))
    own = F.get(F.filter("nodes", lambda n: let(expanded(n["@id"], F.col("prefixes")), lambda i: F.startswith(i, base) & ~F.contains(i, F.lit("#")))), F.lit(0))
    rows = rows.withColumn("n", own).where("n IS NOT NULL").withColumn("iri", expanded(F.col("n.`@id`"), F.col("prefixes")))
    place = F.get(F.filter("nodes", lambda n: n["@id"] == F.concat("iri", F.lit("#this"))), F.lit(0))
    name = F.regexp_extract("iri", r"([^/#]+)$", 1)
    kinds = F.coalesce(F.when(F.col("n.`@type`").startswith("["), F.from_json("n.`@type`", "array<string>")), F.array("n.`@type`"))
    kind = F.coalesce(F.get(F.filter(kinds, lambda k: k.isin(*CONCEPTS)), F.lit(0)), F.lit("nmo:Concept"))
    exact, close = references(F.col("n.`skos:exactMatch`")), references(F.col("n.`skos:closeMatch`"))
    first = lambda refs, site: F.coalesce(F.get(F.filter(refs, lambda r: F.contains(r, F.lit(site))), F.lit(0)), F.when(F.size(refs) > 0, F.array_join(refs, " ")))
    rows = rows.select(
        "iri", F.coalesce(english(F.col("n.`skos:prefLabel`")), F.translate(name, "_", " ")).alias("label"), kind.alias("class"), english(F.col("n.`skos:definition`")).alias("definition"),
        first(exact, "wikidata.org").alias("exact_match"), first(close, "getty.edu").alias("close_match"), _number(place["geo:lat"]).alias("lat"), _number(place["geo:long"]).alias("long"),
    )
    short = F.substring_index("class", ":", -1)
    described = F.concat("label", F.lit(" (Nomisma "), short, F.lit("): "), "definition")
    plain = F.concat("label", F.lit(" is a "), short, F.lit(" in the Nomisma numismatic ontology."))
    return rows.select(
        "iri", "label", "class", F.coalesce(described, plain).alias("content"), "definition", "exact_match", "close_match", "lat", "long",
        F.when(F.col("definition").isNotNull(), "http://www.w3.org/2004/02/skos/core#definition").otherwise("rdf:type").alias("predicate"), F.coalesce("definition", "class").alias("object"), F.lit(0.99).alias("confidence"),
    )


def years(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull(), F.when(high.isNull() | (high == low), low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string"))))


def coin_label(title: Column, low: Column, high: Column, suffix: Column) -> Column:
    """The name of a coin: its title, its years if both are known, its issuer."""
    both = F.when((low != 0) & (high != 0), F.concat(F.lit(" ("), years(low, high), F.lit(")"))).otherwise("")
    return F.trim(F.concat(title, F.coalesce(both, F.lit("")), F.lit(" "), F.coalesce(suffix, F.lit(""))))


def issuer_suffix(code: Column, name: Column, short: Mapping[str, str]) -> Column:
    """The short name of an issuer by its code, else its name."""
    known = F.map_from_arrays(F.lit(list(short)), F.lit(list(short.values()))) if short else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, F.lower(code)), name)


def _summary(material: Column, weight: Column, size: Column) -> Column:
    parts = F.concat_ws(", ", F.concat(F.lit("made of "), F.lower(material)), F.concat(F.lit("weight "), weight.cast("string"), F.lit("g")), F.concat(F.lit("diameter "), size.cast("string"), F.lit("mm")))
    return F.concat(F.col("label"), let(parts, lambda p: F.when(p == "", ".").otherwise(F.concat(F.lit(": "), p, F.lit(".")))))


ISSUER = "issuer_code string, issuer_name string, types array<struct<id:string,title:string,min_year:double,max_year:double,type:string,object_type:struct<name:string>,composition:string,weight:double,size:double,`references`:array<struct<catalogue:struct<code:string>,number:string>>>>"


def issuer_claims(records: DataFrame, blob: str, short: Mapping[str, str]) -> DataFrame:
    """coin, kind (infobox or reference), content, subjects, confidence of an issuer's list: one infobox for
    each coin with a title and one claim for each of its catalogue numbers."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = records.select(F.from_json(blob, ISSUER).alias("r")).select(some(F.col("r.issuer_name")).alias("issuer"), issuer_suffix(F.col("r.issuer_code"), F.col("r.issuer_name"), short).alias("suffix"), F.explode("r.types").alias("c")).where("trim(c.title) <> ''")
    low, high = F.col("c.min_year").cast("int"), F.col("c.max_year").cast("int")
    material = some(F.coalesce(F.get_json_object("c.composition", "$.text"), F.when(~F.col("c.composition").startswith("{"), F.col("c.composition"))))
    kind = F.coalesce(some(F.col("c.type")), some(F.col("c.object_type.name")))
    refs = F.array_compact(F.transform("c.references", lambda x: F.when((x["catalogue"]["code"] != "") & (x["number"] != ""), F.concat(x["catalogue"]["code"], F.lit("# "), x["number"]))))
    rows = r.select("issuer", F.col("c.id").alias("coin"), coin_label(F.trim("c.title"), low, high, F.col("suffix")).alias("label"), kind.alias("type"), material.alias("material"), "c.weight", "c.size", F.coalesce(refs, F.array().cast("array<string>")).alias("refs"))
    return _infobox_and_references(rows, 0.90)


def _infobox_and_references(rows: DataFrame, confidence: float) -> DataFrame:
    subjects = F.array_distinct(F.array_compact(F.array("label", "issuer", "type", "material")))
    box = F.struct(F.lit("infobox").alias("kind"), _summary(F.col("material"), F.col("weight"), F.col("size")).alias("content"), subjects.alias("subjects"))
    named = F.transform("refs", lambda x: F.struct(F.lit("reference").alias("kind"), F.concat(F.col("label"), F.lit(" is catalogued as "), x, F.lit(".")).alias("content"), F.array("label").alias("subjects")))
    return rows.select("coin", F.explode(F.concat(F.array(box), named)).alias("x")).select("coin", "x.*", F.lit(confidence).alias("confidence"))


#: Lines of a piece that give its years, and its material, weight and size.
_YEARS, _PHYSICAL = re.compile(r"(\d{4})(?:-(\d{4}))?"), re.compile(r"^(.+?)\s*•\s*([\d.]+)\s*g\s*•\s*⌀\s*([\d.]+)\s*mm", re.IGNORECASE)


class _Pieces(HTMLParser):
    """The pieces of a listing page: flag image, link, type and text of each."""

    def __init__(self) -> None:
        super().__init__()
        self.pieces: list[dict] = []
        self.depth = 0
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "div":
            if not self.depth and "description_piece" in a.get("class", ""):
                self.pieces.append({"text": [], "type": "", "href": None, "flag": None})
                self.depth = 1
            elif self.depth:
                self.depth += 1
        if not self.depth:
            return
        piece = self.pieces[-1]
        if tag == "img" and "/design/pays/" in a.get("src", "") and piece["flag"] is None:
            piece["flag"] = (a["src"].split("/design/pays/")[1].split(".")[0], a.get("title", ""))
        if tag == "a" and "strong" in self.inside and piece["href"] is None:
            piece["href"] = a.get("href", "").strip("/")
        if tag in ("strong", "em"):
            self.inside.append(tag)
        if tag in ("br", "p", "div"):
            piece["text"].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            self.inside.remove(tag)
        if tag == "div" and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth:
            self.pieces[-1]["text"].append(data)
            if "em" in self.inside:
                self.pieces[-1]["type"] += data


def listing_claims(pages: DataFrame, html: str, short: Mapping[str, str]) -> DataFrame:
    """coin, kind, content, subjects, confidence: one infobox for each piece of a listing page that
    links to a number. The first flag names the issuer of the page."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"coin": pa.string(), "code": pa.string(), "issuer": pa.string(), "title": pa.string(), "low": pa.int32(), "high": pa.int32(), "type": pa.string(), "material": pa.string(), "weight": pa.float64(), "size": pa.float64()}
        for b in batches:
            rows = [row for page in b.column(0).to_pylist() for row in _listed_pieces(page or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    bounded_batches(pages.sparkSession)
    rows = pages.select(html).mapInArrow(read, "coin string, code string, issuer string, title string, low int, high int, type string, material string, weight double, size double")
    label = coin_label(F.col("title"), F.col("low"), F.col("high"), issuer_suffix(F.col("code"), F.col("issuer"), short))
    rows = rows.withColumns({"label": label, "refs": F.array().cast("array<string>"), "issuer": F.nullif("issuer", F.lit("")), "type": F.nullif("type", F.lit(""))})
    return _infobox_and_references(rows, 0.92)


def _listed_pieces(page: str) -> list[dict]:
    reader = _Pieces()
    reader.feed(page)
    code, issuer = next((p["flag"] for p in reader.pieces if p["flag"]), ("", ""))
    out = []
    for p in reader.pieces:
        lines = [x.strip() for x in "".join(p["text"]).splitlines() if x.strip()]
        if not (p["href"] or "").isdigit() or len(lines) < 2:
            continue
        at = _YEARS.match(lines[1])
        low = int(at[1]) if at else None
        body = next((m for m in (_PHYSICAL.match(x.replace("\xa0", " ")) for x in lines[2:]) if m), None)
        kind = p["type"].strip().replace("Coins › ", "").replace("Coins > ", "").strip()
        out.append({"coin": p["href"], "code": code, "issuer": issuer, "title": lines[0], "low": low, "high": int(at[2]) if at and at[2] else low, "type": kind, "material": body[1].strip() if body else None, "weight": float(body[2]) if body else None, "size": float(body[3]) if body else None})
    return out


#: The published shapes of a taxonomy and of a trust lens.
TAXONOMY = "taxonomy_id string, name string, version string, author string, domain string, tags array<struct<tag:string,parent:string,aliases:array<string>,description:string>>, published_at string, corpus_entry_id string"
TRUST_LENS = (
    "kind string, lens_id string, name string, version string, publisher string, description string, statements array<struct<domain:string,source_type:string,trust_rank:double,basis:string>>, url_rules array<struct<scope:string,pattern:string,score:double,modifier:double>>, "
    "extractor_weights map<string,double>, decay_rules array<struct<scope:string,pattern:string,half_life_days:double,floor:double>>, utility_rules array<struct<scope:string,pattern:string,half_life_uses_days:double,rank_lift:double>>, corpus_entry_id string"
)


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _unit(c: Column) -> Column:
    return F.coalesce(c.between(0, 1), F.lit(False))


def _any(items: Column, wrong: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(items, wrong), F.lit(False))


def _taxonomy_faults(a: Column) -> list[tuple[Column, str]]:
    def astray(t: Column) -> Column:
        parent = F.regexp_replace(t["tag"], "/[^/]*$", "")
        return F.when(F.contains(t["tag"], F.lit("/")), ~t["parent"].eqNullSafe(parent)).otherwise(t["parent"].isNotNull())

    return [
        (~_some(a["name"]), "no name"), (~_some(a["version"]), "no version"), (~_some(a["author"]), "no author"), (a["tags"].isNull(), "no tags"),
        (_any(a["tags"], lambda t: ~_some(t["tag"])), "a tag without a name"), (_any(a["tags"], astray), "a tag whose parent isn't its path"),
    ]


def _lens_faults(a: Column) -> list[tuple[Column, str]]:
    def rule(r: Column) -> Column:
        whole = (r["scope"] == "domain") & _unit(r["score"]) & r["modifier"].isNull() | (r["scope"] == "url_pattern") & r["score"].isNull() & r["modifier"].isNotNull()
        return ~(F.coalesce(whole, F.lit(False)) & _some(r["pattern"]))

    def decay(r: Column) -> Column:
        return ~(F.coalesce(r["scope"].isin("source_type", "url_pattern") & (r["half_life_days"] > 0), F.lit(False)) & _some(r["pattern"]) & _unit(r["floor"]))

    def utility(r: Column) -> Column:
        scope = F.coalesce(r["scope"], F.lit("default"))
        place = F.when(scope == "default", r["pattern"].isNull()).when(scope.isin("source_type", "url_pattern"), _some(r["pattern"])).otherwise(False)
        return ~(place & F.coalesce((r["half_life_uses_days"] > 0) & (r["rank_lift"] >= 0), F.lit(False)))

    version = a["version"].try_cast("bigint")
    return [
        (F.coalesce(a["kind"], F.lit("TrustLensDefinition")) != "TrustLensDefinition", "another kind"), (~_some(a["name"]), "no name"), (a["version"].isNull(), "no version"), (F.coalesce(version < 1, F.lit(True)), "version below 1"),
        (_any(a["statements"], lambda s: ~_some(s["domain"]) | ~_some(s["source_type"])), "a statement without domain or source type"), (_any(a["statements"], lambda s: ~_unit(s["trust_rank"])), "trust rank out of range"),
        (_any(a["url_rules"], rule), "a URL rule that isn't one of domain and score or pattern and modifier"), (_any(F.map_values(a["extractor_weights"]), lambda w: ~_unit(w)), "extractor weight out of range"),
        (_any(a["decay_rules"], decay), "a decay rule that can't hold"), (_any(a["utility_rules"], utility), "a utility rule that can't hold"),
    ]


_FAULTS = {TAXONOMY: _taxonomy_faults, TRUST_LENS: _lens_faults}


def artefacts(records: DataFrame, blob: str, schema: str, entry: str = "entry_id") -> DataFrame:
    """entry, artefact, note of definitions (TAXONOMY, TRUST_LENS): they give no claims.

    artefact is null and note says the first fault where the JSON can't be read
    as one, or breaks a rule of its kind: names and versions that are there,
    ranks, scores, weights and floors from 0 to 1, tags whose parent is their
    path, rules that have what their scope asks for and nothing else.
    """
    a = F.from_json(blob, schema)
    is_object = F.coalesce(F.trim(blob).startswith("{"), F.lit(False)) & a.isNotNull()
    rows = records.select(entry, a.alias("artefact"), is_object.alias("read"))
    note = F.when(~F.col("read"), "no object")
    for wrong, why in _FAULTS[schema](F.col("artefact")):
        note = note.when(wrong, why)
    return rows.select(entry, "artefact", note.alias("note")).withColumn("artefact", F.when(F.col("note").isNull(), F.col("artefact")))
