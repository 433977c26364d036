"""Turtle, TriG, N-Triples and N-Quads documents as rows of triples.

A document is read whole, since prefixes, the base and blank nodes hold across
its lines: a lexer of one pattern and a grammar of a method for each production.
Documents are dealt over tasks; Python gets them in batches of bounded bytes.
Nothing outside the document is ever opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.shared import bounded_batches

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
#: Syntaxes by the end of a name, and the bytes of a document that are read at most.
SUFFIXES = {".ttl": "turtle", ".turtle": "turtle", ".nt": "turtle", ".trig": "turtle", ".nq": "quads", ".jsonld": "json", ".rdf": "xml", ".owl": "xml"}
MOST_BYTES = 16 * 1024 * 1024

_LEXEMES = {
    "iri": r'<(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>',
    "text": r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""|\'\'\'(?:\'{0,2}(?:[^\'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|\'(?:[^\'\\\n\r]|\\.)*\'',
    "at": r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*",
    "datatype": r"\^\^",
    "blank": r"_:[\w](?:[\w.\-\u00B7]*[\w\-\u00B7])?",
    "double": r"[+-]?(?:\d+\.\d*|\.?\d+)[eE][+-]?\d+",
    "decimal": r"[+-]?\d*\.\d+",
    "integer": r"[+-]?\d+",
    "name": r"(?:[^\W\d_](?:[\w.\-\u00B7]*[\w\-\u00B7])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-\u00B7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-\u00B7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?",
    "word": r"[A-Za-z]+",
    "mark": r"[.;,\[\](){}]",
}
_SKIP = r"(?:\s+|\#[^\n\r]*)*+"
_LEXER = re.compile(_SKIP + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _LEXEMES.items()) + ")", re.DOTALL)
_BETWEEN = re.compile(_SKIP)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_SINGLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Unreadable(ValueError):
    pass


class Term(NamedTuple):
    kind: str  # iri, blank or literal
    value: str
    datatype: str | None = None
    lang: str | None = None


def _plain(text: str) -> str:
    """Text without its escapes."""

    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] in "uU" and len(code) > 1:
            if 0xD800 <= int(code[1:], 16) < 0xE000 or int(code[1:], 16) > 0x10FFFF:
                raise Unreadable(f"no character {m[0]}")
            return chr(int(code[1:], 16))
        if code not in _SINGLE:
            raise Unreadable(f"no escape {m[0]}")
        return _SINGLE[code]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Document:
    """The triples, with their graph, and the prefixes of one document."""

    def __init__(self, text: str, base: str = "", quads: bool = False) -> None:
        self.base, self.quads = base, quads
        self.prefixes: dict[str, str] = {}
        self.triples: list[tuple[Term, Term, Term, str | None]] = []
        self.graph: str | None = None
        self.fresh = 0
        self.lexemes = self._lexed(text.removeprefix("\ufeff"))
        self._next()
        while self.kind != "end":
            self._statement()

    @staticmethod
    def _lexed(text: str) -> Iterator[tuple[str, str]]:
        at, match = 0, _LEXER.scanner(text).match  # goes on where the last lexeme ended
        while m := match():
            at, kind = m.end(), m.lastgroup
            yield kind, m[kind]
        at = _BETWEEN.match(text, at).end()
        if at < len(text):
            raise Unreadable(f"nothing begins with {text[at : at + 20]!r} at {at}")
        yield "end", ""

    def _next(self) -> None:
        self.kind, self.said = next(self.lexemes)

    def _mark(self, mark: str) -> None:
        if self.kind != "mark" or self.said != mark:
            raise Unreadable(f"{mark!r} expected, not {self.said!r}")
        self._next()

    def _is(self, mark: str) -> bool:
        return self.kind == "mark" and self.said == mark

    def _iri(self) -> str:
        if self.kind == "iri":
            value = _plain(self.said[1:-1])
            value = value if _SCHEME.match(value) else urljoin(self.base, value)
        elif self.kind == "name":
            prefix, _, local = self.said.partition(":")
            if prefix not in self.prefixes:
                raise Unreadable(f"no prefix {prefix!r}")
            value = self.prefixes[prefix] + (re.sub(r"\\(.)", r"\1", local) if "\\" in local else local)
        else:
            raise Unreadable(f"an IRI expected, not {self.said!r}")
        self._next()
        return value

    def _statement(self) -> None:
        word = self.said.lower() if self.kind in ("at", "word") else ""
        dotted = self.kind == "at"
        if word.lstrip("@") in ("prefix", "base"):
            self._next()
            if word.endswith("prefix"):
                prefix = self.said[:-1]
                if self.kind != "name" or not self.said.endswith(":"):
                    raise Unreadable(f"a prefix expected, not {self.said!r}")
                self._next()
                self.prefixes[prefix] = self._iri()
            else:
                self.base = self._iri()
            if dotted:
                self._mark(".")
        elif word == "graph":
            self._next()
            self._block(self._resource().value)
        elif self._is("{"):
            self._block(None)
        elif self._is("["):
            subject, alone = self._nested(), self._is(".")
            if self._is("{"):
                self._block(subject.value)
            else:
                if not alone:
                    self._about(subject)
                self._mark(".")
        else:
            subject = self._collection() if self._is("(") else self._resource()
            if self._is("{"):
                self._block(subject.value)
            else:
                self._about(subject)
                self._mark(".")

    def _block(self, graph: str | None) -> None:
        self._mark("{")
        self.graph = graph
        while not self._is("}"):
            if self._is("["):
                subject = self._nested()
                if not (self._is(".") or self._is("}")):
                    self._about(subject)
            else:
                self._about(self._collection() if self._is("(") else self._resource())
            if not self._is("}"):
                self._mark(".")
        self._next()
        self.graph = None

    def _resource(self) -> Term:
        if self.kind == "blank":
            term = Term("blank", self.said)
            self._next()
            return term
        return Term("iri", self._iri())

    def _about(self, subject: Term) -> None:
        """Predicates with their objects; a semicolon may end the list."""
        while True:
            if self.kind == "word" and self.said == "a":
                self._next()
                predicate = Term("iri", RDF + "type")
            else:
                predicate = Term("iri", self._iri())
            while True:
                value = self._object()
                graph = self.graph
                if self.quads and self.kind in ("iri", "blank"):
                    graph = self._resource().value
                self.triples.append((subject, predicate, value, graph))
                if not self._is(","):
                    break
                self._next()
            more = False
            while self._is(";"):
                more = True
                self._next()
            if not more or self.kind == "mark" or self.kind == "end":
                return

    def _new(self) -> Term:
        self.fresh += 1
        return Term("blank", f"_:.{self.fresh}")  # no label begins with a dot

    def _nested(self) -> Term:
        self._mark("[")
        node = self._new()
        if not self._is("]"):
            self._about(node)
        self._mark("]")
        return node

    def _collection(self) -> Term:
        self._mark("(")
        first, last = Term("iri", RDF + "nil"), None
        while not self._is(")"):
            value, node = self._object(), self._new()
            if last:
                self.triples.append((last, Term("iri", RDF + "rest"), node, self.graph))
            else:
                first = node
            self.triples.append((node, Term("iri", RDF + "first"), value, self.graph))
            last = node
        self._next()
        if last:
            self.triples.append((last, Term("iri", RDF + "rest"), Term("iri", RDF + "nil"), self.graph))
        return first

    def _object(self) -> Term:
        if self._is("["):
            return self._nested()
        if self._is("("):
            return self._collection()
        kind, said = self.kind, self.said
        if kind in ("integer", "decimal", "double") or kind == "word" and said in ("true", "false"):
            self._next()
            return Term("literal", said, XSD + (kind if kind != "word" else "boolean"))
        if kind != "text":
            return self._resource()
        self._next()
        edge = 3 if said[:3] in ('"""', "'''") and len(said) >= 6 else 1
        value = _plain(said[edge:-edge])
        if self.kind == "at":
            lang = self.said[1:].lower()
            self._next()
            return Term("literal", value, None, lang)
        if self.kind == "datatype":
            self._next()
            return Term("literal", value, self._iri())
        return Term("literal", value)


def syntaxes(name: str | None, head: bytes) -> list[str]:
    """Syntaxes to try, by the end of the name, then by how the bytes begin."""
    path = (name or "").split("?")[0].split("#")[0].lower()
    hinted = [s for end, s in SUFFIXES.items() if path.endswith(end)]
    start = head.lstrip()
    if start[:1] in (b"{", b"[") and b"@context" in head:
        hinted.append("json")
    if start.startswith(b"<?xml") or b"<rdf:RDF" in head:
        hinted.append("xml")
    return list(dict.fromkeys([*hinted, "turtle", "quads"]))


def parsed(body: bytes | None, name: str | None, most: int = MOST_BYTES) -> tuple[Document | None, str | None]:
    """(document, why there is none)."""
    body = body or b""
    if len(body) > most:
        return None, f"{len(body)} bytes, over the limit of {most}"
    whys = []
    for syntax in syntaxes(name, body[:2048]):
        if syntax in ("json", "xml"):
            whys.append(f"{syntax}: not read")
            continue
        try:
            found = Document(body.decode(), base=name if name and "://" in name else "", quads=syntax == "quads")
        except (Unreadable, UnicodeDecodeError, RecursionError) as e:
            whys.append(f"{syntax}: {e}")
            continue
        if found.triples:
            return found, None
        whys.append(f"{syntax}: no triples")
    return None, "; ".join(whys)


TRIPLES = "s string, p string, o string, kind string, datatype string, lang string, graph string, note string"
_ROWS = 20_000
#: Documents that a task reads, about: bodies made from a small table would all lie in one.
DOCUMENTS_PER_TASK = 5_000


def read_graphs(docs: DataFrame, document: str, body: str, name: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """document, s, p, o, kind, datatype, lang, graph, note of every document's triples.

    kind is the object's: iri, blank or literal. Blank nodes begin with ``_:``
    and hold within the document; a triple that stands twice in one graph is two
    rows. A row of kind prefix has a prefix as s and its IRI as o. A document
    that can't be read has one row whose note says why, in every syntax that was
    tried: none of it is taken. ``name`` (a column) gives the syntax by its end
    and, if it is an address, the base; ``body`` is binary or a string. Documents
    that lie in too few partitions are dealt anew. Every use of the result reads
    the documents again: write it where it is used more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("document", pa.string()), *((x.split()[0], pa.string()) for x in TRIPLES.split(", "))])
        held: list[tuple] = []
        for b in batches:
            for key, raw, said in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, why = parsed(raw, said, most_bytes)
                if found is None:
                    held.append((key, *[None] * 7, why))
                else:
                    held += [(key, prefix, None, iri, "prefix", None, None, None, None) for prefix, iri in found.prefixes.items()]
                    held += [(key, s.value, p.value, o.value, o.kind, o.datatype, o.lang, g, None) for s, p, o, g in found.triples]
                while len(held) >= _ROWS:
                    yield _rows(held[:_ROWS], kinds)
                    held = held[_ROWS:]
        if held:
            yield _rows(held, kinds)

    bounded_batches(docs.sparkSession)
    told = F.col(name) if name else F.lit(None).cast("string")
    tasks = 1 + docs.count() // DOCUMENTS_PER_TASK
    if docs.rdd.getNumPartitions() < tasks:
        docs = docs.repartition(tasks, document)
    rows = docs.select(F.col(document).cast("string").alias("document"), F.col(body).cast("binary").alias("body"), told.alias("name"))
    return rows.mapInArrow(run, T.StructType.fromDDL(f"document string, {TRIPLES}"))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
