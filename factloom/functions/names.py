"""Names of things: short forms of IRIs, property keys, headers of notes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A block between lines of three dashes at the start of a text, closed within 8,192 characters.
HEADER = r"\A---[ \t]*\r?\n(?s:(.{0,8192}?))\r?\n---[ \t]*(?:\r?\n|\z)"


def curie(iri: Column, namespaces: Mapping[str, str]) -> Column:
    """prefix:rest by the longest namespace that the IRI starts with, else null."""
    known = sorted(namespaces.items(), key=lambda x: (-len(x[1]), x[0]))
    if not known:
        return F.lit(None).cast("string")
    table = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(uri).alias("uri")) for p, uri in known])
    fits = F.get(F.filter(table, lambda n: iri.startswith(n["uri"])), F.lit(0))
    return F.when(fits.isNotNull(), F.concat(fits["prefix"], F.lit(":"), F.substring(iri, F.length(fits["uri"]) + 1, F.length(iri))))


def bare_keys(properties: Column) -> Column:
    """Keys of a map that have no namespace, in order; none for null."""
    return F.coalesce(F.array_sort(F.filter(F.map_keys(properties), lambda k: ~k.contains(":"))), F.array().cast("array<string>"))


def header(text: Column) -> Column:
    """What stands between the dashes at the start of a note; null without such a block."""
    return F.when(text.rlike(HEADER), F.regexp_extract(text, HEADER, 1))


def without_header(text: Column) -> Column:
    return F.regexp_replace(text, HEADER, "")


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by single dashes."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))
