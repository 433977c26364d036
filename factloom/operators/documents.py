"""Chunking, packing, attribution and HTML text of documents and threads."""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.binding import let
from factloom.operators.shared import bounded_batches

#: Elements whose content nobody reads.
HIDDEN = ("script", "style", "nav", "footer", "header", "aside")
#: Names of characters, the common ones first, and those that need no semicolon, the longest first.
_NAMES = sorted(html.entities.html5, key=lambda n: (n not in ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;"), n))
_BARE = sorted((n for n in _NAMES if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers 128 to 159 stand for on pages.
_OLD = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def _numbered(n: Column) -> Column:
    """The character of a number; the replacement character for what is none."""
    code = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    wrong = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(wrong, F.lit("\ufffd")).when(n.between(0x80, 0x9F), F.get(F.lit(_OLD), (n - 0x80).cast("int"))).otherwise(code)


def unescaped(text: Column) -> Column:
    """text with references to characters, by name or number, resolved once."""
    names = F.map_from_arrays(F.lit(_NAMES), F.lit([html.entities.html5[n] for n in _NAMES]))
    bare = "^(?:" + "|".join(_BARE) + ")"

    def piece(p: Column) -> Column:
        decimal, hexadecimal = F.regexp_extract(p, "^#([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        whole, start = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(p, bare, 0)
        rest = lambda shape: F.regexp_replace(p, shape, "")
        return (
            F.when(decimal != "", F.concat(_numbered(decimal.try_cast("long")), rest("^#[0-9]+;?")))
            .when(hexadecimal != "", F.concat(_numbered(F.when(F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10).cast("long"))), rest("^#[xX][0-9a-fA-F]+;?")))
            .when(F.map_contains_key(names, whole), F.concat(F.element_at(names, whole), F.substring(p, F.length(whole) + 1, F.length(p))))
            .when(start != "", F.concat(F.element_at(names, start), F.substring(p, F.length(start) + 1, F.length(p))))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")).otherwise(text)


def plain_text(markup: Column) -> Column:
    """Markup as text: breaks and ends of paragraphs become line ends, other tags go, references are resolved."""
    text = F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n"), r"(?i)</p\s*>", "\n\n")
    return F.regexp_replace(F.regexp_replace(unescaped(F.regexp_replace(text, "<[^>]+>", "")), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def html_text(page: Column) -> Column:
    """Readable text of a page: no scripts, navigation or tags; references resolved; null stays null."""
    hidden = "|".join(rf"<{n}\b.*?</{n}\s*>" for n in HIDDEN)
    return plain_text(F.regexp_replace(page, f"(?is){hidden}", ""))


def paragraph_chunks(text: str | None, size: int) -> list[str]:
    """Windows of at most size characters, cut at the last blank line, else the
    last line end, else anywhere; white space around them and empty ones go."""
    out, at = [], 0
    text = text or ""
    while at < len(text):
        end = min(len(text), at + size)
        gap = 0
        if end < len(text):
            cut = text.rfind("\n\n", at, end)
            gap = 2
            if cut <= at:
                cut, gap = text.rfind("\n", at, end), 1
            if cut <= at:
                cut, gap = end, 0
            end = cut
        if chunk := text[at:end].strip():
            out.append(chunk)
        at = end + gap
    return out


def overlapping_chunks(text: str | None, size: int, lines: int) -> list[str]:
    """Windows of at most size characters, cut at the last line end, each after
    the last ``lines`` lines of the one before."""
    out, tail, at = [], [], 0
    text = text or ""
    while at < len(text):
        end = at + size
        if end < len(text) and (cut := text.rfind("\n", at, end)) > at:
            end = cut
        window = text[at:end]
        if chunk := "\n".join([*tail, window]).strip():
            out.append(chunk)
        tail = window.split("\n")[-lines:] if lines else []
        at = end
    return out


def chunked(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", overlap: int | None = None) -> DataFrame:
    """doc_id, ordinal, chunk, chunk_hash of every chunk; with ``overlap``, chunks
    repeat so many lines of the one before, else they end at paragraphs."""
    cut: Callable[[str | None], list[str]] = (lambda t: paragraph_chunks(t, size)) if overlap is None else (lambda t: overlapping_chunks(t, size, overlap))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = [cut(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chunks, pa.list_(pa.string()))], names=[doc_id, "chunks"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(doc_id, text)
    schema = T.StructType([rows.schema[doc_id], T.StructField("chunks", T.ArrayType(T.StringType()))])
    rows = rows.mapInArrow(windows, schema).select(doc_id, F.posexplode("chunks").alias("ordinal", "chunk"))
    return rows.withColumn("chunk_hash", F.sha2("chunk", 256))


#: Marks and lines of a wiki page that change with each fetch.
EDIT_MARK = r"(?i)\[\s*edit\s*\]"
FOOTER_LINE = r"(?im)^[ \t]*(?:This page was last (?:edited|modified)|Retrieved from|Last updated)\b[^\n]*$"


def without_drift(text: Column) -> Column:
    """text without what changes from one fetch to the next; twice is as good as once."""
    return F.regexp_replace(F.regexp_replace(text, EDIT_MARK, ""), FOOTER_LINE, "")


def chunk_yields(chunks: DataFrame, claims: DataFrame) -> DataFrame:
    """doc_id, ordinal, n of chunks(doc_id, ordinal, chunk_hash): the claims(doc_id, chunk_hash) of each, 0 without any."""
    counts = claims.groupBy("doc_id", "chunk_hash").agg(F.count("*").alias("n"))
    return chunks.join(counts, ["doc_id", "chunk_hash"], "left").select("doc_id", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))


def packed(costs: Column, most: int) -> Column:
    """The pack of each row of an array of costs: greedy, in order, at most ``most`` in a pack."""
    start = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("packs"))

    def add(a: Column, c: Column) -> Column:
        full = (a["used"] > 0) & (a["used"] + c > most)
        pack = F.when(full, a["pack"] + 1).otherwise(a["pack"])
        return F.struct(pack.alias("pack"), F.when(full, c).otherwise(a["used"] + c).alias("used"), F.concat(a["packs"], F.array(pack)).alias("packs"))

    return F.aggregate(costs, start, add)["packs"]


def attributed(claims: DataFrame, comments: DataFrame, least_shared: int = 2, least_coverage: float = 0.2) -> DataFrame:
    """claim_id, comment_id, shared: the comment that covers most of a claim's tokens.

    claims(claim_id, thread, tokens), comments(comment_id, thread, ordinal,
    tokens); a comment has to share least_shared tokens and cover least_coverage
    of them; the first comment wins ties. Tokens meet within their thread only.
    """
    c = claims.select("claim_id", "thread", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    m = comments.select("comment_id", "thread", "ordinal", F.explode("tokens").alias("token"))
    shared = c.join(m, ["thread", "token"]).groupBy("claim_id", "comment_id", "ordinal").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    fits = shared.where((F.col("shared") >= least_shared) & (F.col("shared") >= F.col("n") * least_coverage))
    best = fits.groupBy("claim_id").agg(F.max_by(F.struct("comment_id", "shared"), F.struct(F.col("shared"), -F.col("ordinal"))).alias("x"))
    return best.select("claim_id", "x.comment_id", "x.shared")
