"""Claims as Markdown: lines from rows, documents from groups."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.shared import Tables, bounded_batches

#: Call-out by status.
CALLOUTS = {"ACTIVE": "note", "SUPERSEDED": "abstract", "RETRACTED": "failure", "INCONSISTENCY": "warning", "PROVENANCE_STALE": "question"}


def claim_line(content: Column, status: Column, confidence: Column, location: Column) -> Column:
    kind = F.coalesce(*[F.when(status == s, k) for s, k in CALLOUTS.items()], F.lit("note"))
    head = F.concat(F.lit("> [!"), kind, F.lit("] "), F.regexp_replace(content, r"\s*\n\s*", " "))
    return F.concat_ws("\n", head, F.concat(F.lit("> confidence "), F.format_string("%.2f", confidence)), F.when(location.isNotNull(), F.concat(F.lit("> source "), location)))


def memory_bullet(content: Column, short_id: Column, bases: Column) -> Column:
    flat = F.trim(F.regexp_replace(content, r"\s+", " "))
    return F.concat(F.lit("- "), F.when(F.size(bases) > 0, F.concat(F.lit("[contested: "), F.array_join(F.array_sort(bases), ", "), F.lit("] "))).otherwise(""), flat, F.lit(" (p-"), short_id, F.lit(")"))


def sources_trailer(ids: Column) -> Column:
    """The distinct short ids, sorted, or null without any."""
    return F.when(F.size(ids) > 0, F.concat(F.lit("Sources: "), F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda i: F.concat(F.lit("p-"), i)), ", ")))


def documents(claims: DataFrame, group: Sequence[str], line: str, order: Sequence[str]) -> DataFrame:
    """One document for each group: its lines in order, a blank line between."""
    rows = claims.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, line))).alias("rows"))
    return rows.select(*group, F.array_join(F.transform("rows", lambda r: r[line]), "\n\n").alias("document"))


def document_parts(claims: DataFrame, group: Sequence[str], line: str, order: Sequence[str], most: int = 1_000_000) -> DataFrame:
    """The documents of ``documents`` in parts: the group's columns, part (0, 1, ...), lines, document.

    A group's parts in order, with a blank line between, are its document. A
    part holds at most ``most`` characters, or one line. Rows are dealt by
    ranges of group and order, so a large group is spread over tasks; a part
    also ends where a range ends.
    """
    rows = claims.where(F.col(line).isNotNull()).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order, line)
    rows = rows.withColumn("_range", F.spark_partition_id()).select(*group, "_range", line)
    kinds = [rows.schema[g] for g in group]
    schema = T.StructType([*kinds, T.StructField("_range", T.IntegerType()), T.StructField("_nth", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("document", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, nth, held, size = None, 0, [], 0
        like = None

        def part() -> pa.RecordBatch:
            values = [*of, nth, len(held), "\n\n".join(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, like, strict=True)], names=schema.names)

        for batch in batches:
            like = [*batch.schema.types[:-1], pa.int64(), pa.int64(), pa.string()]
            for *key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (key != of or size + 2 + len(text) > most):
                    yield part()
                    nth, held, size = (nth + 1 if key == of else 0), [], 0
                of, size = key, size + 2 * bool(held) + len(text)
                held.append(text)
        if held:
            yield part()

    bounded_batches(rows.sparkSession)
    parts = Tables(rows.sparkSession).written(rows.mapInArrow(cut, schema))  # the ranges are drawn once
    counts = parts.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    for c in (*group, "_range"):
        same &= F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}"))
    return parts.alias("p").join(F.broadcast(before.alias("b")), same).select(*[F.col(f"p.{g}") for g in group], (F.col("_before") + F.col("_nth")).alias("part"), "lines", "document")


def subject_names(subjects: DataFrame, name: str, qualifiers: Sequence[str]) -> DataFrame:
    """subjects with ``page``: the slug, with the first qualifier that tells all of its namesakes apart."""
    slug = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "-")
    rows = subjects.withColumn("slug", slug)
    counts = [F.count("*").alias("m")] + [F.count_distinct(F.when(F.col(q) != "", F.col(q))).alias(f"d_{q}") for q in qualifiers]
    rows = rows.join(rows.groupBy("slug").agg(*counts), "slug")
    tier = F.coalesce(*[F.when(F.col(f"d_{q}") == F.col("m"), F.col(q).cast("string")) for q in qualifiers], F.lit("?"))
    page = F.when(F.col("m") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.regexp_replace(F.lower(tier), r"[^\p{L}\p{N}]+", "-")))
    return rows.withColumn("page", page).drop("m", *[f"d_{q}" for q in qualifiers])


#: Call-outs of findings by severity, and marks around what a store has rendered into a file.
SEVERITIES = {"ERROR": "failure", "WARNING": "warning", "INFO": "info"}
REGION, REGION_END = r"<!--\s*BEGIN PROJECTED:\s*([^\s(]+)\s*\(manifest:\s*([^)]*?)\s*\)\s*-->", r"<!--\s*END PROJECTED:\s*{}\s*-->"
#: Characters of a narrative's slug.
MOST_SLUG = 80


def stance_callout(positions: Column) -> Column:
    """Who endorses and who disputes a claim, as a call-out; empty for nobody.

    positions: array of struct(kind, holder, confidence, magnitude, stance_id),
    in the order to show.
    """

    def line(p: Column) -> Column:
        strength = F.coalesce(F.format_string(", magnitude %.2f", p["magnitude"]), F.lit(""))
        strength = F.when(p["magnitude"].isNotNull(), strength).otherwise("")
        return F.concat(F.lit("> - "), p["holder"], F.format_string(" (conf %.2f", p["confidence"]), strength, F.lit(") `"), F.substring_index(p["stance_id"], "-", 1), F.lit("`"))

    def block(kind: str, title: str) -> Column:
        own = F.filter(positions, lambda p: p["kind"] == kind)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"> **{title}:**\n"), F.array_join(F.transform(own, line), "\n")))

    head = F.lit("> [!agreement] Positions on this claim (query-time; not factual confidence)")
    tail = F.lit("> _Holders are unverified raw keys — a count of keys, not verified agents._")
    return F.when(F.size(positions) > 0, F.concat_ws("\n", head, block("ENDORSES", "Endorses"), block("DISPUTES", "Disputes"), tail)).otherwise("")


def finding_callout(kind: Column, severity: Column, detail: Column, reference: Column, action: Column) -> Column:
    callout = F.coalesce(*[F.when(severity == s, F.lit(c)) for s, c in SEVERITIES.items()], F.lit("note"))
    return F.concat_ws(
        "\n", F.concat(F.lit("> [!"), callout, F.lit("] Lint ["), kind, F.lit("] — "), severity), F.concat(F.lit("> **Detail:** "), detail),
        F.concat(F.lit("> **Reference:** `"), F.coalesce(reference, F.lit("—")), F.lit("`")), F.when(F.coalesce(action, F.lit("")) != "", F.concat(F.lit("> **Action:** "), action)),
    )


def digests(beliefs: DataFrame, top: int) -> DataFrame:
    """store, digest: the first beliefs of each store by confidence, then id, and how many there are.

    beliefs(store, id, content, confidence, asserted_on, subjects, bases). Each
    task keeps the first of its own rows, so a store is never in one task whole.
    """
    totals = beliefs.groupBy("store").agg(F.count("*").alias("total"))
    order = [F.desc("confidence"), F.asc("id")]
    local = beliefs.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(W.partitionBy("store", "_block").orderBy(*order))).where(F.col("_n") <= top)
    first = local.withColumn("_n", F.row_number().over(W.partitionBy("store").orderBy(*order))).where(F.col("_n") <= top)
    subjects = F.when(F.size("subjects") > 0, F.concat(F.lit(" _("), F.array_join("subjects", ", "), F.lit(")_"))).otherwise("")
    contested = F.when(F.size("bases") > 0, F.concat(F.lit(" · contested ("), F.array_join("bases", ", "), F.lit(")"))).otherwise("")
    line = F.concat(F.format_string("- **%.2f** ", F.col("confidence")), "content", subjects, F.lit(" · "), F.date_format("asserted_on", "yyyy-MM-dd"), contested)
    rows = first.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("rows")).join(totals, "store")
    n = F.size("rows")
    head = F.format_string("# Memory digest — %s\n\n_%d of %d ACTIVE belief(s), ranked by effective confidence._\n", F.col("store"), n, F.col("total"))
    left = F.when(n < F.col("total"), F.format_string("\n\n_Showing the top %d of %d by effective confidence; %d not shown._", n, F.col("total"), F.col("total") - n)).otherwise("")
    return rows.select("store", F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), left, F.lit("\n")).alias("digest"))


def narrative_names(narratives: DataFrame, claim_id: str, label: str) -> DataFrame:
    """narratives with slug: that of the label, with eight characters of the id where several have it."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(F.col(label), F.lit("narrative"))), r'[<>:"/\\|?*\x00-\x1f]', "-"), "-{2,}", "-")
    base = F.regexp_replace(F.left(clean, F.lit(MOST_SLUG)), r"[-. ]+$", "")
    rows = narratives.withColumn("_base", F.when(base == "", "narrative").otherwise(base))
    counts = rows.groupBy("_base").agg(F.count("*").alias("_m"))
    return rows.join(counts, "_base").withColumn("slug", F.when(F.col("_m") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.substring(claim_id, 1, 8)))).drop("_base", "_m")


def as_subject(claim_id: Column, content: Column, asserted_by: Column) -> Column:
    """A narrative as a subject: struct(id, name, asserted_by)."""
    return F.struct(claim_id.alias("id"), F.coalesce(F.nullif(content, F.lit("")), F.lit("Narrative")).alias("name"), asserted_by.alias("asserted_by"))


def regions(text: str) -> list[tuple[str, str, str, int, int]]:
    """(name, manifest, body, start, end) of what lies between marks; a start without its end is none."""
    out = []
    for begin in re.finditer(REGION, text):
        if end := re.compile(REGION_END.format(re.escape(begin[1]))).search(text, begin.end()):
            out.append((begin[1], begin[2], text[begin.end() : end.start()].strip("\n"), begin.start(), end.end()))
    return out


def projected_regions(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, region, manifest, body, start, end (characters, the end exclusive) of every region of every file."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, *r) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in regions(t or "")]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [b.schema.types[0], pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[path, "region", "manifest", "body", "start", "end"])

    rows = files.select(path, text)
    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(find, T.StructType([rows.schema[path], *T.StructType.fromDDL("region string, manifest string, body string, start long, end long")]))


def without_regions(files: DataFrame, path: str, text: str, snapshots: DataFrame) -> DataFrame:
    """files with ``text`` for a deposit: a region that still is as rendered goes, of one that was
    edited (or that snapshots(path, region, body) don't know) the body stays without its marks."""
    found = projected_regions(files, path, text).join(snapshots.select(path, "region", F.col("body").alias("rendered")), [path, "region"], "left")
    pristine = F.coalesce(F.regexp_replace("body", r"^\n+|\n+$", "") == F.regexp_replace("rendered", r"^\n+|\n+$", ""), F.lit(False))
    kept = F.when(pristine | (F.col("body") == ""), "").otherwise(F.concat("body", F.lit("\n")))
    cuts = found.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("start", "end", kept.alias("kept")))).alias("cuts"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(a: Column, c: Column) -> Column:
        fits = c["start"] >= a["at"]
        before = F.substring(F.col(text), (a["at"] + 1).cast("int"), (c["start"] - a["at"]).cast("int"))
        return F.when(fits, F.struct(F.concat(a["out"], before, c["kept"]).alias("out"), c["end"].alias("at"))).otherwise(a)

    rows = files.join(cuts, path, "left")
    done = F.aggregate("cuts", start, cut, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(F.col(text)))))
    return rows.withColumn(text, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(F.regexp_replace(done, r"\n{3,}", "\n\n"))).drop("cuts")


def obsolete(existing: DataFrame, written_now: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Markdown files below a folder that this run didn't write; the caller deletes them."""
    below = F.startswith(F.col(path), F.lit(folder.rstrip("/") + "/")) & ~F.contains(F.col(path), F.lit("/../")) & F.col(path).endswith(".md")
    return existing.where(below).join(written_now.select(path), path, "left_anti")
