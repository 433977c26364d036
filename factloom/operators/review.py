"""What a reviewer reads: findings, conflicts, stances, reverts, bands and refusals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, detectors: Mapping[str, Column]) -> DataFrame:
    """The rows with a column finding, once for each detector that holds: one scan for all of them."""
    held = F.filter(F.array(*[F.when(found, F.lit(name)) for name, found in detectors.items()]), lambda x: x.isNotNull())
    return rows.withColumn("finding", F.explode(held))


def inconsistencies(pairs: DataFrame, excerpt: int = 120) -> DataFrame:
    """One derived claim for each contradicting pair (columns old and new, each a
    struct of id, content, confidence, subjects): the lower confidence, the
    subjects of the old claim or else of the new one, and what it rests on."""

    def short(content: Column) -> Column:
        return F.when(F.length(content) > excerpt, F.concat(F.left(content, F.lit(excerpt)), F.lit("…"))).otherwise(content)

    return pairs.select(
        F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"),
        F.concat(F.lit("Contradiction: "), short(F.col("old.content")), F.lit(" | "), short(F.col("new.content"))).alias("content"),
        F.least("old.confidence", "new.confidence").alias("confidence"),
        F.when(F.size("old.subjects") > 0, F.col("old.subjects")).otherwise(F.col("new.subjects")).alias("subjects"),
        F.array(F.concat(F.lit("claim:"), F.col("old.id")), F.concat(F.lit("claim:"), F.col("new.id")), F.lit("trigger:contradiction")).alias("provenance"),
    )


def stance_positions(stances: DataFrame) -> DataFrame:
    """Of stances(claim_id, holder, kind, at): how many holders endorse and dispute
    each claim, by the last stance of each."""
    last = stances.groupBy("claim_id", "holder").agg(F.max(F.struct("at", "kind")).alias("s"))
    counts = last.groupBy("claim_id").agg(F.count_if(F.col("s.kind") == "endorse").alias("endorse"), F.count_if(F.col("s.kind") == "dispute").alias("dispute"))
    return counts.withColumn("disputed", F.col("dispute") > 0)


def revert_plan(merges: DataFrame, current: DataFrame) -> DataFrame:
    """merges(claim_id, into) with skipped: null where the merge can be undone, else why
    not. Only what still is DUPLICATE_MERGED in current(claim_id, status) goes back."""
    status = F.col("status")
    why = F.when(status.isNull(), "missing").when(status != "DUPLICATE_MERGED", F.concat(F.lit("is "), status))
    return merges.join(current.select("claim_id", "status"), "claim_id", "left").select("claim_id", "into", why.alias("skipped"))


def admissible_band(outcomes: DataFrame) -> DataFrame:
    """Of outcomes(lift, head_size, admissible): the lowest and highest admissible lift of
    each size and whether all between are so. A group holds a grid's lifts."""
    rows = outcomes.groupBy("head_size").agg(
        F.min(F.when(F.col("admissible"), F.col("lift"))).alias("low"), F.max(F.when(F.col("admissible"), F.col("lift"))).alias("high"), F.collect_list(F.when(~F.col("admissible"), F.col("lift"))).alias("out")
    )
    gaps = F.size(F.filter("out", lambda x: (x >= F.col("low")) & (x <= F.col("high"))))
    return rows.select("head_size", "low", "high", (F.col("low").isNotNull() & (gaps == 0)).alias("contiguous"))


def relevance(hits: DataFrame, floor: float = 0.25) -> DataFrame:
    """Of hits(query_id, sim): the best similarity of each query, refused below the floor."""
    return hits.groupBy("query_id").agg(F.max("sim").alias("best")).withColumn("refused", F.col("best") < floor)


def conflict_candidates(queries: DataFrame, claims: DataFrame, subject: str, similarity: Column, least: float, blocks: int = 64) -> DataFrame:
    """query_id, vec_id, sim of claims of the query's subject that are at least so similar.

    Queries are a stated set. A subject's claims are dealt over blocks, to each
    of which its queries go: a hot subject isn't one task.
    """
    every = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = claims.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.join(every, [subject, "block"]).where("vec_id <> query_id").withColumn("sim", similarity).where(F.col("sim") >= least).select("query_id", "vec_id", "sim")


def with_previous_tail(pages: DataFrame, doc: str, page: str, text: str, lines: int) -> DataFrame:
    """pages with overlap: the last lines of the page before, null on the first. Pages of
    a document are numbered without gaps; of repeated ones the greatest text counts."""
    split = F.split(F.col("before"), "\n")
    tail = F.array_join(F.slice(split, F.greatest(F.size(split) - lines, F.lit(0)) + 1, F.lit(lines)), "\n")
    before = pages.groupBy(doc, (F.col(page) + 1).alias(page)).agg(F.max(text).alias("before"))
    return pages.join(before, [doc, page], "left").withColumn("overlap", F.when(F.col("before").isNotNull(), tail)).drop("before")


def model_names(claims: DataFrame, extractor: str, model: str) -> DataFrame:
    """The models that an extractor's claims name, joined in order; anomaly where there is more than one."""
    names = F.array_sort(F.collect_set(model))
    return claims.groupBy(extractor).agg(F.when(F.size(names) > 0, F.array_join(names, ",")).alias("models"), (F.size(names) > 1).alias("anomaly"))
