"""Duplicates, fingerprints, supersession, contestedness and graphs of claims."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.shared import Tables


def duplicate_groups(claims: DataFrame, key: Sequence[str], survivor: Sequence[Column], claim_id: str) -> DataFrame:
    """Groups of more than one claim: key, n, survivor (the first by the given order)."""
    first = F.min_by(claim_id, F.struct(*survivor)).alias("survivor")
    return claims.groupBy(*key).agg(F.count("*").alias("n"), first).where("n > 1")


def fingerprint(ids: DataFrame, claim_id: str) -> DataFrame:
    """SHA-256 over all ids in order, without delimiter: one row, fingerprint.

    One digest over everything has to pass one place; use fingerprint_by for
    tables whose ids don't fit a row.
    """
    return ids.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(claim_id).cast("string"))), ""), 256).alias("fingerprint"))


def fingerprint_by(ids: DataFrame, group: Sequence[str], claim_id: str) -> DataFrame:
    return ids.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(claim_id).cast("string"))), ""), 256).alias("fingerprint"))


def visible_at(claims: DataFrame, at: Column) -> DataFrame:
    """Claims visible at a time: asserted by then and not yet retired. Those
    without a date of assertion are left out."""
    return claims.where(F.col("asserted_at").isNotNull() & (F.col("asserted_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at)))


def with_retirement(claims: DataFrame) -> DataFrame:
    """retired_at: the stored instant, else the successor's assertion, else the end of validity."""
    next_ = claims.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("claim_id")).agg(F.min("asserted_at").alias("successor_at"))
    return claims.join(next_, "claim_id", "left").withColumn("retired_at", F.coalesce("stored_retired_at", "successor_at", "valid_until"))


def spread(rendered: DataFrame, claim_id: str, confidence: str) -> DataFrame:
    """Largest minus smallest confidence of a claim over two policies or more."""
    return rendered.groupBy(claim_id).agg((F.max(confidence) - F.min(confidence)).alias("spread"), F.count("*").alias("policies")).where("policies >= 2")


def badge(stance: Column, divergence: Column, inconsistent: Column, least: float = 0.2) -> Column:
    """What contests a claim, joined in fixed order, or null."""
    bases = F.filter(F.array(F.when(stance, "stance"), F.when(divergence >= least, "divergence"), F.when(inconsistent, "inconsistency")), lambda x: x.isNotNull())
    return F.when(F.size(bases) > 0, F.array_join(bases, ","))


#: Rows of a bridge, and pairs of subjects, that a task has, about, and tasks at most.
ROWS_PER_TASK, PAIRS_PER_TASK, MOST_TASKS = 500_000, 1_000_000, 20_000


def subject_edges(bridge: DataFrame, claim: str, subject: str) -> DataFrame:
    """a < b for the subjects that meet in a claim, with the number of claims.

    Partitions follow from the rows and from the pairs, so that a task's share
    stays as it is when the tables grow: claims' rows are dealt once, for the
    distinct ones and for the join, and pairs once, before they are counted.
    """
    rows = bridge.select(claim, subject).where(F.col(claim).isNotNull() & F.col(subject).isNotNull())
    rows = rows.repartition(1 + rows.count() // ROWS_PER_TASK, claim).distinct()
    k = F.col("k").cast("decimal(20,0)")
    pairs = rows.groupBy(claim).agg(F.count("*").alias("k")).agg(F.sum(k * (k - 1) / 2).cast("double").alias("n")).first().n or 0
    left, right = rows.select(claim, F.col(subject).alias("a")), rows.select(claim, F.col(subject).alias("b"))
    met = left.join(right, claim).where("a < b").select("a", "b")
    return met.repartition(min(MOST_TASKS, 1 + int(pairs // PAIRS_PER_TASK)), "a", "b").groupBy("a", "b").agg(F.count("*").alias("claims"))


def carry_forward(chunks: DataFrame, known: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks that need no work, chunks to work on)."""
    k = known.select(*key).distinct()
    return chunks.join(k, list(key), "left_semi"), chunks.join(k, list(key), "left_anti")


#: Queries up to which they are sent to every task.
MOST_BROADCAST = 10_000


def top_neighbours(queries: DataFrame, vectors: DataFrame, similarity: Column, k: int, blocks: int = 64) -> DataFrame:
    """The k most similar vectors of each query: query_id, vec_id, sim, place.

    ``queries`` is a stated set. Up to MOST_BROADCAST of them go to every task;
    more meet the vectors block by block. Each block of vectors keeps its k best
    for a query before they meet.
    """
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    if queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        met = dealt.join(F.broadcast(queries), F.col("vec_id") != F.col("query_id"))
    else:
        every = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = dealt.join(every.hint("shuffle_hash"), "block").where("vec_id <> query_id")
    order = [F.desc("sim"), F.asc("vec_id")]
    local = met.withColumn("sim", similarity).withColumn("place", F.row_number().over(W.partitionBy("query_id", "block").orderBy(*order))).where(F.col("place") <= k)
    return local.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).select("query_id", "vec_id", "sim", "place")


#: Links that a task follows among themselves, about, and rows of a table that goes to every task.
LINKS_PER_BLOCK, MOST_SENT = 500_000, 100_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's links (one of each claim), gone as far as the block knows the way: claim_id, root, depth.

    What runs into a cycle of the block stays as it is.
    """
    held = list(batches)
    if not held:
        return
    links = pa.Table.from_batches(held).combine_chunks()
    claim, first = links.column(0), links.column(1)
    to = pc.fill_null(pc.index_in(first, value_set=claim), -1).to_numpy().astype(np.int64)
    n = len(to)
    last, steps = np.arange(n), np.ones(n, np.int64)  # a row's last link in the block, and how many it has gone
    on = to >= 0
    last[on], steps[on] = to[on], 2
    for _ in range(n.bit_length()):
        if not (to[last] >= 0).any():
            break
        last, steps = last[last], steps + steps[last] - 1
    lost = to[last] >= 0
    last[lost], steps[lost] = np.flatnonzero(lost), 1
    out = pa.table({"claim_id": claim, "root": first.take(pa.array(last)), "depth": pa.array(steps)})
    yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def supersession_roots(links: DataFrame) -> DataFrame:
    """claim_id, root, depth, cyclic: the end of each chain of links(claim_id,
    supersedes); a claim with several links has a row for each end.

    Where every claim has one link, ranges of claims are followed first, each in
    a task of its own; what they lead to, in other ranges, is all that the rounds
    go on with. Chains whose claims follow each other nearly vanish in this; a
    chain in no order keeps most of its links. Each round doubles the links that
    a row has gone. A chain without a cycle has at most as many links as there
    are claims, so after that many doublings a row that doesn't stand at an end
    runs into a cycle: its root and depth are null and cyclic is true. A round
    joins only rows that aren't at an end, which many share, and builds on the
    side that has a claim once; it is written to the shared folder, where its
    lineage ends, and drops the table before it.
    """
    spark = links.sparkSession
    store, rounds = Tables(spark), Tables(spark)
    links = links.where("claim_id IS NOT NULL AND supersedes IS NOT NULL")
    each = store.written(links.groupBy("claim_id").agg(F.min("supersedes").alias("root"), (F.min("supersedes") != F.max("supersedes")).alias("several")))
    claims = each.count()
    if links.schema["claim_id"].dataType == links.schema["supersedes"].dataType and each.where("several").isEmpty():
        kinds = T.StructType([each.schema["claim_id"], each.schema["root"], T.StructField("depth", T.LongType())])
        now = each.select("claim_id", "root").repartitionByRange(1 + claims // LINKS_PER_BLOCK, "claim_id").mapInArrow(_followed, kinds)
    else:  # lengths of ways that differ between rounds would be rows of their own
        now = links.select("claim_id", F.col("supersedes").alias("root")).distinct().withColumn("depth", F.lit(1).cast("long"))
    now = store.written(now)
    sides = store.written(now.select(F.col("root").alias("claim_id")).distinct())
    ways = rounds.written(now.join(sides, "claim_id", "left_semi"))  # of the claims that a chain goes on with
    n = ways.count()
    few = lambda df: F.broadcast(df) if n <= MOST_SENT else df.hint("shuffle_hash")
    known = ways.select(F.col("claim_id").alias("root")).distinct().withColumn("moves", F.lit(True))
    ways = rounds.only(ways.join(few(known), "root", "left").select("claim_id", "root", "depth", F.col("moves").isNotNull().alias("moved")))
    for _ in range(n.bit_length()):
        if ways.where("moved").isEmpty():
            break
        up = ways.select(F.col("claim_id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("moved").alias("goes_on"))
        longer = ways.where("moved").join(few(up), "root").select("claim_id", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("goes_on").alias("moved"))
        ways = rounds.only(longer.union(ways.where("NOT moved")).distinct())
    ends = ways.select(F.col("claim_id").alias("root"), F.col("root").alias("end"), F.col("depth").alias("more"), F.col("moved").alias("lost"))
    told = now.join(few(ends), "root", "left").withColumn("cyclic", F.coalesce("lost", F.lit(False)))
    out = told.select("claim_id", F.when(~F.col("cyclic"), F.coalesce("end", "root")).alias("root"), F.when(~F.col("cyclic"), F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "cyclic")
    return out.distinct() if now.count() > claims else out
