"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.shared import Tables

#: Edges that a file of an intermediate table holds, about.
EDGES_PER_FILE = 200_000


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is nobody's larger end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 OR (ups = 1 AND root = 0)").isEmpty()


def components(links: DataFrame, job: Tables | None = None) -> DataFrame:
    """(node, root) of every node of links(a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps: every node hangs its larger
    neighbours on the smallest one, until every component is a star; the number
    of rounds grows with the logarithm of the longest path. Minima are combined
    before the shuffle, so a node with very many links costs one row per task.
    Null ends are dropped; an empty table gives an empty one. The table that
    the result reads is dropped with those of ``job``.
    """
    kept = Tables(links.sparkSession)
    edges = kept.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    files = 1 + edges.count() // EDGES_PER_FILE  # no round makes more than twice as many
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = kept.written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), files)
        large = kept.written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), files)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        edges = kept.only(large.join(low, "a").select(F.explode(pairs).alias("e")).select("e.*").where("a <> b").distinct(), files)
    if job is not None:
        job.paths += kept.paths
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
