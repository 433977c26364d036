"""Comment trees: depth-first and breadth-first order, filters, rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.shared import Tables


def tree_paths(comments: DataFrame, prune: Column | None = None, most_levels: int | None = None) -> DataFrame:
    """comments(thread, id, parent, ordinal, ...) with depth and path, level by level.

    Roots have a null parent; sorting a thread by path is its depth-first order,
    by (depth, path) its breadth-first order. With ``prune`` a comment that
    doesn't fulfil it goes with all below it. Comments whose parents are missing
    are left out, and so are cycles. Levels are tables in the shared folder;
    one below ``most_levels`` (none by default) is an error, and so is a tree
    of more levels than comments, which repeated ids make.
    """
    kept = Tables(comments.sparkSession)
    rows = comments if prune is None else comments.where(prune)
    step = kept.written(rows.where("parent IS NOT NULL").select("thread", "id", "parent", "ordinal"))
    most = step.count() if most_levels is None else most_levels
    level = kept.written(rows.where("parent IS NULL").select("thread", "id", F.lit(0).alias("depth"), F.array(F.struct("ordinal", "id")).alias("path")))
    levels = [level]
    while not level.isEmpty():
        if len(levels) > most + 1:
            raise ValueError(f"comments below level {most}")
        up = level.select("thread", F.col("id").alias("parent"), "depth", F.col("path").alias("above"))
        level = kept.written(step.join(up, ["thread", "parent"]).select("thread", "id", (F.col("depth") + 1).alias("depth"), F.concat("above", F.array(F.struct("ordinal", "id"))).alias("path")))
        levels.append(level)
    return comments.join(kept.only(reduce(DataFrame.union, levels)), ["thread", "id"])


def shown(tree: DataFrame, visible: Column) -> DataFrame:
    """Comments that are shown, in depth-first order within their thread; hidden ones keep their children."""
    return tree.where(visible).orderBy("thread", "path")


def top_scored(tree: DataFrame, least_score: int) -> DataFrame:
    """Comments with at least a score, by score, then in breadth-first order."""
    return tree.where(F.col("score") >= least_score).orderBy("thread", F.desc("score"), "depth", "path")


def line(text: Column, depth: Column, indent: int = 2) -> Column:
    return F.concat(F.repeat(F.lit(" "), depth * indent), text)
