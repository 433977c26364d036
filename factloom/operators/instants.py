"""What was visible at many instants: point-in-time joins of intervals and times.

A claim is visible from its assertion until before its retirement. Time is cut
into leaves of equal width, leaves into a binary tree. An interval is covered by
the fewest nodes of the tree, at most two on each level; an instant lies in one
node of each level. Both meet on (keys, level, node) in an equi-join, at most
once, and the two ends of an interval are checked exactly. A claim that stays
visible for ever costs a few rows, and a key with most claims is spread over
the nodes of the tree. Keys of few claims need no tree: an instant meets them
all, and travels once instead of once for each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.shared import Tables

#: Width of a leaf in seconds.
WIDTH = 86_400
#: Claims of a key that each of its instants meets without the tree, at most.
FEW = 64


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The nodes (level, node) that cover the leaves first to last, each leaf once."""

    def of(level: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low = F.call_function("shiftright", first + step - 1, level)  # the first node that lies inside
        high = F.call_function("shiftright", last + 1, level)  # the node after the last one
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((high % 2 == 1) & (low + low % 2 < high), high - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def visible_at_instants(claims: DataFrame, instants: DataFrame, at: str, by: Sequence[str] = (), start: str = "asserted_at", end: str = "retired_at", width: int = WIDTH) -> DataFrame:
    """Each row of instants with each claim visible then: the columns of instants
    as struct ``instant``, those of claims as struct ``claim``.

    by: columns that both must hold equal; null equals nothing. A claim without
    a start is never visible, one without an end for ever; one that ends at or
    before its start, never. An instant without a time sees nothing. Repeated
    rows on either side give repeated results. Keys of at most FEW claims are
    joined by the keys alone, others by the tree. Two tables without keys give as
    many rows as are visible: ask for ``visible_counts`` where only sums are wanted.
    """
    keys = [f"_{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    times = instants.select(F.struct(*[F.col(f"`{c}`") for c in instants.columns]).alias("instant"), *named, _micros(at).alias("_at")).where("_at IS NOT NULL").dropna(subset=keys or None, how="any" if keys else "all")
    rows = claims.select(F.struct(*[F.col(f"`{c}`") for c in claims.columns]).alias("claim"), *named, _micros(start).alias("_start"), F.coalesce(_micros(end), F.lit((1 << 63) - 1)).alias("_end")).where("_start < _end")
    if not keys:
        return _by_tree(rows, times, keys, width)
    store = Tables(claims.sparkSession)
    rows = store.written(rows.dropna(subset=keys))
    sizes = store.written(rows.groupBy(*keys).agg((F.count("*") > FEW).alias("_many")))
    many = sizes.where("_many").drop("_many")
    if many.isEmpty():
        return _within(times.join(rows, keys))
    if sizes.where("NOT _many").isEmpty():
        return _by_tree(rows, times, keys, width)
    few = _within(times.join(many, keys, "left_anti").join(rows.join(many, keys, "left_anti"), keys))
    return few.unionByName(_by_tree(rows.join(many, keys, "left_semi"), times.join(many, keys, "left_semi"), keys, width))


def _within(met: DataFrame) -> DataFrame:
    return met.where("_start <= _at AND _at < _end").select("instant", "claim")


def _by_tree(rows: DataFrame, times: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Instants (instant, keys, _at) and claims (claim, keys, _start, _end) that meet in a node."""
    leaf = F.lit(width * 1_000_000)
    edges = times.agg(F.min("_at"), F.max("_at")).first()
    low, high = edges if edges[0] is not None else (0, 0)
    levels = max(1, ((high - low) // (width * 1_000_000) + 1).bit_length())
    rows = rows.where((F.col("_start") <= high) & (F.col("_end") > low))

    def place(t: Column) -> Column:
        return F.call_function("div", t - F.lit(low), leaf)

    first, last = place(F.greatest(F.col("_start"), F.lit(low))), place(F.least(F.col("_end") - 1, F.lit(high)))
    covered = rows.withColumn("_n", F.explode(_cover(first, last, levels)))
    left = covered.select("claim", "_start", "_end", *keys, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    own = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda v: F.struct(v.alias("level"), F.call_function("shiftright", place(F.col("_at")), v).alias("node")))
    right = times.withColumn("_n", F.explode(own)).select("instant", "_at", *keys, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    return _within(right.join(left, [*keys, "_level", "_node"]))


def visible_counts(claims: DataFrame, instants: DataFrame, at: str, by: Sequence[str] = (), value: str | None = None, start: str = "asserted_at", end: str = "retired_at") -> DataFrame:
    """instants with ``visible``, the number of claims visible then, and ``total``, the sum of their values, where asked for.

    No pair is made: starts count up, ends count down, and the sum of all steps
    up to an instant is its answer. Steps and instants are dealt by ranges of
    (keys, time), ranges are summed apart and take what lies before them, so a
    key with most claims is many tasks. A row without a time sees nothing: 0;
    so does one without a key. Values are summed as decimals, which no order changes.
    """
    keys = [f"_{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    worth = F.coalesce(F.col(f"`{value}`").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")) if value else F.lit(0).cast("decimal(18,4)")
    seen = F.struct(*[F.col(f"`{c}`") for c in instants.columns]).alias("instant")
    spans = claims.select(*named, _micros(start).alias("s"), _micros(end).alias("e"), worth.alias("w")).where("s IS NOT NULL AND (e IS NULL OR s < e)").dropna(subset=keys or None, how="any" if keys else "all")
    steps = spans.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d"), F.col("w").alias("w")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d"), (-F.col("w")).cast("decimal(18,4)").alias("w")))).alias("x"))
    steps = steps.select(*keys, "x.t", "x.d", "x.w").where("t IS NOT NULL").groupBy(*keys, "t").agg(F.sum("d").alias("d"), F.sum("w").alias("w"))  # as many rows as there are times, at most
    asked = instants.select(*named, _micros(at).alias("t"), seen)
    rows = steps.withColumn("instant", F.lit(None).cast(asked.schema["instant"].dataType)).unionByName(asked.withColumn("d", F.lit(None).cast("long")).withColumn("w", F.lit(None).cast(steps.schema["w"].dataType)))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # parts many rows of one time
    order = [*keys, "t", F.col("instant").isNotNull(), "_row"]
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).drop("_row")
    dealt = Tables(claims.sparkSession).written(dealt)  # the ranges are drawn once
    sums = dealt.groupBy(*keys, "_range").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("_d"), F.coalesce(F.sum("w"), F.lit(0)).alias("_w"))
    up = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "_range", F.coalesce(F.sum("_d").over(up), F.lit(0)).alias("_d"), F.coalesce(F.sum("_w").over(up), F.lit(0)).alias("_w"))
    same = F.col("r._range") == F.col("b._range")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    placed = dealt.alias("r").join(before.alias("b"), same).select("r.*", "b._d", "b._w")
    inside = W.partitionBy(*keys, "_range").orderBy("t", F.col("instant").isNotNull()).rangeBetween(W.unboundedPreceding, W.currentRow)
    done = placed.withColumn("n", F.coalesce(F.sum("d").over(inside), F.lit(0)) + F.col("_d")).withColumn("w", F.coalesce(F.sum("w").over(inside), F.lit(0)) + F.col("_w")).where("instant IS NOT NULL")
    answer = [F.when(F.col("t").isNull(), 0).otherwise(F.col("n")).cast("long").alias("visible")]
    if value:
        answer.append(F.when(F.col("t").isNull(), 0).otherwise(F.col("w")).cast("double").alias("total"))
    return done.select("instant.*", *answer)
