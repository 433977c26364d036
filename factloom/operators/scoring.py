"""Merging, reinforcement, calibration and rank sweeps over claims."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.confidence import age_days, calibrated, decayed, saturated
from factloom.operators.shared import Tables


def merged_confidence(claims: DataFrame, group: Sequence[str], source: str, confidence: str) -> DataFrame:
    """Noisy-or of each group: one minus the product of what is left of doubt.

    The k-th claim of a source, by falling confidence, counts 1/k. A single
    claim keeps its confidence; null ones don't count. Claims are dealt by ranges
    of group, source and confidence, so a source with very many of them is
    ranked in parts; products combine before the shuffle.
    """
    keys = [*group, source]
    some = claims.select(*keys, confidence).where(F.col(confidence).isNotNull()).withColumn("_row", F.monotonically_increasing_id())  # parts equal confidences
    rows = some.repartitionByRange(*keys, F.col(confidence).desc(), "_row").select(*keys, confidence, F.spark_partition_id().alias("_range"))
    rows = Tables(claims.sparkSession).written(rows)  # the ranges are drawn once
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    same = F.col("r._range") == F.col("b._range")
    for c in keys:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = rows.alias("r").join(before.alias("b"), same).select("r.*", "b._before")
    place = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(F.col(confidence).desc())) + F.col("_before")
    rest = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(confidence))) / place
    return placed.withColumn("rest", rest).groupBy(*group).agg((1 - F.product("rest")).alias("merged"), F.count("*").alias("n"))


def reinforcement(events: DataFrame, key: Sequence[str], at: str, weight: str, half_life_days: float, now: Column) -> DataFrame:
    """Decayed sum of the weights of each key's events; ages below 0 count as 0, weights up to 0 not at all."""
    value = F.col(weight) * decayed(F.greatest(age_days(F.col(at), now), F.lit(0.0)), F.lit(half_life_days))
    some = F.when(F.col(weight) > 0, value)
    return events.groupBy(*key).agg(F.coalesce(F.sum(some) if half_life_days > 0 else F.lit(0.0), F.lit(0.0)).alias("reinforcement"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last closed at 1: one row, error."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    each = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    return each.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), F.lit(0.0)).alias("error"))


def fit_temperature(rows: DataFrame, raw: str, correct: str, low: float = 0.01, high: float = 10.0, levels: int = 1 << 16) -> float:
    """The temperature that makes the outcomes likeliest, by golden section.

    Saturated values are left out. Counts are gathered by raw value rounded to
    one of ``levels`` steps, so the driver holds no more than those.
    """
    some = rows.where(~saturated(F.col(raw)))
    counts = some.groupBy((F.round(F.col(raw) * levels) / levels).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("k")).where("p > 0 AND p < 1").collect()
    if not counts:
        return 1.0
    logits = [(math.log(r["p"] / (1 - r["p"])), r["n"], r["k"]) for r in sorted(counts)]

    def loss(t: float) -> float:
        return sum(k * math.log1p(math.exp(-x / t)) + (n - k) * math.log1p(math.exp(x / t)) if abs(x / t) < 500 else (n - k if x > 0 else k) * abs(x / t) for x, n, k in logits)

    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    while b - a > 1e-9:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def calibrate(rows: DataFrame, raw: str, temperature: float, name: str = "calibrated") -> DataFrame:
    return rows.withColumn(name, calibrated(F.col(raw), F.lit(temperature)))


def lift_grid(most: float, steps: int) -> list[float]:
    """0 and ``steps`` even values up to most."""
    return [round(most * i / steps, 6) for i in range(steps + 1)] if steps > 0 and most > 0 else [0.0]


def heads(rows: DataFrame, base: str, bonus: str, lifts: Sequence[float], most: int) -> DataFrame:
    """For each lift the first ``most`` rows by base + lift * bonus, then id: lift, place and the row.

    Each task keeps the head of its own rows for each lift before the shuffle,
    so what meets for a lift is ``most`` rows from each task.
    """
    lifted = rows.withColumn("lift", F.explode(F.array(*[F.lit(float(x)) for x in lifts]))).withColumn("score", F.round(F.col(base) + F.col("lift") * F.col(bonus), 12))
    order = [F.desc("score"), F.asc("id")]
    salted = lifted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    local = salted.withColumn("place", F.row_number().over(W.partitionBy("lift", "salt").orderBy(*order))).where(F.col("place") <= most).drop("place", "salt")
    return local.withColumn("place", F.row_number().over(W.partitionBy("lift").orderBy(*order))).where(F.col("place") <= most)


def head_outcomes(head: DataFrame, sizes: Sequence[int], distinct_ratio: float = 0.95) -> DataFrame:
    """lift, head_size, n_distinct, largest, required, admissible of heads() with a column ``dup``."""
    sized = head.withColumn("head_size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("place <= head_size")
    counts = sized.groupBy("lift", "head_size", "dup").agg(F.count("*").alias("m"))
    out = counts.groupBy("lift", "head_size").agg(F.count("*").alias("n_distinct"), F.max("m").alias("largest"), F.sum("m").alias("filled"))
    out = out.withColumn("required", F.ceil(F.round(F.col("filled") * distinct_ratio, 9)))
    return out.select("lift", "head_size", "n_distinct", "largest", "required", (F.col("n_distinct") >= F.col("required")).alias("admissible"))


def spread_of(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, low, middle, high: count, minimum, exact median and maximum of a value.

    Values are counted first, and dealt by ranges of group and value: the median
    is read off the running count, whose start in each range is the sum of those
    before, so neither a group's rows nor its different values meet in one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("m"))
    ranged = counts.repartitionByRange(F.col(group).asc_nulls_first(), value).withColumn("_range", F.spark_partition_id())
    counts = Tables(rows.sparkSession).written(ranged)
    sums = counts.groupBy(group, "_range").agg(F.sum("m").alias("_m"))
    whole = W.partitionBy(group)
    before = sums.select(group, "_range", (F.sum("_m").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")).alias("_before"), F.sum("_m").over(whole).alias("n"))
    same = F.col(f"c.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("c._range") == F.col("b._range"))
    order = W.partitionBy(group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    places = counts.alias("c").join(before.alias("b"), same).select("c.*", "b._before", "b.n").withColumn("upto", F.col("_before") + F.sum("m").over(order))
    inside = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("m") < at)
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = (F.max(F.when(inside(lower), F.col(value))) + F.max(F.when(inside(upper), F.col(value)))) / 2
    return places.groupBy(group).agg(F.max("n").alias("n"), F.min(value).alias("low"), middle.alias("middle"), F.max(value).alias("high"))
