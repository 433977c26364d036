"""Event-time windows, decayed sums and duplicate suppression over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the files of a folder; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by window and key, for batches and streams."""
    rows = events.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", F.round("total", 6).alias("total"))


def first_seen(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def decayed_sums(events: DataFrame, key: str, half_life_days: float, late: str = "1 day") -> DataFrame:
    """Running decayed sum of each key's values after each batch: key, at, total.

    The state is the sum and the time it is rebased to; an event older than that
    adds its decayed weight, so order doesn't matter.
    """

    def update(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, at = state.get if state.exists else (0.0, 0.0)
        for b in batches:
            for ts, weight in zip(b["seconds"], b["value"], strict=True):
                if not weight > 0:
                    continue
                new = max(at, ts)
                total = total * 0.5 ** ((new - at) / 86400 / half_life_days) + weight * 0.5 ** ((new - ts) / 86400 / half_life_days)
                at = new
        state.update((total, at))
        yield pd.DataFrame({key: [name[0]], "at": [at], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(key, (F.unix_micros("ts") / 1e6).alias("seconds"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, at double, total double", "total double, at double", "update", "NoTimeout")
