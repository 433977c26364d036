"""Bounded, reproducible samples of labelled documents, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no model learns from (null: yes)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of labels(doc_id, label), and at most twice as many,
    of which each label has an equal share as far as it has rows; chosen by a
    hash of doc_id, so the same each time. Null labels and ids are left out.
    The driver holds the sample.
    """
    some = labels.where("label IS NOT NULL AND doc_id IS NOT NULL")
    counts = some.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most).collect()
    if not counts:
        return labels.sparkSession.createDataFrame([], labels.select("doc_id", "label").schema)
    share = max(1, most // len(counts))
    rates = labels.sparkSession.createDataFrame([(r["label"], share / r["count"]) for r in counts], f"label {labels.schema['label'].dataType.simpleString()}, rate double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = some.join(F.broadcast(rates), "label").withColumn("draw", draw).where("draw < rate").orderBy("draw", "doc_id").select("doc_id", "label").limit(2 * most).collect()
    return labels.sparkSession.createDataFrame(rows, labels.select("doc_id", "label").schema)
