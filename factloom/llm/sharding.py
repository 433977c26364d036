"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key that keeps equal texts together: the text's CRC,
then that of doc_id. A sample of the keys, weighted by size, gives quantile
boundaries of many ranges; their exact bytes and rows are counted, and ranges
that came out overfull are sampled anew and subdivided. Running sums inside a
range and the sums of the ranges before give each record its place in the whole
order, and the place gives the shard. So shards differ by less than two
records' sizes, whatever the sample. A group of equal texts larger than a
range, or than a shard, is divided by the hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.graphs import written
from factloom.llm.ranges import range_of

#: Bytes of records a range should hold, least and most ranges, sampled keys a range.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES, SAMPLES = 64 << 20, 192, 1 << 16, 20
#: Ranges above this many times the mean are subdivided, in at most so many rounds.
OVERFULL, ROUNDS = 2, 4


def _sample(rows: DataFrame, total: int, keys: int) -> list[tuple[int, float]]:
    """(key, weight) of about ``keys`` rows, drawn by size; the draw is a hash of the row."""
    share = F.col("size") * (keys / max(1, total))
    drawn = F.pmod(F.xxhash64("key", "doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < share
    return [tuple(x) for x in rows.where(drawn).select("key", F.greatest(share, F.lit(1.0))).collect()]


def _quantiles(sample: list[tuple[int, float]], parts: int) -> list[int]:
    sample = sorted(sample)
    total, so_far, cuts = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        if so_far >= total * (len(cuts) + 1) / parts and (not cuts or key > cuts[-1]):
            cuts.append(key)
        so_far += weight
    return cuts


def _ranged(rows: DataFrame, cuts: list[int]) -> tuple[DataFrame, list]:
    ranged = rows.withColumn("range", range_of(F.col("key"), cuts))
    return ranged, ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()


def shards(docs: DataFrame, count: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard (0 to count - 1) and
    slot (gapless from 0 in each shard), shards in near equal bytes.

    size is the UTF-8 length of the text (null: 0) plus 8; a null text has the
    CRC of an empty one. Rows with equal text and doc_id may take each other's
    slots. Only the length and the CRC of a text travel, however long it is; other
    columns, whatever their names, play no part. With fewer rows than shards some shards stay empty; an empty table
    gives an empty one. The driver holds the sample and the ranges' sums, both
    bounded by MOST_RANGES.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    crc = F.crc32(text)
    spread = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    key = crc * (1 << 31) + spread % (1 << 31)
    rows = written(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"), key.alias("key")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(LEAST_RANGES, min(MOST_RANGES // 4, total // RANGE_BYTES))
    cuts = _quantiles(_sample(rows, total, SAMPLES * parts), parts)
    for turn in range(ROUNDS):
        ranged, sums = _ranged(rows, cuts)
        full = {r["range"]: r["bytes"] for r in sums if r["bytes"] > OVERFULL * total / parts and r["rows"] > 1}
        if not full or turn == ROUNDS - 1 or len(cuts) + 4 * len(full) > MOST_RANGES:
            break
        over = ranged.where(F.col("range").isin(list(full)))
        finer = sorted(k for k, _ in _sample(over, sum(full.values()), SAMPLES * len(full)))
        more = {k for i, k in enumerate(finer) if i % 4 == 0}
        new = sorted(set(cuts) | more)
        if len(new) == len(cuts):
            break
        cuts = new
    before, so_far, ranked = [], 0, 0
    for r in sums:
        before.append((r["range"], so_far, ranked))
        so_far, ranked = so_far + r["bytes"], ranked + r["rows"]
    offsets = docs.sparkSession.createDataFrame(before, "range int, bytes_before long, rows_before long")
    order = W.partitionBy("range").orderBy("key", "doc_id", "size")
    placed = ranged.join(F.broadcast(offsets), "range")  # at most MOST_RANGES rows
    placed = placed.withColumn("middle", F.col("bytes_before") * 2 + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) * 2 - F.col("size"))
    placed = placed.withColumn("rank", F.col("rows_before") + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.least(F.lit(count - 1), F.floor(F.col("middle") * count / (2 * max(1, total)))).cast("int"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # count rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
