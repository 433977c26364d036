"""Importance resampling of documents towards a target's word distribution.

Features are runs of 1 to n consecutive words. In a block of texts, distinct
words get integer ids and runs are tuples of ids; each distinct tuple's bytes
are put together and hashed once, and its bucket is joined back to the
documents that hold it. The corpus and the target become counts of buckets; the
gain of a bucket is how much commoner it is in the target, and a document's
weight is the mean gain of its features. Noise of Gumbel's law, drawn from
doc_id, turns the highest scores into a sample without replacement.

Documents' bucket counts are written once: buckets are counted from them, and
weights too, so that texts are read once and never cross the network. Ranks come
from ranges of (score, doc_id), each numbered by itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import graphs
from factloom.llm import textkit as tk

#: Bytes of text whose words share a dictionary.
BLOCK_BYTES = 4 << 20
U64 = np.uint64


def bucket_counts(words: tk.Words, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, features) of all runs of 1 to n words, ascending."""
    doc = words.doc
    last = np.repeat(words.first[1:], words.counts)
    _, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    here, code, parts = np.arange(len(words)), ids.astype(np.int64), []
    for k in range(1, n + 1):
        if k > 1:  # tuples of k ids from tuples of k - 1 and the next word
            stays = here + k <= last[here]
            here, code = here[stays], code[stays]
            _, at, code = np.unique(code * len(first) + ids[here + k - 1], return_index=True, return_inverse=True)
            first_at = here[at]
        else:
            first_at = first
        hashed = np.fromiter((zlib.crc32(words.text(i, i + k)) % buckets for i in first_at.tolist()), np.int64, len(first_at))
        parts.append(doc[here] * buckets + hashed[code])
    key, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    return key // buckets, key % buckets, counts


def _features(n: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in tk.pieces(batches, "text", BLOCK_BYTES):
            words = tk.Words(buf, offsets, tk.NON_ALNUM, True)
            doc, bucket, counts = bucket_counts(words, n, buckets)
            size = np.bincount(doc, minlength=words.docs)
            features = np.bincount(doc, counts, words.docs).astype(np.int64)
            yield tk.batch(rows, ("doc_id",), n_words=pa.array(words.counts.astype(np.int64)), n_features=pa.array(features), buckets=tk.lists(size, pa.array(bucket, pa.int32())), counts=tk.lists(size, pa.array(counts, pa.int64())))

    return tk.tidy(run)


def features(docs: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, buckets and counts of every document's runs of 1 to n words."""
    return tk.narrow(docs, id_col, text_col).mapInArrow(_features(n, buckets), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def _totals(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket. The driver holds the buckets' counts, ``buckets`` numbers of either side."""
    s, t = ([0] * buckets for _ in range(2))
    for side, counts in ((corpus, s), (target, t)):
        for r in _totals(side).collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000.0 * math.log(float(y + 1) * all_s / (float(x + 1) * all_t))) for x, y in zip(s, t, strict=True)]


def _weights(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists, counts = rows.column("buckets"), np.asarray(rows.column("counts").flatten())
            size = np.asarray(lists.value_lengths())
            n = np.asarray(rows.column("n_features"))
            sums = np.zeros(len(size), np.int64)
            np.add.at(sums, np.repeat(np.arange(len(size)), size), gain[np.asarray(lists.flatten())] * counts)
            yield tk.batch(rows, ("doc_id", "n_words", "n_features"), weight=pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0)))

    return tk.tidy(run)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from doc_id (null: the empty string)."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def _cutoff(scored: DataFrame, drawn: int) -> int | None:
    """The lowest score that is drawn. The driver holds a count for each score:
    gains lie within 1000 ln(features) and noise within -3,200 and 23,000, so
    there are at most some 150,000 different ones, whatever the corpus."""
    left = drawn
    for score, n in sorted(((r["score"], r["count"]) for r in scored.where("eligible").groupBy("score").count().collect()), reverse=True):
        left -= n
        if left <= 0:
            return score
    return None


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    ``percent`` of the documents with at least ``least_words`` words are drawn,
    those of the highest scores, ties to the smaller doc_id (null first); rank
    counts them from 1 and is null for all others. Rows equal in doc_id and text
    are documents of their own and take ranks side by side. A null or empty text
    has no features and the weight 0; an empty target is one whose buckets are
    all equally rare. Texts of any length are read whole. Other columns, whatever
    their names, play no part; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    store = graphs.Tables(spark)
    found = store.written(features(docs, n, buckets, id_col, text_col))
    gain = np.array(gains(found, features(target, n, buckets, target_id, target_text), buckets), np.int64)
    rows = found.mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = store.written(rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible")))
    drawn = scored.where("eligible").count() * percent // 100
    lowest = _cutoff(scored, drawn) if drawn else None
    no_rank = ("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if lowest is None:
        return scored.select(*no_rank)
    high = F.col("eligible") & (F.col("score") >= lowest)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row"))
    # a row's number parts even rows that are equal in all else, so no range is one key
    ranges = scored.where(high).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tk.partitions(spark), *order)
    ranges = store.written(ranges.withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").count()
    before = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = ranges.join(F.broadcast(before), "range").select("doc_id", "n_features", "weight", "score", place.cast("long").alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.where(~high).select(*no_rank).unionByName(ranked)
