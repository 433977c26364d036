"""Document fingerprints by winnowing, in Spark SQL only.

The words of a text give rolling hashes of ``K`` words each. Of every
``WINDOW`` consecutive hashes the smallest is chosen, the rightmost of equal
ones, and kept with its position. So two texts that share a run of
``K + WINDOW - 1`` words always share a chosen hash, and no run of fewer than
``K`` words is ever matched.

A chosen hash and its position are one long: 33 bits of hash above 30 bits that
fall as the position grows, so that the least of a window is the smallest hash
at its rightmost place. Hashes and minima come from two doublings each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.pii import let
from factloom.llm.ranges import range_of

#: Both are powers of two: hashes and minima come from doublings.
K, WINDOW = 4, 4
_PLACES = 1 << 30
_HASHES = (1 << 33) - 1
_BLANK = " \t\n\x0b\f\r"


def _later(a: Column, by: int) -> Column:
    """The array from its element ``by`` on, counted from 0."""
    return F.slice(a, F.lit(by + 1), F.size(a))


def _rolling(words: Column) -> Column:
    """Hashes of K consecutive words; of all words where there are fewer."""

    def grown(one: Column) -> Column:
        two = F.zip_with(one, _later(one, 1), lambda a, b: F.xxhash64(a, b))
        four = let(two, lambda t: F.zip_with(t, _later(t, 2), lambda a, b: F.xxhash64(a, b)))
        return F.slice(four, F.lit(1), F.greatest(F.size(one) - (K - 1), F.least(F.size(one), F.lit(1))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grown)


def _chosen(hashes: Column) -> Column:
    """The packed minimum of each window, each once, in order of position."""
    packed = F.transform(hashes, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(_HASHES)), 30).bitwiseOR(F.lit(_PLACES - 1) - i))

    def least(a: Column, by: int) -> Column:
        return F.zip_with(a, _later(a, by), lambda x, y: F.least(x, y))

    minima = let(let(packed, lambda a: least(a, 1)), lambda a: least(a, 2))
    return let(minima, lambda a: F.array_distinct(F.slice(a, F.lit(1), F.greatest(F.size(a) - (WINDOW - 1), F.least(F.size(a), F.lit(1))))))


def fingerprint(text: Column) -> Column:
    """The chosen (hash, position) of a text as packed longs, by position.

    Words are what white space separates, in lower case. A text of fewer than
    K words is one hash; a null text or one without words has no fingerprint
    (an empty array). Equal texts have equal fingerprints.
    """
    clean = F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK)))
    words = let(clean, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[ \t-\r]+", -1)))
    return _chosen(_rolling(words))


def hashes_of(marks: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 30)))


def places_of(marks: Column) -> Column:
    """(hash, position of its first word) of a fingerprint."""
    return F.transform(marks, lambda m: F.struct(F.shiftright(m, 30).alias("hash"), (F.lit(_PLACES - 1) - m.bitwiseAND(F.lit(_PLACES - 1))).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(n / (F.size(a) + F.size(b) - n)))


def digest(marks: Column) -> Column:
    """A fingerprint as text: SHA-256 of its hashes and positions."""
    return F.sha2(F.array_join(marks.cast("array<string>"), ","), 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and marks, the (hash, position) of its fingerprint."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), places_of(fingerprint(F.col(f"`{text_col}`"))).alias("marks"))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, text, marks, next_text, next_hashes of the row
    that follows by ascending doc_id (then text); the first follows the last.

    Rows meet their followers in ranges of ids with about equally many rows,
    each sorted by itself; only the first row of each range crosses to the one
    before. Null ids come first, null texts are empty.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 10 * n)).first()[0] or []  # n - 1 ids
    bucket = range_of(F.col("at"), sorted(set(cuts)))
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.min("at").alias("at")).orderBy("bucket").collect()  # n rows at most
    if not heads:
        heads = [(0, lowest)]
    follows = spark.createDataFrame([(b[0], heads[(i + 1) % len(heads)][1]) for i, b in enumerate(heads)], "bucket int, at long")
    texts = rows.where(F.col("at").isin([h[1] for h in heads])).groupBy("at").agg(F.min("text").alias("head_text"))
    texts = follows.join(texts, "at").select("bucket", "head_text", hashes_of(fingerprint(F.col("head_text"))).alias("head_hashes"))
    order = W.partitionBy("bucket").orderBy("at", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("marks", fingerprint(F.col("text"))).withColumn("hashes", hashes_of(F.col("marks")))
    rows = rows.withColumn("next_hashes", F.lead("hashes").over(order))
    rows = rows.join(texts.hint("merge"), "bucket", "left")  # the rows are dealt by bucket already
    return rows.select("doc_id", "text", "marks", "hashes", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_hashes", "head_hashes").alias("next_hashes"))
