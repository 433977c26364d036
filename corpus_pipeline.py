"""A training corpus in five stages, each written before the next reads it.

quality -> near duplicates -> benchmark decontamination -> personal data ->
tokens. Every stage works on all that the one before kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, graphs, line_quality, ngram_join, pii, sentencepiece_lattice

#: Score from which a document is kept, as in the quality query.
GOOD = 0.3
#: Ids that are broadcast at most: 8 bytes each, and what a hash table adds.
MOST_BROADCAST = 1_000_000
#: Bytes of text whose words are looked up together: smaller blocks send more words, and need less memory.
TOKEN_BLOCK = 8 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(found: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject."""
    model = line_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(line_quality.quality(docs, model, carry=COLUMNS).where(F.col("score") >= GOOD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Up to MOST_BROADCAST ids of documents that go are sent to every task, so that
    no text is shuffled; more of them meet the documents by a shuffle.
    """
    found = ngram_join.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = graphs.written(found.where("NOT stays").select(F.col("doc_id").alias("gone_id")))
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return _documents(found.where(F.col("n_hit") == 0))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each personal datum in its place."""
    text = pii.redacted(F.col("text"))
    return docs.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return sentencepiece_lattice.encode(docs, block_bytes=TOKEN_BLOCK)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_pii", without_pii),
    ("tokens", tokens),
]
#: The classifier and the lattice have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = graphs.written(docs)
    return docs
