"""Intermediate tables that all executors see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Where that is unset, it is set: to a temporary folder of this machine in
    local mode, else to a folder beside the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """df as a table in the shared folder (of at most so many files): its lineage ends there."""
    path = shared_folder(df.sparkSession)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The intermediate tables of one job, which are dropped together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, files: int | None = None) -> DataFrame:
        path = shared_folder(self.spark)
        (df.coalesce(files) if files else df).write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, files: int | None = None) -> DataFrame:
        """df as a table; all tables before it are dropped."""
        before, self.paths = self.paths, []
        out = self.written(df, files)
        system = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in before:
            with contextlib.suppress(Exception):  # what can't be deleted stays behind, and harms nothing
                at = system.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return out


#: Rows and bytes of an Arrow batch to Python, about: whole texts come in it.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python gets batches of at most so many rows and about BATCH_BYTES, or one row.
    Plans read these two settings when they run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, in order, until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
