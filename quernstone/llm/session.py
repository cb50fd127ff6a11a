"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 128 << 20
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, TypeError, AttributeError):  # not glibc
    _trim = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of partitions that the cluster sets for a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_of(rows: DataFrame) -> int:
    """Number of partitions that rows have as they are, which is that of a mapInArrow over them."""
    return max(1, rows.rdd.getNumPartitions())


def batches(docs: DataFrame) -> int:
    """Number of batches for operators that hold a batch of texts in a task.

    As many as the cluster sets for a shuffle, and more where a batch would have
    over BATCH_BYTES of text; reads the column text once.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BATCH_BYTES))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch: texts are long, and a batch is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give free memory back to the system: workers live on between tasks, and share the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def called(fn: Callable, *tables: pa.Table) -> pa.Table:
    """fn(*tables) of a group in a worker, without the memory that it needed on the way."""
    try:
        return fn(*tables)
    finally:
        release()


def streamed(fn: Callable) -> Callable:
    """A function for mapInArrow that releases its memory when the stream ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The folder named by ``spark.checkpoint.dir`` is used; only where that is
    unset and driver and tasks are one process (``local`` masters, as in tests)
    is a folder of this machine chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quernstone-"))
    return df.checkpoint()
