"""Reading tables and text lists, and writing index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_doclens_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of "did len", separated by white space; blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(parts[0].cast("long").alias("did"), parts[1].cast("long").alias("len"))


def read_ints_text(spark: SparkSession, path: str, terminator: int | None = None) -> DataFrame:
    """(pos, v) of integers split by white space, up to a terminator if one is given.

    One file is one list and is read whole.
    """
    values = F.filter(F.split("value", r"\s+"), lambda x: x != "").cast("array<long>")
    if terminator is not None:
        end = F.array_position(values, F.lit(terminator).cast("long"))
        values = F.when(end > 0, F.slice(values, F.lit(1), (end - 1).cast("int"))).otherwise(values)
    return spark.read.text(path, wholetext=True).select(F.posexplode(values).alias("pos", "v")).select(F.col("pos").cast("long").alias("pos"), "v")


# ---- chunks as they are stored: header and body in one binary, tagged with their codec


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Stored chunks (operators.stored), sorted by term and first did."""
    chunks.repartition("term").sortWithinPartitions("term", "chunk_no").write.mode("overwrite").parquet(path)


def read_chunks(spark: SparkSession, path: str, *wanted: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("term").isin(*wanted)) if wanted else rows


# ---- generated lists


def random_list(spark: SparkSession, entries: int, seed: int = 0) -> DataFrame:
    """(pos, v): an increasing list from a seed, with steps of 50 to 99, up to 49 of jitter, and now and then a leap.

    A step is a hash of its position, so lists of any length are made in
    parallel; running sums are found in two levels.
    """
    draw = [F.pmod(F.xxhash64("pos", F.lit(seed), F.lit(k)), F.lit(50)) for k in range(3)]
    steps = spark.range(entries).select(F.col("id").alias("pos")).select("pos", (draw[0] + 50 + F.when(draw[2] == 0, 25_000).otherwise(0)).alias("step"), draw[1].alias("jitter"), F.expr("pos div 65536").alias("block"))
    sums = steps.groupBy("block").agg(F.sum("step").alias("n")).select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum("step").over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = steps.withColumn("inside", inside).join(F.broadcast(sums), F.col("block") == F.col("b"))
    return placed.select("pos", (F.col("base") + F.col("inside") + F.col("jitter")).alias("v"))
