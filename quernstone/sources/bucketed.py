"""Catalog tables that are dealt out by their key, so that merges and joins need no exchange.

Postings lie in buckets of (term, did), document lengths in buckets of did, each
sorted by it.  What is joined with one of them on that key is dealt out alike: of a
change set only the changes move, of two tables of the same number of buckets
neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest

POSTING_KEY = ["term", "did"]
BUCKETS = 64


def write(rows: DataFrame, name: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Save rows as the catalog table `name`: a file a bucket, sorted by the key."""
    dealt = rows.repartition(buckets, *key)
    dealt.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).format("parquet").saveAsTable(name)


def merged(spark: SparkSession, name: str, changes: DataFrame, key: list[str], value: str, new: str) -> DataFrame:
    """The table after changes(key, new; null takes away): the table stays where it is, changes come to its buckets."""
    table, one = spark.table(name), latest(changes, key, new).withColumn("changed", F.lit(True))
    # no hint to send the changes to all tasks: a bucket's rows without changes must come out too
    both = table.join(one.hint("merge"), key, "full_outer")
    out = F.when(F.col("changed"), F.col(new)).otherwise(F.col(value)).alias(value)
    return both.select(*key, out).where(F.col(value).isNotNull())


def by_document(spark: SparkSession, postings: str, lengths: str) -> DataFrame:
    """term, did, wdf, len of two tables that are both dealt out by did."""
    return spark.table(postings).join(spark.table(lengths).hint("merge"), "did").select("term", "did", "wdf", "len")
