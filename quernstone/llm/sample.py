"""Bounded samples of labelled rows, chosen by a hash of doc_id and text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

MAX_BYTES = 32 << 20  # of text of a sample


def remainder(column: str, by: int):
    """crc32 of the value as text, modulo by; null counts as no remainder (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def texts(docs: DataFrame, value, most: int, most_bytes: int = MAX_BYTES) -> pa.Table:
    """text and value (a column of docs) of at most `most` rows and `most_bytes` of text, on the driver.

    Rows, not ids, are chosen: by the hash of doc_id and text; a text that no
    longer fits is left out.  Rows without doc_id are never chosen, rows that
    repeat doc_id, text and value count once, a null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), value.alias("value"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rank = F.xxhash64("doc_id", "h", F.lit("sample"))
    narrow = rows.select("doc_id", "h", "value", F.octet_length("text").alias("n")).distinct()
    first = narrow.orderBy(rank, "doc_id", "h", "value").limit(most).collect()
    chosen, left = [], most_bytes
    for r in first:
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id, r.h, r.value, len(chosen)))
    schema = rows.select("doc_id", "h", "value").schema.add("place", "long")
    # from an Arrow table: a list would start Python workers of another kind on every executor
    columns = [pa.array([r[i] for r in chosen], f.type) for i, f in enumerate(to_arrow_schema(schema))]
    known = spark.createDataFrame(pa.table(columns, schema.names), schema)
    same = rows.join(F.broadcast(known.withColumnsRenamed({"doc_id": "d", "h": "k", "value": "v"})), (F.col("doc_id") == F.col("d")) & (F.col("h") == F.col("k")) & F.col("value").eqNullSafe(F.col("v")))
    return same.select("text", "value", "place").dropDuplicates(["place"]).toArrow().sort_by("place")


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, most_bytes: int = MAX_BYTES) -> pa.Table:
    """text and value of a sample of the rows of docs that have a label; the largest one of a doc_id counts."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most).withColumnRenamed("doc_id", "labelled")
    return texts(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled")), F.col("label"), most, most_bytes)
