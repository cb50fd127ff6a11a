"""Splitting lists into chunks, by count and by bytes, and runs inside them.

The byte split and the block runs depend on all earlier entries of a list;
``folds`` finds them cell by cell, so that a long list is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import MIN_BLOCK
from . import folds

ENTRIES = 2000  # of a document-length chunk
BYTES = 2000  # of a posting chunk's body before the next begins
STRIDE = 1 << 16


def numbered(rows: DataFrame, key: str, name: str = "rn", stride: int = STRIDE) -> DataFrame:
    """Adds the row number (from 0) in the order of an integer key, without one task for all rows.

    Rows are counted for each stride of keys; the running sum of these few
    counts is added to the row number inside the stride.
    """
    cell = F.expr(f"{key} div {stride}")
    counts = rows.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_cell").alias("_c"), F.coalesce(before, F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    out = rows.withColumn("_cell", cell).withColumn("_in", inside)
    return out.join(counts, F.col("_cell") == F.col("_c")).withColumn(name, F.col("_base") + F.col("_in")).drop("_cell", "_c", "_in", "_base")


def doclen_chunk_rows(doclens: DataFrame, entries: int = ENTRIES) -> DataFrame:
    return numbered(doclens, "did").withColumn("chunk_no", F.expr(f"rn div {entries}")).drop("rn")


def bounds(rows: DataFrame, by: list[str]) -> DataFrame:
    """first_did, last_did, n_entries of chunks, and whether first or last of their list."""
    out = rows.groupBy(*by, "chunk_no").agg(F.min("did").alias("first_did"), F.max("did").alias("last_did"), F.count("*").alias("n_entries"))
    if not by:  # one list: its ends are two scalars
        lo, hi = (out.agg(f("chunk_no").alias("c")).scalar() for f in (F.min, F.max))
        ends = (F.col("chunk_no") == lo).alias("is_first"), (F.col("chunk_no") == hi).alias("is_last")
    else:  # rows of chunks only, and the split runs once
        w = Window.partitionBy(*by).orderBy("chunk_no")
        ends = F.lag("chunk_no").over(w).isNull().alias("is_first"), F.lead("chunk_no").over(w).isNull().alias("is_last")
    return out.select(*by, "chunk_no", "first_did", "last_did", "n_entries", *ends)


def doclen_chunks(doclens: DataFrame, entries: int = ENTRIES) -> DataFrame:
    return bounds(doclen_chunk_rows(doclens, entries), [])


def posting_chunk_rows(postings: DataFrame, most: int = BYTES) -> DataFrame:
    return folds.folded(postings, folds.ByteSplit(most), "chunk_no")


def posting_chunks(postings: DataFrame, most: int = BYTES) -> DataFrame:
    return bounds(posting_chunk_rows(postings, most), ["term"])


def block_runs(postings: DataFrame) -> DataFrame:
    """term, first_did, n, is_block of the greedy runs of every list."""
    rows = folds.folded(postings, folds.Runs(), "first_did")
    return rows.groupBy("term", "first_did").agg(F.count("*").alias("n")).select("term", "first_did", "n", (F.col("n") >= MIN_BLOCK).alias("is_block"))


def bodies(rows: DataFrame, by: list[str], encode, value: str = "wdf") -> DataFrame:
    """Encoded bodies of chunk rows; a chunk is bounded by its split."""
    pairs = F.sort_array(F.collect_list(F.struct("did", F.col(value).alias("val"))))
    chunk = rows.groupBy(*by, "chunk_no").agg(pairs.alias("pairs"))
    return chunk.select(*by, "chunk_no", F.col("pairs")[0]["did"].alias("first_did"), F.col("pairs")[F.size("pairs") - 1]["did"].alias("last_did"), F.size("pairs").cast("long").alias("n_entries"), encode("pairs").alias("body"))


def entries_of(chunks: DataFrame, by: list[str], decode, value: str = "wdf") -> DataFrame:
    """Rows of encoded chunks."""
    return chunks.select(*by, F.explode(decode("body", "first_did")).alias("e")).select(*by, F.col("e.did").alias("did"), F.col("e.val").alias(value))


def validate(chunks: DataFrame) -> DataFrame:
    """Per term: number of chunks, and of those that don't follow on their predecessor."""
    w = Window.partitionBy("term").orderBy("chunk_no")
    bad = (F.col("first_did") > F.col("last_did")) | (F.coalesce(F.lag("last_did").over(w), F.lit(0)) >= F.col("first_did"))
    return chunks.withColumn("bad", bad.cast("long")).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("bad").alias("out_of_order"))


def gaps(postings: DataFrame) -> DataFrame:
    before = F.lag("did").over(Window.partitionBy("term").orderBy("did"))
    return postings.select("term", "did", (F.col("did") - F.coalesce(before, F.lit(0))).alias("gap"))


def from_gaps(gaps: DataFrame) -> DataFrame:
    """dids as running sums of gaps, ordered by pos in each term."""
    return gaps.select("term", "pos", F.sum("gap").over(Window.partitionBy("term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("did"))


def did_runs(postings: DataFrame) -> DataFrame:
    """term, first_did, n of the runs of consecutive dids: of a run only its first and last did are kept, and nothing is held but the sort."""
    w = Window.partitionBy("term").orderBy("did")
    first = F.coalesce(F.lag("did").over(w) != F.col("did") - 1, F.lit(True))
    last = F.coalesce(F.lead("did").over(w) != F.col("did") + 1, F.lit(True))
    ends = postings.select("term", "did", first.alias("first"), last.alias("last")).where("first or last")
    end = F.when(F.col("last"), F.col("did")).otherwise(F.lead("did").over(w))
    return ends.select("term", F.col("did").alias("first_did"), (end - F.col("did") + 1).alias("n"), "first").where("first").drop("first")


MOST_LEVELS = 16  # of a skip list of 32-bit dids


def skip_index(postings: DataFrame, levels=None) -> DataFrame:
    """term, level, begin, did_offset, entries: what every pointer of every list's skip list jumps over.

    A list of n entries is halved as often as ``levels`` says (by default its skip list's number
    of levels); both halves of a segment of two entries or more have a pointer.
    Places in a list are found by two levels of counts (cells of dids), so a long list needs no task of its own.
    """
    levels = F.when(F.col("n") > 0, F.floor(F.log10("n") / 0.6)).otherwise(0) if levels is None else F.lit(levels)
    cell = postings.select("term", "did", F.expr(f"did div {STRIDE}").alias("cell"))
    sums = cell.groupBy("term", "cell").agg(F.count("*").alias("c"), F.max("did").alias("top"))
    before = Window.partitionBy("term").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("term", "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.last("top").over(before).alias("prior"), F.sum("c").over(Window.partitionBy("term")).alias("n"))
    here = Window.partitionBy("term", "cell").orderBy("did")
    rows = cell.select("term", "cell", "did", (F.row_number().over(here) - 1).alias("i"), F.lag("did").over(here).alias("back")).join(sums, ["term", "cell"])
    step = F.coalesce(F.col("did") - F.coalesce("back", "prior"), F.lit(0))
    rows = rows.select("term", "n", (F.col("base") + F.col("i")).alias("rn"), step.alias("step"), levels.alias("levels"))
    a, b, parts = F.lit(0).cast("long"), F.col("n"), []
    rows = rows.withColumns({"a0": a, "b0": b})
    for k in range(1, MOST_LEVELS + 1):
        mid = F.expr(f"(a{k - 1} + b{k - 1}) div 2")
        low = F.col("rn") < mid
        rows = rows.withColumns({f"a{k}": F.when(low, F.col(f"a{k - 1}")).otherwise(mid), f"b{k}": F.when(low, mid).otherwise(F.col(f"b{k - 1}"))})
        there = (F.col("levels") >= k) & (F.col(f"b{k - 1}") - F.col(f"a{k - 1}") >= 2)
        parts.append(F.when(there, F.struct(F.lit(k).cast("long").alias("level"), F.col(f"a{k}").alias("begin"))))
    every = rows.select("term", "step", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("p"))
    return every.groupBy("term", "p.level", "p.begin").agg(F.sum("step").alias("did_offset"), F.count("*").alias("entries"))
