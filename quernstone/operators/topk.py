"""The k best documents of some terms, by bounds of the weights in cells of dids.

An impact table holds (term, cell, did, weight), sorted, and beside it the largest
weight of each term in each cell.  A search first reads these bounds alone.  A
document scores at most the sum of its cell's bounds, so cells below the k-th best
score can't matter.  That score is known from below: by the k-th largest weight
that stands in a cell of its own, then by the true scores in the k cells of the
largest bounds.  Only cells that can reach it are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELL = 1 << 12  # dids
LISTED = 1000  # cells that are named in the filter of a scan, to prune row groups


def impacts(postings: DataFrame, weight: Column, cell: int = CELL) -> DataFrame:
    """term, cell, did, weight (a whole number that isn't negative) of postings with what the weight needs."""
    return postings.select("term", F.expr(f"did div {cell}").alias("cell"), "did", weight.cast("long").alias("weight"))


def bounds(rows: DataFrame) -> DataFrame:
    """term, cell, most, n: the largest weight of a term in a cell, and its postings there."""
    return rows.groupBy("term", "cell").agg(F.max("weight").alias("most"), F.count("*").alias("n"))


def write_impacts(rows: DataFrame, path: str) -> None:
    """Both tables, range-partitioned and sorted, so that terms and cells prune row groups; no list is one task."""
    order = ["term", "cell", "did"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/impacts")
    kept = rows.sparkSession.read.parquet(f"{path}/impacts")
    bounds(kept).repartitionByRange("term", "cell").sortWithinPartitions("term", "cell").write.mode("overwrite").parquet(f"{path}/bounds")


def _scores(rows: DataFrame, wanted: tuple[str, ...], cells: DataFrame) -> DataFrame:
    """did, score in some cells: a filter that prunes where they are few, a semi-join where they aren't."""
    rows = rows.where(F.col("term").isin(*wanted))
    few = [r.cell for r in cells.select("cell").limit(LISTED + 1).collect()]
    rows = rows.where(F.col("cell").isin(*few)) if len(few) <= LISTED else rows.join(cells.select("cell"), "cell", "left_semi")
    return rows.groupBy("did").agg(F.sum("weight").alias("score"))


def _kth(scores: DataFrame, column: str, k: int) -> int:
    """The k-th largest value, 0 where there are fewer."""
    best = scores.select(column).orderBy(F.desc(column)).limit(k).collect()  # k rows
    return best[-1][0] if len(best) == k else 0


def reachable(limits: DataFrame, rows: DataFrame, wanted: tuple[str, ...], k: int) -> tuple[DataFrame, int]:
    """cell, bound of the cells that may hold one of the k best, and a score that k documents have at least."""
    cells = limits.where(F.col("term").isin(*wanted)).groupBy("cell").agg(F.sum("most").alias("bound"), F.max("most").alias("seen"))
    least = _kth(cells, "seen", k)
    first = cells.orderBy(F.desc("bound"), "cell").limit(k)
    least = max(least, _kth(_scores(rows, wanted, first), "score", k))
    return cells.where(F.col("bound") >= least).select("cell", "bound"), least


def top(spark: SparkSession, path: str, wanted: tuple[str, ...], k: int) -> DataFrame:
    """rank, did, score of the k documents with the largest sums of weights; of equal ones the least dids."""
    rows, limits = spark.read.parquet(f"{path}/impacts"), spark.read.parquet(f"{path}/bounds")
    wanted = tuple(sorted(set(wanted)))
    cells, _ = reachable(limits, rows, wanted, k)
    best = _scores(rows, wanted, cells).orderBy(F.desc("score"), "did").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "did")).cast("long").alias("rank"), "did", "score")  # k rows
