"""Boolean retrieval over words of bits: 64 dids are one long.

The lists of the terms become bits with partial aggregation before the shuffle, so
what is shuffled is at most a long for every 64 dids and term, however dense a
list is.  A word of every term meets in one row; and, or and not are operators on
longs inside generated code.  Only the answer becomes rows of dids again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def bitmap(postings: DataFrame, *by: str) -> DataFrame:
    """by, word, bits: bit k of a word stands for did 64 * word + k."""
    bit = F.expr(f"shiftleft(1L, int(did % {BITS}))")
    return postings.select(*by, F.expr(f"did div {BITS}").alias("word"), bit.alias("bit")).groupBy(*by, "word").agg(F.bit_or("bit").alias("bits"))


def dids(bits: DataFrame) -> DataFrame:
    """did of every bit that is set in (word, bits)."""
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.getbit("bits", k) == 1))
    return bits.where("bits != 0").select("word", place.alias("k")).select((F.col("word") * BITS + F.col("k")).alias("did"))


def _matched(postings: DataFrame, wanted: tuple[str, ...], answer) -> DataFrame:
    """Dids of which answer(bits of each term) is set; a term without postings in a word has none of its bits."""
    wanted = tuple(dict.fromkeys(wanted))
    bit = F.expr(f"shiftleft(1L, int(did % {BITS}))")
    rows = postings.where(F.col("term").isin(*wanted)).select("term", F.expr(f"did div {BITS}").alias("word"), bit.alias("bit"))
    own = [F.bit_or(F.when(F.col("term") == t, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i, t in enumerate(wanted)]
    columns = [F.col(f"b{i}") for i in range(len(wanted))]
    return dids(rows.groupBy("word").agg(*own).select("word", answer(columns).alias("bits")))


def all_of(postings: DataFrame, *wanted: str) -> DataFrame:
    """did of the documents with all terms."""
    return _matched(postings, wanted, lambda b: reduce(Column.bitwiseAND, b))


def any_of(postings: DataFrame, *wanted: str) -> DataFrame:
    return _matched(postings, wanted, lambda b: reduce(Column.bitwiseOR, b))


def but_not(postings: DataFrame, term: str, *without: str) -> DataFrame:
    """did of the documents with a term and none of others."""
    if term in without:
        return postings.select("did").limit(0)
    return _matched(postings, (term, *without), lambda b: b[0] if len(b) == 1 else b[0].bitwiseAND(F.bitwise_not(reduce(Column.bitwiseOR, b[1:]))))


def together(postings: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """a, b, n: in how many documents two terms are together; counts of bits, no rows of dids."""
    words = bitmap(postings.where(F.col("term").isin(*{t for p in pairs for t in p})), "term")
    asked = postings.sparkSession.createDataFrame(list(pairs), "a string, b string")
    left = words.select(F.col("term").alias("a"), "word", F.col("bits").alias("x"))
    right = words.select(F.col("term").alias("b"), "word", F.col("bits").alias("y"))
    both = F.broadcast(asked).join(left, "a").join(right, ["b", "word"])
    return both.groupBy("a", "b").agg(F.sum(F.bit_count(F.col("x").bitwiseAND(F.col("y")))).alias("n"))
