"""Existence tests, seeks and joins over posting and document-length lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 16  # cells of a level in one of the next
LEVELS = 9  # of cells of dids below 2^36
SEEK_CELL = 1 << 16  # dids that a seek looks at together
MAX_DID = (1 << 32) - 1


def scan(postings: DataFrame, *wanted: str) -> DataFrame:
    """The lists of some terms; sorted files prune by the pushed filter."""
    return postings.where(F.col("term").isin(*wanted))


def term_exists(probes: DataFrame, terms: DataFrame) -> DataFrame:
    found = terms.select("term").distinct().withColumn("found", F.lit(True))
    return probes.join(found, "term", "left").select(*probes.columns, F.coalesce("found", F.lit(False)).alias("found"))


def document_exists(probes: DataFrame, doclens: DataFrame) -> DataFrame:
    found = doclens.select("did", F.lit(True).alias("found"))
    return probes.join(found, "did", "left").select(*probes.columns, F.coalesce("found", F.lit(False)).alias("found"))


def doclength(probes: DataFrame, doclens: DataFrame, strict: bool = False) -> DataFrame:
    """Length of every probed document; strict raises for one that is absent."""
    out = probes.join(doclens.select("did", "len"), "did", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("document not found: "), F.col("did").cast("string"))).cast("long")
        out = out.withColumn("len", F.coalesce("len", missing))
    return out


def with_doclength(postings: DataFrame, doclens: DataFrame) -> DataFrame:
    return postings.join(doclens.select("did", "len"), "did")


def jump_to(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """Exact seek: probes(term, probe) with the wdf there, null if absent."""
    there = postings.select("term", F.col("did").alias("probe"), "wdf")
    return probes.join(there, ["term", "probe"], "left").withColumn("found", F.col("wdf").isNotNull())


def _seek(probes: DataFrame, entries: DataFrame, up: bool, cell: int) -> DataFrame:
    """term, probe, e: the nearest of entries(term, e) at or above (up), or at or below, each probe.

    e is a struct that begins with its did.  Entries and probes of one cell of
    dids are numbered together by one window; a probe without an entry in its
    cell takes the edge of the next cell that has one, from a window over the
    term's cells.  Linear, and no task has more than one cell of a term's list.
    """
    e = entries.schema["e"].dataType
    at = F.col("e").getField(e.names[0])
    rows = entries.select("term", at.alias("at"), "e", F.lit(None).cast("long").alias("probe"))
    asks = probes.select("term", F.col("probe").alias("at"), F.lit(None).cast(e).alias("e"), "probe")
    both = rows.unionByName(asks).withColumn("cell", F.expr(f"at div {cell}"))
    way = F.col("at").desc() if up else F.col("at").asc()
    here = Window.partitionBy("term", "cell").orderBy(way, F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("e", F.last("e", ignorenulls=True).over(here)).where("probe is not null")
    # struct order is the order of dids; null is less than any struct
    edge = F.min_by("e", at) if up else F.max_by("e", at)
    cells = both.groupBy("term", "cell").agg(edge.alias("edge"))
    before = Window.partitionBy("term").orderBy(F.col("cell").desc() if up else F.col("cell").asc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("term", "cell", F.last("edge", ignorenulls=True).over(before).alias("beyond"))
    return found.join(cells, ["term", "cell"]).select("term", "probe", F.coalesce("e", "beyond").alias("e"))


def skip_to(probes: DataFrame, postings: DataFrame, cell: int = SEEK_CELL) -> DataFrame:
    """Lower-bound seek: the first did at or after each probe in its term's list, null at the end."""
    found = _seek(probes, postings.select("term", F.struct("did").alias("e")), True, cell)
    return found.select("term", "probe", F.col("e.did").alias("did"))


def chunk_seek(probes: DataFrame, chunks: DataFrame, cell: int = SEEK_CELL) -> DataFrame:
    """Floor seek: the chunk of each probe's term with the greatest first_did not above the probe."""
    found = _seek(probes, chunks.select("term", F.struct("first_did", "chunk_no", "last_did").alias("e")), False, cell)
    return found.select("term", "probe", "e.chunk_no", "e.first_did", "e.last_did")


def chunk_contains(seeks: DataFrame) -> DataFrame:
    """Whether the probe is inside the range of the chunk a seek found (range, not presence)."""
    return seeks.withColumn("inside", F.coalesce(F.col("probe").between(F.col("first_did"), F.col("last_did")), F.lit(False)))


def cover(lo: Column, hi: Column) -> Column:
    """Array of (level, cell): aligned cells of 16^level dids that make up lo to hi, at most 30 a level.

    Whole cells of a level are a to b - 1.  Those that lie in whole cells of the
    next level are left to it, so that the ones before and behind are taken.
    """

    def whole(level: int) -> tuple[Column, Column]:
        size = F.lit(FAN**level)
        return F.call_function("div", lo + (size - 1), size), F.call_function("div", hi + 1, size)

    def cells(start: Column, stop: Column, level: int) -> Column:
        some = F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))

    parts = []
    for level in range(LEVELS):
        (a, b), (up, down) = whole(level), whole(level + 1)
        if level == LEVELS - 1:
            parts.append(cells(a, b, level))
        else:
            parts.append(F.when(up <= down, F.concat(cells(a, up * FAN, level), cells(down * FAN, b, level))).otherwise(cells(a, b, level)))
    return F.concat(*parts)


def interval_join(dids: DataFrame, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Every did with every range that holds it, both ends included; ranges may overlap and be of any width below 2^32.

    A range is O(log width) aligned cells of several sizes, and a did has one cell
    of each size that occurs, so one join on equal cells finds each pair once.
    A range that ends before it begins holds nothing.
    """
    named = ranges.columns
    spread = ranges.select(*named, F.explode(cover(F.col(lo), F.col(hi))).alias("part")).select(*named, "part.level", "part.cell")
    levels = [r.level for r in spread.select("level").distinct().collect()]  # at most LEVELS
    places = F.array(*[F.struct(F.lit(n).alias("level"), F.expr(f"did div {FAN**n}L").alias("cell")) for n in sorted(levels)])
    if not levels:
        return dids.join(ranges, F.lit(False))
    points = dids.select(*dids.columns, F.explode(places).alias("part")).select(*dids.columns, "part.level", "part.cell")
    return points.join(spread, ["level", "cell"]).drop("level", "cell")


def interval_sums(dids: DataFrame, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """ranges that hold a did, with n and dids: the number of dids in each and their sum, without a row for each pair.

    Dids are summed up by cell of every size that occurs, so a range takes one row for
    each of its O(log width) cells; equal ranges are summed once and share the result.
    """
    bounds = ranges.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    spread = bounds.distinct().select("_lo", "_hi", F.explode(cover(F.col("_lo"), F.col("_hi"))).alias("part")).select("_lo", "_hi", "part.level", "part.cell")
    sizes = F.array(*[F.struct(F.lit(n).alias("level"), F.expr(f"did div {FAN**n}L").alias("cell")) for n in range(LEVELS)])
    cells = dids.select("did", F.explode(sizes).alias("part")).groupBy("part.level", "part.cell").agg(F.count("*").alias("n"), F.sum("did").alias("dids"))
    sums = spread.join(cells, ["level", "cell"]).groupBy("_lo", "_hi").agg(F.sum("n").alias("n"), F.sum("dids").alias("dids"))
    return ranges.join(sums, (F.col(lo) == F.col("_lo")) & (F.col(hi) == F.col("_hi"))).select(*ranges.columns, "n", "dids")


def chunk_range_join(dids: DataFrame, chunks: DataFrame) -> DataFrame:
    """did with the chunk of one list whose range holds it."""
    return interval_join(dids, chunks.select("chunk_no", "first_did", "last_did"), "first_did", "last_did")


def chunk_max_did(chunks: DataFrame) -> DataFrame:
    """Largest did that each chunk may take: up to the next chunk's first."""
    nxt = F.lead("first_did").over(Window.partitionBy("term").orderBy("first_did")) - 1
    return chunks.withColumn("max_did", F.coalesce(nxt, F.lit(MAX_DID)))


# ---- boolean combinations (derived from the seeks)


def _list(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("term") == term).select("did", "wdf")


def postings_and(postings: DataFrame, *wanted: str) -> DataFrame:
    """Documents with all terms, and their summed wdf."""
    n = len(set(wanted))
    return scan(postings, *wanted).groupBy("did").agg(F.sum("wdf").alias("wdf"), F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def postings_or(postings: DataFrame, *wanted: str) -> DataFrame:
    return scan(postings, *wanted).groupBy("did").agg(F.sum("wdf").alias("wdf"))


def postings_andnot(postings: DataFrame, term: str, *without: str) -> DataFrame:
    return reduce(lambda left, t: left.join(_list(postings, t), "did", "left_anti"), without, _list(postings, term))
