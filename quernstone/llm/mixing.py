"""Mix sources to target weights by a low-discrepancy schedule (native only).

Sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3, ... and
share the words of the corpus by weight; a target stops at ``REPEATS`` times
its source's size and the excess is shared again by weight.

The mix is a sequence of equal slots of ``BLOCK`` words, as many as the corpus
fills.  Slot ``j`` has the point ``frac((j + 1/2) * golden ratio)``, which the
cumulative targets map to a source; the slot of rank ``r`` in its source takes
the block ``r mod blocks`` of that source, whose documents were laid end to end
in a shuffled order (by the MD5 of doc_id).  A block is taken up to ``REPEATS``
times.  The ranks of a source's n slots are 0 to n - 1, so its first ``n mod
blocks`` blocks are taken ``n div blocks + 1`` times and the others once less:
slots are counted, not kept.  Running sizes are found in two levels (sums of
buckets, then inside a bucket), so no source needs one task.

Each source gets its target within a few blocks.  ``SQL`` makes blocks longer
above 2^24 words; up to there results are the same.

Defined cases: a null text has size 0; null sources form one source; documents
of size 0 take 0; repeated rows are documents of their own; a table without
words gives targets of 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPEATS = 3
BLOCK = 16
GOLDEN = 0.6180339887498949
TURN = 1 << 20  # slots whose points are found from one start, so that they stay exact
CHUNK = 1 << 16
BUCKET = 1 << 16  # documents whose places are summed up together
CELLS = 4096  # equal parts of [0, 1) that each know the bounds in them
UNITS = 10_000  # of a word: cumulative targets are sums of whole numbers, the same in any order
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (number of words)."""
    return docs.select("doc_id", "source", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long")).alias("n")).select(
        "doc_id", "source", F.greatest("n", F.lit(0).cast("long")).alias("size")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, rank, source_size, target, low, high, block, slots: one row for each source.

    The sources that reach their limit are the first in the order of limit by
    weight; behind them all have the same words for each unit of weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    w = w.withColumn("cap", F.col("source_size") * REPEATS)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(every), F.sum("weight").over(every)
    w = w.withColumns({"total": total, "weights": weights})
    w = w.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    fits = (F.col("total") - F.col("cap_before")) * F.col("weight") <= F.col("cap") * (F.col("weights") - F.col("weight_before"))
    unit = F.min(F.when(fits, F.struct("weight_before", ((F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))).alias("unit")))).over(every)["unit"]
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(unit, F.lit(0.0)) * F.col("weight")))
    ordered = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumns({"high": F.sum(F.floor(F.col("target") * UNITS + 0.5)).over(ordered) / UNITS / F.greatest(F.col("total"), F.lit(1)), "block": F.lit(BLOCK).cast("long")})
    return w.select("source", "rank", "source_size", "target", "high", "block", F.expr("(total + block - 1) div block").alias("slots"))


def schedule(goals: DataFrame) -> DataFrame:
    """rank (of the source), turns: how many of the planned slots fall to each source."""
    bounds = goals.agg(F.sort_array(F.collect_list("high")).alias("b"), F.max("slots").alias("m"))
    slots = bounds.select(F.explode(F.when(F.col("m") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {CHUNK}")))).alias("chunk"), "m")
    slots = slots.repartition("chunk").select(F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, m) - 1)")).alias("slot"))
    x = (F.col("slot") % TURN + 0.5) * GOLDEN + F.expr(f"slot div {TURN}") * (TURN * GOLDEN % 1)
    slots = slots.select((x - F.floor(x)).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    cells = bounds.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long"))).alias("cell"))
    cells = cells.select("cell", F.size("b").alias("last"), F.expr(f"size(filter(b, h -> floor(h * {CELLS}) < cell))").alias("before"), F.expr(f"filter(b, h -> floor(h * {CELLS}) = cell)").alias("here"))
    # the last bound is open: sums of targets may end a rounding below 1
    rank = F.expr("cast(least(1 + before + if(size(here) = 0, 0, size(filter(here, h -> h <= x))), last) as int)")
    return slots.join(F.broadcast(cells), "cell").select(rank.alias("rank")).groupBy("rank").agg(F.count("*").alias("turns"))


def laid_out(sizes: DataFrame) -> DataFrame:
    """Adds start: where a document begins when its source is laid end to end.

    The order is that of the MD5; a bucket is a prefix of it, as long as makes buckets of about BUCKET rows.
    """
    digits, rows = 2, sizes.count()
    while rows > BUCKET * 16**digits:
        digits += 1
    keyed = sizes.withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("shuffled", 1, digits))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return keyed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("doc_id", "source", "size", (F.col("base") + F.col("within")).alias("start"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    from .session import cut

    sizes = cut(sized(docs))
    goals = cut(targets(sizes))
    g = goals.join(F.broadcast(schedule(goals)), "rank", "left").withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    g = g.withColumn("n", F.least(F.coalesce("turns", F.lit(0).cast("long")), F.col("blocks") * REPEATS))
    g = g.select(F.col("source").alias("s"), "source_size", "target", F.expr("n div greatest(blocks, 1)").alias("times"), F.expr("n % greatest(blocks, 1) * block").alias("more"))
    placed = laid_out(sizes).join(F.broadcast(g), F.col("source").eqNullSafe(F.col("s")))
    taken = F.expr("size * times + greatest(least(start + size, more) - start, cast(0 as bigint))")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL = r"""
WITH sizes AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM per),
w2 AS (SELECT *, (sum(weight) OVER ())::BIGINT AS weights,
         coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_before
       FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_min((total - cap_before)::DOUBLE / (weights - weight_before)::DOUBLE, weight_before) AS unit FROM w2
      WHERE (total - cap_before) * weight <= cap * (weights - weight_before)),
t AS (SELECT source, rank, source_size, total, least(cap::DOUBLE, coalesce(unit, 0) * weight) AS target FROM w2, u),
g AS (SELECT *, (sum(floor(target * 10000 + 0.5)::BIGINT) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT / 10000 / greatest(total, 1) AS high, greatest(16, (total + 1048575) // 1048576) AS block FROM t),
points AS (SELECT j AS slot, (j + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS y FROM (SELECT unnest(range((SELECT max((total + block - 1) // block) FROM g))) AS j)),
slots AS (SELECT p.slot, least((SELECT max(rank) FROM g), 1 + (SELECT count(*) FROM g WHERE g.high <= p.y - floor(p.y))) AS rank FROM points p),
turns AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn FROM slots),
blocks AS (SELECT rank, (source_size + block - 1) // block AS blocks FROM g),
taken AS (SELECT rank, turn % blocks AS pos, count(*) AS times FROM turns JOIN blocks USING (rank) WHERE blocks > 0 AND turn < 3 * blocks GROUP BY ALL),
placed AS (SELECT s.row, s.doc_id, s.size, g.source_size, g.target, g.rank, g.block,
             (sum(size) OVER (PARTITION BY s.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
           FROM sizes s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
pieces AS (SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS pos FROM placed WHERE size > 0),
got AS (SELECT row, sum((least(start + size, (p.pos + 1) * block) - greatest(start, p.pos * block)) * times)::BIGINT AS taken
        FROM pieces p JOIN taken USING (rank, pos) GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN got USING (row)
"""
