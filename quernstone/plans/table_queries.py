"""Queries over posting tables that are written, changed and read again."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import udtf
from ..operators import bitmaps, lookup, topk
from ..sources import bucketed, posting_log
from ..sources.shared import discard, scratch
from ..streaming import changes
from . import inputs as I
from .inputs import WANTED, sql

QUERIES, ORACLES = {}, {}
PARTS = 3  # change sets, or batches of a stream
NAMES = ("tokens", "postings", "posting_changes", "merged_postings")


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _changed(spark, sf) -> str:
    """A table of all postings, and the changes over it in three sets; its path."""
    path = scratch(spark, "postings")
    posting_log.create(I.posting_parts(spark, sf), path, parts=True)
    base = posting_log.read(spark, path)
    for k in range(PARTS):
        posting_log.merge(spark, path, I.posting_changes(base).where(F.pmod("did", F.lit(PARTS)) == k))
    return path


@query(sql("SELECT * FROM merged_postings", *NAMES))
def postlist_log_read(spark, sf):
    """Changes are merged with the base when they are read."""
    return posting_log.read(spark, _changed(spark, sf))


@query(sql("SELECT * FROM merged_postings", *NAMES))
def postlist_log_compact(spark, sf):
    """After the runs of changes have become one, and then the base."""
    path = _changed(spark, sf)
    posting_log.compact(spark, path, fan=2)
    posting_log.compact(spark, path, whole=True)
    posting_log.forget(spark, path)
    return posting_log.read(spark, path)


AS_OF = f"""SELECT v AS version, term, did, wdf FROM postings, (SELECT unnest(range(1, {PARTS + 2})) AS v) WHERE NOT EXISTS (
      SELECT 1 FROM posting_changes c WHERE c.term = postings.term AND c.did = postings.did AND c.did % {PARTS} < v - 1)
    UNION ALL SELECT v, term, did, new_wdf FROM posting_changes, (SELECT unnest(range(1, {PARTS + 2})) AS v) WHERE new_wdf IS NOT NULL AND did % {PARTS} < v - 1"""


@query(sql(AS_OF, "tokens", "postings", "posting_changes"))
def postlist_as_of(spark, sf):
    """The table as it was in each of its versions, read after it was compacted."""
    path = _changed(spark, sf)
    posting_log.compact(spark, path, whole=True)
    each = [posting_log.read(spark, path, version=v).select(F.lit(v).cast("long").alias("version"), "term", "did", "wdf") for v in range(1, PARTS + 2)]
    return reduce(lambda a, b: a.unionByName(b), each)


@query(sql("SELECT * FROM merged_postings", *NAMES))
def postlist_stream(spark, sf):
    """Changes that come as a stream, the last of each posting before an outdated one, and some twice."""
    path, feed, state = (scratch(spark, n) for n in ("postings", "feed", "state"))
    posting_log.create(I.posting_parts(spark, sf), path, parts=True)
    rows = I.posting_changes(posting_log.read(spark, path))
    at = F.timestamp_seconds(F.lit(1_000_000) + F.col("did") % 1000).alias("at")
    last = rows.select("term", "did", "new_wdf", at, F.lit(2).cast("long").alias("seq"))
    stale = rows.select("term", "did", F.lit(999_999).cast("long").alias("new_wdf"), at, F.lit(1).cast("long").alias("seq"))
    for part in (last.where("did % 2 = 0"), stale.unionByName(last.where("did % 2 = 0")), last.where("did % 2 = 1")):
        part.write.mode("append").option("compression", "zstd").parquet(feed)  # as the table is read: not exchanged, and in order
    files = len(spark.read.parquet(feed).inputFiles())
    changes.start(changes.from_files(spark, feed, -(-files // PARTS)), path, state).awaitTermination()
    for done in (feed, state):
        discard(spark, done)
    return posting_log.read(spark, path)


K = 20
IMPACT_CELL = 64  # small, so that small tables have several
TOP = f"""SELECT row_number() OVER (ORDER BY score DESC, did) AS rank, did, score FROM (
      SELECT did, sum(wdf * 1000000 // len)::BIGINT AS score FROM postings JOIN doclens USING (did) WHERE term IN ({", ".join(f"'{t}'" for t in WANTED)}) GROUP BY did)
    ORDER BY score DESC, did LIMIT {K}"""


@query(sql(TOP, "tokens", "postings", "doclens"))
def postlist_topk(spark, sf):
    """By relative frequency; cells whose bounds are too small are not read."""
    path = scratch(spark, "impacts")
    rows = I.postings_with_length(spark, sf)
    topk.write_impacts(topk.impacts(rows, F.expr("wdf * 1000000 div len"), IMPACT_CELL), path)
    return topk.top(spark, path, WANTED, K)


WIDE = "SELECT o_orderkey AS id, (o_orderkey * 7919) % 5000 AS lo, (o_orderkey * 7919) % 5000 + (1::BIGINT << (o_orderkey % 32)::INT) - 2 AS hi FROM orders"


@query(sql(f"SELECT id, count(*) AS n, sum(did)::BIGINT AS dids FROM ({WIDE}) JOIN doclens ON did BETWEEN lo AND hi GROUP BY id", "tokens", "doclens"))
def interval_join(spark, sf):
    """Ranges of all widths that overlap, some of them empty."""
    key, lo = F.col("o_orderkey"), (F.col("o_orderkey") * 7919) % 5000
    ranges = I.table(spark, sf, "orders").select(key.alias("id"), lo.alias("lo"), (lo + F.expr("shiftleft(1L, int(o_orderkey % 32))") - 2).alias("hi"))
    # pairs are not made: their number is that of ranges times that of documents
    found = lookup.interval_sums(I.doclens(spark, sf).select("did"), ranges, "lo", "hi")
    return found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("dids").alias("dids"))


FIVE = (*WANTED, "la")


def _five(body: str) -> str:
    a, *rest = (f"'{t}'" for t in FIVE)
    return sql(body.format(a=a, rest=", ".join(rest), all=", ".join([a, *rest])), "tokens", "postings")


@query(_five("SELECT did FROM postings WHERE term IN ({all}) GROUP BY did"))
def bitmap_or(spark, sf):
    return bitmaps.any_of(I.postings(spark, sf), *FIVE)


@query(_five("SELECT did FROM postings WHERE term IN ('the', 'of', 'and') GROUP BY did HAVING count(*) = 3"))
def bitmap_and(spark, sf):
    return bitmaps.all_of(I.postings(spark, sf), "the", "of", "and")


@query(_five("SELECT did FROM postings WHERE term = {a} AND did NOT IN (SELECT did FROM postings WHERE term IN ({rest}))"))
def bitmap_andnot(spark, sf):
    return bitmaps.but_not(I.postings(spark, sf), *FIVE)


@query(_five("SELECT x.term AS a, y.term AS b, count(*) AS n FROM postings x JOIN postings y USING (did) WHERE x.term IN ({all}) AND y.term IN ({all}) AND x.term < y.term GROUP BY ALL HAVING count(*) > 0"))
def bitmap_together(spark, sf):
    """In how many documents two of five terms are together."""
    return bitmaps.together(I.postings(spark, sf), *((a, b) for a in FIVE for b in FIVE if a < b)).where("n > 0")


def _named(spark, rows, kind: str, key: list[str]) -> str:
    """A bucketed table of the rows, in the warehouse; its name."""
    name = f"quernstone_{kind}_{uuid4().hex}"
    bucketed.write(rows, name, key, 8)
    return name


@query(sql("SELECT * FROM merged_postings", *NAMES))
def postlist_bucket_merge(spark, sf):
    """Only the changes are exchanged."""
    name = _named(spark, I.postings(spark, sf), "postings", bucketed.POSTING_KEY)
    return bucketed.merged(spark, name, I.posting_changes(spark.table(name)), bucketed.POSTING_KEY, "wdf", "new_wdf")


@query(sql("SELECT term, did, wdf, len FROM postings JOIN doclens USING (did)", "tokens", "postings", "doclens"))
def postings_bucket_join(spark, sf):
    """Both tables lie in buckets of did: nothing is exchanged."""
    postings, lengths = _named(spark, I.postings(spark, sf), "by_did", ["did"]), _named(spark, I.doclens(spark, sf), "lengths", ["did"])
    return bucketed.by_document(spark, postings, lengths)


@query(sql("SELECT term, min(did) AS first_did, count(*) AS n FROM (SELECT term, did, did - row_number() OVER (PARTITION BY term ORDER BY did) AS island FROM postings) GROUP BY term, island", "tokens", "postings"))
def list_runs_sql(spark, sf):
    """A table function, called from SQL."""
    udtf.register(spark)
    return spark.sql(f"SELECT term, first_did, n FROM list_runs(TABLE(SELECT * FROM {{rows}}) PARTITION BY pmod(hash(term), {udtf.BUCKETS}) ORDER BY (term, did))", rows=I.places(spark, sf))
