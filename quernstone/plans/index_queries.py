"""Queries over posting lists, document lengths, chunks and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import build, chunking, lookup, merge

from . import inputs as I
from .inputs import BODY_BYTES, DOCLEN_ENTRIES, WANTED, split_cte, sql, vsize

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def in_list(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


# ---- building, scans, statistics


@query(sql("SELECT * FROM postings", "tokens", "postings"))
def postings_build(spark, sf):
    return I.postings(spark, sf)


@query(sql("SELECT * FROM doclens", "tokens", "doclens"))
def doclen_build(spark, sf):
    return build.doclens(I.tokens(spark, sf))


@query(sql("SELECT * FROM doclens", "tokens", "doclens"))
def doclen_scan(spark, sf):
    rows = chunking.doclen_chunk_rows(I.doclens(spark, sf), DOCLEN_ENTRIES)
    return chunking.entries_of(chunking.bodies(rows, [], C.lengths_encode, "len"), [], C.lengths_decode, "len")


@query(sql("SELECT * FROM tokens", "tokens"))
def positions(spark, sf):
    return I.tokens(spark, sf).select("term", "did", "pos")


@query(sql("SELECT term, did, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tokens GROUP BY term, did", "tokens"))
def position_lists(spark, sf):
    return build.position_lists(I.tokens(spark, sf)).select("term", "did", F.array_join("pos", " ").alias("positions"))


@query(sql(f"SELECT did, wdf FROM postings WHERE term = '{WANTED[0]}'", "tokens", "postings"))
def postlist_scan(spark, sf):
    return lookup.scan(I.postings(spark, sf), WANTED[0]).select("did", "wdf")


@query(sql(f"SELECT * FROM postings WHERE term IN ({in_list(WANTED)})", "tokens", "postings"))
def postlist_multi_scan(spark, sf):
    return lookup.scan(I.postings(spark, sf), *WANTED)


@query(sql("SELECT term, count(*) AS termfreq FROM postings GROUP BY term", "tokens", "postings"))
def termfreq(spark, sf):
    return build.terms(I.postings(spark, sf)).select("term", "termfreq")


@query(sql("SELECT term, sum(wdf)::BIGINT AS collfreq FROM postings GROUP BY term", "tokens", "postings"))
def collfreq(spark, sf):
    return build.terms(I.postings(spark, sf)).select("term", "collfreq")


@query(sql("SELECT term || ':' || termfreq AS description FROM terms", "tokens", "postings", "terms"))
def postlist_describe(spark, sf):
    return build.terms(I.postings(spark, sf)).select(C.describe(F.col("term"), F.col("termfreq")).alias("description"))


@query(sql("SELECT term, count(*) AS n_entries, max(did) AS last_entry FROM postings GROUP BY term", "tokens", "postings"))
def list_stats(spark, sf):
    return I.postings(spark, sf).groupBy("term").agg(F.count("*").alias("n_entries"), F.max("did").alias("last_entry"))


@query(sql(f"SELECT term, sum({vsize('did')} + {vsize('wdf')})::BIGINT AS bytes FROM postings GROUP BY term", "tokens", "postings"))
def varint_size(spark, sf):
    return I.postings(spark, sf).groupBy("term").agg(F.sum(C.varint_size(F.col("did")) + C.varint_size(F.col("wdf"))).alias("bytes"))


# ---- existence, seeks, joins


@query(sql("SELECT term, term IN (SELECT term FROM terms) AS found FROM term_probes", "tokens", "postings", "terms", "term_probes"))
def term_exists(spark, sf):
    return lookup.term_exists(I.term_probes(spark, sf), build.terms(I.postings(spark, sf)))


@query(sql("SELECT o_orderkey AS did, o_orderkey IN (SELECT did FROM doclens) AS found FROM orders", "tokens", "doclens"))
def document_exists(spark, sf):
    return lookup.document_exists(I.did_probes(spark, sf), I.doclens(spark, sf))


@query(sql("SELECT o_orderkey AS did, len FROM orders LEFT JOIN doclens ON did = o_orderkey", "tokens", "doclens"))
def doclen_lookup(spark, sf):
    return lookup.doclength(I.did_probes(spark, sf), I.doclens(spark, sf))


@query(sql("SELECT term, did, wdf, len FROM postings JOIN doclens USING (did)", "tokens", "postings", "doclens"))
def postings_with_doclen(spark, sf):
    return lookup.with_doclength(I.postings(spark, sf), I.doclens(spark, sf)).select("term", "did", "wdf", "len")


@query(sql("SELECT s.term, probe, wdf, wdf IS NOT NULL AS found FROM seek_probes s LEFT JOIN postings p ON p.term = s.term AND p.did = probe", "tokens", "postings", "seek_probes"))
def jump_to(spark, sf):
    return lookup.jump_to(I.seek_probes(spark, sf), I.postings(spark, sf))


@query(sql("SELECT s.term, probe, did FROM seek_probes s ASOF LEFT JOIN postings p ON s.term = p.term AND probe <= p.did", "tokens", "postings", "seek_probes"))
def skip_to(spark, sf):
    return lookup.skip_to(I.seek_probes(spark, sf), I.postings(spark, sf))


def _posting_chunks(spark, sf):
    return chunking.posting_chunks(I.postings(spark, sf), BODY_BYTES)


SPLIT = split_cte("postings", BODY_BYTES)
SEEK = "SELECT s.term, probe, chunk_no, first_did, last_did FROM seek_probes s ASOF LEFT JOIN posting_chunks c ON s.term = c.term AND probe >= c.first_did"


@query(sql(SEEK, "tokens", "postings", "seek_probes", extra=SPLIT))
def chunk_seek(spark, sf):
    return lookup.chunk_seek(I.seek_probes(spark, sf), _posting_chunks(spark, sf))


@query(sql(f"SELECT *, coalesce(probe BETWEEN first_did AND last_did, false) AS inside FROM ({SEEK})", "tokens", "postings", "seek_probes", extra=SPLIT))
def chunk_contains(spark, sf):
    return lookup.chunk_contains(lookup.chunk_seek(I.seek_probes(spark, sf), _posting_chunks(spark, sf)))


@query(sql("SELECT o_orderkey AS did, chunk_no, first_did, last_did FROM orders JOIN doclen_chunks ON o_orderkey BETWEEN first_did AND last_did", "tokens", "doclens", "doclen_rows", "doclen_chunks"))
def chunk_range_join(spark, sf):
    return lookup.chunk_range_join(I.did_probes(spark, sf), chunking.doclen_chunks(I.doclens(spark, sf), DOCLEN_ENTRIES))


@query(sql("SELECT term, chunk_no, first_did, coalesce(lead(first_did) OVER (PARTITION BY term ORDER BY first_did) - 1, 4294967295) AS max_did FROM posting_chunks", "tokens", "postings", extra=SPLIT))
def chunk_max_did(spark, sf):
    return lookup.chunk_max_did(_posting_chunks(spark, sf)).select("term", "chunk_no", "first_did", "max_did")


def _two(body: str) -> str:
    return sql(body.format(a=WANTED[0], b=WANTED[1]), "tokens", "postings")


@query(_two("SELECT did, sum(wdf)::BIGINT AS wdf FROM postings WHERE term IN ('{a}', '{b}') GROUP BY did HAVING count(*) = 2"))
def postings_and(spark, sf):
    return lookup.postings_and(I.postings(spark, sf), *WANTED[:2])


@query(_two("SELECT did, sum(wdf)::BIGINT AS wdf FROM postings WHERE term IN ('{a}', '{b}') GROUP BY did"))
def postings_or(spark, sf):
    return lookup.postings_or(I.postings(spark, sf), *WANTED[:2])


@query(_two("SELECT did, wdf FROM postings WHERE term = '{a}' AND did NOT IN (SELECT did FROM postings WHERE term = '{b}')"))
def postings_andnot(spark, sf):
    return lookup.postings_andnot(I.postings(spark, sf), *WANTED[:2])


# ---- chunks, gaps, runs


@query(sql("SELECT * FROM doclen_chunks", "tokens", "doclens", "doclen_rows", "doclen_chunks"))
def doclen_chunks(spark, sf):
    return chunking.doclen_chunks(I.doclens(spark, sf), DOCLEN_ENTRIES)


@query(sql("SELECT * FROM posting_chunks", "tokens", "postings", extra=SPLIT))
def postlist_chunks(spark, sf):
    return _posting_chunks(spark, sf)


@query(sql("SELECT * FROM posting_chunks", "tokens", "postings", extra=split_cte("postings", chunking.BYTES)))
def postlist_chunks_full(spark, sf):
    """At the production size of a chunk."""
    return chunking.posting_chunks(I.postings(spark, sf))


@query(sql(f"SELECT did // {chunking.ENTRIES} AS chunk_no, min(did0) AS first_did, max(did0) AS last_did, count(*) AS n_entries FROM (SELECT did AS did0, row_number() OVER (ORDER BY did) - 1 AS did FROM doclens) GROUP BY 1", "tokens", "doclens"))
def doclen_chunks_full(spark, sf):
    """At the production size of a chunk."""
    return chunking.doclen_chunks(I.doclens(spark, sf)).select("chunk_no", "first_did", "last_did", "n_entries")


@query(sql("SELECT term, count(*) AS chunks, 0::BIGINT AS out_of_order FROM posting_chunks GROUP BY term", "tokens", "postings", extra=SPLIT))
def chunk_validate(spark, sf):
    return chunking.validate(_posting_chunks(spark, sf))


@query(sql("SELECT term, did, did - coalesce(lag(did) OVER (PARTITION BY term ORDER BY did), 0) AS gap FROM postings", "tokens", "postings"))
def postings_gaps(spark, sf):
    return chunking.gaps(I.postings(spark, sf))


@query(sql("SELECT term, did FROM postings", "tokens", "postings"))
def gaps_roundtrip(spark, sf):
    return chunking.from_gaps(chunking.gaps(I.postings(spark, sf)).withColumnRenamed("did", "pos")).select("term", "did")


@query(sql("SELECT term, min(did) AS first_did, count(*) AS n FROM (SELECT term, did, did - row_number() OVER (PARTITION BY term ORDER BY did) AS island FROM postings) GROUP BY term, island", "tokens", "postings"))
def did_runs(spark, sf):
    return chunking.did_runs(I.postings(spark, sf))


RUNS = """ordered AS MATERIALIZED (SELECT term, did, CASE WHEN wdf < 256 THEN 1 WHEN wdf < 65536 THEN 2 WHEN wdf < 16777216 THEN 3 ELSE 4 END AS w, row_number() OVER (PARTITION BY term ORDER BY did) AS rn
      FROM (SELECT * FROM postings UNION ALL SELECT '', did, len FROM doclens)),
    step AS (
      SELECT term, rn, did, did AS first_did, w AS width, 0::BIGINT AS used, 0::BIGINT AS good FROM ordered WHERE rn = 1
      UNION ALL
      SELECT o.term, o.rn, o.did, CASE WHEN ok THEN s.first_did ELSE o.did END, CASE WHEN ok THEN s.width ELSE o.w END,
             CASE WHEN ok THEN s.used + s.width ELSE 0 END, CASE WHEN ok THEN s.good + o.w ELSE 0 END
      FROM step s JOIN ordered o ON o.term = s.term AND o.rn = s.rn + 1,
           LATERAL (SELECT o.did = s.did + 1 AND o.w <= s.width AND (s.good + o.w) * 10 >= (s.used + s.width) * 8 AS ok))"""


@query(sql("SELECT term, first_did, count(*) AS n, count(*) >= 6 AS is_block FROM step GROUP BY term, first_did", "tokens", "postings", "doclens", extra=RUNS))
def fixedwidth_segments(spark, sf):
    lengths = I.doclens(spark, sf).select(F.lit("").alias("term"), "did", F.col("len").alias("wdf")).repartition("did")  # words are counted once
    return chunking.block_runs(I.postings(spark, sf).unionByName(lengths))


@query(sql("SELECT term, count(*) AS n, CAST(floor(log10(count(*)) / 0.6) AS BIGINT) AS levels FROM postings GROUP BY term", "tokens", "postings"))
def skip_levels(spark, sf):
    return I.postings(spark, sf).groupBy("term").agg(F.count("*").alias("n")).select("term", "n", C.skip_levels(F.col("n")).alias("levels"))


SKIPS = """o AS MATERIALIZED (SELECT term, row_number() OVER w - 1 AS rn, coalesce(did - lag(did) OVER w, 0) AS step FROM postings WINDOW w AS (PARTITION BY term ORDER BY did)),
    l AS (SELECT term, count(*) AS n, floor(log10(count(*)) / 0.6)::BIGINT AS levels FROM postings GROUP BY term),
    seg AS (
      SELECT term, 0::BIGINT AS level, 0::BIGINT AS a, n AS b, levels FROM l
      UNION ALL
      SELECT term, level + 1, CASE WHEN half = 0 THEN a ELSE (a + b) // 2 END, CASE WHEN half = 0 THEN (a + b) // 2 ELSE b END, levels
      FROM seg, (VALUES (0), (1)) h(half) WHERE level < levels AND b - a >= 2)"""


@query(sql("SELECT s.term, s.level, s.a AS begin, sum(step)::BIGINT AS did_offset, count(*) AS entries FROM seg s JOIN o ON o.term = s.term AND o.rn >= s.a AND o.rn < s.b WHERE s.level > 0 GROUP BY ALL", "tokens", "postings", extra=SKIPS))
def skip_index(spark, sf):
    return chunking.skip_index(I.postings(spark, sf))


# ---- merges


@query(sql("SELECT * FROM merged_postings", "tokens", "postings", "posting_changes", "merged_postings"))
def postlist_merge(spark, sf):
    p = I.postings(spark, sf)
    return merge.merge_postings(p, I.posting_changes(p))


@query(sql("SELECT * FROM merged_doclens", "tokens", "doclens", "doclen_changes", "merged_doclens"))
def doclen_merge(spark, sf):
    d = I.doclens(spark, sf)
    return merge.merge_doclens(d, I.doclen_changes(d))


@query(sql("SELECT d.did, coalesce(new_len, len) AS len FROM doclens d LEFT JOIN doclen_changes c USING (did) UNION SELECT did, new_len FROM doclen_changes WHERE new_len IS NOT NULL", "tokens", "doclens", "doclen_changes"))
def skiplist_merge(spark, sf):
    d = I.doclens(spark, sf)
    return merge.upsert_doclens(d, I.doclen_changes(d))


@query(sql("SELECT term, count(*) AS termfreq, sum(wdf)::BIGINT AS collfreq FROM merged_postings GROUP BY term", "tokens", "postings", "posting_changes", "merged_postings"))
def term_stats_delta(spark, sf):
    p = I.postings(spark, sf)
    return merge.apply_delta(build.terms(p), merge.stats_delta(p, I.posting_changes(p)))


@query(sql("SELECT DISTINCT term FROM postings WHERE term NOT IN (SELECT term FROM merged_postings)", "tokens", "postings", "posting_changes", "merged_postings"))
def term_drop(spark, sf):
    p = I.postings(spark, sf)
    return merge.dropped_terms(build.terms(p), merge.merge_postings(p, I.posting_changes(p)))


@query(sql("SELECT * FROM posting_chunks", "tokens", "postings", "posting_changes", "merged_postings", extra=split_cte("merged_postings", BODY_BYTES)))
def postlist_merge_chunks(spark, sf):
    p = I.postings(spark, sf)
    return chunking.posting_chunks(merge.merge_postings(p, I.posting_changes(p)), BODY_BYTES)



