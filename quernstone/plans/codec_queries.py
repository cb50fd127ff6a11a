"""Queries over the codecs: formulas against SQL, codecs by round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import stem as S
from ..operators import build, chunking, partitions, stored
from ..sources.tables import table
from . import inputs as I
from .inputs import BODY_BYTES, DOCLEN_ENTRIES, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register




# ---- formulas


def varint_sql(v: str) -> str:
    parts = []
    for i in range(5):
        byte = f"printf('%02X', (({v} >> {7 * i}) & 127) + CASE WHEN {v} >= {1 << (7 * (i + 1))} THEN 128 ELSE 0 END)"
        parts.append(byte if i == 0 else f"CASE WHEN {v} >= {1 << (7 * i)} THEN {byte} ELSE '' END")
    return " || ".join(parts)


def sortable_sql(v: str) -> str:
    cases = "".join(f"WHEN {v} < {1 << (6 + 8 * m)} THEN printf('%0{2 * m + 2}X', {v} + {(m - 1) << (6 + 8 * m)}) " for m in (1, 2, 3))
    return f"CASE {cases}ELSE printf('%010X', {v} + {3 << 38}) END"


@query(sql(f"SELECT v, {varint_sql('v')} AS code FROM ints", "ints"))
def varint_encode(spark, sf):
    return I.ints(spark, sf).select("v", C.varint_hex(F.col("v")).alias("code"))


@query(sql(f"SELECT v, {sortable_sql('v')} AS code FROM ints", "ints"))
def sortable_uint(spark, sf):
    return I.ints(spark, sf).select("v", C.sortable_hex(F.col("v")).alias("code"))


@query(sql("SELECT v, row_number() OVER (ORDER BY v) AS place FROM ints", "ints"))
def key_order(spark, sf):
    """The order of the encoded bytes is the order of the values."""
    keyed = I.ints(spark, sf).withColumn("key", C.sortable_put(F.col("v")))
    from pyspark.sql import Window

    # rows of one beginning are numbered together; there are at most 2^16 beginnings for each length of a key
    cell = F.substring("key", 1, 3)
    counts = keyed.groupBy(cell.alias("c")).agg(F.count("*").alias("n"))
    counts = counts.select("c", F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = keyed.withColumn("c", cell).withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("key")))
    return inside.join(counts, "c").select("v", (F.col("base") + F.col("k")).alias("place"))


@query(sql(f"SELECT term, first_did, hex(term) || CASE WHEN chunk_no = 0 THEN '' ELSE '00' || ({sortable_sql('first_did')}) END AS key FROM posting_chunks", "tokens", "postings", extra=I.split_cte("postings", BODY_BYTES)))
def postlist_key(spark, sf):
    c = chunking.posting_chunks(I.postings(spark, sf), BODY_BYTES)
    return c.select("term", "first_did", C.posting_key_hex(F.col("term"), F.when(~F.col("is_first"), F.col("first_did"))).alias("key"))


@query(sql("SELECT v, CASE WHEN v < 256 THEN 1 WHEN v < 65536 THEN 2 WHEN v < 16777216 THEN 3 ELSE 4 END::BIGINT AS width FROM ints", "ints"))
def byte_width(spark, sf):
    return I.ints(spark, sf).select("v", C.byte_width(F.col("v")).alias("width"))


@query(sql("SELECT v, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END::BIGINT AS width FROM ints", "ints"))
def bit_width(spark, sf):
    return I.ints(spark, sf).select("v", C.bit_width(F.col("v")).alias("width"))


LOG2 = "CASE WHEN {0} <= 1 THEN 0 ELSE length(bin({0} - 1)) + CASE WHEN {0} >= 256 AND ({0} & ({0} - 1)) = 0 THEN 1 ELSE 0 END END"


@query(sql(f"SELECT v, ({LOG2.format('v')})::BIGINT AS log2 FROM ints", "ints"))
def vs_log2(spark, sf):
    return I.ints(spark, sf).select("v", C.log2_up(F.col("v")).alias("log2"))


@query(sql("SELECT v, v AS unary_length, (2 * length(bin(v)) - 1)::BIGINT AS gamma_length FROM ints WHERE v > 0", "ints"))
def code_lengths(spark, sf):
    return I.ints(spark, sf).where("v > 0").select("v", F.col("v").alias("unary_length"), (2 * F.length(F.bin(F.col("v"))) - 1).cast("long").alias("gamma_length"))


@query("SELECT p_partkey, p_size::BIGINT AS v, repeat('1', p_size - 1) || '0' AS bits FROM part")
def unary_bits(spark, sf):
    v = F.col("p_size").cast("long")
    return table(spark, sf, "part").select("p_partkey", v.alias("v"), C.unary_bits(v).alias("bits"))


@query(sql("SELECT v, repeat('1', length(bin(v))::INT - 1) || '0' || substr(bin(v), 2) AS bits, v AS back FROM ints WHERE v > 0", "ints"))
def gamma_bits(spark, sf):
    out = I.ints(spark, sf).where("v > 0").select("v", C.gamma_bits(F.col("v")).alias("bits"))
    return out.withColumn("back", C.gamma_read("bits"))


@query(sql("SELECT v, lpad(bin(v), 32, '0') AS bits FROM ints", "ints"))
def fixed_bits(spark, sf):
    return I.ints(spark, sf).select("v", C.fixed_bits(F.col("v"), 32).alias("bits"))


# ---- round trips of values


@query(sql("SELECT v, v AS back FROM ints", "ints"))
def varint_rt(spark, sf):
    return I.ints(spark, sf).select("v", C.varint_get(C.varint_put(F.col("v"))).alias("back"))


@query(sql("SELECT v, v AS back FROM ints", "ints"))
def fixedbytes_rt(spark, sf):
    return I.ints(spark, sf).select("v", C.fixed_get(C.fixed_put(F.col("v"), 4), 4).alias("back"))


@query(sql("SELECT v, v AS back FROM ints", "ints"))
def lastint_rt(spark, sf):
    return I.ints(spark, sf).select("v", C.last_get(C.last_put(F.col("v"))).alias("back"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS back FROM orders")
def bool_rt(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.bool_get(C.bool_put(F.col("o_orderkey") % 2 == 0)).alias("back"))


@query("SELECT p_partkey, p_name AS back FROM part")
def string_rt(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.string_get(C.string_put(F.col("p_name"))).alias("back"))


@query("SELECT doc_id, sha256(text) AS back FROM documents")
def sortable_string(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(C.sortable_string_get(C.sortable_string_put(F.col("text"))), 256).alias("back"))


@query("SELECT o_orderkey, o_orderkey % 1000 AS back FROM orders")
def minbin_rt(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", C.minimal_binary(key % 1000, key % 1000 + 1 + key % 37).alias("back"))


# ---- round trips of lists

LISTS = sql("SELECT term, did FROM postings", "tokens", "postings")
PAIRS = sql("SELECT term, did, wdf FROM postings", "tokens", "postings")


def _lists(spark, sf):
    return build.int_lists(I.postings(spark, sf))


@query(LISTS)
def vs_rt(spark, sf):
    return _lists(spark, sf).select("term", F.explode(C.vs_decode(C.vs_encode("dids"))).alias("did"))


@query(LISTS)
def interp_rt(spark, sf):
    return _lists(spark, sf).select("term", F.explode(C.interp_decode(C.interp_encode("dids"))).alias("did"))


@query(PAIRS)
def fixedwidth_rt(spark, sf):
    rows = chunking.posting_chunk_rows(I.postings(spark, sf), BODY_BYTES)
    return chunking.entries_of(chunking.bodies(rows, ["term"], C.lengths_encode), ["term"], C.lengths_decode)


@query(PAIRS)
def postlist_chunk_rt(spark, sf):
    rows = chunking.posting_chunk_rows(I.postings(spark, sf), BODY_BYTES)
    return chunking.entries_of(chunking.bodies(rows, ["term"], C.postings_encode), ["term"], C.postings_decode)


@query(PAIRS)
def skiplist_rt(spark, sf):
    rows = chunking.posting_chunk_rows(I.postings(spark, sf), BODY_BYTES)
    return chunking.entries_of(chunking.bodies(rows, ["term"], C.skips_encode), ["term"], C.skips_decode)


@query(sql("SELECT term, did, wdf FROM postings UNION ALL SELECT '', did, len FROM doclens", "tokens", "postings", "doclens"))
def stored_chunks_rt(spark, sf):
    """Posting, skip-list and length chunks with their headers in one table, read back by their codec names."""
    p = I.postings(spark, sf)
    skips = F.crc32(F.encode("term", "UTF-8")) % 2 == 0
    kept = [stored.stored_postings(p.where(skips), BODY_BYTES, "skiplist"), stored.stored_postings(p.where(~skips), BODY_BYTES)]
    return stored.entries_of(kept[0].unionByName(kept[1]).unionByName(stored.stored_doclens(I.doclens(spark, sf), DOCLEN_ENTRIES)))


@query(sql("SELECT term, count(*) AS entries, sum(wdf)::BIGINT AS collfreq, min(did) AS first_did FROM postings GROUP BY term", "tokens", "postings"))
def stored_headers(spark, sf):
    """What the first chunks' headers say of their lists, at the production chunk size."""
    return stored.list_headers(stored.stored_postings(I.postings(spark, sf)))


JUMP = sql("SELECT o_orderkey AS did, len FROM orders JOIN doclen_chunks ON o_orderkey BETWEEN first_did AND last_did LEFT JOIN doclens ON did = o_orderkey", "tokens", "doclens", "doclen_rows", "doclen_chunks")


def _jump(spark, sf, encode, find):
    """Each probe that falls in a chunk, read straight from the chunk's bytes."""
    from ..operators.lookup import chunk_range_join

    rows = chunking.doclen_chunk_rows(I.doclens(spark, sf), DOCLEN_ENTRIES)
    bodies = chunking.bodies(rows, [], encode, "len")
    hit = chunk_range_join(I.did_probes(spark, sf), bodies)
    return hit.join(bodies.select("chunk_no", "body"), "chunk_no").select("did", find("body", "first_did", "did").alias("len"))


@query(JUMP)
def fixedwidth_jump(spark, sf):
    return _jump(spark, sf, C.lengths_encode, C.lengths_find)


@query(JUMP)
def skiplist_jump(spark, sf):
    return _jump(spark, sf, C.skips_encode, C.skips_find)


PARTS = f"""g AS MATERIALIZED (SELECT term, did - coalesce(lag(did) OVER w, 0) AS gap, row_number() OVER w - 1 AS i FROM postings WINDOW w AS (PARTITION BY term ORDER BY did)),
    l AS MATERIALIZED (SELECT term, i, ({LOG2.format("gap")})::BIGINT AS b FROM g),
    cut AS (
      SELECT term, i, 0::BIGINT AS part, b AS top, b AS good, 1::BIGINT AS n FROM l WHERE i = 0
      UNION ALL
      SELECT l.term, l.i, CASE WHEN c THEN l.i ELSE s.part END, CASE WHEN c THEN b ELSE greatest(top, b) END, CASE WHEN c THEN b ELSE good + b END, CASE WHEN c THEN 1 ELSE n + 1 END
      FROM cut s JOIN l ON l.term = s.term AND l.i = s.i + 1, LATERAL (SELECT greatest(s.top, l.b) > 0 AND (s.good + l.b) * 10 < 3 * greatest(s.top, l.b) * (s.n + 1) AS c))"""


@query(sql("SELECT term, part, count(*) AS n FROM cut GROUP BY term, part", "tokens", "postings", extra=PARTS))
def vs_partitions(spark, sf):
    cuts = _lists(spark, sf).select("term", C.vs_cuts("dids").alias("c"))
    part = F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] as part, c[i] - c[i - 1] as n))"))
    return cuts.select("term", part.alias("p")).select("term", "p.part", "p.n")


@query()
def vs_partitions_opt(spark, sf):
    """Bits of both partitionings; the optimal one never needs more (within its longest partition)."""
    return partitions.bits(I.places(spark, sf))


# ---- stemming

SET = ", ".join(f"({r.rule_id}, '{r.suffix}', '{r.repl}', {str(r.intact).lower()}, {str(r.cont).lower()}, {str(r.prot).lower()})" for r in S.ALL)
ACCEPTABLE = "(length({0}) > 3 OR regexp_matches({0}, '^[aeiouy][b-df-hj-np-tv-xz]') OR regexp_matches({0}, '^[^aeiouy][aeiouy].$'))"
STEMS = f"""rules(id, suf, rep, intact, cont, prot) AS (VALUES {SET}),
    words AS (SELECT DISTINCT term FROM tokens),
    walk AS (
      SELECT term, term AS cur, true AS whole, NOT {ACCEPTABLE.format("term")} AS done FROM words
      UNION ALL
      SELECT term, CASE WHEN r.id IS NULL OR prot THEN cur WHEN NOT cont OR {ACCEPTABLE.format("nxt")} THEN nxt ELSE cur END, false,
             r.id IS NULL OR NOT coalesce(cont, false) OR NOT {ACCEPTABLE.format("nxt")}
      FROM (SELECT w.term, w.cur, r.*, left(w.cur, length(w.cur) - length(r.suf)) || r.rep AS nxt, row_number() OVER (PARTITION BY w.term ORDER BY r.id) AS k
            FROM walk w LEFT JOIN rules r ON right(w.cur, length(r.suf)) = r.suf AND length(r.suf) < length(w.cur) AND (NOT r.intact OR w.whole) WHERE NOT w.done) r
      WHERE k = 1)"""


@query(sql("SELECT term, cur AS stem FROM walk WHERE done", "tokens", extra=STEMS))
def stem(spark, sf):
    return I.tokens(spark, sf).select("term").distinct().select("term", C.stem_word("term").alias("stem"))


@query(sql(f"SELECT DISTINCT term, {ACCEPTABLE.format('term')} AS acceptable FROM tokens", "tokens"))
def stem_acceptable(spark, sf):
    return I.tokens(spark, sf).select("term").distinct().select("term", C.acceptable(F.col("term")).alias("acceptable"))


@query(f"SELECT id AS rule_id, suf AS suffix, rep AS repl, intact, cont, prot FROM (VALUES {SET}) r(id, suf, rep, intact, cont, prot)")
def stem_rules(spark, sf):
    return spark.createDataFrame([tuple(r) for r in S.ALL], "rule_id int, suffix string, repl string, intact boolean, cont boolean, prot boolean")
