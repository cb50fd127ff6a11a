"""Tables that the queries start from, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..sources.tables import table

DOCLEN_ENTRIES = 100  # small, so that small tables have several chunks
BODY_BYTES = 200
WANTED = ("the", "of", "de", "und")
ABSENT = "qqqq"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return build.tokens(table(spark, sf, "documents"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return build.postings(tokens(spark, sf))


def posting_parts(spark: SparkSession, sf: str) -> DataFrame:
    return build.posting_parts(table(spark, sf, "documents"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    return build.places(table(spark, sf, "documents"))


def postings_with_length(spark: SparkSession, sf: str) -> DataFrame:
    return build.postings_with_length(table(spark, sf, "documents"))


def doclens(spark: SparkSession, sf: str) -> DataFrame:
    return build.doclens_of(table(spark, sf, "documents"))


def term_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Every part name as a term, and some that exist."""
    names = table(spark, sf, "part").select(F.lower(F.substring_index("p_name", " ", 1)).alias("term"))
    return names.unionByName(spark.createDataFrame([(t,) for t in (*WANTED, ABSENT)], "term string")).distinct()


def did_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as document ids: some exist, most don't."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("did"))


def seek_probes(spark: SparkSession, sf: str) -> DataFrame:
    """(term, probe): a few terms at every order key."""
    return did_probes(spark, sf).select(F.explode(F.array(*map(F.lit, (*WANTED, ABSENT)))).alias("term"), F.col("did").alias("probe"))


def doclen_changes(doclens: DataFrame) -> DataFrame:
    """Deletes, updates, inserts behind the end, deletes of what is absent."""
    top = doclens.agg(F.max("did").alias("top"))
    some = doclens.where("did % 7 = 0 or did % 5 = 0").select("did", F.when(F.col("did") % 7 != 0, F.col("len") + 1).alias("new_len"))
    more = top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + 10)).alias("did")).select("did", (F.col("did") % 300 + 1).alias("new_len"))
    none = top.select(F.explode(F.sequence(F.col("top") + 101, F.col("top") + 103)).alias("did")).select("did", F.lit(None).cast("long").alias("new_len"))
    return some.unionByName(more).unionByName(none)


def posting_changes(postings: DataFrame) -> DataFrame:
    """As for lengths; the term "of" loses all its postings, a new term gets some."""
    top = postings.agg(F.max("did").alias("top"))
    gone = (F.col("term") == "of") | (F.col("did") % 7 == 0)
    some = postings.where(gone | (F.col("did") % 5 == 0)).select("term", "did", F.when(~gone, F.col("wdf") + 1).alias("new_wdf"))
    more = top.select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + 10)).alias("did")).select(F.explode(F.array(F.lit("the"), F.lit("newterm"))).alias("term"), "did", (F.col("did") % 9 + 1).alias("new_wdf"))
    none = top.select(F.lit(ABSENT).alias("term"), F.explode(F.sequence(F.col("top") + 101, F.col("top") + 103)).alias("did")).select("term", "did", F.lit(None).cast("long").alias("new_wdf"))
    return some.unionByName(more).unionByName(none)


def ints(spark: SparkSession, sf: str) -> DataFrame:
    """v: 32-bit integers of all widths, from the order keys."""
    key = F.col("o_orderkey")
    spread = (key * 2654435761) % 4294967295
    return table(spark, sf, "orders").select(F.when(key % 3 == 0, key).when(key % 3 == 1, spread).otherwise(F.expr("shiftleft(1L, int(o_orderkey % 32))")).alias("v")).distinct()


# ---- the same as SQL

CTE = {
    "tokens": """tokens AS (SELECT doc_id + 1 AS did, lower(unnest(w)) AS term, generate_subscripts(w, 1)::BIGINT AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents))""",
    "postings": "postings AS MATERIALIZED (SELECT term, did, count(*) AS wdf FROM tokens GROUP BY ALL)",
    "doclens": "doclens AS (SELECT did, count(*) AS len FROM tokens GROUP BY ALL)",
    "terms": "terms AS (SELECT term, count(*) AS termfreq, sum(wdf)::BIGINT AS collfreq FROM postings GROUP BY ALL)",
    "term_probes": f"""term_probes AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part
      UNION SELECT unnest([{", ".join(f"'{t}'" for t in (*WANTED, ABSENT))}]))""",
    "seek_probes": f"seek_probes AS (SELECT unnest([{', '.join(f"'{t}'" for t in (*WANTED, ABSENT))}]) AS term, o_orderkey AS probe FROM orders)",
    "doclen_changes": """doclen_changes AS (
      SELECT did, CASE WHEN did % 7 != 0 THEN len + 1 END AS new_len FROM doclens WHERE did % 7 = 0 OR did % 5 = 0
      UNION ALL SELECT did, did % 300 + 1 FROM (SELECT unnest(range(max(did) + 1, max(did) + 11)) AS did FROM doclens)
      UNION ALL SELECT did, NULL FROM (SELECT unnest(range(max(did) + 101, max(did) + 104)) AS did FROM doclens))""",
    "posting_changes": f"""posting_changes AS MATERIALIZED (
      SELECT term, did, CASE WHEN term != 'of' AND did % 7 != 0 THEN wdf + 1 END AS new_wdf FROM postings WHERE term = 'of' OR did % 7 = 0 OR did % 5 = 0
      UNION ALL SELECT unnest(['the', 'newterm']), did, did % 9 + 1 FROM (SELECT unnest(range(max(did) + 1, max(did) + 11)) AS did FROM postings)
      UNION ALL SELECT '{ABSENT}', did, NULL FROM (SELECT unnest(range(max(did) + 101, max(did) + 104)) AS did FROM postings))""",
    "merged_postings": """merged_postings AS (
      SELECT term, did, CASE WHEN c.changed THEN c.new_wdf ELSE p.wdf END AS wdf
      FROM postings p FULL JOIN (SELECT *, true AS changed FROM posting_changes) c USING (term, did)
      WHERE CASE WHEN c.changed THEN c.new_wdf ELSE p.wdf END IS NOT NULL)""",
    "merged_doclens": """merged_doclens AS (
      SELECT * FROM doclens d WHERE NOT EXISTS (SELECT 1 FROM doclen_changes c WHERE c.did = d.did)
      UNION ALL SELECT did, new_len FROM doclen_changes WHERE new_len IS NOT NULL)""",
    "doclen_rows": f"doclen_rows AS (SELECT did, len, (row_number() OVER (ORDER BY did) - 1) // {DOCLEN_ENTRIES} AS chunk_no FROM doclens)",
    "doclen_chunks": """doclen_chunks AS (SELECT chunk_no, min(did) AS first_did, max(did) AS last_did, count(*) AS n_entries,
      chunk_no = 0 AS is_first, chunk_no = (SELECT max(chunk_no) FROM doclen_rows) AS is_last FROM doclen_rows GROUP BY chunk_no)""",
    "ints": """ints AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN (o_orderkey * 2654435761) % 4294967295
      ELSE 1::BIGINT << (o_orderkey % 32)::INT END AS v FROM orders)""",
}


def vsize(v: str) -> str:
    """SQL: bytes of the variable-byte form."""
    return f"(CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END)"


def split_cte(rows: str, most: int, prefix: str = "") -> str:
    """SQL (recursive): byte split of the lists in `rows`, as {prefix}posting_rows and {prefix}posting_chunks."""
    return f"""{prefix}ordered AS MATERIALIZED (SELECT term, did, wdf, row_number() OVER w AS rn, did - lag(did) OVER w - 1 AS gap FROM {rows} WINDOW w AS (PARTITION BY term ORDER BY did)),
    {prefix}split AS (
      SELECT term, did, rn, 0::BIGINT AS chunk_no, {vsize("wdf")}::BIGINT AS bytes FROM {prefix}ordered WHERE rn = 1
      UNION ALL
      SELECT o.term, o.did, o.rn, s.chunk_no + (s.bytes >= {most})::BIGINT,
             CASE WHEN s.bytes >= {most} THEN 0 ELSE s.bytes + {vsize("o.gap")} END + {vsize("o.wdf")}
      FROM {prefix}split s JOIN {prefix}ordered o ON o.term = s.term AND o.rn = s.rn + 1),
    {prefix}chunk AS (SELECT term, chunk_no, min(did) AS first_did, max(did) AS last_did, count(*) AS n_entries FROM {prefix}split GROUP BY ALL),
    {prefix}posting_chunks AS (SELECT *, chunk_no = 0 AS is_first, chunk_no = max(chunk_no) OVER (PARTITION BY term) AS is_last FROM {prefix}chunk)"""


def sql(body: str, *names: str, extra: str = "") -> str:
    """A statement with the named common tables in order, and extra ones."""
    parts = [CTE[n] for n in names] + ([extra] if extra else [])
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
