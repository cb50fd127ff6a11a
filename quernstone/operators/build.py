"""Inverted index tables from documents.

tokens(did, pos, term), postings(term, did, wdf), doclens(did, len) and
terms(term, termfreq, collfreq).  did is doc_id + 1, so it starts at 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import terms_of


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select((F.col("doc_id") + 1).alias("did"), F.posexplode(terms_of(F.col("text"))).alias("pos", "term")).select("did", (F.col("pos") + 1).cast("long").alias("pos"), "term")


def postings(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "did").agg(F.count("*").alias("wdf"))


def posting_parts(docs: DataFrame) -> DataFrame:
    """(term, did, wdf) within each row of docs: no shuffle. Where several rows have a doc_id, a posting comes in parts that add up."""
    # sorted words, and where each run of one word ends; a variable of a function, so that they are made once
    ends = lambda w: F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
    once = F.transform(F.filter(F.array(F.sort_array(terms_of(F.col("text")))), lambda w: F.size(w) > 0), lambda w: F.struct(w.alias("words"), ends(w).alias("ends")))
    runs = docs.select((F.col("doc_id") + 1).alias("did"), F.inline(once)).select("did", "words", "ends", F.posexplode("ends").alias("k", "end"))
    return runs.select(F.get("words", F.col("end") - 1).alias("term"), "did", (F.col("end") - F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0))).cast("long").alias("wdf"))


def places(docs: DataFrame) -> DataFrame:
    """(term, did) of the postings without making a row for each token: no shuffle. A did that several documents have may repeat."""
    return docs.select((F.col("doc_id") + 1).alias("did"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).select("term", "did")


def postings_with_length(docs: DataFrame) -> DataFrame:
    """(term, did, wdf, len): a document's length goes with each of its words, so nothing is joined; doc_id is a key."""
    # a variable of a function: a column that two others need would be worked out twice
    once = F.transform(F.array(terms_of(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("len"), w.alias("words")))
    words = docs.select((F.col("doc_id") + 1).alias("did"), F.inline(once))
    rows = words.select("did", "len", F.explode("words").alias("term"))
    return rows.groupBy("term", "did").agg(F.count("*").alias("wdf"), F.first("len").alias("len"))


def doclens(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("did").agg(F.count("*").alias("len"))


def doclens_of(docs: DataFrame) -> DataFrame:
    """The same table without making a row for each token: no shuffle."""
    return docs.select((F.col("doc_id") + 1).alias("did"), F.size(terms_of(F.col("text"))).cast("long").alias("len")).where("len > 0")


def terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("termfreq"), F.sum("wdf").alias("collfreq"))


def position_lists(tokens: DataFrame) -> DataFrame:
    """(term, did, pos ARRAY): a list is bounded by its document's length."""
    return tokens.groupBy("term", "did").agg(F.sort_array(F.collect_list("pos")).alias("pos"))


def int_lists(postings: DataFrame) -> DataFrame:
    """(term, dids ARRAY, pairs ARRAY) of every term, in did order."""
    pairs = F.sort_array(F.collect_list(F.struct("did", F.col("wdf").alias("val"))))
    return postings.groupBy("term").agg(pairs.alias("pairs")).select("term", F.col("pairs.did").alias("dids"), "pairs")
