"""A corpus pipeline of five stages over the documents of a scale folder.

Every stage works on what its predecessor kept and returns the columns of
documents; the last one returns the mix.

Defined cases, for every stage: null and empty texts are clean documents without
words (of several, exact dedup keeps one); rows without doc_id and with nulls in
other columns take part by their text; rows of one doc_id with different texts
are documents of their own; an empty table gives an empty result; columns of
other names go along up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import decontamination, exact_dedup, jaccard_join, mixing, toxicity
from quernstone.llm.session import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model grades toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of repeated rows one."""
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of similar documents the row with the least doc_id stays.

    Rows are told apart by doc_id and text, so that different texts of one doc_id
    each count; rows without doc_id stay.
    """
    gone = jaccard_join.jaccard_components(docs).where("not first").select("doc_id", "text_hash").distinct()
    # whole rows are one column, so that none of theirs can have the name of a key
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    kept = rows.join(gone, ["doc_id", "text_hash"], "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of what is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Training and retrieval can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
