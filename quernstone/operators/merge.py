"""Merging change sets into lists: upserts, and deletes as a null new value.

Deleting what is absent does nothing; an empty change set changes nothing; a
term whose last posting goes disappears with it.  A key has one change: the last
by given columns, or else two are an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: list[str], new: str, order: list[str] | None = None) -> DataFrame:
    """keys and new, one change for each key: the last by the columns `order`, an error where there are several without them."""
    if order:
        return changes.groupBy(*keys).agg(F.max(F.struct(*order, new))[new].alias(new))
    one = changes.groupBy(*keys).agg(F.count("*").alias("n"), F.first(new).alias(new))
    many = F.raise_error(F.concat(F.lit("several changes of "), F.to_json(F.struct(*keys)))).cast(changes.schema[new].dataType)
    return one.select(*keys, F.when(F.col("n") > 1, many).otherwise(F.col(new)).alias(new))


def merge(rows: DataFrame, changes: DataFrame, keys: list[str], value: str, new: str, order: list[str] | None = None) -> DataFrame:
    """rows(keys, value) after changes(keys, new): one full outer join on the keys."""
    left = rows.select(*keys, F.col(value).alias("_old"))
    right = latest(changes, keys, new, order).select(*keys, F.col(new).alias("_new"), F.lit(True).alias("_changed"))
    out = left.join(right, keys, "full_outer").select(*keys, F.when(F.col("_changed"), F.col("_new")).otherwise(F.col("_old")).alias(value))
    return out.where(F.col(value).isNotNull())


def merge_postings(postings: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    return merge(postings, changes, ["term", "did"], "wdf", "new_wdf", order)


def merge_doclens(doclens: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    return merge(doclens, changes, ["did"], "len", "new_len", order)


def upsert_doclens(doclens: DataFrame, changes: DataFrame) -> DataFrame:
    """Only the upserts of a change set."""
    return merge_doclens(doclens, changes.where("new_len is not null"))


def stats_delta(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """term, tfdelta, cfdelta of a change set, from the touched postings alone."""
    old = postings.select("term", "did", F.col("wdf").alias("_old"))
    both = changes.join(old, ["term", "did"], "left")
    return both.groupBy("term").agg(
        F.sum(F.col("new_wdf").isNotNull().cast("long") - F.col("_old").isNotNull().cast("long")).alias("tfdelta"),
        F.sum(F.coalesce("new_wdf", F.lit(0)) - F.coalesce("_old", F.lit(0))).alias("cfdelta"),
    )


def apply_delta(terms: DataFrame, delta: DataFrame) -> DataFrame:
    """terms after a delta; terms without postings are dropped."""
    t = terms.join(delta, "term", "full_outer")
    out = t.select("term", (F.coalesce("termfreq", F.lit(0)) + F.coalesce("tfdelta", F.lit(0))).alias("termfreq"), (F.coalesce("collfreq", F.lit(0)) + F.coalesce("cfdelta", F.lit(0))).alias("collfreq"))
    return out.where("termfreq > 0")


def dropped_terms(terms: DataFrame, merged: DataFrame) -> DataFrame:
    return terms.select("term").join(merged.select("term").distinct(), "term", "left_anti")
