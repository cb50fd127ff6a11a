"""Boolean retrieval over words of bits, and bucketed tables."""

import random
from uuid import uuid4

import pytest

from quernstone.operators import bitmaps
from quernstone.sources import bucketed


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    return {t: set(rng.sample(range(0, 70_000), n)) for t, n in (("a", 30_000), ("b", 9000), ("c", 700), ("d", 1), ("e", 40_000))}


@pytest.fixture(scope="module")
def postings(spark, lists):
    return spark.createDataFrame([(t, d, 1) for t, x in lists.items() for d in x], "term string, did long, wdf long").cache()


def test_sets(lists, postings):
    def got(df):
        rows = [r.did for r in df.collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    a, b, c, d, e = (lists[t] for t in "abcde")
    assert got(bitmaps.all_of(postings, "a", "b", "c", "e")) == a & b & c & e
    assert got(bitmaps.all_of(postings, "a", "none")) == set() and got(bitmaps.all_of(postings, "d", "d")) == d
    assert got(bitmaps.any_of(postings, "a", "b", "c", "d", "e")) == a | b | c | d | e
    assert got(bitmaps.but_not(postings, "a", "b", "c", "none")) == a - b - c
    assert got(bitmaps.but_not(postings, "a")) == a and got(bitmaps.but_not(postings, "a", "a")) == set()
    pairs = {(r.a, r.b): r.n for r in bitmaps.together(postings, ("a", "b"), ("a", "e"), ("c", "none")).collect()}
    assert pairs == {("a", "b"): len(a & b), ("a", "e"): len(a & e)}


def test_dense_lists_shuffle_no_more_rows(spark):
    """What is shuffled depends on the dids that there are, not on how many of them a list has."""
    thin = spark.range(0, 64_000, 64).selectExpr("'t' as term", "id as did")
    dense = spark.range(0, 64_000).selectExpr("'t' as term", "id as did")
    assert bitmaps.bitmap(thin, "term").count() == bitmaps.bitmap(dense, "term").count() == 1000
    plan = bitmaps.any_of(dense, "t", "u")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_bit_or") > plan.index("Exchange hashpartitioning(word")  # printed from the top


def test_buckets_are_not_exchanged(spark):
    rng = random.Random(4)
    old = {(rng.choice("abc"), d): d % 9 + 1 for d in range(600)}
    new = {("a", 5): None, ("b", 5): 7, ("z", 1): 3, **{("c", d): None for d in range(0, 600, 7)}}
    one, two = (f"t_{uuid4().hex}" for _ in range(2))
    rows = spark.createDataFrame([(*k, v) for k, v in old.items()], "term string, did long, wdf long")
    changes = spark.createDataFrame([(*k, v) for k, v in new.items()], "term string, did long, new_wdf long")
    bucketed.write(rows, one, bucketed.POSTING_KEY, 4)
    got = bucketed.merged(spark, one, changes, bucketed.POSTING_KEY, "wdf", "new_wdf")
    assert {(r.term, r.did): r.wdf for r in got.collect()} == {k: v for k, v in (old | new).items() if v is not None}
    plan = got._jdf.queryExecution().executedPlan().toString()
    large = [line for line in plan.splitlines() if one in line or "Exchange" in line or "Join" in line]
    scan = next(i for i, line in enumerate(large) if one in line)
    join = next(i for i, line in enumerate(large) if "Join" in line)
    assert not any("Exchange" in line for line in large[join:scan])  # from the join down to the table
    lengths = spark.range(600).selectExpr("id as did", "id % 7 as len")
    bucketed.write(rows, two, ["did"], 4)
    bucketed.write(lengths, one, ["did"], 4)
    both = bucketed.by_document(spark, two, one)
    assert both.count() == len(old) and "Exchange" not in both._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
