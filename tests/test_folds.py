"""Folds cell by cell give what one walk over the list gives."""

import random

import numpy as np
import pytest

from quernstone.functions import chunks, varint
from quernstone.operators import folds


def lists(seed):
    """did -> value, with dense stretches, gaps, and values of all widths."""
    rng = random.Random(seed)
    did, out, kind = rng.randrange(1, 5), {}, 0
    for _ in range(rng.randrange(1, 400)):
        if rng.random() < 0.05:
            kind = rng.randrange(3)
        did += 1 if kind and rng.random() < 0.98 else rng.randrange(1, 200)
        out[did] = rng.choice([[1], [1, 1, 1, 300], [5, 300, 70_000, 1 << 24]][kind])
    return out


def walked_chunks(x, most):
    chunk, held, last, out = 0, None, 0, []
    for d, v in x.items():
        if held is not None and held >= most:
            chunk, held = chunk + 1, None
        held = (0 if held is None else held + varint.size(d - last - 1)) + varint.size(v)
        out.append(chunk)
        last = d
    return out


def walked_runs(x):
    pairs = list(x.items())
    return [pairs[a][0] for a, b in chunks.segments(pairs) for _ in range(a, b)]


def by_cells(x, fold, stride):
    """The fold without Spark: summaries, scan, entries."""
    did, value = np.array(list(x)), np.array(list(x.values()))
    edges = np.flatnonzero(np.r_[True, np.diff(did // stride) != 0])
    state, out = fold.START, []
    for a, b in zip(edges, [*edges[1:], len(did)]):
        out += fold.through(state, did[a:b], value[a:b]).tolist()
        state = fold.apply(state, *fold.summary(did[a:b], value[a:b]))
    return out


@pytest.mark.parametrize("stride", [4, 16, 64, 1 << 16])
def test_maps_compose(monkeypatch, stride):
    monkeypatch.setattr(folds, "STRIDE", stride)
    for seed in range(60):
        x = lists(seed)
        for most in (1, 7, 30, 200):
            assert by_cells(x, folds.ByteSplit(most), stride) == walked_chunks(x, most), (seed, most)
        assert by_cells(x, folds.Runs(), stride) == walked_runs(x), seed


def test_short_lists_together():
    some = [lists(seed) for seed in range(80)] + [{5: 1}, {6: 1, 7: 1}]
    did, value = (np.array([v for x in some for v in f(x)]) for f in (dict.keys, dict.values))
    edges = np.cumsum([0, *map(len, some)])[:-1]
    for most in (1, 30, 200):
        assert folds.ByteSplit(most).fresh(did, value, edges).tolist() == [c for x in some for c in walked_chunks(x, most)]
    assert folds.Runs().fresh(did, value, edges).tolist() == [r for x in some for r in walked_runs(x)]


def test_one_list_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(folds, "STRIDE", 64)
    x = {d: (1, 1, 1, 300)[d * 7919 % 11 % 4] for d in range(1, 5000) if d % 500}
    rows = spark.createDataFrame([("", d, v) for d, v in x.items()], "term string, did long, wdf long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for fold, want in ((folds.ByteSplit(50), walked_chunks(x, 50)), (folds.Runs(), walked_runs(x))):
            got = folds.folded(rows, fold, "n")
            sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
            assert max(sizes) < len(x) / 2 and sum(sizes) == len(x)
            assert [r.n for r in got.orderBy("did").collect()] == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def final_plan(rows):
    rows._jdf.collectAsList()
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["postlist_chunks", "chunk_max_did", "chunk_validate", "postlist_key"])
def test_words_are_counted_once(spark, name):
    from quernstone import catalog

    plan = final_plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") == 1


def test_runs_hold_no_table(spark):
    """Runs of consecutive dids come from the sorted rows; the only aggregate is that of the postings."""
    from quernstone import catalog

    assert final_plan(catalog.QUERIES["did_runs"](spark, "/root/testdata/sf0.001")).count("HashAggregate") == 2


def test_short_lists_are_whole_in_a_task(spark):
    """A list of few entries that are far apart is not dealt out in cells."""
    rows = spark.createDataFrame([(t, d << 20, 1) for t in "ab" for d in range(1, 40)], "term string, did long, wdf long")
    got = folds.folded(rows, folds.ByteSplit(10), "n")
    assert "MapInArrow summarise" not in final_plan(got)
    x = {d << 20: 1 for d in range(1, 40)}
    assert [r.n for r in got.where("term = 'b'").orderBy("did").collect()] == walked_chunks(x, 10)
