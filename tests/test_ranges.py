"""Interval joins over cells of several sizes, and the best documents by bounds."""

import random

from pyspark.sql import functions as F

from quernstone.operators import lookup, topk


def test_cover_is_disjoint_and_small(spark):
    rng = random.Random(2)
    ranges = [(0, 0), (5, 4), (0, (1 << 32) - 1), (1, (1 << 32) - 2), (15, 16), (16, 31), (255, 256)]
    ranges += [(a, a + rng.randrange(1 << rng.randrange(1, 31))) for a in (rng.randrange(1 << 31) for _ in range(40))]
    rows = spark.createDataFrame(ranges, "lo long, hi long").select("lo", "hi", lookup.cover(F.col("lo"), F.col("hi")).alias("cells")).collect()
    for lo, hi, cells in rows:
        spans = sorted((c * 16**n, (c + 1) * 16**n) for n, c in cells)
        assert len(spans) <= 30 * lookup.LEVELS
        if hi < lo:
            assert not spans
        else:
            assert spans[0][0] == lo and spans[-1][1] == hi + 1
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_interval_join(spark):
    rng = random.Random(3)
    dids = sorted({rng.randrange(1 << rng.randrange(4, 32)) for _ in range(300)})
    ranges = [(i, a, a + rng.randrange(1 << rng.randrange(1, 32)) - 1) for i, a in enumerate(rng.randrange(1 << rng.randrange(2, 32)) for _ in range(80))]
    ranges += [(90, 5, 4), (91, 0, (1 << 32) - 1), (92, 7, 7), (93, 7, 7)]
    points, spans = spark.createDataFrame([(d,) for d in dids], "did long"), spark.createDataFrame(ranges, "id long, lo long, hi long")
    got = sorted((r.did, r.id) for r in lookup.interval_join(points, spans, "lo", "hi").collect())
    assert got == sorted((d, i) for d in dids for i, lo, hi in ranges if lo <= d <= hi)
    assert lookup.interval_join(points, spans.where("id = 90"), "lo", "hi").count() == 0
    assert lookup.interval_join(points, spans.limit(0), "lo", "hi").count() == 0
    # one very wide range is a few rows, not one for every cell
    wide = spans.where("id = 91").select(F.size(lookup.cover(F.col("lo"), F.col("hi"))).alias("n")).first()
    assert wide.n <= 16


def test_interval_sums(spark):
    rng = random.Random(5)
    dids = sorted({rng.randrange(1 << rng.randrange(4, 32)) for _ in range(300)})
    ranges = [(i, a, a + rng.randrange(1 << rng.randrange(1, 32)) - 1) for i, a in enumerate(rng.randrange(1 << rng.randrange(2, 32)) for _ in range(80))]
    ranges += [(90, 5, 4), (91, 0, (1 << 32) - 1), (92, 7, 7), (93, 7, 7), (94, 0, (1 << 32) - 1)]
    points, spans = spark.createDataFrame([(d,) for d in dids], "did long"), spark.createDataFrame(ranges, "id long, lo long, hi long")
    held = {i: [d for d in dids if lo <= d <= hi] for i, lo, hi in ranges}
    got = {r.id: (r.n, r.dids) for r in lookup.interval_sums(points, spans, "lo", "hi").collect()}
    assert got == {i: (len(x), sum(x)) for i, x in held.items() if x}
    assert lookup.interval_sums(points, spans.where("id = 90"), "lo", "hi").count() == 0


def test_interval_sums_make_no_pairs(spark):
    """No step has as many rows as there are pairs: 2,000 wide ranges of 500 dids."""
    points, spans = spark.range(1, 501).select(F.col("id").alias("did")), spark.range(2000).select("id", (F.col("id") % 5).alias("lo"), (F.col("id") + 1000).alias("hi"))
    out = lookup.interval_sums(points, spans, "lo", "hi")
    pairs = 500 * 2000 - sum(max(0, i % 5 - 1) for i in range(2000))
    assert sum(r.n for r in out.collect()) == pairs
    plan = out._jdf.queryExecution()
    out._jdf.collectAsList()
    made, todo = 0, [plan.executedPlan()]
    while todo:
        p = todo.pop()
        metrics = p.metrics()
        if metrics.contains("numOutputRows"):
            made = max(made, metrics.apply("numOutputRows").value())
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    assert 0 < made < pairs / 5


def test_top_documents(spark, tmp_path):
    rng = random.Random(4)
    # weights differ between regions of dids, so that bounds can tell cells apart
    lists = {t: {d: rng.randrange(1, 5) + (100 if d // 512 == 3 else 0) for d in rng.sample(range(1, 8192), n)} for t, n in (("a", 3000), ("b", 500), ("c", 7))}
    rows = spark.createDataFrame([(t, d, w) for t, x in lists.items() for d, w in x.items()], "term string, did long, wdf long")
    path = str(tmp_path / "impacts")
    topk.write_impacts(topk.impacts(rows, F.col("wdf"), 64), path)
    for wanted in (("a",), ("a", "b", "c"), ("b", "none"), ("none",), ("a", "a")):
        for k in (1, 10, 200, 6000):
            score: dict[int, int] = {}
            for t in set(wanted) & set(lists):
                for d, w in lists[t].items():
                    score[d] = score.get(d, 0) + w
            want = sorted(((-s, d) for d, s in score.items()))[:k]
            got = topk.top(spark, path, wanted, k).orderBy("rank").collect()
            assert [(r.rank, r.did, r.score) for r in got] == [(i + 1, d, -s) for i, (s, d) in enumerate(want)], (wanted, k)
    limits, impacts = (spark.read.parquet(f"{path}/{n}") for n in ("bounds", "impacts"))
    cells, least = topk.reachable(limits, impacts, ("a", "b"), 10)
    every = limits.where("term in ('a', 'b')").select("cell").distinct().count()
    assert least > 100 and cells.count() <= 8 < every == 128  # the rest is not read
    plan = topk._scores(impacts, ("a",), cells)._jdf.queryExecution().executedPlan().toString()
    assert "In(cell" in plan.split("PushedFilters:")[1]
