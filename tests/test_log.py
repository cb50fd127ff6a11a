"""Posting tables: merge when read, levels, snapshots, writers side by side, streams of changes."""

import random
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from quernstone.operators import build, merge
from quernstone.plans import table_queries
from quernstone.sources import posting_log as log
from quernstone.sources import shared
from quernstone.streaming import changes

ROWS, NEW = "term string, did long, wdf long", "term string, did long, new_wdf long"


def rows(spark, m, schema=ROWS):
    return spark.createDataFrame([(*k, v) for k, v in m.items()], schema)


def state(spark, path, *wanted, version=None):
    got = log.read(spark, path, *wanted, version=version).collect()
    assert len({(r.term, r.did) for r in got}) == len(got)  # no posting is there twice
    return {(r.term, r.did): r.wdf for r in got}


def after(m, change):
    return {k: v for k, v in (m | change).items() if v is not None}


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("data/**/part-*")}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "index")


def test_a_table_knows_its_buckets(spark, path):
    """A read or merge needs no number of buckets, so it can't have another one."""
    start = {(t, 1): 1 for t in ("alpha", "beta", "gamma", "delta")}
    log.create(rows(spark, start), path, buckets=8)
    for t, d in start:
        assert state(spark, path, t) == {(t, d): 1}
    log.merge(spark, path, rows(spark, {("alpha", 1): 70}, NEW))
    assert state(spark, path) == start | {("alpha", 1): 70}
    assert state(spark, path, "alpha") == {("alpha", 1): 70}


def test_one_change_writes_one_row(spark, path):
    start = {(f"t{i}", d): d for i in range(50) for d in range(1, 9)}
    log.create(rows(spark, start), path, buckets=16)
    before = files(path)
    log.merge(spark, path, rows(spark, {("t7", 3): None}, NEW))
    new = files(path) - before
    assert len(new) == 1 and before <= files(path)  # nothing is written anew
    assert spark.read.parquet(f"{path}/{new.pop()}").count() == 1
    assert state(spark, path) == after(start, {("t7", 3): None})
    plan = log.read(spark, path, "t7").select("did")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_random_changes_and_levels(spark, path):
    rng, now = random.Random(5), {(f"t{i % 9}", i): 1 for i in range(200)}
    log.create(rows(spark, now), path, buckets=4)
    history = {1: dict(now)}
    for step in range(9):
        change = {(f"t{rng.randrange(11)}", rng.randrange(260)): rng.choice([None, 2, 3]) for _ in range(rng.choice([1, 30]))}
        version = log.merge(spark, path, rows(spark, change, NEW))
        now = after(now, change)
        history[version] = dict(now)
        if step % 2:
            again = log.compact(spark, path, fan=2)
            history[again] = dict(now)
        assert state(spark, path) == now
    levels = {r.level for r in log.snapshot(spark, path).runs}
    assert 0 in levels
    for version in sorted(history)[::3]:
        assert state(spark, path, version=version) == history[version]
    last = log.compact(spark, path, whole=True)
    assert {r.level for r in log.snapshot(spark, path).runs} == {0} and state(spark, path) == now
    assert log.compact(spark, path, whole=True) == last  # nothing left to do
    gone = log.forget(spark, path)
    assert gone and log.versions(spark, path) == [last] and state(spark, path) == now
    assert not any(g in f for g in gone for f in files(path))
    with pytest.raises(ValueError, match="no version 1"):
        log.read(spark, path, version=1)


def test_due_takes_full_levels_and_grown_bases():
    run = lambda level, at, rows=1: log.Run(0, f"g{at}", level, at, rows)
    base = run(0, 1, 1000)
    assert log.due([base, run(1, 2), run(1, 3)], 3) == []
    assert {r.at for r in log.due([base, run(1, 2), run(1, 3), run(1, 4)], 3)} == {2, 3, 4}
    full = [base, run(2, 2), run(2, 3), run(1, 4), run(1, 5), run(1, 6)]
    assert {r.at for r in log.due(full, 3)} == {2, 3, 4, 5, 6}
    assert {r.at for r in log.due([base, run(1, 2, 100), run(1, 3, 100), run(1, 4, 100)], 3)} == {1, 2, 3, 4}
    assert {r.level for r in log.due([base, *(run(k, 10 - k) for k in (1, 2, 3))], 1)} == {0, 1, 2, 3}


def test_merges_that_empty_tables(spark, path):
    """Deletes that empty a bucket, or the whole table, hold; a term without postings is gone."""
    now = {("alpha", 1): 1, ("beta", 1): 2, ("gamma", 5): 3}
    log.create(rows(spark, now), path)
    for change in ({("alpha", 1): None}, {("beta", 1): 7, ("none", 3): None}, {("beta", 1): None, ("gamma", 5): None}, {("alpha", 9): 4}, {}):
        log.merge(spark, path, rows(spark, change, NEW))
        now = after(now, change)
        assert state(spark, path) == now and {d for _, d in state(spark, path, "alpha")} == {d for t, d in now if t == "alpha"}
    log.compact(spark, path, whole=True)
    assert state(spark, path) == now
    log.create(rows(spark, {("delta", 2): 2}), path)
    assert state(spark, path) == {("delta", 2): 2}
    log.create(rows(spark, {}), path)
    assert state(spark, path) == {}
    log.merge(spark, path, spark.createDataFrame([("a", None, 1), (None, 1, 1), ("a", 1, 1)], NEW))
    assert state(spark, path) == {("a", 1): 1}


def test_scan_is_pruned(spark, path):
    log.create(rows(spark, {(t, d): 1 for t in "abc" for d in range(40)}), path, buckets=4)
    one = log.read(spark, path, "b").select("did")
    plan = one._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "term_bucket" in pruned and "gen" in pruned
    assert "In(term, [b])" in plan or "EqualTo(term,b)" in plan
    assert "wdf" not in plan.split("ReadSchema:")[1] and "Exchange" not in plan
    assert one.count() == 40


def test_a_hot_term_is_many_files(spark, path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.create(spark.range(20_000).selectExpr("'the' as term", "id as did", "1L as wdf"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(path)) > 1 and log.read(spark, path, "the").count() == 20_000


def test_writers_side_by_side(spark, path):
    """Of two writers of one version one is first; the other tries again, and neither is lost."""
    log.create(rows(spark, {("a", 1): 1}), path, buckets=2)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda i: log.merge(spark, path, rows(spark, {("a", 10 + i): i}, NEW)), range(4)))
    assert len(set(found)) == 4
    assert state(spark, path) == {("a", 1): 1} | {("a", 10 + i): i for i in range(4)}


def test_the_swap_is_refused_once_it_is_taken(spark, path):
    log.create(rows(spark, {("a", 1): 1}), path)
    table = log.snapshot(spark, path)
    other = log.replace(table, version=2)
    assert log._swap(spark, path, other) and not log._swap(spark, path, other)
    assert log.versions(spark, path) == [1, 2]


def test_a_compaction_survives_later_merges(spark, path, monkeypatch):
    """A change set that comes in between stays on top of what is merged below it."""
    log.create(rows(spark, {("a", 1): 1, ("a", 2): 2}), path, buckets=1)
    log.merge(spark, path, rows(spark, {("a", 1): 5}, NEW))
    write, done = log._write, []

    def slow(*a):
        out = write(*a)
        if not done:
            done.append(1)
            log.merge(spark, path, rows(spark, {("a", 1): 9, ("a", 2): None}, NEW))
        return out

    monkeypatch.setattr(log, "_write", slow)
    log.compact(spark, path, whole=True)
    assert state(spark, path) == {("a", 1): 9}


def test_expected_version(spark, path):
    log.create(rows(spark, {("a", 1): 1, ("b", 1): 1}), path, buckets=64)
    log.merge(spark, path, rows(spark, {("a", 1): 2}, NEW), expected=1)
    with pytest.raises(log.Conflict, match="since version 1"):
        log.merge(spark, path, rows(spark, {("a", 1): 3}, NEW), expected=1)
    log.merge(spark, path, rows(spark, {("b", 1): 3}, NEW), expected=1)  # another bucket
    assert state(spark, path) == {("a", 1): 2, ("b", 1): 3}


def test_several_changes_of_one_posting(spark, path):
    twice = spark.createDataFrame([("a", 1, 7, 2), ("a", 1, None, 1), ("b", 1, 4, 1)], NEW + ", seq long")
    base = rows(spark, {("a", 1): 1, ("b", 1): 1})
    assert {tuple(r) for r in merge.merge_postings(base, twice, ["seq"]).collect()} == {("a", 1, 7), ("b", 1, 4)}
    with pytest.raises(Exception, match="several changes of"):
        merge.merge_postings(base, twice).collect()
    log.create(base, path)
    log.merge(spark, path, twice, order=["seq"])
    assert state(spark, path) == {("a", 1): 7, ("b", 1): 4}
    with pytest.raises(Exception, match="several changes of"):
        log.merge(spark, path, twice)


def feed(spark, folder, batch):
    spark.createDataFrame([(*k, v, t, s) for k, v, t, s in batch], "term string, did long, new_wdf long, t long, seq long").selectExpr("term", "did", "new_wdf", "timestamp_seconds(t + 1) as at", "seq").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, path, tmp_path, **more):
    q = changes.start(changes.from_files(spark, folder), path, str(tmp_path / "state"), **more)
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_stream_in_any_order(spark, path, tmp_path):
    """Repeated and out-of-order changes over several batches give what one batch recomputation gives."""
    rng, folder = random.Random(8), str(tmp_path / "feed")
    start = {("a", d): 1 for d in range(20)}
    log.create(rows(spark, start), path, buckets=2)
    every = [((rng.choice("ab"), rng.randrange(25)), rng.choice([None, 5, 6]), rng.randrange(3), s) for s in range(200)]
    rng.shuffle(every)
    every += rng.sample(every, 40)
    for i in range(0, 240, 80):
        feed(spark, folder, every[i : i + 80])
    run(spark, folder, path, tmp_path)
    want = dict(start)
    for k, v, _, _ in sorted(every, key=lambda c: (c[2], c[3])):
        want[k] = v
    assert state(spark, path) == {k: v for k, v in want.items() if v is not None}
    assert log.snapshot(spark, path).streams["changes"] >= 2
    # later files only, and an older change doesn't come back
    feed(spark, folder, [(("a", 1), 77, 9, 1), (("a", 2), 55, 0, -1)])
    run(spark, folder, path, tmp_path)
    assert state(spark, path)["a", 1] == 77 and state(spark, path).get(("a", 2)) == want.get(("a", 2))


def test_stream_writes_its_changes_only_and_once(spark, path, tmp_path):
    folder = str(tmp_path / "feed")
    log.create(rows(spark, {("a", d): 1 for d in range(3000)}), path, buckets=1)
    feed(spark, folder, [(("a", 5), None, 1, 1)])
    before = files(path)
    run(spark, folder, path, tmp_path)
    new = files(path) - before
    assert len(new) == 1 and spark.read.parquet(f"{path}/{next(iter(new))}").count() == 1
    # the batch again, as after a failure between its commit and the checkpoint's
    version = log.snapshot(spark, path).version
    assert log.merge(spark, path, rows(spark, {("a", 6): None}, NEW), stream=("changes", 0)) == version
    assert ("a", 6) in state(spark, path) and ("a", 5) not in state(spark, path)


def test_stream_gives_up_state_behind_the_watermark(spark, path, tmp_path):
    folder = str(tmp_path / "feed")
    log.create(rows(spark, {}), path, buckets=1)
    for t in (100, 200_000, 400_000):
        feed(spark, folder, [(("a", t), 1, t, 1)])
    feed(spark, folder, [(("a", 100), 9, 50, 2)])  # behind the watermark: dropped, and its key's state is gone
    q = run(spark, folder, path, tmp_path)
    assert state(spark, path) == {("a", 100): 1, ("a", 200_000): 1, ("a", 400_000): 1}
    assert q.lastProgress.stateOperators[0].numRowsTotal < 6  # of the value and the timer of three keys


def test_stream_of_lengths(spark, path, tmp_path):
    folder = str(tmp_path / "feed")
    log.create(spark.createDataFrame([("", 1, 5), ("", 2, 6)], ROWS), path)
    new = spark.createDataFrame([(1, 8, 1), (1, None, 2), (3, 7, 1)], "did long, new_len long, seq long").selectExpr("*", "timestamp_seconds(1) as at")
    changes.lengths(new).coalesce(1).write.parquet(folder)
    run(spark, folder, path, tmp_path)
    assert state(spark, path) == {("", 2): 6, ("", 3): 7}


def test_stream_calls_python_once_for_a_bucket(spark, path, tmp_path, monkeypatch):
    """Postings share states: 3,000 changed postings are at most a state and a timer a bucket."""
    monkeypatch.setattr(changes, "BUCKETS", 8)
    folder = str(tmp_path / "feed")
    log.create(rows(spark, {("a", d): 1 for d in range(3000)}), path, buckets=1)
    feed(spark, folder, [(("a", d), 2, d % 7, 1) for d in range(3000)])
    feed(spark, folder, [(("a", d), 3, d % 5, 2) for d in range(3000)])
    q = run(spark, folder, path, tmp_path)
    assert state(spark, path) == {("a", d): 3 if d % 5 >= d % 7 else 2 for d in range(3000)}
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 16


def test_large_runs_are_not_sent_to_the_driver(spark, path, monkeypatch):
    monkeypatch.setattr(log, "KEPT_APART", 0)
    log.create(rows(spark, {("a", d): 1 for d in range(50)}), path)
    log.merge(spark, path, rows(spark, {("a", d): 2 for d in range(9)}, NEW))
    out = log.read(spark, path)
    assert out.count() == 50
    out._jdf.collectAsList()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_large_runs_are_read_once(spark, path, monkeypatch):
    """Of large runs each is scanned once, joined without a sort where tasks can hold it, and merged the same either way."""
    start = {(t, d): d for t in "abcdef" for d in range(40)}
    first, second = {("a", d): None for d in range(30)}, {(t, d): d + 100 for t in "abx" for d in range(20, 60)}
    want = after(after(start, first), second)
    log.create(rows(spark, start), path, buckets=4)
    log.merge(spark, path, rows(spark, first, NEW))
    log.merge(spark, path, rows(spark, second, NEW))
    monkeypatch.setattr(log, "KEPT_APART", 0)
    for held, sorts in ((log.HELD, 0), (0, 2)):
        monkeypatch.setattr(log, "HELD", held)
        plan = log.read(spark, path)._jdf.queryExecution().executedPlan().toString()
        assert state(spark, path) == want
        assert plan.count("FileScan") == 3 and plan.count("Sort [") == sorts


def shuffle_files(spark):
    """Of this machine's only block manager."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark, path, tmp_path):
    """Tables, change sets, compactions and streams give their disk back when they end, whenever the driver collects garbage."""
    before, folder = shuffle_files(spark), str(tmp_path / "feed")
    log.create(spark.range(20_000).selectExpr("concat('t', id % 7) as term", "id as did", "1L as wdf"), path)
    log.merge(spark, path, spark.range(9_000).selectExpr("concat('t', id % 7) as term", "id as did", "2L as new_wdf"))
    log.compact(spark, path, whole=True)
    for t in (5, 9):
        feed(spark, folder, [(("t0", d), t, t, 1) for d in range(0, 700, 7)])
    run(spark, folder, path, tmp_path)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    small = [f for f in left if f.endswith(".data")]
    assert len(small) <= 3, small  # counts of rows a bucket
    assert spark.conf.get(shared.CLEANUP) == "false"
    got = state(spark, path)
    assert len(got) == 20_000 and sum(got.values()) == 9_000 * 2 + 11_000 + 100 * 7


def test_the_setting_for_shuffles_is_restored_by_the_last(spark):
    with shared.shuffles_freed(spark):
        with shared.shuffles_freed(spark):
            assert spark.conf.get(shared.CLEANUP) == "true"
        assert spark.conf.get(shared.CLEANUP) == "true"
    assert spark.conf.get(shared.CLEANUP) == "false"


def test_a_table_of_parts(spark, path):
    """Postings of each row of documents, those of a repeated doc_id added up, through one exchange."""
    docs = spark.createDataFrame([(1, "The cat, the CAT the"), (2, None), (3, "..."), (1, "cat x"), (4, "z"), (5, ""), (6, "a b a b a")], "doc_id long, text string")
    want = {(r.term, r.did): r.wdf for r in build.postings(build.tokens(docs)).collect()}
    parts = build.posting_parts(docs)
    assert [f.dataType for f in parts.schema] == [f.dataType for f in build.postings(build.tokens(docs)).schema]
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    assert want["cat", 2] == 3 and parts.count() == len(want) + 1
    log.create(parts, path, parts=True)
    assert state(spark, path) == want
    dealt = parts.withColumn("term_bucket", log.bucket_of(4).cast("int")).repartitionByRange(*log.PLACE)
    added = dealt.groupBy(*log.PLACE).count()._jdf.queryExecution().executedPlan().toString()
    assert added.count("Exchange ") == 1


def test_a_batch_without_news_writes_no_state(spark, path, tmp_path):
    """Repeated and outdated changes leave the states' files small; their timeouts still hold."""
    folder = str(tmp_path / "feed")
    log.create(rows(spark, {}), path, buckets=1)
    batch = [(("a", d), 1, d % 50, 2) for d in range(5000)]
    for again in (batch, [(k, 9, t, 1) for k, _, t, _ in batch], batch):
        feed(spark, folder, again)
    run(spark, folder, path, tmp_path)
    assert state(spark, path) == {("a", d): 1 for d in range(5000)}
    size = {v: sum(p.stat().st_size for p in (tmp_path / "state" / "state" / "0").rglob(f"{v}.delta")) for v in (1, 2, 3)}
    assert size[2] * 10 < size[1] and size[3] * 10 < size[1]
    feed(spark, folder, [(("a", 1), 7, 400_000, 1)])
    q = run(spark, folder, path, tmp_path)
    assert state(spark, path)["a", 1] == 7
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 4


def test_a_state_is_small(spark):
    """In order and packed, a fifth of what its columns take; older states are still read."""
    import pandas as pd
    import pyarrow as pa

    d = range(20_000)
    held = pd.DataFrame({"term": [f"word{i % 40}" for i in d], "did": d, "micros": [10**12 + i % 1000 * 10**6 for i in d], "seq": [2] * len(d)})
    packed = changes._packed(held)
    assert len(packed) * 5 < 20_000 * 34
    assert changes._unpacked(packed).equals(held.sort_values(["term", "did"], ignore_index=True))
    table, sink = pa.Table.from_pandas(held, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    assert changes._unpacked(sink.getvalue().to_pybytes()).equals(held)


def test_the_stream_query_leaves_its_table_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(table_queries, "scratch", lambda spark, name: str(tmp_path / name))
    out = table_queries.postlist_stream(spark, "/root/testdata/sf0.001")
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"postings"} and out.count() > 0
