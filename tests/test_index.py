"""Index operators on small lists: seeks, merges, chunk edges, plans, sources, streams."""

import random
import time

import pytest

from quernstone.functions import chunks, interpolative, sortable, varint, vs
from quernstone.functions import columns as C
from quernstone.operators import build, chunking, folds, lookup, merge, stored
from quernstone.sources import tables


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    return {t: {d: rng.choice([1, 2, 300]) for d in sorted(rng.sample(range(1, 5000), n))} for t, n in (("a", 1), ("b", 40), ("c", 2500))}


@pytest.fixture(scope="module")
def postings(spark, lists):
    return spark.createDataFrame([(t, d, w) for t, x in lists.items() for d, w in x.items()], "term string, did long, wdf long").cache()


def test_seeks(spark, lists, postings):
    rng = random.Random(4)
    asks = [(t, rng.randrange(0, 5200)) for t in (*lists, "none") for _ in range(60)]
    probes = spark.createDataFrame(sorted(set(asks)), "term string, probe long")
    for r in lookup.skip_to(probes, postings).collect():
        assert r.did == min((d for d in lists.get(r.term, {}) if d >= r.probe), default=None)
    for r in lookup.jump_to(probes, postings).collect():
        assert (r.wdf, r.found) == (lists.get(r.term, {}).get(r.probe), r.probe in lists.get(r.term, {}))
    split = chunking.posting_chunks(postings, 50)
    bounds = [(c.term, c.first_did, c.last_did) for c in split.collect()]
    for r in lookup.chunk_contains(lookup.chunk_seek(probes, split)).collect():
        below = [(f, l) for t, f, l in bounds if t == r.term and f <= r.probe]
        assert (r.first_did, r.last_did) == (max(below) if below else (None, None))
        assert r.inside == bool(below and r.probe <= max(below)[1])


def test_strict_lookup(spark):
    lengths = spark.createDataFrame([(1, 5)], "did long, len long")
    assert lookup.doclength(spark.createDataFrame([(1,)], "did long"), lengths, strict=True).collect()[0].len == 5
    with pytest.raises(Exception, match="document not found: 2"):
        lookup.doclength(spark.createDataFrame([(2,)], "did long"), lengths, strict=True).collect()


@pytest.mark.parametrize("change", [{}, {1: None}, {0: 7, 99999: 8}, {"all": None}, {"first": None}, {77777: None}])
def test_merges(spark, lists, postings, change):
    old = lists["c"]
    if "all" in change:
        change = dict.fromkeys(old)
    elif "first" in change:
        change = dict.fromkeys(sorted(old)[:120]) | {4999: 3}
    rows = spark.createDataFrame([("c", d, v) for d, v in change.items()], "term string, did long, new_wdf long")
    got = {(r.term, r.did): r.wdf for r in merge.merge_postings(postings, rows).collect()}
    want = {(t, d): w for t, x in lists.items() for d, w in x.items()} | {("c", d): v for d, v in change.items()}
    assert got == {k: v for k, v in want.items() if v is not None}
    stats = {r.term: (r.termfreq, r.collfreq) for r in merge.apply_delta(build.terms(postings), merge.stats_delta(postings, rows)).collect()}
    fresh = {r.term: (r.termfreq, r.collfreq) for r in build.terms(merge.merge_postings(postings, rows)).collect()}
    assert stats == fresh


def test_chunks(spark):
    for n in (1, 2000, 2001, 4000):
        lengths = spark.range(1, n + 1).selectExpr("id as did", "id % 700 as len")
        got = sorted(map(tuple, chunking.doclen_chunks(lengths).collect()))
        want = [(i, 2000 * i + 1, min(n, 2000 * i + 2000), min(2000, n - 2000 * i)) for i in range(-(-n // 2000))]
        assert [g[:4] for g in got] == want
        assert [g[4:] for g in got] == [(i == 0, i == len(want) - 1) for i in range(len(want))]
    small = chunking.numbered(spark.range(0, 300).selectExpr("id * 7 as did"), "did", stride=100)
    assert all(r.did == 7 * r.rn for r in small.collect())


def test_byte_split_counts_before_adding(spark):
    rows = spark.range(1, 101).selectExpr("'t' as term", "id * 2 as did", "1L as wdf")
    got = [r.n_entries for r in chunking.posting_chunks(rows, 11).orderBy("chunk_no").collect()]
    assert got == [6] * 16 + [4]  # 1 + 5 * 2 bytes, then the next entry sees 11


def test_stored_chunks(spark, tmp_path, lists, postings):
    lengths = spark.range(1, 4102).selectExpr("id as did", "id % 700 as len")
    kept = stored.stored_postings(postings, 50).unionByName(stored.stored_postings(postings.selectExpr("concat(term, '+') as term", "did", "wdf"), 50, "skiplist")).unionByName(stored.stored_doclens(lengths))
    tables.write_chunks(kept, str(tmp_path / "chunks"))
    back = tables.read_chunks(spark, str(tmp_path / "chunks"))
    assert {r.codec for r in back.select("codec").distinct().collect()} == {"postings", "skiplist", "lengths"}
    got = {(r.term, r.did): r.wdf for r in stored.entries_of(back).collect()}
    want = {(t + x, d): w for x in ("", "+") for t, m in lists.items() for d, w in m.items()} | {("", d): d % 700 for d in range(1, 4102)}
    assert got == want
    heads = {r.term: (r.entries, r.collfreq, r.first_did) for r in stored.list_headers(back).collect()}
    assert all(heads[t] == (len(m), sum(m.values()), min(m)) for t, m in lists.items()) and heads[""][0] == 4101
    cut = back.where("term = 'c'").withColumn("chunk", C.F.expr("substring(chunk, 1, length(chunk) - 2)"))
    with pytest.raises(Exception, match="CorruptData"):
        stored.entries_of(cut).collect()


def test_folds_in_batches(spark):
    """Chunk and run numbers don't depend on where Arrow batches end."""
    rng = random.Random(9)
    lists = {t: sorted(rng.sample(range(1, n * 2), n)) for t, n in (("a", 3), ("b", 700), ("c", 40), ("d", 1))} | {"e": list(range(10, 400))}
    value = lambda d: (1, 200, 300, 70_000)[(d * 7919) % 11 % 4]
    rows = spark.createDataFrame([(t, d, value(d)) for t, x in lists.items() for d in x], "term string, did long, wdf long")
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for size in ("10000", "7", "1"):
        spark.conf.set(key, size)
        seen.append([sorted(map(tuple, f.collect())) for f in (chunking.posting_chunk_rows(rows, 30), folds.folded(rows, folds.Runs(), "run"))])
        spark.conf.unset(key)
    assert seen[0] == seen[1] == seen[2]
    want, runs = [], []
    for t, x in lists.items():
        chunk, held, last = 0, None, 0
        for d in x:
            if held is not None and held >= 30:
                chunk, held = chunk + 1, None
            held = (0 if held is None else held + varint.size(d - last - 1)) + varint.size(value(d))
            want.append((t, d, value(d), chunk))
            last = d
        for a, b in chunks.segments([(d, value(d)) for d in x]):
            runs += [(t, d, value(d), x[a]) for d in x[a:b]]
    assert seen[0] == [sorted(want), sorted(runs)]


def test_seeks_across_cells(spark, lists, postings):
    rng = random.Random(6)
    probes = spark.createDataFrame(sorted({(t, rng.randrange(0, 5200)) for t in (*lists, "none") for _ in range(50)}), "term string, probe long")
    chunks_ = chunking.posting_chunks(postings, 50)
    for f, rows in ((lookup.skip_to, postings), (lookup.chunk_seek, chunks_)):
        assert sorted(map(str, f(probes, rows, 64).collect())) == sorted(map(str, f(probes, rows, 1 << 20).collect()))


def test_value_codes_match_the_byte_codecs(spark):
    values = [0, 1, 127, 128, 255, 256, 300, 16383, 16384, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]
    v, F = C.F.col("v"), C.F
    d = spark.createDataFrame([(x,) for x in values], "v long")
    got = d.select("v", C.varint_put(v), C.fixed_put(v, 4), C.last_put(v), C.sortable_put(v), C.varint_get(C.varint_put(v)), C.fixed_get(C.fixed_put(v, 4), 4), C.last_get(C.last_put(v)), C.sortable_get(C.sortable_put(v))).collect()
    for x, *r in got:
        assert [bytes(b) for b in r[:4]] == [varint.put(x), varint.put_fixed(x, 4), varint.put_last(x), sortable.put_uint(x)] and r[4:] == [x] * 4
    words = ["", "abc", "é漢", "a\0b", "\0", "\0\0x", "p\u0000ÿ", "x" * 300]
    t = spark.createDataFrame([(w,) for w in words], "s string")
    for w, a, b, c, e in t.select("s", C.string_put(F.col("s")), C.sortable_string_put(F.col("s")), C.string_get(C.string_put(F.col("s"))), C.sortable_string_get(C.sortable_string_put(F.col("s")))).collect():
        assert (bytes(a), bytes(b), c, e) == (varint.put_string(w.encode()), sortable.put_string(w.encode()), w, w)
    for broken in (C.varint_get(F.unhex(F.lit("80"))), C.string_get(F.unhex(F.lit("0561"))), C.bool_get(F.unhex(F.lit("07"))), C.sortable_get(F.unhex(F.lit("c0ff")))):
        with pytest.raises(Exception, match="truncated|boolean"):
            spark.range(1).select(broken).collect()


def test_skip_index_is_that_of_the_encoder(spark, lists, postings):
    """Every pointer's jump in the encoded skip list is a row."""
    got = {t: sorted((r.did_offset, r.entries) for r in chunking.skip_index(postings).where(C.F.col("term") == t).collect()) for t in lists}
    for t, m in lists.items():
        pairs, body, pos, found = list(m.items()), chunks.encode_skips(list(m.items())), 0, []
        while pos < len(body):
            delta, pos = varint.get(body, pos)
            if delta == varint.SENTINEL:
                _, pos = varint.get(body, pos)
                span, pos = varint.get(body, pos)
                found.append(span)
            else:
                _, pos = varint.get(body, pos)
        assert [x for x, _ in got[t]] == sorted(found) and len(found) == (0 if len(pairs) < 4 else sum(2**k for k in range(1, chunks.skip_levels(len(pairs)) + 1)))


def test_random_list(spark):
    v = [r.v for r in tables.random_list(spark, 70_000, 5).orderBy("pos").collect()]
    steps = [b - a for a, b in zip(v, v[1:])]
    assert min(steps) >= 1 and max(steps) > 20_000 and len(v) == 70_000
    assert v == [r.v for r in tables.random_list(spark, 70_000, 5).orderBy("pos").collect()]
    few = v[:5000]
    assert vs.decode(vs.encode(few)) == few == interpolative.decode(interpolative.encode(few))


def test_long_lists_are_coded_in_linear_time():
    long = list(range(1, 3_000_000, 3))
    began = time.time()
    assert interpolative.decode(interpolative.encode(long)) == long and vs.decode(vs.encode(long)) == long
    assert time.time() - began < 60


def test_text_sources(spark, tmp_path):
    (tmp_path / "doclens").write_text("4 5\n6 254\n\n8 1024\n")
    assert sorted(map(tuple, tables.read_doclens_text(spark, str(tmp_path / "doclens")).collect())) == [(4, 5), (6, 254), (8, 1024)]
    (tmp_path / "ints").write_text("3 8\n11 -1 99\n")
    assert [r.v for r in tables.read_ints_text(spark, str(tmp_path / "ints"), -1).orderBy("pos").collect()] == [3, 8, 11]
    assert tables.read_ints_text(spark, str(tmp_path / "ints")).count() == 5


def test_empty_documents(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "Ab ab. Cd")], "doc_id long, text string")
    t = build.tokens(docs)
    assert sorted(map(tuple, build.postings(t).collect())) == [("ab", 3, 2), ("cd", 3, 1)]
    assert [tuple(r) for r in build.doclens_of(docs).collect()] == [(3, 3)] == [tuple(r) for r in build.doclens(t).collect()]
    assert spark.range(1).select(C.stem_word(C.F.lit("running")).alias("s")).first().s == "run"
