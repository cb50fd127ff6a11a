"""Exact dedup, Jaccard join and passage dedup against brute force."""

import collections
import hashlib
import os
import platform
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import exact_dedup, jaccard_join, passage_dedup, session, signature_tree, suffixes
from quernstone.llm.components import components

from . import data


def test_exact(spark):
    rows = data.texts()
    got = exact_dedup.exact_dedup(data.documents(spark), max_blocks=1).collect()
    assert got[0].__fields__ == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        want[(i, keep, len(groups[t or ""]), keep is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(data.empty(spark)).count() == 0


def test_unique_rows_are_not_shuffled(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(5000, "text 7")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = d.select(exact_dedup.F.xxhash64("text").alias("h"))
    blocks = 2001 * exact_dedup.BITS_PER_TEXT // exact_dedup.BLOCK_BITS + 1
    assert exact_dedup.repeated_filter(hashes, blocks).count() <= blocks
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(d).collect()}
    assert not got[7].kept and got[5000].kept and got[7].group_size == 2 and sum(r.kept for r in got.values()) == 2000


@pytest.mark.parametrize("blocks", [4096, 0])
def test_keep_last(spark, blocks):
    """One row of every text stays, the largest doc_id; columns of any name stay with it."""
    rows = data.texts() + [(30, "other text of an id"), (31, "other text of an id"), (31, "other text of an id")]
    docs = data.documents(spark, rows)
    got = exact_dedup.keep_last(docs, max_blocks=blocks)
    assert got.columns == docs.columns
    best = {}
    for i, t in rows:
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == Counter((i, t) for t, i in best.items())
    assert exact_dedup.keep_last(data.empty(spark)).count() == 0
    assert Counter((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs, max_blocks=blocks).collect()) == Counter((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect())


def shingle_sets(rows):
    out = []
    for i, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(rows):
    sets = [(i, s) for i, s in shingle_sets(rows) if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TREE_BLOCK", 8 * block)
    monkeypatch.setattr(session, "BATCH_BYTES", 40 * block**3)
    rows = data.texts()
    got = jaccard_join.jaccard_components(data.documents(spark)).collect()
    assert len(got) == len(rows)
    comps, sizes = brute_components(rows), Counter((i, len(s)) for i, s in shingle_sets(rows))
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    assert all(r.component_id == comps.get(r.doc_id) for r in got)


def test_jaccard_threshold_is_exact(spark):
    base = [f"t{i}" for i in range(94)]  # 90 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:76])), (3, " ".join(base[:75])), (4, " ".join(base[:60]))]  # 72, 71, 56
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_jaccard_rows_of_one_id(spark):
    """Different texts of one doc_id are documents of their own; one of each group comes first."""
    a, b, c = data.words(1, 60), data.words(2, 60), data.words(3, 300)
    rows = [(3, a), (5, data.edited(a, 1, 1)), (5, b), (9, c), (9, data.edited(c, 2, 3)), (10, data.edited(c, 3, 3)), (11, None), (11, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hashes = {r.h: t for r, (_, t) in zip(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(coalesce(text, '')) h").collect(), rows, strict=True)}
    found = {(r.doc_id, hashes[r.text_hash] or ""): (r.component_id, r.first) for r in got}
    assert [found[(i, t or "")][0] for i, t in rows] == [3, 3, 5, 9, 9, 9, 11, 11]
    firsts = [found[(i, t or "")][1] for i, t in rows]
    assert firsts[:3] == [True, False, True] and sum(firsts[3:6]) == 1 and not firsts[5] and firsts[6:] == [True, True]


def test_many_equal_and_near_rows(spark):
    """Groups of thousands: equal rows, and a chain of near copies over many blocks."""
    base = data.words(8, 400).split()
    rows = [(i, "the same words here again and again") for i in range(3000)] + [(20, "the same words here again and again")] * 500
    rows += [(4000 + i, " ".join([*base[:i], f"n{i}", *base[i + 1 :]])) for i in range(400)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0, 4000}
    assert [r.doc_id for r in got if r.first] and {r.doc_id for r in got if r.first} == {0, 4000}


def test_batches_are_bounded(spark, monkeypatch):
    """Batches grow in number with the bytes of text; rows of one doc_id or of none are spread over them."""
    monkeypatch.setattr(session, "BATCH_BYTES", 1000)
    rows = spark.createDataFrame([(i and 7, data.words(n, 100)) for n in range(100) for i in (0, None)], "doc_id long, text string")
    size = rows.selectExpr("sum(octet_length(text))").first()[0]
    assert session.batches(rows) == -(-size // 1000) > 50
    assert session.batches(rows.limit(1)) == session.batches(data.empty(spark)) == session.partitions(spark)
    batch = "pmod(xxhash64(doc_id, xxhash64(text), 'batch'), 100)"
    assert rows.groupBy(F.expr(batch)).count().agg(F.max("count")).first()[0] < 10


RETAINED = """
import re
import numpy as np, pyarrow as pa
from quernstone.llm import jaccard_join

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = np.random.default_rng(1)
texts = [" ".join(f"word{i}" for i in rng.integers(0, 4000, 300)) for _ in range(5000)]
table = pa.table({"doc_id": np.arange(5000), "text_hash": np.arange(5000), "text": texts, "batch": np.zeros(5000, np.int64)})
before = held()
asked = jaccard_join._ask(4)(table)
sets = jaccard_join._sets(table, asked.select(["batch", "keys", "counts"]))
print(held() - before - (asked.nbytes + sets.nbytes) / 2**20)
"""


def test_workers_keep_no_memory_between_groups():
    """A worker that is idle holds what it returned, but not what it needed for it."""
    if not os.path.exists("/proc/self/smaps_rollup") or platform.libc_ver()[0] != "glibc":
        pytest.skip("needs glibc on Linux")
    out = subprocess.run([sys.executable, "-c", RETAINED], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 16


def test_a_stream_releases_when_it_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(session, "release", lambda: calls.append(1))
    assert list(session.streamed(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(session.streamed(lambda batches: (1 // b for b in batches))(iter([0])))
    assert calls == [1, 1]


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(data.empty(spark)).count() == 0


def test_signature_tree_keeps_all_similar_pairs():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 120, dtype=np.uint64)
        for _ in range(3):
            kept = base[rng.random(120) > 0.07]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, 3, dtype=np.uint64)])))
    found = {(a, b) for x, y in signature_tree.pairs(jaccard_join._leaves(sets)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    true = {(a, b) for b in range(len(sets)) for a in range(b) if signature_tree.similar(sets[a], sets[b])}
    assert true and true <= found and len(found) < 0.2 * len(sets) ** 2


@pytest.mark.parametrize("size", [2000, 20_000])
def test_signature_tree_tells_long_sets_apart(size):
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**63, size + i, dtype=np.uint64)) for i in range(40)]
    sets += [np.sort(np.r_[s[size // 20 :], rng.integers(0, 2**63, 9, dtype=np.uint64)]) for s in sets[:5]]
    found = {(int(a), int(b)) for x, y in signature_tree.pairs(jaccard_join._leaves(sets)) for a, b in zip(x, y, strict=True)}
    assert {(i, 40 + i) for i in range(5)} <= found and len(found) < 20


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (50, 60), (60, 70), (7, 7)] + [(100, x) for x in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in range(150)], "node long")
    got = {r.node: r.comp for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 150 and got[30] == 1 and got[70] == 40 and got[139] == 100 and got[0] == 0 and got[149] == 149


def test_components_of_random_links(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2600, 2))] + [(i, 5000 - i % 7) for i in range(3000, 4000)] + [(6000 + 2 * i, 6002 + 2 * i) for i in range(600)]
    up = list(range(8000))
    for a, b in links * 40:
        up[a] = up[b] = min(up[a], up[b])
    for a, b in links[::-1] * 40:
        up[a] = up[b] = min(up[a], up[b])
    nodes = spark.createDataFrame([(i,) for i in range(8000)], "node long")
    got = {r.node: r.comp for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict(enumerate(up))


def brute_passages(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = Counter()
    for i, b in bodies:
        mask = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mask[s] += 1
                mask[s + length] -= 1
        gone = np.cumsum(mask)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("most", [session.BATCH_BYTES, 20_000])
def test_passages(spark, monkeypatch, most):
    monkeypatch.setattr(session, "BATCH_BYTES", most)
    rows = data.texts()
    # windows that share an anchor but not their bytes, and matches that end at different places
    core = data.words(4242, 60)
    rows += [(200 + i, data.words(i, 10 + i) + " " + core[i * 3 : 330 - 5 * i] + " " + data.words(300 + i, 20)) for i in range(12)]
    got = passage_dedup.passages_query(data.documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_passages(rows, 200)
    assert passage_dedup.passages_query(data.empty(spark)).count() == 0


def test_hot_anchors(monkeypatch):
    """The path for anchors with very many different pieces gives the same result."""
    import pyarrow as pa

    core = data.words(4242, 60)
    rows = [(i, data.words(i, 10 + i) + " " + core[i * 3 : 330 - 5 * i] + " " + data.words(300 + i, 20)) for i in range(12)]
    results = []
    for hot in (512, 1):
        monkeypatch.setattr(passage_dedup, "HOT", hot)
        left = pa.table({"doc_id": [i for i, _ in rows], "key": [i * 31 for i, _ in rows], "text": [t for _, t in rows], "batch": [0] * len(rows)})
        said = passage_dedup.count(passage_dedup.ask(1)(left))
        sent = passage_dedup.send(left, said).sort_by([("anchor", "ascending"), ("piece", "ascending")])
        fine = [pa.Table.from_batches([b]) for b in passage_dedup.compare(sent.to_batches())]
        right = pa.concat_tables([said.cast(fine[0].schema) if fine else said, *fine])
        out = passage_dedup.cut_out(left, right)
        results.append(out.column("kept").to_pylist())
        want = brute_passages(rows, 200)
        assert {hashlib.sha256(k).hexdigest() for k in results[-1]} == {w[4] for w in want}
    assert results[0] == results[1]


def test_later_copies_keep_the_first():
    text = b"abcdefghij" * 3 + b"0123456789klmnopqrst" + b"xabcdefghijy" + b"0123456789klmnopqrst"
    gone = suffixes.later_copies(text, 10)
    seen, want = set(), np.zeros(len(text), bool)
    for s in range(len(text) - 9):
        if text[s : s + 10] in seen:
            want[s : s + 10] = True
        seen.add(text[s : s + 10])
    assert (gone == want).all()
    rng = np.random.default_rng(0)
    data_ = rng.integers(97, 100, 400).astype(np.uint8)
    before, after = suffixes.factors(data_, np.arange(400), 16)
    b = data_.tobytes()
    for s in range(385):
        assert (before[s] >= 16) == (b[s : s + 16] in {b[j : j + 16] for j in range(s)})
        assert (after[s] >= 16) == (b[s : s + 16] in {b[j : j + 16] for j in range(s + 1, 385)})
