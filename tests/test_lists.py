"""Operators that go through many lists at a time give what each list alone gives."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quernstone.functions import udtf, vs
from quernstone.operators import partitions


def walked_runs(rows):
    out = []
    for term, did in rows:
        if out and out[-1][0] == term and did is not None and out[-1][1] is not None and did <= out[-1][1] + out[-1][2]:
            out[-1][2] = did - out[-1][1] + 1
        elif not (out and did is None and out[-1][:2] == [term, None]):
            out.append([term, did, 1])
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_runs_go_on_over_batches(size):
    rng, rows = random.Random(size), []
    for t in (None, "", "a", "b", "c"):
        rows += [(t, None)] * rng.randrange(3)
        rows += [(t, d) for d in sorted(rng.choices(range(90), k=rng.choice([1, 20, 60])))]  # some repeat
    made, out = udtf.ListRuns.func(), []
    for at in range(0, len(rows), size):
        term, did = (list(c) for c in zip(*rows[at : at + size]))
        for batch in made.eval(pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(did, pa.int64())], ["term", "did"])):
            out += batch.to_pylist()
    for batch in made.terminate():
        out += batch.to_pylist()
    assert [[r["term"], r["first_did"], r["n"]] for r in out] == walked_runs(rows)


def test_runs_from_sql_go_by_batches(spark):
    from quernstone import catalog

    rows = catalog.QUERIES["list_runs_sql"](spark, "/root/testdata/sf0.001")
    rows._jdf.collectAsList()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ArrowEvalPythonUDTF" in plan and plan.count("Exchange") == 1


def test_bits_are_those_of_the_cuts():
    rng = random.Random(8)
    for n in [0, 1, 2, 3, 63, 64, 65, 66, 129, *[rng.randrange(400) for _ in range(60)]]:
        gap = []
        while len(gap) < n:  # stretches of one kind
            most = rng.choice([1, 2, 5, 300, 1 << 31])
            gap += [rng.randrange(1, most + 1) for _ in range(rng.randrange(1, 150))]
        gap = gap[:n]
        gap[:1] = [rng.choice([0, 1, 256])] if gap else []

        def cost(cuts):
            return sum(vs.part_bits(gap[a:b]) for a, b in zip(cuts, cuts[1:]))

        assert vs.optimal_bits(gap) == cost(vs.optimal_cuts(gap))
        assert vs.optimal_bits(gap, 5) == cost(vs.optimal_cuts(gap, 5))
        assert vs.greedy_bits(gap) == cost(vs.greedy_cuts(gap)) and vs.greedy_bits(gap, True) == cost(vs.greedy_cuts(gap, True))


def test_bits_take_a_long_list():
    """Time grows with the list alone: no entry looks at all beginnings of its part."""

    class Width(int):
        asked = 0

        def bit_length(self):
            Width.asked += 1
            return int(self).bit_length()

    vs.optimal_bits([Width(g) for g in [1, 2, 9, 1] * 500])
    assert Width.asked == 2000


def test_lists_side_by_side(spark, monkeypatch):
    """Lanes of long lists, some of which don't meet, and lists of one entry; as lists and as rows, of which some repeat."""
    monkeypatch.setattr(partitions, "BLOCK", 128)
    monkeypatch.setattr(partitions, "OVER", 64)
    monkeypatch.setattr(partitions, "LANES", 7)
    rng, lists = random.Random(9), []
    for n in [1, 1, 2, 63, 64, 65, 191, 192, 193, 320, 500, 700, 1000, 1000]:
        kinds = rng.choice([[1], [1, 2, 300], [1 << 20], [3, 1 << 40]])
        lists.append([rng.randrange(1, rng.choice(kinds) + 1) for _ in range(n)])
    lists += [[1] * 700, [0] + [1] * 300]
    want = [(vs.optimal_bits(g), vs.greedy_bits(g)) for g in lists]
    got = partitions.optimal_bits(np.array(sum(lists, [])), np.array([len(g) for g in lists]))
    assert got.tolist() == [w[0] for w in want]
    rows = [(f"t{k}", int(d)) for k, g in enumerate(lists) for d in np.cumsum(g) for _ in range(1 + d % 2)]
    found = partitions.bits(spark.createDataFrame(rng.sample(rows, len(rows)), "term string, did long"))
    assert {tuple(r) for r in found.collect()} == {(f"t{k}", *w) for k, w in enumerate(want)}


def test_words_and_lengths_come_together(spark):
    """Postings with the length of their document: the text is read once, and nothing is joined."""
    from quernstone.operators import build

    docs = spark.createDataFrame([(0, "a b a"), (1, None), (2, ""), (3, "B c d")], "doc_id long, text string")
    found = build.postings_with_length(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Join" not in plan and plan.count("Exchange") == 1
    assert {tuple(r) for r in found.collect()} == {("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 4, 1, 3), ("c", 4, 1, 3), ("d", 4, 1, 3)}
