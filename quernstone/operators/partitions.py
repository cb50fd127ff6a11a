"""Bits of the partitionings of lists, many lists at once.

Lists are gone through side by side, one entry of each in a step of numpy.  A long
list is several lanes: each begins BLOCK entries after the one before, as if the
list began there, and goes OVER entries into the next.  Once the last MAX_PART
costs of two lanes differ by one number they go on alike, so the costs before
that place add up.  A list whose lanes don't meet is walked alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vs
from ..functions.vs import MAX_PART
from . import folds

BLOCK, OVER = 1024, 256  # entries; OVER >= MAX_PART
LANES = 2048  # at once
ROWS = 1 << 19  # that are waited for
POWERS = 1 << np.arange(63, dtype=np.int64)


def _costs(width: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least bits of the first i entries of every lane, as (i, lane); lanes go from long to short, to some thousands of entries."""
    most, lanes, heads = int(size[0]), len(size), np.array(vs.HEADS, np.int16)
    out = np.zeros((most + 1, lanes), np.int32)
    top, head, best = (np.zeros((MAX_PART, lanes), t) for t in (np.int16, np.int16, np.int32))
    born, going = np.zeros((MAX_PART, 1), np.int64), np.searchsorted(-size, -np.arange(most), side="left")
    for i in range(most):
        a, k, row = going[i], min(i + 1, MAX_PART), i % MAX_PART
        w = width[begin[:a] + i]
        best[row, :a], top[row, :a], head[row, :a], born[row] = out[i, :a], 0, 0, i
        t, h = top[:k, :a], head[:k, :a]
        np.maximum(t, w + 1, out=t)  # bits of an entry, with the one of the length's unary form
        np.maximum(h, heads[w], out=h)
        cost = t * (i + 1 - born[:k]).astype(np.int16)
        cost += h
        out[i + 1, :a] = (best[:k, :a] + cost).min(0)
    return out


def optimal_bits(gap: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of the optimal partitioning of lists of `size` gaps, one after the other in `gap`."""
    width, start = np.searchsorted(POWERS, gap, side="right").astype(np.int16), np.cumsum(size) - size
    count = np.maximum(1, (size - OVER) // BLOCK)
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    last = nth + 1 == count[of]
    length = np.where(last, size[of] - nth * BLOCK, BLOCK + OVER)
    value, tail, head = np.zeros(len(of), np.int64), {}, {}
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        cost = _costs(width, start[of[some]] + nth[some] * BLOCK, length[some])
        value[some] = cost[length[some], np.arange(len(some))]
        for k in np.flatnonzero(~last[some]):
            tail[some[k]] = cost[BLOCK + OVER + 1 - MAX_PART : BLOCK + OVER + 1, k].astype(np.int64)
        for k in np.flatnonzero(nth[some]):
            head[some[k]] = cost[OVER + 1 - MAX_PART : OVER + 1, k].astype(np.int64)
    alone = set()
    for lane, end in tail.items():
        differ = end - head[lane + 1]
        value[lane] = differ[-1]
        if (differ != differ[-1]).any():
            alone.add(of[lane])
    total = np.zeros(len(size), np.int64)
    np.add.at(total, of, value)
    for k in alone:
        total[k] = vs.optimal_bits(gap[start[k] : start[k] + size[k]].tolist())
    return total


def _bits(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Of whole lists."""
    rows = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    edges, did = folds._edges(rows), rows.column(2).to_numpy()
    first = np.zeros(len(did), bool)
    first[edges] = True
    gap = np.where(first, did, np.diff(did, prepend=0))
    kept = first | (gap != 0)  # a did that repeats is there once
    size, gap = np.add.reduceat(kept.astype(np.int64), edges), gap[kept]
    if (gap < 0).any():
        raise ValueError("values must increase")
    ends = np.cumsum(size)
    greedy = [vs.greedy_bits(gap[a:b].tolist()) for a, b in zip(ends - size, ends)]
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(edges)), pa.array(optimal_bits(gap, size)), pa.array(greedy, pa.int64())], ["term", "optimal_bits", "greedy_bits"])


def bits(places: DataFrame) -> DataFrame:
    """term, optimal_bits, greedy_bits of the lists of places(term, did); a task holds some hundred thousand entries, and a list whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for lists in folds._groups(batches):
            held.append(lists)
            if sum(b.num_rows for b in held) >= ROWS:
                yield _bits(held)
                held = []
        if held:
            yield _bits(held)

    rows = places.where("term is not null and did is not null").select("term", F.lit(0).alias("cell"), "did")
    return rows.repartition("term").sortWithinPartitions("term", "did").mapInArrow(run, "term string, optimal_bits long, greedy_bits long")
