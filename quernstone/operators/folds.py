"""Greedy folds over lists, cell by cell.

Where a chunk or a run begins depends on all earlier entries of its list.  A long
list is dealt out in cells of ``STRIDE`` dids.  Every cell is summed up, whatever comes
before it, as a map from the state at its beginning to the state at its end; a scan
over the cells of a list, of which there are at most 2^16, applies the maps in
turn, one lookup each; then every cell goes through its entries from the state
that it begins with.  So a list is as many tasks as it has cells; lists of at most
``STRIDE`` entries, which most are, are whole in a task however far their dids are
apart, are gone through together and need no maps.

Maps are small.  A chunk that is held open closes at one of the first entries of
the cell, and what follows doesn't depend on anything before.  A run only goes on
into a cell that begins with the did after the last; then it is its width and
its slack (tenths of used bytes above what a block needs) that say where it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import varint
from ..functions.chunks import GOOD_TENTHS

STRIDE = 1 << 16
WIDTHS = (1, 2, 3, 4)


def widths(value: np.ndarray) -> np.ndarray:
    """Bytes that hold each value; 1 for 0."""
    return 1 + sum((value >= 1 << (8 * k)).astype(np.int64) for k in (1, 2, 3))


class ByteSplit:
    """Chunks that end once their body has `most` bytes. State: chunk number, bytes held (-1 at the list's beginning), last did."""

    START = (0, -1, 0)
    STATE = "chunk long, held long, last long"
    MAP = "first long, last long, body long, total long, need array<long>, chunks array<long>, held array<long>"

    def __init__(self, most: int) -> None:
        self.most = most

    def step(self, state: tuple[int, int, int], did: int, body: int) -> tuple[int, int]:
        """chunk and held after one more entry."""
        chunk, held, last = state
        if held < 0:
            return chunk, body
        if held >= self.most:
            return chunk + 1, body
        return chunk, held + varint.size(did - last - 1) + body

    def _follow(self, body: np.ndarray, total: np.ndarray) -> np.ndarray:
        """For a chunk that begins at each entry, where the next one does."""
        n = len(body)
        return np.maximum(np.searchsorted(total, self.most - body + total, "left"), np.arange(n)) + 1

    def _sums(self, did: np.ndarray, body: np.ndarray) -> np.ndarray:
        """Bytes of entries that go on in their chunk, summed up; 0 at the first."""
        return np.concatenate([[0], np.cumsum(body[1:] + varint.sizes(did[1:] - did[:-1] - 1))])

    def summary(self, did: np.ndarray, value: np.ndarray) -> tuple:
        body, n = varint.sizes(value), len(did)
        total = self._sums(did, body)
        # a chunk that holds h bytes after the first entry ends before entry j if h + total[j - 1] >= most
        some = np.arange(1, min(n, int(np.searchsorted(total, self.most - 1, "left")) + 2))
        need, after, at, begun = self.most - total[some - 1], self._follow(body, total), some.copy(), np.ones(len(some), np.int64)
        while (more := after[at] < n).any():
            at = np.where(more, after[at], at)
            begun += more
        return int(did[0]), int(did[-1]), int(body[0]), int(total[-1]), need, begun, body[at] + total[-1] - total[at]

    def apply(self, state: tuple[int, int, int], first, last, body, total, need, chunks, held) -> tuple[int, int, int]:
        chunk, now = self.step(state, first, body)
        j = len(need) - int(np.searchsorted(np.asarray(need)[::-1], now, "right"))  # need falls: the first that is met
        if j < len(need):
            return chunk + chunks[j], held[j], last
        return chunk, now + total, last

    def fresh(self, did: np.ndarray, value: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Chunk number of each entry of lists that begin at the edges; only lists of several chunks take a step each."""
        step = varint.sizes(value)
        gap = np.diff(did, prepend=did[:1]) - 1
        gap[edges] = 0
        total = np.cumsum(step + varint.sizes(gap))
        ends = np.append(edges[1:], len(did))
        sums = total[ends - 1] - total[edges] + step[edges]
        out = np.zeros(len(did), np.int64)
        for a, b in zip(edges[sums >= self.most].tolist(), ends[sums >= self.most].tolist()):
            out[a:b] = self.through(self.START, did[a:b], value[a:b])
        return out

    def through(self, state: tuple[int, int, int], did: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Chunk number of each entry."""
        body = varint.sizes(value)
        total, out = self._sums(did, body), np.empty(len(did), np.int64)
        chunk, held = self.step(state, int(did[0]), int(body[0]))
        at, base = 0, held
        while at < len(did):
            stop = min(len(did), max(int(np.searchsorted(total, self.most - base, "left")), at) + 1)
            out[at:stop] = chunk
            if stop < len(did):
                base = int(body[stop] - total[stop])
            at, chunk = stop, chunk + 1
        return out


class Runs:
    """Runs of consecutive dids for fixed-width blocks, named by their first did. State: last did, width, slack, first did."""

    START = (-2, 0, 0, 0)
    STATE = "last long, width long, slack long, first long"
    MAP = "begin long, end long, width long, slack long, first long, at array<array<long>>, to array<array<struct<width: long, slack: long, first: long>>>"

    @staticmethod
    def _sums(width: np.ndarray) -> dict[int, np.ndarray]:
        """Slack that entries add to a run of each width, summed up."""
        return {w: np.cumsum(10 * width - GOOD_TENTHS * w) for w in WIDTHS}

    @staticmethod
    def _end(sums: np.ndarray, stop: int, start: int, base: int) -> int:
        """The first entry from start to stop whose sum is below base, else stop."""
        size = 16
        while start < stop:
            low = np.flatnonzero(sums[start : min(start + size, stop)] < base)
            if len(low):
                return start + int(low[0])
            start, size = start + size, size * 4
        return stop

    def _open(self, did: np.ndarray, value: np.ndarray, edges: np.ndarray | None = None):
        width = widths(value)
        n = len(did)
        gap = np.flatnonzero(np.diff(did) != 1) + 1
        if edges is not None:
            gap = np.union1d(gap, edges)
        limits = {w: np.union1d(gap, np.flatnonzero(width > w)) for w in WIDTHS}  # no run of a width goes on here

        def limit(w: int, after: int) -> int:
            k = int(np.searchsorted(limits[w], after, "right"))
            return int(limits[w][k]) if k < len(limits[w]) else n

        return width, self._sums(width), limit

    def _next(self, width, sums, limit, j: int) -> int:
        """Where the run that begins at j ends."""
        w = int(width[j])
        return self._end(sums[w], limit(w, j), j + 1, int(sums[w][j]))

    def summary(self, did: np.ndarray, value: np.ndarray) -> tuple:
        width, sums, limit = self._open(did, value)
        n, known = len(did), {}
        tail = int(np.flatnonzero(np.diff(did, prepend=did[:1] - 2) != 1)[-1])  # after the last gap a run begins, whatever was before

        def leave(j: int) -> tuple[int, int, int]:
            """State at the end if a run begins at j."""
            path, j = [], max(j, tail)
            while j not in known:
                path.append(j)
                k = self._next(width, sums, limit, j)
                if k >= n:
                    w = int(width[j])
                    known[j] = (w, int(sums[w][-1] - sums[w][j]), int(did[j]))
                else:
                    j = k
            for i in path:
                known[i] = known[j]
            return known[j]

        at, to = [], []
        for w in WIDTHS if did[0] % STRIDE == 0 else ():
            stop = limit(w, -1)
            low = np.minimum.accumulate(np.r_[0, sums[w][:stop]])
            ends = np.flatnonzero(low[1:] < low[:-1])  # a run of slack s ends here if s < -low
            places = [(int(-sums[w][j]), *leave(int(j))) for j in ends]
            if stop < n:
                places.append((1 << 62, *leave(stop)))
            # of neighbours that lead to the same only the last
            kept = [p for p, q in zip(places, [*places[1:], None]) if q is None or p[1:] != q[1:]]
            at.append([p[0] for p in kept])
            to.append([dict(zip(("width", "slack", "first"), p[1:])) for p in kept])
            if stop == n:
                at[-1].append(1 << 62)
                to[-1].append({"width": w, "slack": int(sums[w][-1]), "first": -1})  # it goes on to the end
        return int(did[0]), int(did[-1]), *leave(0), at, to

    def apply(self, state: tuple, begin, end, width, slack, first, at, to) -> tuple:
        last, w, s, f = state
        if last + 1 != begin or not at:
            return end, width, slack, first
        k = int(np.searchsorted(at[w - 1], s, "right"))  # the first of which s is below
        found = to[w - 1][k]
        if found["first"] < 0:
            return end, w, s + found["slack"], f
        return end, found["width"], found["slack"], found["first"]

    def fresh(self, did: np.ndarray, value: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """First did of each entry's run, of lists that begin at the edges."""
        return self._walk(did, value, 0, edges)

    def through(self, state: tuple, did: np.ndarray, value: np.ndarray) -> np.ndarray:
        """First did of each entry's run."""
        last, w, s, f = state
        if last + 1 != did[0]:
            return self._walk(did, value, 0)
        _, sums, limit = self._open(did, value)
        at = self._end(sums[w], limit(w, -1), 0, -s)
        out = self._walk(did, value, at)
        out[:at] = f
        return out

    def _walk(self, did: np.ndarray, value: np.ndarray, at: int, edges: np.ndarray | None = None) -> np.ndarray:
        """Runs from entry `at`, where one begins; neighbours of one width are a run, only those of several widths take a step each."""
        follows = np.diff(did, prepend=did[:1] - 2) == 1
        if edges is not None:
            follows[edges] = False
        follows[at : at + 1] = False
        start = np.flatnonzero(~follows)
        out, width, ends = did[start[np.cumsum(~follows) - 1]], widths(value), np.append(start[1:], len(did))
        mixed = (np.maximum.reduceat(width, start) != np.minimum.reduceat(width, start)) & (start >= at)
        if mixed.any():
            width, sums, limit = self._open(did, value, edges)
        for a, b in zip(start[mixed].tolist(), ends[mixed].tolist()):
            while a < b:
                stop = self._next(width, sums, limit, a)
                out[a:stop] = did[a]
                a = stop
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each (term, cell) of sorted batches together, several in one; a group has at most STRIDE rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch)
        if held:
            before = held[-1]
            same = all(before.column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in (0, 1))
            end = (edges[1] if len(edges) > 1 else batch.num_rows) if same else 0
            if end:
                held.append(batch.slice(0, end))
            if same and len(edges) == 1:
                continue
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, batch = [], batch.slice(end)
            edges = _edges(batch)
        if edges[-1]:
            yield batch.slice(0, edges[-1])
        held.append(batch.slice(edges[-1]))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """Where groups of (term, cell) begin."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = pc.or_(*[pc.not_equal(c[1:], c[:-1]) for c in batch.columns[:2]]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def folded(postings: DataFrame, fold, name: str) -> DataFrame:
    """postings(term, did, wdf) with what the fold says of each entry, as column `name`."""
    state = [part.split()[0] for part in fold.STATE.split(", ")]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            edges = _edges(batch)
            did, wdf = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rows = [fold.summary(did[a:b], wdf[a:b]) for a, b in zip(edges, [*edges[1:], batch.num_rows])]
            head = [batch.column(k).take(pa.array(edges)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, now = None, fold.START
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            columns = [c.to_pylist() for c in (batch.column(0), *batch.columns[2:])]
            for key, *entry in zip(*columns):
                if key != term:
                    term, now = key, fold.START
                out.append(now)
                now = fold.apply(now, *entry)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, map(list, zip(*out)))], ["term", "cell", *state])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            edges = _edges(batch)
            did, wdf = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out, ends = fold.fresh(did, wdf, edges), np.append(edges[1:], batch.num_rows)
            known = batch.column(4).is_valid().to_numpy(zero_copy_only=False)[edges]  # cells of long lists
            begin = zip(*[batch.column(4 + k).take(pa.array(edges[known])).to_pylist() for k in range(len(state))])
            for s, a, b in zip(begin, edges[known], ends[known]):
                out[a:b] = fold.through(s, did[a:b], wdf[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out)], ["term", "did", "wdf", name])

    schema = f"term string, cell long, {fold.MAP}"
    arrow = _arrow(schema)
    names, types = arrow.names, arrow.types[2:]
    # lists that may have more than STRIDE entries, one at most of every STRIDE words; the three uses of the rows ask for
    # the same columns under the same filter, so that Spark makes them once and uses their exchange again
    rows = postings.where("term is not null and did is not null").select("term", "did", "wdf")
    long = rows.groupBy("term").agg(F.sum(F.greatest("wdf", F.lit(1))).alias("_n")).where(F.col("_n") > STRIDE)
    known = F.broadcast(long)
    short = rows.join(known, "term", "left").where("_n is null").select("term", F.lit(-1).cast("long").alias("cell"), "did", "wdf", *(F.lit(None).cast("long").alias(c) for c in state))
    alone = short.repartition("term").sortWithinPartitions("term", "did")
    cells = rows.join(known, "term").select("term", F.expr(f"did div {STRIDE}").alias("cell"), "did", "wdf").repartition("term", "cell")
    maps = cells.sortWithinPartitions("term", "cell", "did").mapInArrow(summarise, schema)
    states = maps.repartition("term").sortWithinPartitions("term", "cell").mapInArrow(scan, f"term string, cell long, {fold.STATE}")
    both = cells.join(states, ["term", "cell"], "left").sortWithinPartitions("term", "cell", "did").select("term", "cell", "did", "wdf", *state)
    out = f"term string, did long, wdf long, {name} long"
    return alone.mapInArrow(through, out).unionByName(both.mapInArrow(through, out))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
