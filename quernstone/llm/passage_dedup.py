"""Removes long byte strings that repeat across or inside documents, by suffix arrays.

A window is a string of ``LENGTH`` bytes.  Its anchor is its least ``GRAM``-byte
gram (leftmost of equal ones), so equal windows have equal anchors at the same
place in them.  The windows of a document that share an anchor's position lie
side by side and form a piece of at most ``2 * LENGTH - GRAM`` bytes.

1. Batches of documents (of bounded bytes) ask for their distinct (anchor, piece) pairs; a hash of
   the anchor decides where they are counted.  A piece that occurs twice is
   repeated whole.  An anchor with one piece in all is done.
2. Of anchors with different pieces, each distinct piece is sent once for each
   batch.  Groups of anchors are put one after another, and the suffix array of
   these bytes with longest previous and next factors (nearest smaller and
   larger positions in suffix order) tells which windows of a piece occur in
   another one.  Anchors with more than ``HOT`` distinct pieces are not put in
   one task: their windows are compared by a 64-bit hash, one row for each
   distinct window and batch.
3. The batches mark the bytes of repeated windows and cut them out.

Windows are judged on the input; all copies go (``keep="none"``), or all but
the first of a single text (``suffixes.later_copies``).

Defined cases: a null text is empty; a text shorter than a window is kept;
doc_id may be null or repeated (rows are told apart by doc_id and text; equal
rows get equal results); an empty table gives an empty result; cutting may
split a UTF-8 character, so the rest is returned as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packed, suffixes
from .session import batches, bounded_batches

LENGTH = 200
GRAM = 32
HOT = 512
PLACE_BITS = np.uint64(31)
BATCH_BYTES = 2 << 20
WHOLE, SENT, OPEN, HOT_OPEN = 1, 2, 3, 4  # what a reply says of a piece

ENTRY = "batch long, bucket long, anchors binary, pieces binary, counts binary"
REPLY = "batch long, anchors binary, pieces binary, says binary, key long, at long, n long, window long"
SENT_ROW = "anchor long, piece long, batch long, key long, at long, n long, many boolean, open boolean, body binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"


class Pieces:
    """The pieces of the texts of one slice."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, n = buf, off, len(buf)
        self.hash = K.Hasher(buf)
        if n < LENGTH:
            self.first = self.last = self.text = np.zeros(0, np.int64)
            self.anchor = self.piece = np.zeros(0, np.uint64)
            return
        at = np.arange(n - GRAM + 1)
        gram = K.mix((self.hash.sums[GRAM:] - self.hash.sums[: n - GRAM + 1]) * self.hash.inverse[: n - GRAM + 1])
        low = ((gram >> PLACE_BITS) << PLACE_BITS) | at.astype(np.uint64)
        count, span = LENGTH - GRAM + 1, 1
        while 2 * span <= count:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < count:
            low = np.minimum(low[: len(low) - (count - span)], low[count - span :])
        place = (low & np.uint64((1 << 31) - 1)).astype(np.int64)  # of the anchor of the window at each start
        size = np.diff(off)
        windows = np.maximum(size - LENGTH + 1, 0)
        text = np.repeat(np.arange(len(size)), windows)
        start = np.arange(len(text)) + np.repeat(off[:-1] - (np.cumsum(windows) - windows), windows)
        place = place[start]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        cut = np.flatnonzero(new)
        self.first, self.text = start[cut], text[cut]
        self.last = start[np.r_[cut[1:], len(start)] - 1] if len(cut) else start[:0]
        place = place[cut]
        self.anchor = gram[place]
        shape = ((place - self.first).astype(np.uint64) << np.uint64(20)) | (place - self.last).astype(np.uint64)
        self.piece = K.mix(self.hash(self.first, self.last + LENGTH, 1) ^ K.mix(shape))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start, hash) of every window of some pieces."""
        n = self.last[which] - self.first[which] + 1
        owner = np.repeat(which, n)
        start = np.arange(len(owner)) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)
        return owner, start, self.hash(start, start + LENGTH, 2)


def pair_keys(anchor: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return K.mix(anchor * np.uint64(0xC2B2AE3D27D4EB4F) ^ piece)


def ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, pieces, counts = [], [], []
        for _, _, buf, off in K.slices(table.column("text")):
            p = Pieces(buf, off)
            _, first, n = np.unique(pair_keys(p.anchor, p.piece), return_index=True, return_counts=True)
            anchors.append(p.anchor[first])
            pieces.append(p.piece[first])
            counts.append(n)
        if not anchors:
            return pa.table({k: pa.array([], t) for k, t in (("batch", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("pieces", pa.binary()), ("counts", pa.binary()))})
        anchor, piece, count = np.concatenate(anchors), np.concatenate(pieces), np.concatenate(counts)
        _, first, of = np.unique(pair_keys(anchor, piece), return_index=True, return_inverse=True)
        count = np.bincount(of, count, minlength=len(first)).astype(np.int64)
        anchor, piece = anchor[first], piece[first]
        bucket = packed.bucket_of(anchor, buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
        parts = [order[i:j] for i, j in zip(cut, [*cut[1:], len(order)], strict=False)]
        return pa.table(
            {
                "batch": pa.array([table.column("batch")[0].as_py()] * len(parts), pa.int64()),
                "bucket": pa.array([int(bucket[x[0]]) for x in parts], pa.int64()),
                "anchors": pa.array([anchor[x].tobytes() for x in parts], pa.binary()),
                "pieces": pa.array([piece[x].tobytes() for x in parts], pa.binary()),
                "counts": pa.array([count[x].tobytes() for x in parts], pa.binary()),
            }
        )

    return run


def _arrays(column, kind=np.uint64) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, kind)


def count(table: pa.Table) -> pa.Table:
    """What each piece of a bucket's requests is; pieces of anchors that occur once get no reply."""
    anchor, piece, n = _arrays(table.column("anchors")), _arrays(table.column("pieces")), _arrays(table.column("counts"), np.int64)
    row = np.repeat(np.arange(table.num_rows), [len(x.as_buffer()) // 8 for x in table.column("anchors")])
    distinct, of = np.unique(pair_keys(anchor, piece), return_inverse=True)
    total = np.bincount(of, n, minlength=len(distinct))
    rep = np.zeros(len(distinct), np.int64)
    rep[of] = np.arange(len(of))
    _, group = np.unique(anchor[rep], return_inverse=True)
    kinds = np.bincount(group)[group]
    says = np.where(kinds == 1, WHOLE, np.where(total > 1, SENT, OPEN))
    says = np.where((kinds > HOT) & (says == OPEN), HOT_OPEN, says)
    # a repeated piece of a hot anchor is compared by its windows too
    says = np.where((kinds > HOT) & (says == SENT), SENT + 8, says)
    says[(kinds == 1) & (total < 2)] = 0
    say = says[of]
    keep = np.flatnonzero(say)
    cut = np.flatnonzero(np.r_[True, np.diff(row[keep]) != 0]) if len(keep) else np.zeros(0, int)
    parts = [keep[i:j] for i, j in zip(cut, [*cut[1:], len(keep)], strict=False)]
    batches = table.column("batch").to_numpy()
    none = pa.array([None] * len(parts), pa.int64())
    return pa.table(
        {
            "batch": pa.array([int(batches[row[x[0]]]) for x in parts], pa.int64()),
            "anchors": pa.array([anchor[x].tobytes() for x in parts], pa.binary()),
            "pieces": pa.array([piece[x].tobytes() for x in parts], pa.binary()),
            "says": pa.array([say[x].astype(np.uint8).tobytes() for x in parts], pa.binary()),
            "key": none,
            "at": none,
            "n": none,
            "window": none,
        }
    )


class Replies:
    def __init__(self, table: pa.Table):
        keys = pair_keys(_arrays(table.column("anchors")), _arrays(table.column("pieces")))
        says = _arrays(table.column("says"), np.uint8)
        order = np.argsort(keys)
        self.keys, self.says = keys[order], says[order]

    def of(self, p: Pieces) -> np.ndarray:
        return packed.found(self.keys, self.says, pair_keys(p.anchor, p.piece))


def send(left: pa.Table, right: pa.Table) -> pa.Table:
    """The distinct pieces of a batch that must be compared byte by byte, and windows of hot anchors."""
    if not left.num_rows:
        right = right.slice(0, 0)
    replies, batch = Replies(right), left.column("batch")[0].as_py() if left.num_rows else 0
    keys = left.column("key").to_numpy()
    out = {k: [] for k in ("anchor", "piece", "key", "at", "n", "many", "open", "body")}
    sent: set[int] = set()
    hot_hash, hot_open = [], []
    for a, _, buf, off in K.slices(left.column("text")):
        p = Pieces(buf, off)
        says = replies.of(p)
        which = np.flatnonzero((says == SENT) | (says == OPEN))
        for i in which.tolist():
            pair = (int(p.anchor[i]), int(p.piece[i]))
            if says[i] == SENT:
                if pair in sent:
                    continue
                sent.add(pair)
            t = int(p.text[i])
            out["anchor"].append(pair[0])
            out["piece"].append(pair[1])
            out["key"].append(int(keys[a + t]))
            out["at"].append(int(p.first[i] - off[t]))
            out["n"].append(int(p.last[i] - p.first[i]) + 1)
            out["many"].append(False)
            out["open"].append(bool(says[i] == OPEN))
            out["body"].append(buf[p.first[i] : p.last[i] + LENGTH].tobytes())
        for code in (HOT_OPEN, SENT + 8):
            hot_hash.append(p.windows(np.flatnonzero(says == code))[2])
            hot_open.append(np.full(len(hot_hash[-1]), code == HOT_OPEN))
    if hot_hash:
        h, o = np.concatenate(hot_hash), np.concatenate(hot_open)
        distinct, of, n = np.unique(h, return_inverse=True, return_counts=True)
        is_open = np.bincount(of, o, minlength=len(distinct)) > 0
    else:
        distinct, n, is_open = np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, bool)
    m = len(distinct)

    def whole(values, more) -> pa.Array:
        return pa.array(np.concatenate([np.array(values, np.uint64), more]).view(np.int64))

    empty = np.zeros(m, np.int64)
    return pa.table(
        {
            "anchor": whole(out["anchor"], distinct),
            "piece": whole(out["piece"], distinct),
            "batch": pa.array(np.full(len(out["n"]) + m, batch, np.int64)),
            "key": pa.array(np.concatenate([np.array(out["key"], np.int64), empty])),
            "at": pa.array(np.concatenate([np.array(out["at"], np.int64), empty])),
            "n": pa.array(np.concatenate([np.array(out["n"], np.int64), empty])),
            "many": pa.array(np.concatenate([np.array(out["many"], bool), n > 1])),
            "open": pa.array(np.concatenate([np.array(out["open"], bool), is_open])),
            "body": pa.array(out["body"] + [None] * m, pa.binary()),
        }
    )


def compare(batches):
    """Rows come sorted by anchor and piece; groups are compared when enough bytes have come together."""
    schema = ["batch", "anchors", "pieces", "says", "key", "at", "n", "window"]

    def reply(batch, key, at, n, window) -> pa.RecordBatch:
        none = pa.array([None] * len(batch), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), none, none, none, pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(window, pa.int64())], schema)

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        """Runs of windows of open pieces that occur in another piece."""
        bodies = [np.frombuffer(r[8], np.uint8) for r in rows]
        size = np.array([len(b) for b in bodies])
        base = np.cumsum(size) - size
        n = np.array([r[5] for r in rows])
        owner = np.repeat(np.arange(len(rows)), n)
        starts = np.arange(len(owner)) + np.repeat(base - (np.cumsum(n) - n), n)
        before, after = suffixes.factors(np.concatenate(bodies), starts, LENGTH)
        is_open = np.array([r[7] for r in rows])
        hit = (np.maximum(before, after) >= LENGTH) & is_open[owner]
        inner = np.ones(len(owner), bool)
        inner[0] = False
        inner[1:] = owner[1:] == owner[:-1]
        prev = np.r_[False, hit[:-1]] & inner
        begin = np.flatnonzero(hit & ~prev)
        follow = np.r_[hit[1:] & inner[1:], False]
        end = np.flatnonzero(hit & ~follow)
        who = owner[begin]
        at = np.array([r[4] for r in rows])[who] + (starts[begin] - base[who])
        return reply([rows[i][2] for i in who], [rows[i][3] for i in who], at.tolist(), (end - begin + 1).tolist(), [None] * len(who))

    group: list[tuple] = []
    ready: list[tuple] = []
    windows: list[tuple] = []
    size = 0

    def close() -> None:
        nonlocal size
        if len(group) > 1 and group[0][8] is not None:
            ready.extend(group)
            size += sum(len(r[8]) for r in group)
        elif group and group[0][8] is None and (len(group) > 1 or group[0][6]):
            windows.extend((r[2], r[0]) for r in group if r[7])
        group.clear()

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and r[0] != group[0][0]:
                close()
                if size >= BATCH_BYTES:
                    yield runs(ready)
                    ready.clear()
                    size = 0
                if len(windows) > 10_000:
                    yield reply([w[0] for w in windows], [None] * len(windows), [None] * len(windows), [None] * len(windows), [w[1] for w in windows])
                    windows.clear()
            if r[8] is not None and group and r[1] == group[-1][1]:
                continue  # the same piece from another batch
            group.append(r)
    close()
    if ready:
        yield runs(ready)
    if windows:
        yield reply([w[0] for w in windows], [None] * len(windows), [None] * len(windows), [None] * len(windows), [w[1] for w in windows])


def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
    replies = Replies(right)
    fine: dict[int, list[tuple[int, int]]] = {}
    hot = []
    for key, at, n, window in zip(*(right.column(c).to_pylist() for c in ("key", "at", "n", "window")), strict=True):
        if window is not None:
            hot.append(window)
        elif key is not None:
            fine.setdefault(key, []).append((at, n))
    hot = np.sort(np.array(hot, np.int64).view(np.uint64))
    keys = left.column("key").to_numpy()
    sizes, spans, kept = [], [], []
    for a, b, buf, off in K.slices(left.column("text")):
        p = Pieces(buf, off)
        says = replies.of(p)
        cover = np.zeros(len(buf) + 1, np.int64)
        whole = np.flatnonzero((says == WHOLE) | (says == SENT) | (says == SENT + 8))
        np.add.at(cover, p.first[whole], 1)
        np.add.at(cover, p.last[whole] + LENGTH, -1)
        _, start, h = p.windows(np.flatnonzero(says == HOT_OPEN))
        if len(start) and len(hot):
            at = start[packed.found(hot, np.ones(len(hot), np.int64), h) > 0]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + LENGTH, -1)
        for t in range(b - a):
            for at, n in fine.get(int(keys[a + t]), ()):
                cover[off[t] + at] += 1
                cover[off[t] + at + n - 1 + LENGTH] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        for t in range(b - a):
            g = gone[off[t] : off[t + 1]]
            edge = np.flatnonzero(np.diff(np.r_[0, g.view(np.int8), 0]))
            sizes.append(len(g))
            spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(buf[off[t] : off[t + 1]][~g].tobytes())
    return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes) and kept (the other bytes) of every document."""
    bounded_batches(docs.sparkSession)
    n = batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("batch", F.pmod(F.col("key"), F.lit(n)))
    by_batch = rows.groupBy("batch")
    said = by_batch.applyInArrow(ask(n), ENTRY).groupBy("bucket").applyInArrow(count, REPLY)
    sent = by_batch.cogroup(said.groupBy("batch")).applyInArrow(send, SENT_ROW)
    compared = sent.repartition("anchor").sortWithinPartitions("anchor", "piece").mapInArrow(compare, REPLY)
    return by_batch.cogroup(said.unionByName(compared).groupBy("batch")).applyInArrow(cut_out, RESULT)


def passages_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.col("n_bytes") - F.length("kept")
    return repeated_passages(docs).select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
