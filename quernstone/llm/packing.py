"""Packing token sequences into as few bins of equal capacity as possible.

Documents become token ids with an end token; those above the capacity are cut
into pieces of it, the first of which may be shorter.  All that the plan needs is
the histogram of piece lengths, at most ``capacity`` rows at any size of the
corpus.

The configuration linear program over it (how often to use which multiset of
lengths) is solved by multiplicative weights.  A length weighs its share of the
capacity, times exp(-ETA * the share of its pieces that configurations cover
already).  A round prices configurations by the unbounded knapsack over these
weights, one dynamic program over all capacities, from which it takes the best
configuration that has each of the lengths that lag most, without what isn't left; each is used as often
as its scarcest length allows, rounded down, but for at most a step of a length, so that
all are covered alike.  What the last rounds leave is the residue of the
rounding: it goes best fit first into the room of the bins that are open, and
into new ones, many equal bins at a time.

The plan is a list of patterns (lengths and how often each) with copies.  A
piece's rank among those of its length, found in two levels so that a length
that most pieces share needs no single task, says which copy of which pattern it
takes, by a join with the slots of the plan, whose number doesn't depend on the
corpus (``MAX_SLOTS``, checked).

Defined cases: a null text is empty, and a piece of the end token alone; repeated
rows are documents of their own; null doc_ids are packed like others; an empty
table gives an empty result; other columns of any name are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bounded_batches, cut, streamed

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END = 0
ETA = 0.3
STEPS = (0.1, 1.0)  # of the pieces of a length that one configuration covers at most; the better plan is taken
ENOUGH = 4  # pieces of a short length, below which it is left to the residue
LAGGING = 48  # configurations taken from one dynamic program
ROUNDS = 2000
SHARES = (0.05, 0.1, 0.25, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0)  # of the copies, after which rounding may stop
BUCKET = 1 << 14  # pieces that are ranked together
MAX_SLOTS = 1 << 20  # patterns times lengths in them; a plan has some ten thousand

PIECES = "doc_id long, piece int, start long, length long, ids binary"

# ---- tokens


@lru_cache(1)
def encoder(path: str):
    """text -> ids of the byte-level BPE in a vocabulary file of the tokenizers library.

    tiktoken merges the same ranks several times as fast; its results are those of
    the file's own tokenizer (tests), which also reads what tiktoken refuses
    (very long runs of white space).
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.asarray(own.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenized(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece."""
    if vocabulary is None:
        from public_tokenizers import path

        vocabulary = path(VOCABULARY)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            owner, number, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(encode(text.as_py() or ""), end).astype("<u4")
                at, k, stop = 0, 0, len(tokens) % capacity or capacity
                while at < len(tokens):
                    owner.append(i), number.append(k), start.append(at), length.append(stop - at), ids.append(tokens[at:stop].tobytes())
                    at, k, stop = stop, k + 1, stop + capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(streamed(pieces), PIECES)


# ---- the plan


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[w]: the largest value of lengths that fit in w; last[w]: one of them, -1 for none."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]  # room may be left over
        n = fits[w]
        if n:
            total = best[w - lengths[:n]] + value[:n]
            k = n - 1 - int(total[::-1].argmax())  # of equal ones the longest
            if total[k] > best[w]:
                best[w], last[w] = total[k], k
    return best, last


def configuration(last: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """Index of a length -> times, for the best value in the room."""
    found: dict[int, int] = {}
    while room > 0:
        k = int(last[room])
        if k < 0:
            room -= 1
            continue
        found[k] = found.get(k, 0) + 1
        room -= int(lengths[k])
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> times) and copies that hold every piece of the histogram once."""
    plans = (_rounded(histogram, patterns, share, capacity) for patterns in (covering(histogram, capacity, s) for s in STEPS) for share in SHARES)
    return min(plans, key=lambda plan: sum(copies for _, copies in plan))


def covering(histogram: dict[int, int], capacity: int, step: float) -> list[tuple[dict[int, int], int]]:
    """The configurations that multiplicative weights choose, in turn, with whole numbers of copies."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], np.int64)
    left = need.copy()
    patterns: list[tuple[dict[int, int], int]] = []
    for _ in range(ROUNDS):
        some = np.flatnonzero(left >= np.minimum(capacity // lengths, ENOUGH))
        if not len(some):
            break
        size = lengths[some]
        covered = 1 - left[some] / need[some]
        before = len(patterns)
        best, last = knapsack(size, size / capacity * np.exp(-ETA * covered), capacity)
        for k in np.lexsort((-size, covered))[:LAGGING]:
            found = configuration(last, size, capacity - int(size[k]))
            found[int(k)] = found.get(int(k), 0) + 1
            found = {i: n for i, n in ((i, min(n, int(left[some[i]]))) for i, n in found.items()) if n}
            if not found:
                continue
            times = int(min(min(left[some[i]] // n, max(1, need[some[i]] * step // n)) for i, n in found.items()))
            if times:
                patterns.append(({int(size[i]): n for i, n in found.items()}, times))
                for i, n in found.items():
                    left[some[i]] -= times * n
        if len(patterns) == before:
            break
    return patterns


def _rounded(histogram: dict[int, int], patterns: list[tuple[dict[int, int], int]], share: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The first patterns with this share of all copies, and the residue of the histogram best fit."""
    residue, kept, most = dict(histogram), [], share * sum(copies for _, copies in patterns)
    for content, copies in patterns:
        if most < copies:
            break
        most -= copies
        kept.append((content, copies))
        for length, times in content.items():
            residue[length] -= times * copies
    return best_fit(kept, {length: count for length, count in residue.items() if count}, capacity)


def best_fit(patterns: list[tuple[dict[int, int], int]], residue: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Puts the residue, longest first, where least room is left over; equal bins are filled together."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(content: dict[int, int], copies: int) -> None:
        room = capacity - sum(n * t for n, t in content.items())
        open_bins.setdefault(room, []).append((content, copies))

    for content, copies in patterns:
        put(content, copies)
    for length in sorted(residue, reverse=True):
        count = residue[length]
        while count:
            room = min((r for r, bins in open_bins.items() if bins and r >= length), default=None)
            content, copies = ({}, count) if room is None else open_bins[room].pop()
            times = min((capacity if room is None else room) // length, count)
            used = min(copies, count // times)
            put(content | {length: content.get(length, 0) + times}, used)
            if room is not None and used < copies:
                open_bins[room].append((content, copies - used))
            count -= used * times
    return [entry for room in sorted(open_bins) for entry in open_bins[room]]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, stop, times, sequence, offset): ranks first to stop of a length lie in copies of one pattern.

    Rank first + i is in sequence + i div times, at offset + i mod times * length.
    """
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for content, copies in patterns:
        offset = 0
        for length, times in sorted(content.items(), reverse=True):
            first = rank.get(length, 0)
            rank[length] = first + copies * times
            rows.append((length, first, rank[length], times, sequence, offset))
            offset += length * times
        sequence += copies
    return rows


# ---- places


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... among the pieces of a length; groups that are ranked together stay near BUCKET rows."""
    buckets = max(1, -(-pieces.count() // BUCKET))
    order = ["doc_id", "piece", "ids_crc32"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return rows.join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


SLOTS = "slot_length long, first long, stop long, times long, sequence long, place long"


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with doc_id, piece, length and ids_crc32, and where each goes: sequence_id, offset."""
    pieces = cut(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = slots(solve(histogram, capacity))
    if len(rows) > MAX_SLOTS:
        raise ValueError(f"a plan of {len(rows)} slots")
    plan = pieces.sparkSession.createDataFrame(rows, SLOTS)
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    found = ranked(pieces).join(F.broadcast(plan), here)
    sequence = F.expr("sequence + (rank - first) div times").alias("sequence_id")
    offset = F.expr("place + (rank - first) % times * length").alias("offset")
    return found.select(*pieces.columns, sequence, offset)


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = tokenized(docs, vocabulary, capacity, end)
    return placed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves; at most capacity tokens meet in a group."""
    rows = placed(tokenized(docs, vocabulary, capacity, end).withColumn("ids_crc32", F.crc32("ids")), capacity)
    part = F.struct("offset", "ids")
    return rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("sequence_id", F.expr("aggregate(parts.ids, cast('' as binary), (x, y) -> x || y)").alias("ids"))
