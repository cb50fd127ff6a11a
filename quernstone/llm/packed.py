"""Exchanges of packed arrays: sums over partitions, and a distributed counter.

Rows of these exchanges hold whole NumPy arrays as binary, so that a shuffle
costs its bytes and not its number of values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64


def rounds(most: int, fan_in: int = FAN_IN) -> list[int]:
    """Number of groups after each round of adding so many vectors fan_in at a time."""
    groups = []
    while most > 1:
        most = -(-most // fan_in)
        groups.append(most)
    return groups


def summed(parts: DataFrame, most: int, fan_in: int = FAN_IN, kind: type = np.float64) -> np.ndarray | None:
    """Sum of the vectors of floats in column vec of (part, vec), fan_in at a time; parts are 0 to most - 1.

    The vectors have the same bounded length; the driver gets one.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), kind) for x in table.column("vec"))
        return pa.table({"part": table.column("part")[:1], "vec": pa.array([total.tobytes()], pa.binary())})

    for n in rounds(most, fan_in):
        parts = parts.select(F.pmod("part", F.lit(n)).alias("part"), "vec").groupBy("part").applyInArrow(add, "part long, vec binary")
    rows = parts.toArrow().column("vec")
    return sum(np.frombuffer(x.as_buffer(), kind) for x in rows) if len(rows) else None


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def requests(batch: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket: the distinct keys of a batch with their counts in it."""
    b = bucket_of(keys, buckets)
    order = np.lexsort((keys, b))
    keys, counts, b = keys[order], counts[order], b[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(b)]
    return pa.table(
        {
            "batch": pa.array(np.full(len(cut), batch, np.int64)),
            "bucket": pa.array(b[cut]),
            "keys": pa.array([keys[i:j].tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary()),
            "counts": pa.array([counts[i:j].astype(np.int64).tobytes() for i, j in zip(cut, ends, strict=False)], pa.binary()),
        }
    )


REQUEST = "batch long, bucket long, keys binary, counts binary"


def gathered(table: pa.Table):
    """All keys, counts, and the row of each, of a bucket's requests."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    counts = [np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")]
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.concatenate(keys), np.concatenate(counts), row


def answered(asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> DataFrame:
    """Replies (batch, keys, counts) to requests, bucket by bucket.

    answer(keys, counts, row) gives which entries to send back, their values,
    and optionally a float64 vector, sent as a reply to batch -1.
    """

    def run(table: pa.Table) -> pa.Table:
        keys, counts, row = gathered(table)
        keep, values, vector = answer(keys, counts, row)
        batches = table.column("batch").to_numpy()
        k, v, r = keys[keep], values, row[keep]
        cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
        ends = np.r_[cut[1:], len(r)]
        ks = [k[i:j].tobytes() for i, j in zip(cut, ends, strict=False)]
        vs = [v[i:j].astype(np.int64).tobytes() for i, j in zip(cut, ends, strict=False)]
        to = batches[r[cut]].tolist() if len(r) else []
        if vector is not None:
            ks.append(table.column("bucket")[0].as_py().to_bytes(8, "little"))
            vs.append(vector.tobytes())
            to.append(-1)
        return pa.table({"batch": pa.array(to, pa.int64()), "keys": pa.array(ks, pa.binary()), "counts": pa.array(vs, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "batch long, keys binary, counts binary")


def replies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys, sorted, and values that a batch got back."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts, _ = gathered(table)
    order = np.argsort(keys)
    return keys[order], counts[order]


def found(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The value of each key, 0 for those not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)
