"""Many small groups through one Arrow stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import streamed

HELD = 4096  # rows of an unfinished group that are merged


def by_group(rows: DataFrame, keys: list[str], fn: Callable[[pa.Table], list], names: list[str], binary: tuple[str, ...] = (), merge: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """fn of every group of equal keys (longs, not null), as one frame of longs (and the binary columns named).

    Rows are hashed and sorted by the keys and streamed; small groups share
    their batches.  A group is held in memory, as with applyInArrow, unless
    ``merge`` turns many rows of a group into a few that stand for them.
    """
    types = [pa.binary() if n in binary else pa.int64() for n in names]

    def run(batches):
        carry, out = None, []

        def flush():
            columns = [pa.array([x for o in out for x in o[i]], t) if t == pa.binary() else pa.array(np.concatenate([np.asarray(o[i], np.int64) for o in out])) for i, t in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if carry is None else pa.concat_tables([carry, table])
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                v = table.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cut = np.r_[0, np.flatnonzero(new)]
            if len(cut) > 1:
                table = table.combine_chunks()
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    out.append(fn(table.slice(a, b - a)))
                yield flush()
            carry = table.slice(cut[-1])
            if merge and carry.num_rows > HELD:
                carry = merge(carry.combine_chunks()).cast(carry.schema)
        if carry is not None:
            out.append(fn(carry.combine_chunks()))
            yield flush()

    schema = ", ".join(f"{n} {'binary' if n in binary else 'long'}" for n in names)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(streamed(run), schema)
