"""List operators that SQL can call as table functions.

    SELECT * FROM list_runs(TABLE(postings) PARTITION BY pmod(hash(term), 8192) ORDER BY (term, did))

``register`` makes them known to a session.  A call of the function goes through
many lists, a batch of rows at a time, and holds no more than a batch and the run
that is open; with PARTITION BY term every list is a call, which gives the same
rows and takes longer where most lists are short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

BUCKETS = 8192  # of lists; each is a call
NONE = -(1 << 62)  # a did that is null


def _changes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; null is a value."""
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


@arrow_udtf(returnType="term string, first_did bigint, n bigint")
class ListRuns:
    """Runs of consecutive dids of lists (term, did) in order of term and did; a did may repeat."""

    def __init__(self) -> None:
        self.term, self.first, self.last = None, None, None  # the open run: a term as an array of one

    def _runs(self, term: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([term, pa.array(first, mask=first == NONE), pa.array(last - first + 1)], ["term", "first_did", "n"])

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        term, did = rows.column("term"), pc.fill_null(rows.column("did"), NONE).to_numpy(zero_copy_only=False)
        new = np.ones(len(did), bool)
        new[1:] = (did[1:] > did[:-1] + 1) | _changes(term[1:], term[:-1])
        if self.term is not None:
            new[0] = did[0] > self.last + 1 or _changes(term[:1], self.term)[0]
        start = np.flatnonzero(new)
        first, last, terms = did[start], did[np.append(start[1:], len(did)) - 1], term.take(pa.array(start))
        if self.term is not None:  # the open run goes before the ones that begin here
            reached = self.last if new[0] else did[start[0] - 1] if len(start) else did[-1]
            first, last = np.r_[self.first, first], np.r_[reached, last]
            terms = pa.concat_arrays([self.term, terms])
        self.term, self.first, self.last = terms[-1:], first[-1], last[-1]
        if len(first) > 1:
            yield self._runs(terms[:-1], first[:-1], last[:-1])

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.term is not None:
            yield self._runs(self.term, np.array([self.first]), np.array([self.last]))


def register(spark: SparkSession) -> None:
    spark.udtf.register("list_runs", ListRuns)
