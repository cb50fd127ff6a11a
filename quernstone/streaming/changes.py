"""Follows a stream of changes and keeps a posting table up to date.

A change is (term, did, new_wdf, at, seq): what a posting becomes (null: it goes),
its event time, and a number that orders changes of one time.  Changes may come
late, twice and in any order, in one batch or over several: for each posting the
state keeps the (at, seq) of the last change that was passed on, and only a
later one goes through.  The state of a posting is given up when the watermark
has passed its change: whatever still comes after that is later, because rows
behind the watermark are dropped.  So the state holds the changes of the last
`delay`, not the table.  Postings are dealt out in ``BUCKETS`` by a hash, each with
one state, a table: a batch calls Python once for a bucket, not for each posting,
and writes the states that it changes.

Every micro-batch adds its changes to the table as one run, so bytes written
follow the changes.  The snapshot names the batch, and a batch that is replayed
after a failure is left out.

Document lengths are the list of the empty term, as `lengths` makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import posting_log
from ..sources.shared import shuffles_freed

CHANGES = "term string, did long, new_wdf long, at timestamp, seq long"
OUT = "term string, did long, new_wdf long"
DELAY = "1 hour"
BUCKETS = 512  # a checkpoint holds on to them
STATE = "held binary"  # term, did, micros, seq as an Arrow stream
KEY, ORDER = ["term", "did"], ["micros", "seq"]


def _packed(held: pd.DataFrame) -> bytes:
    """In order and by numbers of terms, which makes it a fraction of the rows."""
    table, sink = pa.Table.from_pandas(held.sort_values(KEY), preserve_index=False), pa.BufferOutputStream()
    table = table.set_column(0, "term", table["term"].cast(pa.string()).dictionary_encode())
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(held).read_all()
    return table.set_column(0, "term", table["term"].cast(pa.string())).to_pandas()


def last_change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Passes on the changes of a bucket's postings that are later than all before them."""
    if state.hasTimedOut:
        state.remove()
        return
    new = pd.concat([part[[*KEY, *ORDER, "new_wdf"]] for part in parts], ignore_index=True)
    # of equal order the larger value counts, and any value before none: as posting tables do
    new["new_wdf"] = new["new_wdf"].astype("Int64").fillna(-1).astype("int64")
    new = new.sort_values([*ORDER, "new_wdf"]).drop_duplicates(KEY, keep="last")
    held = None
    if state.exists:
        held = _unpacked(bytes(state.get[0]))
        both = new.merge(held, "left", KEY, suffixes=("", "_held"))
        later = both["micros_held"].isna() | (both["micros"] > both["micros_held"]) | ((both["micros"] == both["micros_held"]) & (both["seq"] > both["seq_held"]))
        new = both[later]
    kept = new[[*KEY, *ORDER]] if held is None else pd.concat([held, new[[*KEY, *ORDER]]]).drop_duplicates(KEY, keep="last")
    kept = kept[kept["micros"] // 1000 + 1 > state.getCurrentWatermarkMs()]
    if held is not None and not len(new) and len(kept) == len(held):
        pass  # it stays what it was, with its timeout, and isn't written again
    elif len(kept):
        state.update((_packed(kept),))
        state.setTimeoutTimestamp(int(kept["micros"].max()) // 1000 + 1)
    elif state.exists:
        state.remove()
    yield new[KEY].assign(new_wdf=new["new_wdf"].astype("Int64").mask(new["new_wdf"] < 0)).reset_index(drop=True)


def lengths(changes: DataFrame) -> DataFrame:
    """Changes (did, new_len, at, seq) of document lengths as changes of the empty term's list."""
    return changes.select(F.lit("").alias("term"), "did", F.col("new_len").alias("new_wdf"), "at", "seq")


def from_files(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet files of changes as they come, so many in a batch."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(folder)


def last_changes(changes: DataFrame, delay: str = DELAY) -> DataFrame:
    """term, did, new_wdf of the changes of a stream that count."""
    keyed = changes.where("term is not null and did is not null and at is not null").withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))
    keyed = keyed.withWatermark("at", delay).withColumns({"micros": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("term", "did"), F.lit(BUCKETS))})
    return keyed.groupBy("bucket").applyInPandasWithState(last_change, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start(changes: DataFrame, path: str, checkpoint: str, name: str = "changes", delay: str = DELAY, fan: int = posting_log.FAN) -> StreamingQuery:
    """Merge a stream of changes into the posting table under path, until what is there now is done."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()  # its rows are sampled and written
        try:
            posting_log.merge(batch.sparkSession, path, batch, stream=(name, number))
        finally:
            batch.unpersist()
        posting_log.compact(batch.sparkSession, path, fan)

    writer = last_changes(changes, delay).writeStream.outputMode("update").foreachBatch(apply)
    with shuffles_freed(changes.sparkSession):  # the stream's own session begins with this one's settings
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
