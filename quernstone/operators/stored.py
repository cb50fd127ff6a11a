"""Chunks as they are stored: a header and a body in one binary, with the codec's name beside it.

The first chunk of a list begins with the list's header (entries, collection
frequency, first did), every chunk with its own (whether it is the last, and
how far its last did is from its first); the body follows.  The codec is a
column, so lists of any codecs lie in one table and are read back by it.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import columns
from ..functions.varint import LIMIT
from . import chunking

# fixed values: names of the codecs of chunk bodies
CODECS = {"postings": (C.encode_postings, C.decode_postings), "lengths": (C.encode_lengths, C.decode_lengths), "skiplist": (C.encode_skips, C.decode_skips)}
STORED = "term string, chunk_no long, first_did long, last_did long, is_first boolean, is_last boolean, n_entries long, codec string, chunk binary"
ROWS = "term string, did long, wdf long"
SLICE = 256  # chunks that are held as Python objects at a time


def stored(rows: DataFrame, codec: str) -> DataFrame:
    """Stored chunks of rows(term, did, wdf, chunk_no) that a split has numbered."""
    encode = CODECS[codec][0]
    pairs = F.sort_array(F.collect_list(F.struct("did", "wdf"))).alias("pairs")  # a chunk is bounded by its split

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch, out = whole.slice(at, SLICE), []
                for p in columns.pairs_of(batch.column("pairs")):
                    out.append((p[0][0], p[-1][0], len(p), sum(w for _, w in p), encode(p)))
                yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("chunk_no"), *(pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.binary()]))], names)

    schema = "term string, chunk_no long, first_did long, last_did long, n_entries long, _wdf long, body binary"
    names = [x.split()[0] for x in schema.split(", ")]
    bodies = rows.groupBy("term", "chunk_no").agg(pairs).mapInArrow(run, schema)
    # headers need the list's totals and its ends: of chunks, not of entries
    every, order = Window.partitionBy("term"), Window.partitionBy("term").orderBy("chunk_no")
    known = bodies.withColumns({"entries": F.sum("n_entries").over(every), "collfreq": F.sum("_wdf").over(every), "is_first": F.lag("chunk_no").over(order).isNull(), "is_last": F.lead("chunk_no").over(order).isNull()})
    too_much = F.raise_error(F.concat("collfreq", F.lit(" is not an unsigned 32-bit integer"))).cast("long")
    total = F.when(F.col("collfreq") >= LIMIT, too_much).otherwise(F.col("collfreq"))
    first = F.concat(columns.varint_put(F.col("entries")), columns.varint_put(total), columns.varint_put(F.col("first_did") - 1))
    own = F.concat(columns.bool_put(F.col("is_last")), columns.varint_put(F.col("last_did") - F.col("first_did")))
    chunk = F.concat(F.when(F.col("is_first"), first).otherwise(F.unhex(F.lit(""))), own, "body").alias("chunk")
    return known.select("term", "chunk_no", "first_did", "last_did", "is_first", "is_last", "n_entries", F.lit(codec).alias("codec"), chunk)


def stored_postings(postings: DataFrame, most: int = chunking.BYTES, codec: str = "postings") -> DataFrame:
    """Chunks of posting lists, split by bytes."""
    return stored(chunking.posting_chunk_rows(postings, most), codec)


def stored_doclens(doclens: DataFrame, entries: int = chunking.ENTRIES, codec: str = "lengths") -> DataFrame:
    """Chunks of the document-length list (the list of the empty term), split by entries."""
    rows = chunking.doclen_chunk_rows(doclens, entries)
    return stored(rows.select(F.lit("").alias("term"), "did", F.col("len").alias("wdf"), "chunk_no"), codec)


def entries_of(chunks: DataFrame) -> DataFrame:
    """term, did, wdf of stored chunks of any codecs; headers must agree with bodies, else CorruptData."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                term, pairs = [], []
                for r in whole.slice(at, SLICE).to_pylist():
                    buf, first = r["chunk"], r["first_did"]
                    if r["is_first"]:
                        _, _, first, pos = C.read_first_header(buf)
                        buf = buf[pos:]
                    _, last, pos = C.read_chunk_header(buf, 0, first)
                    found = CODECS[r["codec"]][1](buf[pos:], first)
                    if not found or found[0][0] != first or found[-1][0] != last:
                        raise C.CorruptData(f"chunk {r['chunk_no']} of {r['term']!r} does not end where its header says")
                    term.append(r["term"])
                    pairs.append(found)
                lists = columns.lists_of(pairs)
                names = pa.array(term, pa.string()).take(pc.list_parent_indices(lists))
                yield pa.RecordBatch.from_arrays([names, *lists.flatten().flatten()], ["term", "did", "wdf"])

    return chunks.mapInArrow(run, ROWS)


def list_headers(chunks: DataFrame) -> DataFrame:
    """term, entries, collfreq, first_did from the first chunks' headers, without decoding a body."""

    def run(batches):
        for batch in batches:
            got = [C.read_first_header(x)[:3] for x in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("term"), *(pa.array([g[i] for g in got], pa.int64()) for i in range(3))], ["term", "entries", "collfreq", "first_did"])

    return chunks.where("is_first").select("term", "chunk").mapInArrow(run, "term string, entries long, collfreq long, first_did long")
