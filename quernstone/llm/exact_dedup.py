"""Exact dedup by two-pass Bloom filtering (native DataFrame functions only).

Pass one hashes every text, sets two slots of a blocked Bloom filter for it and
counts the hits of each slot (two numbers a text are shuffled, no text).  Slots
that were hit at least twice form the "repeated" filter, one 4 KB bitmap per
block.  Pass two looks every row up in those bitmaps: a row of which some slot
was hit once is unique for certain and passes straight through; only the other
rows are shuffled and grouped exactly by the SHA-256 of the text.

The filter has ``BITS_PER_TEXT`` bits for each text at any size.  Up to
``MAX_BLOCKS`` blocks (16 MB, 16 million texts) it is broadcast; a larger one is
joined by a shuffle: ``exact_dedup`` then moves hashes and no text, ``keep_last``
moves its rows once, by their hash.

Defined cases: a null text counts as the empty text; a null ``doc_id`` is kept
only when no other row has that text with a doc_id; repeated rows with one
``doc_id`` count towards ``group_size`` and share their decision (``keep_last``
keeps one of them, the first by its other columns); an empty table gives an
empty result; ``exact_dedup`` ignores columns other than ``doc_id`` and
``text``, ``keep_last`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

BLOCK_BITS = 32768  # what bitmap_construct_agg makes
MAX_BLOCKS = 4096  # 16 MB
BITS_PER_TEXT = 8
SALTS = 16


def _slots(h):
    """Two slots inside the block, from other bits of the hash than the block."""
    return F.array(
        F.pmod(F.shiftright(h, 20), F.lit(BLOCK_BITS)),
        F.pmod(F.shiftright(h, 40), F.lit(BLOCK_BITS)),
    )


def _bit(bitmap, slot):
    byte = F.conv(F.hex(F.substring(bitmap, (slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def repeated_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bitmap) of the slots that were hit at least twice by column h."""
    return (
        hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(_slots(F.col("h"))).alias("slot"))
        .groupBy("block", "slot")
        .agg(F.count("*").alias("hits"))
        .where("hits > 1")
        .groupBy("block")
        .agg(F.bitmap_construct_agg("slot").alias("bitmap"))
    )


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def _filter(docs: DataFrame) -> tuple[DataFrame, int]:
    """The repeated filter of all texts, and its number of blocks."""
    hashes = docs.select(F.xxhash64(_text()).alias("h"))
    blocks = hashes.count() * BITS_PER_TEXT // BLOCK_BITS + 1
    return repeated_filter(hashes, blocks), blocks


def _looked_up(rows: DataFrame, filt: DataFrame, blocks: int, max_blocks: int) -> DataFrame:
    """rows (one column h among them) with the column repeated in place of h."""
    keyed = rows.withColumn("block", F.pmod("h", F.lit(blocks)))
    found = keyed.join(F.broadcast(filt) if blocks <= max_blocks else filt, "block", "left")
    slots = _slots(F.col("h"))
    return found.withColumn("repeated", F.coalesce(_bit(F.col("bitmap"), slots[0]) & _bit(F.col("bitmap"), slots[1]), F.lit(False))).drop("block", "bitmap", "h")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_dedup(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; the largest doc_id of equal texts stays."""
    filt, blocks = _filter(docs)
    rows = docs.select("doc_id", F.sha2(_text(), 256).alias("text_sha256"), F.xxhash64(_text()).alias("h"))
    flagged = cut(_looked_up(rows, filt, blocks, max_blocks))
    unique = flagged.where("not repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = flagged.where("repeated").select("doc_id", "text_sha256", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    # every group meets its rows in SALTS parts, so that no group needs one task
    groups = _groups(maybe).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    exact = maybe.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )
    return unique.unionByName(exact)


def keep_last(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows that stay, with all their columns; one of rows that repeat a doc_id and text.

    Rows that are unique for certain are not shuffled.  Of the others the groups
    are found by (SHA-256, doc_id) alone, and rows meet what stays by both.
    """
    filt, blocks = _filter(docs)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(_text()).alias("h"), F.sha2(_text(), 256).alias("text_sha256"))
    if blocks > max_blocks:  # rows are looked up by their hashes alone, in keys of rows
        known = _looked_up(whole.select("h").distinct().select("h", F.col("h").alias("key")), filt, blocks, max_blocks).where("repeated")
        whole = whole.join(known.select(F.col("key").alias("h"), "repeated"), "h", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))).drop("h")
    else:
        whole = _looked_up(whole, filt, blocks, max_blocks)
    back = [F.col("row").getField(c).alias(c) for c in docs.columns]
    straight = whole.where("not repeated").select(*back)
    maybe = whole.where("repeated")
    groups = _groups(maybe.select("doc_id", "text_sha256")).select(F.col("text_sha256").alias("s"), "keep_id")
    stay = maybe.join(groups, (F.col("text_sha256") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # rows of one doc_id and text become one before the shuffle, the first by their other columns as text
    plain = [F.col("row").getField(c).cast("string") for c in docs.columns if c != "text"]
    one = stay.groupBy("text_sha256", "doc_id").agg(F.min_by("row", F.struct(*plain)).alias("row"))
    return straight.unionByName(one.select(*back))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
