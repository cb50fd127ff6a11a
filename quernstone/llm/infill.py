"""Fill-in-the-middle: cut texts at drawn units and put the middle last.

A unit is a word ``[A-Za-z]+`` or one other code point.  Counting units goes
over the bytes of a text in blocks of bounded size and keeps a sparse index: the
byte and the code-point offset of every ``EVERY``-th unit.  A cut at unit u is
found by binary search of the checkpoint at or before u and a rescan of at most
``EVERY`` units from there.  Only text goes to the worker and only numbers come
back; outputs are put together, and taken apart again by ``restored``, from byte
slices by built-in functions.

Draws are the first 8-digit groups of the hex sha256 of ``SEED:doc_id``: two
cuts modulo n + 1, the share that is cut at all, the share with the suffix first.

Defined cases: a null text is empty; an empty text, or one that holds a mark, is
left plain; a null doc_id draws from ``SEED:`` alone; repeated rows are documents
of their own; a text without letters has one unit a code point; cuts may
fall together, so any of the three parts may be empty; an empty table gives an
empty result; other columns of any name are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded_batches

SEED = 1
RATE = 90  # of 100 texts are cut
SUFFIX_FIRST = 20  # of 100 texts that are cut
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
EVERY = 256
BLOCK = 1 << 20

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_first = np.ones(256, bool)  # of the bytes of a code point
_first[0x80:0xC0] = False


class UnitIndex:
    """Number of units of UTF-8 bytes, and offsets of every EVERY-th of them."""

    def __init__(self, data: np.ndarray, every: int = EVERY, block: int = BLOCK) -> None:
        self.data, self.every = data, every
        units, chars, marks = 0, 0, []
        for at in range(0, len(data), block):
            begins, first = self._begins(at, min(at + block, len(data)))
            where = np.flatnonzero(begins)
            some = where[-units % every :: every]
            marks.append(np.stack([at + some, chars + np.cumsum(first)[some] - 1]))
            units, chars = units + len(where), chars + int(first.sum())
        self.units, self.chars = units, chars
        self.bytes_at, self.chars_at = np.concatenate(marks, axis=1) if marks else np.zeros((2, 0), np.int64)
        self.unit_at = np.arange(len(self.bytes_at)) * every

    def _begins(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a unit, and which a code point."""
        part = self.data[start:stop]
        letter, first = _letter[part], _first[part]
        after = np.empty(len(part), bool)  # a letter
        after[1:] = letter[:-1]
        after[:1] = start > 0 and _letter[self.data[start - 1]]
        return first & ~(letter & after), first

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which this unit begins, or the end."""
        if unit >= self.units:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.unit_at, unit, "right")) - 1
        start, char, left = int(self.bytes_at[k]), int(self.chars_at[k]), unit - int(self.unit_at[k])
        size = 16 * (left + 1)
        while True:  # a word may be long: look twice as far until the unit is there
            begins, first = self._begins(start, min(start + size, len(self.data)))
            where = np.flatnonzero(begins)
            if left < len(where):
                at = int(where[left])
                return start + at, char + int(first[:at].sum())
            size *= 2


CUTS = pa.struct([(name, pa.int64()) for name in ("n", "b1", "b2", "c1", "c2")])


def _cuts(text: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    out = np.empty((5, len(text)), np.int64)
    text = text.cast(pa.large_binary())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    draws = zip(low.to_numpy(zero_copy_only=False), high.to_numpy(zero_copy_only=False))
    for i, (one, other) in enumerate(draws):
        index = UnitIndex(data[at[i] : at[i + 1]])
        n = index.units
        one, other = sorted((int(one) % (n + 1), int(other) % (n + 1)))
        (b1, c1), (b2, c2) = index.cut(one), index.cut(other)
        out[:, i] = n, b1, b2, c1, c2
    return pa.StructArray.from_arrays([pa.array(x) for x in out], fields=list(CUTS))


def _slice(data: str, start: str, stop: str | None = None) -> Column:
    """Text of bytes start to stop of a binary column."""
    size = f"int({stop} - {start})" if stop else f"int(length({data}) - {start})"
    return F.expr(f"string(substring({data}, int({start}) + 1, {size}))")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output; one row for each document.

    The lengths are code points, null where form is plain.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("digest", digest)
    draw = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    cuts = F.arrow_udf(_cuts, "n long, b1 long, b2 long, c1 long, c2 long")
    rows = rows.select("doc_id", "text", cuts("text", draw[0], draw[1]).alias("cut"), draw[2].alias("h3"), draw[3].alias("h4"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", F.col("text").cast("binary").alias("data"), "cut.*", form.alias("form"))
    prefix, middle, suffix = _slice("data", "0", "b1"), _slice("data", "b1", "b2"), _slice("data", "b2")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("c1")).alias("prefix_chars"), F.when(cut, F.expr("c2 - c1")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text of an output: the marks, each of which is there once, say where its parts are."""
    def whole(first: Column) -> Column:  # without the mark that it begins with
        return F.substring(first, len(PREFIX) + 1, 2**31 - 1)

    rest, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(whole(F.substring_index(rest, SUFFIX, 1)), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, whole(F.substring_index(rest, PREFIX, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_query(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = fill_in_middle(docs)
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), restored(F.col("form"), F.col("output")))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))
