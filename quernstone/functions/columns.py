"""The codecs as column functions.

Fixed formulas are built-in expressions and stay inside whole-stage codegen;
list codecs and the stemmer are Arrow UDFs, meant for chunks and distinct
terms, never for single tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from . import bits, chunks, interpolative, stem, vs

WORD = "[A-Za-z]+"


def terms_of(text: Column) -> Column:
    """Lower-cased ASCII words in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


# ---- built-in expressions


def _byte(value: Column) -> Column:
    return F.format_string("%02X", value)


def varint_size(v: Column) -> Column:
    out = F.lit(1)
    for i in range(1, 5):
        out = F.when(v >= 1 << (7 * i), i + 1).otherwise(out)
    return out.cast("long")


def varint_hex(v: Column) -> Column:
    """Hexadecimal digits of the variable-byte form."""
    parts = []
    for i in range(5):
        more = F.when(v >= 1 << (7 * (i + 1)), 128).otherwise(0)
        byte = _byte(F.shiftright(v, 7 * i).bitwiseAND(F.lit(127)) + more)
        parts.append(byte if i == 0 else F.when(v >= 1 << (7 * i), byte).otherwise(""))
    return F.concat(*parts)


def sortable_hex(v: Column) -> Column:
    """Hexadecimal digits of the form whose byte order is the order of the values."""
    out = F.format_string("%010X", v + (3 << 38))
    for more in (3, 2, 1):
        out = F.when(v < 1 << (6 + 8 * more), F.format_string(f"%0{2 * more + 2}X", v + ((more - 1) << (6 + 8 * more)))).otherwise(out)
    return out


def posting_key_hex(term: Column, first_did: Column) -> Column:
    """Key of a chunk of a term without NUL; null first_did is the list's first chunk."""
    name = F.hex(F.encode(term, "UTF-8"))
    return F.when(first_did.isNull(), F.when(term == "", "00E0").otherwise(name)).otherwise(F.concat(F.when(term == "", "00E0").otherwise(F.concat(name, F.lit("00"))), sortable_hex(first_did)))


def byte_width(v: Column) -> Column:
    return F.when(v < 1 << 8, 1).when(v < 1 << 16, 2).when(v < 1 << 24, 3).otherwise(4).cast("long")


def bit_width(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v))).cast("long")


def log2_up(v: Column) -> Column:
    """Ceiling of the binary logarithm; powers of two from 256 count one more (as the partitioner does)."""
    power = (v >= 256) & (v.bitwiseAND(v - 1) == 0)
    return F.when(v <= 1, 0).otherwise(bit_width(v - 1) + power.cast("long")).cast("long")


def unary_bits(v: Column) -> Column:
    return F.concat(F.repeat(F.lit("1"), (v - 1).cast("int")), F.lit("0"))


def gamma_bits(v: Column) -> Column:
    return F.concat(unary_bits(F.length(F.bin(v))), F.substring(F.bin(v), 2, 64))


def fixed_bits(v: Column, width: int) -> Column:
    return F.lpad(F.bin(v), width, "0")


def skip_levels(n: Column) -> Column:
    return F.when(n > 0, (F.log10(n) / 0.6).cast("int")).otherwise(0).cast("long")


def describe(term: Column, termfreq: Column) -> Column:
    return F.concat(term, F.lit(":"), termfreq.cast("string"))


def acceptable(word: Column) -> Column:
    """Whether the stemmer takes the word."""
    return (F.length(word) > 3) | word.rlike("^[aeiouy][b-df-hj-np-tv-xz]") | word.rlike("^[^aeiouy][aeiouy].$")


# ---- value codes as bytes


def _at(b: Column, i: int | Column) -> Column:
    """Value of the byte at a position from 1; null behind the end."""
    one = F.substring(b, F.lit(i) if isinstance(i, int) else i, F.lit(1))
    return F.when(F.octet_length(one) == 1, F.conv(F.hex(one), 16, 10).cast("long"))


def _corrupt(what: str) -> Column:
    return F.raise_error(F.lit(what))


def varint_put(v: Column) -> Column:
    return F.unhex(varint_hex(v))


def _varint_bytes(b: Column) -> Column:
    """Bytes of the variable-byte integer that b begins with; an error if it doesn't end."""
    out = _corrupt("truncated integer").cast("int")
    for i in range(5, 0, -1):
        out = F.when(_at(b, i) < 128, i).otherwise(out)
    return out


def varint_get(b: Column) -> Column:
    n, value = _varint_bytes(b), F.lit(0).cast("long")
    for i in range(5):
        value = value + F.when(n > i, F.shiftleft(_at(b, i + 1).bitwiseAND(F.lit(127)), 7 * i)).otherwise(0)
    return value


def _little(v: Column, width: int) -> list[Column]:
    return [_byte(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))) for i in range(width)]


def fixed_put(v: Column, width: int) -> Column:
    """Little-endian bytes."""
    return F.unhex(F.concat(*_little(v, width)))


def _from_little(b: Column, width: int) -> Column:
    return sum((F.shiftleft(F.coalesce(_at(b, i + 1), F.lit(0).cast("long")), 8 * i) for i in range(width)), F.lit(0).cast("long"))


def fixed_get(b: Column, width: int) -> Column:
    return F.when(F.octet_length(b) < width, _corrupt("truncated fixed-width integer").cast("long")).otherwise(_from_little(b, width))


def last_put(v: Column) -> Column:
    """As few little-endian bytes as hold the value; none for 0."""
    return F.unhex(F.concat(*(F.when(v >= 1 << (8 * i), x).otherwise("") if i else F.when(v > 0, x).otherwise("") for i, x in enumerate(_little(v, 4)))))


def last_get(b: Column) -> Column:
    return F.when(F.octet_length(b) > 4, _corrupt("integer of more than four bytes").cast("long")).otherwise(_from_little(b, 4))


def bool_put(v: Column) -> Column:
    return F.encode(F.when(v, "1").otherwise("0"), "UTF-8")


def bool_get(b: Column) -> Column:
    return F.when(F.hex(b) == "31", True).when(F.hex(b) == "30", False).otherwise(_corrupt("no boolean").cast("boolean"))


def string_put(s: Column) -> Column:
    return F.concat(varint_put(F.octet_length(s).cast("long")), F.encode(s, "UTF-8"))


def string_get(b: Column) -> Column:
    rest = F.substring(b, _varint_bytes(b) + 1, varint_get(b).cast("int"))
    return F.when(F.octet_length(rest) < varint_get(b), _corrupt("truncated string")).otherwise(F.decode(rest, "UTF-8"))


def sortable_put(v: Column) -> Column:
    return F.unhex(sortable_hex(v))


def sortable_get(b: Column) -> Column:
    more = F.floor(_at(b, 1) / 64) + 2  # bytes
    value = F.lit(0).cast("long")
    for i in range(5):
        byte = _at(b, i + 1)
        value = F.when(more > i, value * 256 + (byte % 64 if i == 0 else byte)).otherwise(value)
    return F.when(F.octet_length(b) < more, _corrupt("truncated key").cast("long")).otherwise(value)


def sortable_string_put(s: Column) -> Column:
    """Bytes with 00 written as 00FF, ended by 00; pairs of digits are kept together by \\G."""
    return F.unhex(F.concat(F.regexp_replace(F.hex(F.encode(s, "UTF-8")), r"\G((?:(?!00)..)*+)00", "$100FF"), F.lit("00")))


def sortable_string_get(b: Column) -> Column:
    """The string before the first 00 that no FF follows."""
    body = F.regexp_extract(F.hex(b), r"^((?:(?!00)..|00FF)*+)", 1)
    return F.decode(F.unhex(F.regexp_replace(body, r"\G((?:(?!00)..)*+)00FF", "$100")), "UTF-8")


# ---- Arrow UDFs


def _map(kind: pa.DataType, fn):
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    return run


def _udf(kind: pa.DataType, fn):
    """fn over the values of one to three columns, a batch at a time."""
    spark_type = from_arrow_type(kind)
    run = _map(kind, fn)
    count = fn.__code__.co_argcount
    if count == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        return arrow_udf(one, spark_type)
    if count == 2:

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        return arrow_udf(two, spark_type)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return arrow_udf(three, spark_type)


INTS, BYTES = pa.list_(pa.int64()), pa.binary()
PAIRS = pa.list_(pa.struct([("did", pa.int64()), ("val", pa.int64())]))


def pairs_of(lists: pa.Array):
    """Lists of (did, value) pairs one at a time, without an object for every struct of a batch."""
    flat, ends = lists.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    did, value = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for a, b, there in zip([0, *ends[:-1].tolist()], ends.tolist(), lists.is_valid().to_pylist()):
        yield list(zip(did[a:b].tolist(), value[a:b].tolist())) if there else None


def lists_of(every) -> pa.Array:
    """Lists of pairs as an array; each is packed as it comes."""
    some = [None if p is None else np.array(p, np.int64).reshape(-1, 2) for p in every]
    flat = np.concatenate([p for p in some if p is not None] or [np.empty((0, 2), np.int64)])
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in some)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in (0, 1)], ["did", "val"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs, mask=pa.array([p is None for p in some]))


def _encoder(fn):
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if p is None else fn(p) for p in pairs_of(a)], BYTES)

    return arrow_udf(run, from_arrow_type(BYTES))


def _decoder(fn):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return lists_of(None if body.as_py() is None else fn(body.as_py(), first) for body, first in zip(a, b.to_pylist()))

    return arrow_udf(run, from_arrow_type(PAIRS))


vs_encode = _udf(BYTES, lambda v: vs.encode(v))
vs_encode_optimal = _udf(BYTES, lambda v: vs.encode(v, optimal=True))
vs_decode = _udf(INTS, lambda b: vs.decode(b))
vs_cuts = _udf(INTS, lambda v: vs.greedy_cuts(vs.gaps(v)))
vs_optimal_bits = _udf(pa.int64(), lambda v: vs.optimal_bits(vs.gaps(v)))
vs_greedy_bits = _udf(pa.int64(), lambda v: vs.greedy_bits(vs.gaps(v)))
interp_encode = _udf(BYTES, lambda v: interpolative.encode(v))
interp_decode = _udf(INTS, lambda b: interpolative.decode(b))
lengths_encode = _encoder(chunks.encode_lengths)
lengths_decode = _decoder(chunks.decode_lengths)
lengths_find = _udf(pa.int64(), lambda b, first, did: chunks.find_length(b, first, did))
postings_encode = _encoder(chunks.encode_postings)
postings_decode = _decoder(chunks.decode_postings)
skips_encode = _encoder(chunks.encode_skips)
skips_decode = _decoder(chunks.decode_skips)
skips_find = _udf(pa.int64(), lambda b, first, did: chunks.skip_find(b, first, did))
stem_word = _udf(pa.string(), lambda w: stem.stem(w))
gamma_read = _udf(pa.int64(), lambda s: bits.BitReader(s).gamma())


def minimal_round_trip(value: int, outof: int) -> int:
    out = interpolative.Writer()
    out.put(value, outof)
    return interpolative.Reader(out.bytes()).get(outof)


minimal_binary = _udf(pa.int64(), lambda v, n: minimal_round_trip(v, n))
