"""Byte-level integer and string encodings.

All integers are unsigned and at most 32 bits wide.  Readers take a buffer and
a position and return the value and the next position.
"""

from __future__ import annotations

import numpy as np

LIMIT = 1 << 32
SENTINEL = LIMIT - 1


class CorruptData(ValueError):
    """The buffer ends inside a value or holds something no writer makes."""


class ValueRange(OverflowError):
    """The buffer holds a value that does not fit 32 bits."""


def checked(value: int) -> int:
    if not 0 <= value < LIMIT:
        raise ValueRange(f"{value} is not an unsigned 32-bit integer")
    return value


def put(value: int) -> bytes:
    """Little-endian base 128; the high bit of a byte says that more follow."""
    checked(value)
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def get(buf: bytes, pos: int = 0) -> tuple[int, int]:
    value = 0
    for i in range(5):
        if pos + i >= len(buf):
            raise CorruptData("truncated integer")
        byte = buf[pos + i]
        value |= (byte & 0x7F) << (7 * i)
        if byte < 0x80:
            if value >= LIMIT:
                raise ValueRange("integer too large")
            return value, pos + i + 1
    raise ValueRange("integer of more than five bytes")


def size(value: int) -> int:
    return max(1, -(-checked(value).bit_length() // 7))


def sizes(values: np.ndarray) -> np.ndarray:
    """size of each value."""
    if len(values) and not (0 <= values.min() and values.max() < LIMIT):
        raise ValueRange("not all are unsigned 32-bit integers")
    return 1 + sum((values >= 1 << (7 * i)).astype(np.int64) for i in range(1, 5))


def puts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and how many each has."""
    size = sizes(values)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        some = size > i
        out[start[some] + i] = (values[some] >> (7 * i)) & 0x7F | np.where(size[some] > i + 1, 0x80, 0)
    return out, size


def gets(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a buffer that holds nothing else, and where each ends."""
    ends = np.flatnonzero(buf < 0x80) + 1
    if len(buf) and (not len(ends) or ends[-1] != len(buf)):
        raise CorruptData("truncated integer")
    start = np.append(0, ends[:-1]) if len(ends) else ends
    size = ends - start
    if size.max(initial=0) > 5:
        raise ValueRange("integer of more than five bytes")
    out = np.zeros(len(ends), np.int64)
    for i in range(int(size.max(initial=0))):
        some = size > i
        out[some] |= (buf[start[some] + i].astype(np.int64) & 0x7F) << (7 * i)
    if out.max(initial=0) >= LIMIT:
        raise ValueRange("integer too large")
    return out, ends


def byte_width(value: int) -> int:
    """Bytes that hold the value; 1 for 0."""
    return max(1, -(-checked(value).bit_length() // 8))


def put_fixed(value: int, width: int) -> bytes:
    return value.to_bytes(width, "little")


def get_fixed(buf: bytes, pos: int, width: int) -> tuple[int, int]:
    if pos + width > len(buf):
        raise CorruptData("truncated fixed-width integer")
    return int.from_bytes(buf[pos : pos + width], "little"), pos + width


def put_last(value: int) -> bytes:
    """As few little-endian bytes as hold the value; none for 0.  Ends the buffer."""
    return checked(value).to_bytes(-(-value.bit_length() // 8), "little")


def get_last(buf: bytes, pos: int = 0) -> int:
    if len(buf) - pos > 4:
        raise ValueRange("integer of more than four bytes")
    return int.from_bytes(buf[pos:], "little")


def put_bool(value: bool) -> bytes:
    return b"1" if value else b"0"


def get_bool(buf: bytes, pos: int = 0) -> tuple[bool, int]:
    if buf[pos : pos + 1] not in (b"0", b"1"):
        raise CorruptData("no boolean")
    return buf[pos] == 0x31, pos + 1


def put_string(value: bytes) -> bytes:
    return put(len(value)) + value


def get_string(buf: bytes, pos: int = 0) -> tuple[bytes, int]:
    n, pos = get(buf, pos)
    if pos + n > len(buf):
        raise CorruptData("truncated string")
    return buf[pos : pos + n], pos + n
