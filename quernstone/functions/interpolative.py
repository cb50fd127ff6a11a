"""Binary interpolative coding (after Moffat and Stuiver), bits from the low end."""

from __future__ import annotations

from collections.abc import Sequence

from . import varint


HELD = 512  # bits of a growing string that are not in its byte array yet


class Writer:
    def __init__(self) -> None:
        self.whole, self.value, self.count = bytearray(), 0, 0

    def put(self, value: int, outof: int) -> None:
        """Centred minimal binary: the middle values take a bit less."""
        bits = (outof - 1).bit_length()
        if not bits:
            return
        spare = (1 << bits) - outof
        mid = (outof - spare) // 2
        if mid <= value < mid + spare:
            bits -= 1
        elif value >= mid + spare:
            value = (value - mid - spare) | 1 << (bits - 1)
        self.value |= value << self.count
        self.count += bits
        if self.count > HELD:
            n = self.count // 8
            self.whole += (self.value & ((1 << (8 * n)) - 1)).to_bytes(n, "little")
            self.value, self.count = self.value >> (8 * n), self.count - 8 * n

    def bytes(self) -> bytes:
        return bytes(self.whole) + self.value.to_bytes(-(-self.count // 8), "little")


class Reader:
    def __init__(self, buf: bytes):
        self.buf, self.pos = buf, 0

    def bits(self, n: int) -> int:
        if self.pos + n > 8 * len(self.buf):
            raise varint.CorruptData("bit string ends inside a value")
        byte, bit = divmod(self.pos, 8)
        self.pos += n
        return int.from_bytes(self.buf[byte : byte + (bit + n + 7) // 8], "little") >> bit & ((1 << n) - 1)

    def get(self, outof: int) -> int:
        bits = (outof - 1).bit_length()
        if not bits:
            return 0
        spare = (1 << bits) - outof
        mid = (outof - spare) // 2
        value = self.bits(bits - 1)
        if value < mid and self.bits(1):
            value += mid + spare
        return value

    def all_gone(self) -> bool:
        left = 8 * len(self.buf) - self.pos
        return left < 8 and not self.bits(left)


def _inner(n: int):
    """(left, middle, right) of every inner entry: a middle, its left half, its right half."""
    todo = [(0, n - 1)]
    while todo:
        j, k = todo.pop()
        if k - j > 1:
            m = (j + k) // 2
            yield j, m, k
            todo += [(m, k), (j, m)]


def encode(values: Sequence[int]) -> bytes:
    """values: strictly increasing, from 1 on.  An empty list has no bytes."""
    if not values:
        return b""
    if values[0] < 1 or any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("values must increase, from 1 on")
    out = Writer()
    if len(values) > 1:
        out.put(values[0], values[-1])
        out.put(len(values) - 2, values[-1] - values[0])
        for j, m, k in _inner(len(values)):
            out.put(values[m] - values[j] - (m - j), values[k] - values[j] - (k - j) + 1)
    return varint.put(values[-1]) + out.bytes()


def decode(buf: bytes) -> list[int]:
    if not buf:
        return []
    last, pos = varint.get(buf)
    if pos == len(buf):
        return [last]
    reader = Reader(buf[pos:])
    first = reader.get(last)
    values = [0] * (reader.get(last - first) + 2)
    values[0], values[-1] = first, last
    for j, m, k in _inner(len(values)):
        values[m] = values[j] + (m - j) + reader.get(values[k] - values[j] - (k - j) + 1)
    if not reader.all_gone():
        raise varint.CorruptData("bytes after the last value")
    return values
