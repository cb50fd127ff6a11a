"""Bit strings, most significant bit first, and the codes written in them.

A growing string keeps its whole bytes in a byte array and the rest, at most
``HELD`` bits and a value, in a number, so that a value costs its own bits.
"""

from __future__ import annotations

from .varint import CorruptData

HELD = 512


class Bits:
    def __init__(self) -> None:
        self.whole, self.value, self.held = bytearray(), 0, 0

    @property
    def count(self) -> int:
        return 8 * len(self.whole) + self.held

    def fixed(self, value: int, width: int) -> Bits:
        if value >> width:
            raise ValueError(f"{value} needs more than {width} bits")
        self.value, self.held = self.value << width | value, self.held + width
        if self.held > HELD:
            self.settle()
        return self

    def settle(self) -> None:
        """Move whole bytes to the byte array."""
        tail = self.held % 8
        self.whole += (self.value >> tail).to_bytes(self.held // 8, "big")
        self.value, self.held = self.value & ((1 << tail) - 1), tail

    def unary(self, n: int) -> Bits:
        """n - 1 ones and a zero."""
        return self.fixed((1 << n) - 2, n)

    def gamma(self, n: int) -> Bits:
        """The length of n in unary, then n without its leading one."""
        width = n.bit_length()
        return self.unary(width).fixed(n - (1 << (width - 1)), width - 1)

    def __str__(self) -> str:
        return "".join(f"{b:08b}" for b in self.whole) + (format(self.value, f"0{self.held}b") if self.held else "")


class BitReader:
    def __init__(self, bits: str):
        self.bits, self.pos = bits, 0

    def fixed(self, width: int) -> int:
        if self.pos + width > len(self.bits):
            raise CorruptData("bit string ends inside a value")
        self.pos += width
        return int(self.bits[self.pos - width : self.pos] or "0", 2)

    def unary(self) -> int:
        end = self.bits.find("0", self.pos)
        if end < 0:
            raise CorruptData("unary value without an end")
        n = end - self.pos + 1
        self.pos = end + 1
        return n

    def gamma(self) -> int:
        width = self.unary()
        return 1 << (width - 1) | self.fixed(width - 1)


def unary_length(n: int) -> int:
    return n


def gamma_length(n: int) -> int:
    return 2 * n.bit_length() - 1
