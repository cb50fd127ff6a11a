"""Partitioned variable-width coding of increasing lists (after VSEncoding)."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from . import varint
from .bits import BitReader, Bits, gamma_length

RATIO = 0.3
MAX_PART = 64
HEADS = [gamma_length(w + 1) for w in range(65)]  # bits of the width of a part


def log2_up(value: int, exact: bool = False) -> int:
    """Ceiling of the binary logarithm; powers of two from 256 count one more unless exact."""
    if value <= 0:
        return 0
    up = (value - 1).bit_length()
    return up + (not exact and value >= 256 and value & (value - 1) == 0)


def gaps(values: Sequence[int], wrap: bool = False) -> list[int]:
    out = [b - a for a, b in zip([0, *values], values, strict=False)]
    if wrap:
        return [g % varint.LIMIT for g in out]
    if any(g <= 0 for g in out[1:]) or values and values[0] < 0:
        raise ValueError("values must increase")
    return out


def greedy_cuts(gap: Sequence[int], exact: bool = False) -> list[int]:
    """Start of every partition and the end: cut where too few of the bits would be used."""
    cuts, top, good, n = [0], 0, 0, 0
    for i, g in enumerate(gap):
        width = log2_up(g, exact)
        top, good, n = max(top, width), good + width, n + 1
        if n > 1 and top * n and good / (top * n) < RATIO:
            cuts.append(i)
            top, good, n = width, width, 1
    return [*cuts, len(gap)] if gap else [0]


def part_bits(gap: Sequence[int]) -> int:
    width = max(g.bit_length() for g in gap)
    return gamma_length(width + 1) + len(gap) + width * len(gap)


def optimal_cuts(gap: Sequence[int], most: int = MAX_PART) -> list[int]:
    """Cuts of least total bits with partitions of at most `most` gaps."""
    best, origin = [0], [0]
    for end in range(1, len(gap) + 1):
        width, choice = 0, None
        for begin in range(end - 1, max(-1, end - most - 1), -1):
            width = max(width, gap[begin].bit_length())
            n = end - begin
            cost = best[begin] + gamma_length(width + 1) + n + width * n
            if choice is None or cost < choice[0]:
                choice = (cost, begin)
        best.append(choice[0])
        origin.append(choice[1])
    cuts, at = [], len(gap)
    while at:
        cuts.append(at)
        at = origin[at]
    return [0, *reversed(cuts)]


def optimal_bits(gap: Sequence[int], most: int = MAX_PART) -> int:
    """Bits of the optimal cuts, in time linear in the list.

    What a part costs that begins at j and ends here is known from its largest width. Beginnings of one largest width
    are a stair; of a stair only those are held that no later one is as cheap as, so its first is its cheapest. A
    beginning that is dominated stays so when its stair is taken into a wider one.
    """
    stairs: list[list] = []  # from wide to narrow: width, cost of the first without its length, beginnings (j, cost without length and head)
    best = 0
    for i, g in enumerate(gap):
        w = g.bit_length()
        key = best - (w + 1) * i
        if not stairs or stairs[-1][0] > w:
            stairs.append([w, HEADS[w] + key, deque([(i, key)])])
        else:
            at = len(stairs)
            while at and stairs[at - 1][0] < w:
                at -= 1
            narrow = stairs[at:]
            if at and stairs[at - 1][0] == w:
                del stairs[at:]
            else:
                stairs[at:] = [[w, 0, deque()]]
            held = stairs[-1][2]
            for v, _, some in narrow:
                for j, cost in some:
                    cost -= (w - v) * j
                    while held and held[-1][1] >= cost:
                        held.pop()
                    held.append((j, cost))
            while held and held[-1][1] >= key:
                held.pop()
            held.append((i, key))
            stairs[-1][1] = HEADS[w] + held[0][1]
        widest, _, held = stairs[0]
        if held[0][0] == i - most:  # the part would be too long
            held.popleft()
            if held:
                stairs[0][1] = HEADS[widest] + held[0][1]
            else:
                del stairs[0]
        best = min([cost + (v + 1) * (i + 1) for v, cost, _ in stairs])
    return best


def greedy_bits(gap: Sequence[int], exact: bool = False) -> int:
    """Bits of the greedy cuts."""
    bits, top, good, n, wide = 0, 0, 0, 0, 0
    up = [log2_up(1 << k >> 1, exact) for k in range(66)]  # of powers of two, by their bits
    for g in gap:
        w = g.bit_length()
        used = up[w] if g & (g - 1) == 0 else w
        top, good, n = max(top, used), good + used, n + 1
        if n > 1 and good * 10 < 3 * top * n:
            bits += HEADS[wide] + (wide + 1) * (n - 1)
            top, good, n, wide = used, used, 1, w
        elif w > wide:
            wide = w
    return bits + HEADS[wide] + (wide + 1) * n if n else 0


def encode(values: Sequence[int], optimal: bool = False, wrap: bool = False, exact: bool = False) -> bytes:
    gap = gaps(values, wrap)
    cuts = optimal_cuts(gap) if optimal else greedy_cuts(gap, exact)
    bits = Bits()
    for a, b in zip(cuts, cuts[1:], strict=False):
        width = max(g.bit_length() for g in gap[a:b])
        bits.gamma(width + 1).unary(b - a)
        for g in gap[a:b]:
            bits.fixed(g, width)
    bits.settle()
    return bytes([bits.value, bits.held]) + varint.put(len(values)) + varint.put(values[-1] if values else 0) + bytes(bits.whole)


def header(buf: bytes) -> tuple[int, int]:
    """(number of entries, last value) without decoding the list."""
    n, pos = varint.get(buf, 2)
    return n, varint.get(buf, pos)[0]


def decode(buf: bytes) -> list[int]:
    if len(buf) < 4:
        raise varint.CorruptData("truncated list")
    n, pos = varint.get(buf, 2)
    _, pos = varint.get(buf, pos)
    body = buf[pos:]
    text = "".join(f"{b:08b}" for b in body) + (format(buf[0], f"0{buf[1]}b") if buf[1] else "")
    reader, out, value = BitReader(text), [], 0
    while len(out) < n:
        width = reader.gamma() - 1
        for _ in range(reader.unary()):
            value = (value + reader.fixed(width)) % varint.LIMIT
            out.append(value)
    return out
