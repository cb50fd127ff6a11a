"""Bodies and headers of posting and document-length chunks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import log10

import numpy as np

from . import varint
from .varint import SENTINEL, CorruptData, byte_width

Pairs = Sequence[tuple[int, int]]
MIN_BLOCK = 6  # consecutive dids that make a block
GOOD_TENTHS = 8  # a block goes on while 8/10 of its bytes are used


# ---- headers


def chunk_header(first: int, last: int, is_last: bool) -> bytes:
    return varint.put_bool(is_last) + varint.put(last - first)


def first_header(entries: int, collfreq: int, first: int) -> bytes:
    return varint.put(entries) + varint.put(collfreq) + varint.put(first - 1)


def read_chunk_header(buf: bytes, pos: int, first: int) -> tuple[bool, int, int]:
    """is_last, last did, next position."""
    is_last, pos = varint.get_bool(buf, pos)
    span, pos = varint.get(buf, pos)
    return is_last, first + span, pos


def read_first_header(buf: bytes) -> tuple[int, int, int, int]:
    """entries, collection frequency, first did, next position."""
    entries, pos = varint.get(buf)
    collfreq, pos = varint.get(buf, pos)
    first, pos = varint.get(buf, pos)
    return entries, collfreq, first + 1, pos


# ---- term postings


def encode_postings(pairs: Pairs) -> bytes:
    if not len(pairs):
        return b""
    both = np.array(pairs, np.int64)
    gap = np.diff(both[:, 0])
    if (gap <= 0).any():
        raise ValueError("dids must increase")
    both[1:, 0] = gap - 1
    return varint.puts(both.ravel()[1:])[0].tobytes()


def decode_postings(body: bytes, first: int) -> list[tuple[int, int]]:
    value, _ = varint.gets(np.frombuffer(body, np.uint8))
    if not len(value):
        return []
    if len(value) % 2 == 0:
        raise CorruptData("truncated integer")
    did = first + np.append(0, np.cumsum(value[1::2] + 1))
    return list(zip(did.tolist(), value[::2].tolist(), strict=True))


# ---- document lengths in fixed-width blocks


class Segmenter:
    """Greedy runs of consecutive dids whose lengths fit the width of the first one."""

    def __init__(self) -> None:
        self.last, self.width, self.used, self.good = None, 0, 0, 0

    def opens(self, did: int, length: int) -> bool:
        """Take the next entry; whether it begins a new run."""
        w = byte_width(length)
        used, good = self.used + self.width, self.good + w
        if self.last is not None and did == self.last + 1 and w <= self.width and good * 10 >= used * GOOD_TENTHS:
            self.last, self.used, self.good = did, used, good
            return False
        self.last, self.width, self.used, self.good = did, w, 0, 0
        return True


def segments(pairs: Pairs) -> list[tuple[int, int]]:
    """(begin, end) of the runs in pairs."""
    s = Segmenter()
    cuts = [i for i, (did, length) in enumerate(pairs) if s.opens(did, length)]
    return list(zip(cuts, [*cuts[1:], len(pairs)], strict=False))


def encode_lengths(pairs: Pairs) -> bytes:
    out, last = [], pairs[0][0] if pairs else 0
    for a, b in segments(pairs):
        if b - a >= MIN_BLOCK:
            width = byte_width(pairs[a][1])
            out += [varint.put(SENTINEL), varint.put(pairs[a][0] - last), varint.put_fixed(b - a, 2), varint.put_fixed(width, 1)]
            out += [varint.put_fixed(v, width) for _, v in pairs[a:b]]
        else:
            for i in range(a, b):
                out += [varint.put(pairs[i][0] - (pairs[i - 1][0] if i > a else last)), varint.put(pairs[i][1])]
        last = pairs[b - 1][0]
    return b"".join(out)


def length_records(body: bytes, first: int) -> Iterable[tuple[int, int, int, int]]:
    """(first did, entries, width, position of the data): width 0 for a single pair."""
    pos, did = 0, first
    while pos < len(body):
        delta, pos = varint.get(body, pos)
        if delta == SENTINEL:
            delta, pos = varint.get(body, pos)
            n, pos = varint.get_fixed(body, pos, 2)
            width, pos = varint.get_fixed(body, pos, 1)
            if pos + n * width > len(body):
                raise CorruptData("truncated block")
            yield did + delta, n, width, pos
            did, pos = did + delta + n - 1, pos + n * width
        else:
            did += delta
            yield did, 1, 0, pos
            _, pos = varint.get(body, pos)


def decode_lengths(body: bytes, first: int) -> list[tuple[int, int]]:
    out = []
    for did, n, width, pos in length_records(body, first):
        if width:
            out += [(did + i, varint.get_fixed(body, pos + i * width, width)[0]) for i in range(n)]
        else:
            out.append((did, varint.get(body, pos)[0]))
    return out


def find_length(body: bytes, first: int, did: int) -> int | None:
    """Length of one document: straight to its bytes inside a block."""
    for start, n, width, pos in length_records(body, first):
        if start <= did < start + n:
            return varint.get_fixed(body, pos + (did - start) * width, width)[0] if width else varint.get(body, pos)[0]
        if start > did:
            return None
    return None


# ---- skip lists


def skip_levels(n: int) -> int:
    return int(log10(n) / 0.6) if n > 0 else 0


def encode_skips(pairs: Pairs, levels: int | None = None) -> bytes:
    """Pairs with, before both halves of every segment, a pointer to the half's last pair."""
    dids = [d for d, _ in pairs]
    delta = [0, *(b - a for a, b in zip(dids, dids[1:], strict=False))]
    record = [varint.put(d) + varint.put(v) for d, (_, v) in zip(delta, pairs, strict=False)]

    def part(a: int, b: int, level: int) -> bytes:
        if not level or b - a < 2:
            return b"".join(record[a:b])
        out = b""
        for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)):
            inner = part(x, y, level - 1)
            out += varint.put(SENTINEL) + varint.put(len(inner) - len(record[y - 1])) + varint.put(sum(delta[x:y])) + inner
        return out

    return part(0, len(pairs), skip_levels(len(pairs)) if levels is None else levels)


def decode_skips(body: bytes, first: int) -> list[tuple[int, int]]:
    out, pos, did = [], 0, first
    while pos < len(body):
        delta, pos = varint.get(body, pos)
        if delta == SENTINEL:
            _, pos = varint.get(body, pos)
            _, pos = varint.get(body, pos)
            continue
        value, pos = varint.get(body, pos)
        did += delta
        out.append((did, value))
    return out


def skip_find(body: bytes, first: int, want: int) -> int | None:
    """Value of one did, by the pointers."""
    pos, did = 0, first
    while pos < len(body):
        delta, pos = varint.get(body, pos)
        if delta == SENTINEL:
            ahead, pos = varint.get(body, pos)
            span, pos = varint.get(body, pos)
            if did + span <= want:  # land on the half's last pair, whose own step is part of span
                pos += ahead
                _, pos = varint.get(body, pos)
                did += span
                value, pos = varint.get(body, pos)
                if did == want:
                    return value
            continue
        value, pos = varint.get(body, pos)
        did += delta
        if did >= want:
            return value if did == want else None
    return None
