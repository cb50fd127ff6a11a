"""Encodings whose byte order is the order of the values, and posting keys."""

from __future__ import annotations

from .varint import CorruptData, checked

DOCLEN_PREFIX = b"\x00\xe0"  # fixed value of the key format


def put_uint(value: int) -> bytes:
    """Two bits for the number of following bytes less one, then big-endian bits."""
    more = next(n for n in range(1, 5) if checked(value) < 1 << (6 + 8 * n))
    return (value | (more - 1) << (6 + 8 * more)).to_bytes(more + 1, "big")


def get_uint(buf: bytes, pos: int = 0) -> tuple[int, int]:
    if pos >= len(buf):
        raise CorruptData("truncated key")
    end = pos + 2 + (buf[pos] >> 6)
    if end > len(buf):
        raise CorruptData("truncated key")
    bits = 8 * (end - pos) - 2
    return checked(int.from_bytes(buf[pos:end], "big") & ((1 << bits) - 1)), end


def put_string(value: bytes, last: bool = False) -> bytes:
    return value.replace(b"\0", b"\0\xff") + (b"" if last else b"\0")


def get_string(buf: bytes, pos: int = 0) -> tuple[bytes, int]:
    out = bytearray()
    while pos < len(buf):
        if buf[pos]:
            out.append(buf[pos])
            pos += 1
        elif buf[pos + 1 : pos + 2] == b"\xff":
            out.append(0)
            pos += 2
        else:
            return bytes(out), pos + 1
    return bytes(out), pos


def posting_key(term: bytes, first_did: int | None = None) -> bytes:
    """Key of a chunk; the first chunk of a list has no did, the doc-length list no term."""
    did = b"" if first_did is None else put_uint(first_did)
    if not term:
        return DOCLEN_PREFIX + did
    return put_string(term, last=first_did is None) + did


def split_key(key: bytes) -> tuple[bytes, int | None]:
    if key.startswith(DOCLEN_PREFIX):
        return b"", get_uint(key, 2)[0] if len(key) > 2 else None
    term, pos = get_string(key)
    return term, get_uint(key, pos)[0] if pos < len(key) else None


def key_is_of(key: bytes, term: bytes) -> bool:
    return split_key(key)[0] == term
