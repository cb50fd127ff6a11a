"""Suffix arrays, common prefixes and longest previous factors with NumPy."""

from __future__ import annotations

import numpy as np


def ranks(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of the substring of that length at every position), by prefix doubling.

    Lengths 8, 16, ... up to most; a substring that runs over the end counts as
    if zeros followed.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + n]
    levels, length = [], 8
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while True:
        levels.append((length, rank))
        if length >= most:
            return levels
        step = min(length, most - length)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        length += step


def common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, in steps of 8 bytes at least, up to most.

    Exact at `most`; below it a lower bound, which is all that a threshold at
    `most` needs.
    """
    n = len(levels[0][1])
    got = np.zeros(len(a), np.int64)
    top = levels[-1][1][a] == levels[-1][1][b]
    got[top] = levels[-1][0]
    for length, rank in reversed(levels[:-1]):
        x, y = a + got, b + got
        ok = ~top & (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = rank[x[ok]] == rank[y[ok]]
        got[same] += length
    return np.minimum(got, most)


def previous_smaller(values: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest earlier place with a smaller value (-1: none), and the least link on the way.

    link[i] belongs to the step from i - 1 to i.  Pointers jump over pointers:
    all that lies between a place and its pointer is larger than its value.
    """
    n = len(values)
    to = np.arange(-1, n - 1)
    low = link.copy()
    todo = np.flatnonzero(to >= 0)
    while len(todo):
        todo = todo[values[to[todo]] > values[todo]]
        low[todo] = np.minimum(low[todo], low[to[todo]])
        to[todo] = to[to[todo]]
        todo = todo[to[todo] >= 0]
    low[to < 0] = 0
    return to, low


def factors(data: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor (up to most) of the suffixes at starts.

    Only the given starts take part.  In suffix order, the nearest places on
    both sides with a smaller position hold the longest earlier match; those
    with a larger position the longest later one.
    """
    levels = ranks(data, most)
    order = starts[np.argsort(levels[-1][1][starts], kind="stable")]
    link = np.zeros(len(order), np.int64)
    link[1:] = common(levels, order[:-1], order[1:], most)

    def both(values: np.ndarray) -> np.ndarray:
        _, left = previous_smaller(values, link)
        back = np.zeros_like(link)
        back[1:] = link[:0:-1]
        _, right = previous_smaller(values[::-1], back)
        return np.maximum(left, right[::-1])

    place = np.argsort(order, kind="stable")
    inverse = np.empty(len(starts), np.int64)
    inverse[np.argsort(starts, kind="stable")] = place
    return both(order)[inverse], both(-order)[inverse]


def later_copies(data: bytes, least: int) -> np.ndarray:
    """Bytes of one text to remove so that of every repeated string of `least` bytes the first stays."""
    buf = np.frombuffer(data, np.uint8)
    mask = np.zeros(len(buf) + 1, np.int64)
    if len(buf) >= least:
        starts = np.arange(len(buf) - least + 1)
        earlier, _ = factors(buf, starts, least)
        hit = starts[earlier >= least]
        np.add.at(mask, hit, 1)
        np.add.at(mask, hit + least, -1)
    return np.cumsum(mask)[:-1] > 0
