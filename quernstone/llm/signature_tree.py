"""Signature trees over sets: which pairs can still reach a Jaccard similarity of 0.8.

A leaf stands for one set or for a group of sets, by the OR and the AND of
their token bitmaps and the range of their sizes; inner nodes combine
``FANOUT`` children.  For x in A and y in B at least ``|AND(A) minus OR(B)|``
tokens of x are not in y, so the overlap is at most ``|x|`` less that; with
``overlap >= 4/9 (|x| + |y|)``, which a similarity of 0.8 needs, a pair of
nodes is pruned unless ``5 max|A| - 4 min|B| >= 9 |AND(A) minus OR(B)|`` and
the same the other way round.  Bitmaps have two bits for each token of the
largest set, so that they tell long sets apart too; a bitmap folds into a
narrower one by OR, of OR and AND bitmaps alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAST_WORDS = 32  # of 64 bits
MOST_WORDS = 4096
FANOUT = 8
CHUNK = 1 << 19  # words of bitmaps compared at once


def words_for(size: int, most: int = MOST_WORDS) -> int:
    """Words of the bitmaps of sets of so many tokens: a power of two."""
    words = LEAST_WORDS
    while words < most and 32 * words < size:
        words *= 2
    return words


def bitmap(tokens: np.ndarray, words: int = LEAST_WORDS) -> np.ndarray:
    """Token bitmap of one set of hashes."""
    out = np.zeros(words, np.uint64)
    bit = tokens & np.uint64(64 * words - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer words: a token's bit is the same one of the narrower bitmap."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


@dataclass
class Nodes:
    either: np.ndarray  # OR of the bitmaps
    every: np.ndarray  # AND
    low: np.ndarray  # least size
    high: np.ndarray

    def parents(self) -> Nodes:
        at = np.arange(0, len(self.low), FANOUT)
        return Nodes(np.bitwise_or.reduceat(self.either, at, axis=0), np.bitwise_and.reduceat(self.every, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at))

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (5 * self.high[a] >= 4 * self.low[b]) & (5 * self.high[b] >= 4 * self.low[a])
        at = np.flatnonzero(ok)
        step = max(1, CHUNK // self.either.shape[1])
        for i in range(0, len(at), step):
            some = at[i : i + step]
            x, y = a[some], b[some]
            there = np.bitwise_count(self.every[x] & ~self.either[y]).sum(1, dtype=np.int64)
            back = np.bitwise_count(self.every[y] & ~self.either[x]).sum(1, dtype=np.int64)
            ok[some] = (5 * self.high[x] - 4 * self.low[y] >= 9 * there) & (5 * self.high[y] - 4 * self.low[x] >= 9 * back)
        return ok


def pairs(leaves: Nodes):
    """Yields (a, b) arrays, a < b, of the leaves that a dual traversal can't rule out."""
    m = len(leaves.low)
    if m < 2:
        return
    if m <= FANOUT:
        a, b = np.triu_indices(m, 1)
        ok = leaves.possible(a, b)
        if ok.any():
            yield a[ok], b[ok]
        return
    order = np.lexsort((leaves.every[:, 0], leaves.low))
    levels = [Nodes(leaves.either[order], leaves.every[order], leaves.low[order], leaves.high[order])]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].parents())
    child = np.arange(FANOUT)
    step = 1 << 14
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        ok = levels[level].possible(a, b)
        if level == 0:
            ok &= a != b
            x, y = order[a[ok]], order[b[ok]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)
            continue
        a, b = a[ok], b[ok]
        size = len(levels[level - 1].low)
        x = (a[:, None, None] * FANOUT + child[None, :, None]).repeat(FANOUT, 2).ravel()
        y = (b[:, None, None] * FANOUT + child[None, None, :]).repeat(FANOUT, 1).ravel()
        keep = (x <= y) & (x < size) & (y < size)
        x, y = x[keep], y[keep]
        for i in range(0, len(x), step):
            todo.append((level - 1, x[i : i + step], y[i : i + step]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 0.8 or more, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 5 * len(a) < 4 * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)
