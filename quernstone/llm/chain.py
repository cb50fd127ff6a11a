"""Scaled forward-backward over many sequences at once (linear chains), exact at any length.

A sequence longer than ``LONG`` is cut into parts that run side by side.  What a
part makes of each state it may be entered in is found first; from that follow
the distributions between parts, one step a part, and then all tokens of all
parts.  So Python's steps grow with ``LONG`` and the number of parts, not with
the longest sequence; nothing is approximated at the cuts.
"""

from __future__ import annotations

import numpy as np

LONG = 1024


def segments(lengths: np.ndarray, most: int) -> np.ndarray:
    """Cut every length into parts of at most `most`; returns all parts' lengths in order."""
    parts = np.maximum(1, -(-lengths // most))
    out = np.full(int(parts.sum()), most, np.int64)
    last = np.cumsum(parts) - 1
    out[last] = lengths - (parts - 1) * most
    return out[out > 0]


class Parts:
    """Parts of sequences: first token, size, and number of the part in its sequence."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        lengths = lengths[lengths > 0]
        self.size = segments(lengths, LONG)
        self.first = np.cumsum(self.size) - self.size
        many = -(-lengths // LONG)
        self.rank = np.arange(len(self.size)) - np.repeat(np.cumsum(many) - many, many)
        self.inner = np.flatnonzero(np.r_[self.rank[1:] > 0, False]) if len(self.size) else np.zeros(0, np.int64)  # a part follows

    def by_rank(self):
        """Numbers of the parts before another one, in order of their rank."""
        order = np.argsort(self.rank[self.inner], kind="stable")
        return np.split(self.inner[order], np.flatnonzero(np.diff(self.rank[self.inner][order])) + 1)


def _active(first, size):
    order = np.argsort(-size, kind="stable")
    steps = int(size[order[0]]) if len(size) else 0
    return order, first[order], np.searchsorted(-size[order], -np.arange(steps), "left")


def _ahead(emit, first, size, enter, move, alpha=None, scale=None):
    """Forward through parts from what they are entered with; their last alpha and log scale."""
    order, first, active = _active(first, size)
    into = enter[order]
    last, log = np.empty_like(into), np.zeros(len(order))
    for t, k in enumerate(active):
        at = first[:k] + t
        a = emit[at]
        a *= into[:k]
        c = a.sum(1)
        a /= c[:, None]
        if alpha is None:
            last[:k] = a
            log[:k] += np.log(c)
        else:
            alpha[at] = a
            scale[at] = c
        into = a[: active[t + 1]] @ move if t + 1 < len(active) else a
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return last[back], log[back]


def forward(emit: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray):
    """alpha (normalised) and scale of every token.

    emit: (tokens, states), positive; lengths: of the sequences that lie one
    after another in it; start: (states,); move: (states, states).
    """
    p, states = Parts(lengths), emit.shape[1]
    alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
    enter = np.tile(np.asarray(start, emit.dtype), (len(p.size), 1))
    if len(p.inner):
        each = np.tile(np.eye(states, dtype=emit.dtype), (len(p.inner), 1))
        last, log = _ahead(emit, np.repeat(p.first[p.inner], states), np.repeat(p.size[p.inner], states), each, move)
        last, log = last.reshape(-1, states, states), log.reshape(-1, states)
        last *= np.exp(log - log.max(1, keepdims=True))[:, :, None]
        place = np.zeros(len(p.size), np.int64)
        place[p.inner] = np.arange(len(p.inner))
        for some in p.by_rank():
            out = np.einsum("ki,kij->kj", enter[some], last[place[some]])
            enter[some + 1] = (out / out.sum(1, keepdims=True)) @ move
    _ahead(emit, p.first, p.size, enter, move, alpha, scale)
    return alpha, scale


def _behind(emit, scale, first, size, leave, move, beta=None):
    """Backward through parts from the beta of their last token; the beta of the token before the part."""
    order, first, active = _active(first, size)
    back = np.ascontiguousarray(move.T)
    now = leave[order].copy()
    out = np.empty_like(now)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        if beta is not None:
            beta[at] = now[:k]
        now[:k] = (emit[at] * (now[:k] / scale[at, None])) @ back
    out[order] = now
    return out


def backward(emit: np.ndarray, scale: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """beta of every token, scaled so that alpha * beta sums to 1."""
    p, states = Parts(lengths), emit.shape[1]
    beta = np.ones_like(emit)
    leave = np.ones((len(p.size), states), emit.dtype)
    if len(p.inner):
        after = p.inner + 1
        each = np.tile(np.eye(states, dtype=emit.dtype), (len(after), 1))
        through = _behind(emit, scale, np.repeat(p.first[after], states), np.repeat(p.size[after], states), each, move).reshape(-1, states, states)
        place = np.zeros(len(p.size), np.int64)
        place[p.inner] = np.arange(len(p.inner))
        for some in p.by_rank()[::-1]:
            leave[some] = np.einsum("ki,kij->kj", leave[some + 1], through[place[some]])
    _behind(emit, scale, p.first, p.size, leave, move, beta)
    return beta


def pair_counts(alpha, beta, emit, scale, lengths, move) -> np.ndarray:
    """Expected number of moves between states, summed over all sequences."""
    lengths = np.asarray(lengths, np.int64)
    last = np.zeros(len(emit), bool)
    last[np.cumsum(lengths) - 1] = True
    here = np.flatnonzero(~last)
    return move * (alpha[here].T @ (emit[here + 1] * beta[here + 1] / scale[here + 1, None]))
