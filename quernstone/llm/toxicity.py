"""Toxicity severity by cumulative-link ordinal regression on sparse features.

Features are the words of a text and their prefixes, hashed to 64 bits, by
``log(1 + count)``.  From a bounded labelled sample (``MAX_LABELLED`` rows, by
hash of doc_id and text, of ``sample.MAX_BYTES`` at most) the features with the strongest association with
``labels.toxic`` are selected.  Grades: 0 for a clean text; a toxic one is
graded 1, 2 or 3 by the tertile of its number of words that carry a selected
feature, as the labels hold no finer severity.  One weight vector is shared by
the ordered thresholds: ``P(grade > k) = logistic(w.x - theta_k)``.  The output
is the expected severity ``sum_k P(grade > k)`` over the whole text.

Defined cases: null or empty text scores as a text without features; doc_id may
be null or repeated (of several labels of one doc_id the largest counts, for all its texts); without labelled rows of both kinds all rows get severity
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sample
from .session import bounded_batches, streamed

MAX_LABELLED = 8000
SLICE = 1 << 19
TRAIN_SLICE = 1 << 18  # smaller than for scoring: the driver has less memory than executors
MAX_FEATURES = 4096
LEAST_DOCS = 4
LEAST_RATIO = 6.0
PREFIXES = (4, 5, 6, 7, 8)
GRADES = 4
SCHEMA = "doc_id long, severity double, p_toxic double, grade int, is_toxic boolean"


def word_features(buf: np.ndarray, off: np.ndarray):
    """Yields (text number, word number, hash) for each kind of feature; words are lower-cased in ASCII and Latin-1."""
    buf = K.folded(buf)
    start, end, doc = K.word_spans(buf, off)
    # punctuation at the ends of a word doesn't count
    for _ in range(3):
        end = end - ((end > start + 1) & np.isin(buf[end - 1], PUNCTUATION))
    for _ in range(2):
        start = start + ((end > start + 1) & np.isin(buf[np.minimum(start, len(buf) - 1)], PUNCTUATION))
    h = K.Hasher(buf)
    words = np.arange(len(start))
    yield doc, words, h(start, end, 1)
    for n in PREFIXES:
        at = np.flatnonzero(end - start >= n)
        yield doc[at], words[at], h(start[at], start[at] + n, n + 1)


PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~", np.uint8)


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thetas: np.ndarray
    cut: float = 0.5  # a text is toxic if P(grade > 0) is above

    def counts(self, column: pa.Array, limit: int = SLICE):
        """Sparse counts (text, feature, count) and marked words for each text, slice by slice."""
        look = K.Lookup(self.keys)
        for a, b, buf, off in K.slices(column, limit):
            texts, which, marked = [], [], []
            for doc, word, h in word_features(buf, off):
                at, key = look.hits(h)
                texts.append(doc[at])
                which.append(key)
                marked.append(word[at] * np.int64(b - a) + doc[at])
            code, n = np.unique(np.concatenate(texts).astype(np.int64) * max(1, len(self.keys)) + np.concatenate(which), return_counts=True)
            words = np.bincount(np.unique(np.concatenate(marked)) % (b - a), minlength=b - a) if b > a else np.zeros(0, int)
            yield a, b, code // max(1, len(self.keys)), code % max(1, len(self.keys)), n, words

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        out = np.zeros((len(column), len(self.thetas)))
        for a, b, doc, key, n, _ in self.counts(column):
            x = np.bincount(doc, self.weights[key] * np.log1p(n), minlength=b - a)
            out[a:b] = np.where(np.isinf(self.thetas), 0, 1 / (1 + np.exp(np.clip(self.thetas - x[:, None], -500, 500))))
        return out


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, np.inf))


def select(column: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features that go with toxic texts, sorted."""

    def per_text(rows: np.ndarray) -> np.ndarray:
        found = []
        for _, _, buf, off in K.slices(column.take(pa.array(rows)), TRAIN_SLICE):
            for doc, _, h in word_features(buf, off):
                order = np.lexsort((h, doc))
                d, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
                found.append(h[new])
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    bad, good = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    keys, c1 = np.unique(per_text(bad), return_counts=True)
    keys, c1 = keys[c1 >= min(LEAST_DOCS, len(bad))], c1[c1 >= min(LEAST_DOCS, len(bad))]
    if not len(keys):
        return keys
    c0, look = np.zeros(len(keys)), K.Lookup(keys)
    for some in np.array_split(good, max(1, len(good) // 200)):
        c0 += np.bincount(look.hits(per_text(some))[1], minlength=len(keys))
    p1, p0 = (c1 + 0.5) / (len(bad) + 1), (c0 + 0.5) / (len(good) + 1)
    strength = np.where(p1 > LEAST_RATIO * p0, (p1 - p0) * np.log(p1 / p0), 0)
    best = np.argsort(-strength, kind="stable")[:MAX_FEATURES]
    return np.sort(keys[best[strength[best] > 0]])


def ordinal(doc, key, x, grades: np.ndarray, features: int, steps: int = 500, rate: float = 0.05, decay: float = 2e-4):
    """Weights and ordered thresholds by gradient descent (Adam) on the penalised likelihood."""
    levels = GRADES - 1
    y = (grades[:, None] > np.arange(levels)).astype(float)
    share = np.clip(y.mean(0), 1e-3, 1 - 1e-3)
    theta0 = np.log((1 - share) / share)
    # theta_k = p_0 + sum of exp(p_i): always in order
    p = np.concatenate([np.zeros(features), theta0[:1], np.log(np.maximum(np.diff(theta0), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(grades)
    balance = np.where(grades > 0, max(1.0, (grades == 0).sum() / max(1, (grades > 0).sum()) / 2), 1.0)[:, None]
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([p[features : features + 1], np.exp(p[features + 1 :])]))
        s = np.bincount(doc, p[key] * x, minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta - s[:, None], -50, 50)))
        # with P(grade = k) = above[k-1] - above[k]
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        prob = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = above * (1 - above)
        hi = (y * slope * (np.arange(levels) == grades[:, None] - 1)) / prob[:, None]
        lo = -(slope * (np.arange(levels) == grades[:, None])) / prob[:, None]
        ds = -(hi + lo) * balance / n  # of minus the mean log-likelihood
        dtheta = -ds.sum(0)
        dw = np.bincount(key, ds.sum(1)[doc] * x, minlength=features) + decay * p[:features]
        tail = np.cumsum(dtheta[::-1])[::-1]
        g = np.concatenate([dw, tail[:1], tail[1:] * np.exp(p[features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:features], np.cumsum(np.concatenate([p[features : features + 1], np.exp(p[features + 1 :])]))


def train(column: pa.Array, toxic: np.ndarray) -> Model:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not toxic.any() or toxic.all():
        return NOTHING
    keys = select(column, toxic)
    if not len(keys):
        return NOTHING
    model = Model(keys, np.zeros(len(keys)), np.zeros(GRADES - 1))
    doc, key, count, words = [], [], [], np.zeros(len(column), int)
    for a, b, d, k, n, w in model.counts(column, TRAIN_SLICE):
        doc.append(d + a)
        key.append(k)
        count.append(n)
        words[a:b] = w
    cuts = np.quantile(words[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (words > cuts[0]) + (words > cuts[1]), 0)
    w, theta = ordinal(np.concatenate(doc), np.concatenate(key), np.log1p(np.concatenate(count)), grades, len(keys))
    model = Model(keys, w, theta)
    model.cut = best_cut(model.above(column)[:, 0], toxic)
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of the best F1 on the labelled rows; the middle of the widest such gap."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic.sum())
    below = np.append(p[order][1:], 0.0)
    gap = p[order] - below
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(np.clip(below[best] + gap[best] / 2, 0.4, 0.6))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Learn from at most `most` rows of labels with a non-null toxic (1 is toxic)."""
    bounded_batches(docs.sparkSession)
    got = sample.labelled(docs, labels, "toxic", most)
    return train(got["text"], got["value"].to_numpy() == 1)


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def run(batches):
        m = shared.value
        for batch in batches:
            above = m.above(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(above.sum(1)),
                    pa.array(above[:, 0]),
                    pa.array((above > 0.5).sum(1).astype(np.int32)),
                    pa.array(above[:, 0] > m.cut),
                ],
                ["doc_id", "severity", "p_toxic", "grade", "is_toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (0 to 3), p_toxic, grade, is_toxic for every document."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.above(batch.column(at))[:, 0] <= shared.value.cut))

    return docs.mapInArrow(streamed(run), docs.schema)



