"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes TF-IDF weights of its words (lower-cased, hashed to ``TERMS``
slots), of its byte-class pairs (letters fall into a few classes, every
punctuation mark is its own) and of bins of a few measures: words repeated at
once, distinct words, word length, text length.  A singular
value decomposition of a bounded labelled sample (``MAX_LABELLED`` rows by hash
of doc_id) gives ``RANK`` latent dimensions.  The labelled vectors (at most
``MAX_LABELLED * RANK`` numbers, 2 MB) are broadcast; exact cosine products are
computed in blocks for every document, and the ``NEIGHBOURS`` most similar
labelled texts vote with weights that grow with the similarity.

Defined cases: null and empty texts are texts without pairs and are scored as
such; without labelled rows every score is 0.5; doc_id may be null or repeated;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sample
from .session import bounded_batches

MAX_LABELLED = 8000
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 40.0
THRESHOLD = 0.7
BINS = 8
MEASURES = 6
BIN_WEIGHT = 0.35
TERMS = 1024
TERM_WEIGHT = 0.5
BLOCK = 512
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in "\t\x0b\x0c "]] = 1
    t[[10, 13]] = 2
    t[48:58] = 3
    t[65:91] = 4
    t[97:123] = 5
    t[[ord(c) for c in "aeiouy"]] = 6
    t[0x80:0xC0] = 7
    t[0xC0:] = 8
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    t[marks] = np.arange(9, 9 + len(marks))
    return t


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
SHAPES = CLASSES * CLASSES + BINS * MEASURES
WIDTH = SHAPES + TERMS


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, WIDTH): roots of the shares of pairs, one-hot bins of the measures, roots of the shares of words."""
    n = len(off) - 1
    size = np.diff(off)
    c = CLASS[buf]
    pair = c[:-1] * CLASSES + c[1:] if len(c) else c
    doc = np.repeat(np.arange(n), size)
    same = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    counts = np.bincount(doc[:-1][same] * (CLASSES * CLASSES) + pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    x = np.zeros((n, WIDTH), np.float32)
    x[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    low = K.LOWER[buf]
    start, end, of = K.word_spans(low, off)
    h = K.Hasher(low)(start, end)
    words = np.bincount(of, minlength=n)
    w = np.maximum(words, 1)
    again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n) / w
    order = np.lexsort((h, of))
    ho, oo = h[order], of[order]
    new = np.ones(len(ho), bool)
    new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = np.bincount(oo[new], minlength=n) / w
    length = np.bincount(of, end - start, minlength=n) / w
    upper = np.bincount(doc, c == 4, minlength=n) / np.maximum(size, 1)
    odd = np.bincount(doc, (c == 3) | (c > 8), minlength=n) / np.maximum(size, 1)
    terms = np.bincount(of * TERMS + (h >> np.uint64(54)).astype(np.int64), minlength=n * TERMS).reshape(n, -1)
    x[:, SHAPES:] = TERM_WEIGHT * np.sqrt(terms / w[:, None])
    measures = (
        np.minimum(again * 20, BINS - 1),
        np.minimum(distinct * BINS, BINS - 1),
        np.minimum(length / 1.5, BINS - 1),
        np.minimum(np.log2(w) / 1.8, BINS - 1),
        np.minimum(upper * 24, BINS - 1),
        np.minimum(odd * 24, BINS - 1),
    )
    for i, m in enumerate(measures):
        x[np.arange(n), CLASSES * CLASSES + i * BINS + m.astype(int)] = BIN_WEIGHT
    return x


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a, b, buf, off in K.slices(column):
            v = self.latent(features(buf, off))
            for i in range(0, b - a, BLOCK):
                s = v[i : i + BLOCK] @ self.vectors.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(s, top, 1).astype(np.float64)
                w = np.exp(SHARPNESS * (near - near.max(1, keepdims=True)))
                out[a + i : a + i + len(s)] = (w * self.labels[top]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def train(column: pa.Array, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.empty((len(labels), WIDTH), np.float32)  # one copy of the sample, changed in place
    for a, b, buf, off in K.slices(column):
        x[a:b] = features(buf, off)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.3)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    axes = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, : -RANK - 1 : -1]).astype(np.float32)
    v = x @ axes
    return Model(idf, axes, v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9), labels.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Learn from at most `most` rows of labels with a non-null quality (1 is good)."""
    bounded_batches(docs.sparkSession)
    got = sample.labelled(docs, labels, "quality", most)
    return train(got["text"], got["value"].to_numpy() == 1)


def quality(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out (the given column), score, predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 4 is not 2; score all."""
    return quality(docs, fit(docs, labels.where(sample.remainder("doc_id", 4) != 2)), sample.remainder("doc_id", 4) == 2)
