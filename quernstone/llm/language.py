"""Language identification by a linear-chain conditional random field over words.

Every word has a label (a language).  Its score for a label is the sum of
learned weights of hashed features: the word itself (lexicon), its first and
last one to four bytes (affixes) and its byte trigrams with word ends marked
(n-grams); learned transition scores link neighbouring words.  Forward-backward
gives each word's label probabilities, so code-switched texts are labelled word
by word.  A document's language is the one with the largest sum of these
probabilities over words with letters; its score is that share.

Training maximises the conditional likelihood on a bounded sample
(``MAX_TRAIN`` rows by hash of doc_id and text, whole texts), where every word of a document
has the document's lang.

Defined cases: null texts and texts without a letter give ``und`` and score 0;
without training rows all give ``und``; doc_id may be null or repeated; very
long texts are labelled whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chain, sample
from . import kernels as K
from .session import bounded_batches

MAX_TRAIN = 1500
BUCKETS = 1 << 17
AFFIXES = (1, 2, 3, 4)
EPOCHS = 4
BATCH_WORDS = 40_000
SLICE = 4 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[0xC3:] = True


def letters(buf: np.ndarray) -> np.ndarray:
    """Whether a byte is, or begins, a letter (or is one of the other signs beyond Latin-1)."""
    out = LETTER[buf]
    out[:-1] |= (buf[:-1] == 0xC2) & np.isin(buf[1:], (0xAA, 0xB5, 0xBA))
    return out


def word_slots(buf: np.ndarray, off: np.ndarray):
    """Features of the distinct words of a slice.

    Returns the number of the distinct word of each word, the text of each
    word, whether it has a letter, and the feature slots of the distinct words
    with the distinct word of each slot (in order).
    """
    start, end, doc = K.word_spans(buf, off)
    h = K.Hasher(buf)
    _, first, of = np.unique(h(start, end), return_index=True, return_inverse=True)
    sums = np.concatenate([[0], np.cumsum(letters(buf))])
    has = sums[end] > sums[start]
    s, e = start[first], end[first]
    n = np.arange(len(s))
    owner, slot = [n], [h(s, e, 1)]
    for k in AFFIXES:
        at = n[e - s >= k]
        owner += [at, at]
        slot += [h(s[at], s[at] + k, 2 * k), h(e[at] - k, e[at], 2 * k + 1)]
    grams = np.maximum(e - s - 2, 0)
    o = np.repeat(n, grams)
    at = np.repeat(s, grams) + np.arange(len(o)) - np.repeat(np.cumsum(grams) - grams, grams)
    owner.append(o)
    slot.append(h(at, at + 3, 20))
    owner, slot = np.concatenate(owner), (np.concatenate(slot) >> np.uint64(47)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return of, doc, has, owner[order], slot[order]


def word_scores(weights: np.ndarray, owner: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Sum of the weights of each distinct word's slots; every word has slots."""
    if not len(owner):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[slot], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), axis=0)


def likelihoods(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(1, keepdims=True))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray  # log scores
    start: np.ndarray

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        alpha, scale = chain.forward(emit, lengths, np.exp(self.start), np.exp(self.moves))
        p = alpha * chain.backward(emit, scale, lengths, np.exp(self.moves))
        return p / p.sum(1, keepdims=True)

    def words(self, text: str | None) -> list[tuple[str, str]]:
        """(word, label) of one text, for code-switched text."""
        got = self.detail(pa.array([text]))
        return list(zip((text or "").split(), (self.labels[i] for i in got), strict=False))

    def detail(self, column: pa.Array) -> np.ndarray:
        for _, _, buf, off in K.slices(column):
            of, doc, _, owner, slot = word_slots(buf, off)
            emit = likelihoods(word_scores(self.weights, owner, slot))[of]
            return self.marginals(emit, np.bincount(doc, minlength=len(off) - 1)).argmax(1) if len(of) else np.zeros(0, int)
        return np.zeros(0, int)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = np.full(len(column), "und", object), np.zeros(len(column))
        if not self.labels:
            return names.tolist(), score
        for a, b, buf, off in K.slices(column, SLICE):
            of, doc, has, owner, slot = word_slots(buf, off)
            if not len(of):
                continue
            lengths = np.bincount(doc, minlength=b - a)
            p = self.marginals(likelihoods(word_scores(self.weights, owner, slot))[of], lengths[lengths > 0])
            share = np.stack([np.bincount(doc[has], p[has, i], minlength=b - a) for i in range(len(self.labels))], 1)
            total = share.sum(1)
            best = share.argmax(1)
            sure = np.bincount(np.repeat(np.arange(b - a), np.diff(off)), LETTER[buf] & (buf < 128), minlength=b - a) > 0
            for i in np.flatnonzero((total > 0) & ~sure):  # only bytes beyond ASCII: letters or other signs
                if not any(map(str.isalpha, bytes(buf[off[i] : off[i + 1]]).decode("utf-8", "replace"))):
                    total[i] = 0
            ok = np.flatnonzero(total > 0)
            score[a + ok] = np.clip(share[ok, best[ok]] / total[ok], 0, 1)
            names[a + ok] = np.array(self.labels, object)[best[ok]]
        return names.tolist(), score


def train(column: pa.Array, langs: np.ndarray, epochs: int = EPOCHS) -> Model:
    labels = sorted({x for x in langs.tolist() if x is not None})
    if not labels:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0))
    n = len(labels)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    gold_of = np.searchsorted(labels, langs.astype(str))
    m = Model(labels, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n))
    params = {"weights": m.weights, "moves": m.moves, "start": m.start}
    squares = {k: np.full_like(v, 1e-6) for k, v in params.items()}
    for epoch in range(epochs):
        for a, _, buf, off in K.slices(column, BATCH_WORDS * 6):
            of, doc, _, owner, slot = word_slots(buf, off)
            if not len(of):
                continue
            gold = gold_of[a + doc]
            sizes = np.bincount(doc, minlength=len(off) - 1)
            lengths = sizes[sizes > 0]
            emit = likelihoods(word_scores(m.weights, owner, slot))[of]
            start, move = np.exp(m.start), np.exp(m.moves)
            alpha, scale = chain.forward(emit, lengths, start, move)
            beta = chain.backward(emit, scale, lengths, move)
            p = alpha * beta
            p /= p.sum(1, keepdims=True)
            pairs = chain.pair_counts(alpha, beta, emit, scale, lengths, move)
            first = np.cumsum(lengths) - lengths
            hot = np.zeros_like(p)
            hot[np.arange(len(gold)), gold] = 1
            inner = np.ones(len(gold), bool)
            inner[first] = False
            gold_pairs = np.zeros((n, n))
            np.add.at(gold_pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            diff = hot - p
            by_word = np.stack([np.bincount(of, diff[:, i], minlength=int(owner[-1]) + 1) for i in range(n)], 1)
            by_slot = np.stack([np.bincount(slot, by_word[owner, i], minlength=BUCKETS) for i in range(n)], 1)
            size = len(gold)
            for k, g in (("weights", by_slot / size - 1e-7 * m.weights), ("moves", (gold_pairs - pairs) / size - 1e-4 * m.moves), ("start", (hot - p)[first].sum(0) / size)):
                squares[k] += g * g
                params[k] += (0.5 / (1 + epoch)) * g / np.sqrt(squares[k])
    m.weights = m.weights.astype(np.float32)
    return m


def fit(docs: DataFrame, use, most: int = MAX_TRAIN) -> Model:
    """Learn from at most `most` of the rows that the column `use` marks, with text and lang."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = sample.texts(rows, F.col("lang"), most)
    return train(got["text"], np.array(got["value"].to_pylist(), object))


def identify(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """doc_id, held_out (the given column), lang_pred, score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a label

    def run(batches):
        for batch in batches:
            names, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0; predict all."""
    held = sample.remainder("doc_id", 5) == 0
    return identify(docs, fit(docs, ~held), held)
