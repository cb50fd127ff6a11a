"""Scores texts by a hidden Markov language model trained by Baum-Welch.

Tokens are words, ASCII lower-cased, and one end for each text.  A word belongs
to one of ``CLASSES`` classes by the hash of its last three bytes.  A state
emits a class, and the class a word by its smoothed share of the class's
training tokens, ``(c + 0.5) / (N_g + 0.5 (V_g + 1))``: so every state has a
full distribution over words, one unknown word for each class included, while
the trained table stays bounded.

Training starts on a bounded sample and then makes ``ROUNDS`` passes of
Baum-Welch over all training texts, each from end to end; expected counts are added up in each
partition and then across partitions.  Word counts come from all training
texts through a packed exchange: batches of texts (of bounded bytes) ask for the counts of their
distinct words, so a frequent word moves once for each batch.  The score is
the exact log10 likelihood by the scaled forward recursion over whole texts.

Defined cases: null texts are empty and consist of the end alone; doc_id may be
null or repeated; without training texts all counts are 0 and the base score
is 0 for each token; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chain, packed, sample
from . import kernels as K
from .session import batches, bounded_batches, cut, parts_of

STATES = 6
CLASSES = 4096  # the last is the end
END = np.uint64((CLASSES - 1) << 52)
SAMPLE = 1000
SAMPLE_ROUNDS = 12
ROUNDS = 2
SLICE = 2 << 20
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of every token, ends included, and the number of tokens of each text.

    A key holds the class in its upper 12 bits and 52 bits of the word's hash.
    """
    low = K.LOWER[buf]
    start, end, doc = K.word_spans(low, off)
    h = K.Hasher(low)
    group = h(np.maximum(start, end - 3), end, 1) % np.uint64(CLASSES - 1)
    words = (group << np.uint64(52)) | (h(start, end) >> np.uint64(12))
    n = len(off) - 1
    sizes = np.bincount(doc, minlength=n) + 1
    keys = np.full(len(words) + n, END, np.uint64)
    keys[np.arange(len(words)) + doc] = words
    return keys, sizes


def group_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(52)).astype(np.int64)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (CLASSES, STATES)

    @classmethod
    def first(cls, groups: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        share = np.bincount(groups, minlength=CLASSES) + 0.5
        emit = share[:, None] * rng.gamma(2.0, 0.5, (CLASSES, STATES))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    def expected(self, groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Expected counts (starts, moves, emissions) and the log likelihood, as one vector."""
        lengths = sizes
        e = self.emit[groups]
        alpha, scale = chain.forward(e, lengths, self.start, self.move)
        beta = chain.backward(e, scale, lengths, self.move)
        p = alpha * beta
        first = np.cumsum(sizes) - sizes
        emits = np.stack([np.bincount(groups, p[:, s], minlength=CLASSES) for s in range(STATES)], 1)
        pairs = chain.pair_counts(alpha, beta, e, scale, lengths, self.move)
        return np.concatenate([p[first].sum(0), pairs.ravel(), emits.ravel(), [np.log(scale).sum()]])

    @classmethod
    def from_counts(cls, vec: np.ndarray) -> Model:
        a, b = STATES, STATES + STATES * STATES
        start, move, emit = vec[:a] + 0.1, vec[a:b].reshape(STATES, STATES) + 0.1, vec[b:-1].reshape(CLASSES, STATES) + 1e-3
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def log10(self, groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence of classes."""
        _, scale = chain.forward(self.emit[groups], sizes, self.start, self.move)
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log10(scale), minlength=len(sizes))


def train(docs: DataFrame, use, rounds: int = ROUNDS, most: int = SAMPLE) -> Model:
    """Baum-Welch on a bounded sample, then `rounds` passes over all rows that `use` marks."""
    rows = docs.where(use)
    got = sample.texts(rows, F.lit(0), most)
    parts = [tokens(buf, off) for _, _, buf, off in K.slices(got["text"], SLICE)]
    if not parts:
        return Model.first(np.zeros(0, np.int64))
    groups, sizes = [group_of(k) for k, _ in parts], [s for _, s in parts]
    model = Model.first(np.concatenate(groups))
    for _ in range(SAMPLE_ROUNDS):
        model = Model.from_counts(sum(model.expected(g, s) for g, s in zip(groups, sizes, strict=True)))
    for _ in range(rounds):
        model = Model.from_counts(one_round(rows, model))
    return model


def one_round(rows: DataFrame, model: Model) -> np.ndarray:
    """Expected counts of all rows: sums in each partition, then across partitions."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # CLASSES x STATES numbers

    def run(batches):
        from pyspark import TaskContext

        m, total = shared.value, None
        for batch in batches:
            for _, _, buf, off in K.slices(batch.column(0), SLICE):
                keys, sizes = tokens(buf, off)
                got = m.expected(group_of(keys), sizes)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "vec"])

    texts = rows.select("text")
    vec = packed.summed(texts.mapInArrow(run, "part long, vec binary"), parts_of(texts))
    return vec if vec is not None else np.zeros(STATES + STATES * STATES + CLASSES * STATES + 1)


def count_answer(keys: np.ndarray, counts: np.ndarray, row: np.ndarray):
    """Totals of all keys, and tokens and distinct words of each class."""
    distinct, of = np.unique(keys, return_inverse=True)
    total = np.bincount(of, counts, minlength=len(distinct)).astype(np.int64)
    seen = total > 0
    g = group_of(distinct)
    stats = np.concatenate([np.bincount(g[seen], total[seen], minlength=CLASSES), np.bincount(g[seen], minlength=CLASSES)]).astype(np.float64)
    return np.arange(len(keys)), total[of], stats


def lm_scores(docs: DataFrame, held_out, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = batches(docs)
    model = train(docs, ~held_out, rounds)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", F.pmod(F.xxhash64("doc_id", "text", F.lit("batch")), F.lit(n)).alias("batch"))

    def ask(table: pa.Table) -> pa.Table:
        # counts of each part of the batch first, so that it is never held as tokens at once
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = table.column("held_out").to_numpy()
        for a, b, buf, off in K.slices(table.column("text"), SLICE):
            k, sizes = tokens(buf, off)
            u, of = np.unique(k, return_inverse=True)
            c = np.bincount(of, np.repeat(~held[a:b], sizes), minlength=len(u)).astype(np.int64)
            keys, of = np.unique(np.concatenate([keys, u]), return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
        return packed.requests(table.column("batch")[0].as_py(), keys, counts, n)

    got = cut(packed.answered(keyed.groupBy("batch").applyInArrow(ask, packed.REQUEST), count_answer))
    stats = packed.summed(got.where("batch = -1").select(F.xxhash64("keys").alias("part"), F.col("counts").alias("vec")), n)
    stats = np.zeros(2 * CLASSES) if stats is None else stats
    shared = spark.sparkContext.broadcast((model, stats))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m, s = shared.value
        size, distinct = s[:CLASSES], s[CLASSES:]
        train_tokens, vocabulary = int(size.sum()), int(distinct.sum())
        sorted_keys, totals = packed.replies(right)
        rows = left.num_rows
        out = {k: np.zeros(rows, np.int64 if k.startswith("n_") else np.float64) for k in ("n_tokens", "n_known", "base_score", "score")}
        for a, b, buf, off in K.slices(left.column("text"), SLICE):
            keys, sizes = tokens(buf, off)
            c, g = packed.found(sorted_keys, totals, keys), group_of(keys)
            doc = np.repeat(np.arange(b - a), sizes)
            out["n_tokens"][a:b] = sizes
            out["n_known"][a:b] = np.bincount(doc, c > 0, minlength=b - a)
            out["base_score"][a:b] = np.bincount(doc, np.log10((c + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))), minlength=b - a)
            word = np.log10((c + 0.5) / (size[g] + 0.5 * (distinct[g] + 1)))
            out["score"][a:b] = m.log10(g, sizes) + np.bincount(doc, word, minlength=b - a)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": np.full(rows, train_tokens), "base_score": out["base_score"], "score": out["score"]})

    return keyed.groupBy("batch").cogroup(got.where("batch >= 0").groupBy("batch")).applyInArrow(score, SCHEMA)


def lm_query(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 1; score all."""
    return lm_scores(docs, sample.remainder("doc_id", 5) == 1)
