"""Finds benchmark passages in documents by latent semantic retrieval.

Words (lower-cased in ASCII and Latin-1, without punctuation at their ends) are weighted by
IDF over all documents.  A distributed randomised SVD of the TF-IDF passages of
the documents and of the benchmark gives a latent space: each partition adds up
``A'(A omega)`` for its passages, the sums are added, and the driver takes the
largest singular values of ``A`` and their vectors from this sketch in one pass
(Nystroem; the sketch has ``EXTRA`` columns more than are kept).  Only words of the benchmark have coordinates; the others count in the
length of a passage.  Windows of 16, 32, ... words over every whole document
(of 8 too for items of fewer than ``FINE``) are compared with all items by
cosine in blocks, whatever else they hold.  Left out are only the windows around
which no item can pass the check below, as too few of its rarest words are there
(``Rarest``; exact at any size of the corpus).  Candidates must then hold the
item's words in order (longest common subsequence), almost all of them or, as a
paraphrase, most of them and of the item's end (the answer).

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, so what is
broadcast is bounded; a larger benchmark takes more passes over the documents.

Defined cases: null and empty texts hold nothing; items without words are in
nothing, and items of fewer than ``SHORT`` words must occur whole, for which they
are looked up as they are, with a cosine of 1; repeated
items and documents each give their own rows; doc_id may be null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import packed
from .session import bounded_batches, parts_of, streamed

RANK = 224
EXTRA = 32  # columns of the sketch beyond the rank
BLOCK_BYTES = 1 << 20
PASSAGE = 32
LEAST_WINDOW = 8  # they double up to the longest item
RAREST = (0.2, 0.1, 0.3)  # of an item's words must be among its rarest words, see Rarest
FINE = 32  # items of fewer words are compared with the least windows
SPARSE = 0.1  # passages of less coverage are nothing to the decomposition
COSINE = 0.5
NEARLY_ALL, MOST, ANSWER = 0.8, 0.6, 0.6
SHORT = 8
ITEM_WEIGHT = 4.0
SLICE = 1 << 19
SKETCH_SLICE = 1 << 18
PRESENT = 1 << 23  # cells of a table of documents by words
ROWS = 512  # passages with latent vectors at once
GROUP = 1 << 15  # words of which the windows get latent vectors at once
SCHEMA = "doc_id long, item_id long, cosine double, lcs long, item_words long, share double, answer_share double"
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; words of punctuation alone are left out."""
    low = K.folded(buf)
    start, end, doc = K.word_spans(low, off)
    if not len(start):
        return np.zeros(0, np.uint64), doc
    last, first = np.flatnonzero(PUNCTUATION[low[end - 1]]), np.flatnonzero(PUNCTUATION[low[start]])
    if len(last) or len(first):
        for _ in range(4):
            end[last] -= 1
            last = last[end[last] > start[last]]
            last = last[PUNCTUATION[low[end[last] - 1]]]
            first = first[start[first] < end[first]]
            first = first[PUNCTUATION[low[start[first]]]]
            start[first] += 1
        ok = end > start
        start, end, doc = start[ok], end[ok], doc[ok]
    return K.Hasher(low)(start, end), doc


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit of a long integer for each word of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    ids: list
    texts: list[np.ndarray]  # hashes of the words of each item
    keys: np.ndarray  # sorted hashes of all words of the benchmark

    @classmethod
    def of(cls, ids: list, column: pa.Array) -> Items:
        texts = []
        for a, b, buf, off in K.slices(column):
            h, doc = words(buf, off)
            texts += np.split(h, np.searchsorted(doc, np.arange(1, b - a)))
        return cls(ids, texts, np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint64))


class Windows:
    """Weights and places of the words of one slice."""

    def __init__(self, look: K.Lookup, h: np.ndarray, doc: np.ndarray):
        self.at, self.key = look.hits(h)
        self.words = len(h)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=int(doc[-1]) + 1 if len(doc) else 0))])

    def weigh(self, idf: np.ndarray, rare: float) -> Windows:
        """With weights, and the running sums of their squares, of all words and of the benchmark's."""
        self.weight = np.full(self.words, rare)
        self.weight[self.at] = idf[self.key]
        self.square = np.concatenate([[0], np.cumsum(self.weight * self.weight)])
        inside = np.zeros(self.words)
        inside[self.at] = self.weight[self.at] ** 2
        self.inside = np.concatenate([[0], np.cumsum(inside)])
        return self

    def cut(self, size: int, stride: int, coverage: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, begin and end (word numbers) of the windows with enough words of the benchmark."""
        n = np.diff(self.first)
        each = np.where(n > 0, np.maximum(1, -(-(n - size) // stride) + 1), 0)
        doc = np.repeat(np.arange(len(n)), each)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        begin = self.first[doc] + k * stride
        end = np.minimum(begin + size, self.first[doc + 1])
        ok = self.inside[end] - self.inside[begin] >= coverage * (self.square[end] - self.square[begin])
        ok &= self.inside[end] > self.inside[begin]
        return doc[ok], begin[ok], end[ok]

    def entries(self, begin: np.ndarray, end: np.ndarray):
        """(row, key, place) of the words of the benchmark in some windows, rows in order."""
        lo, hi = np.searchsorted(self.at, begin), np.searchsorted(self.at, end)
        n = hi - lo
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) + np.repeat(lo - (np.cumsum(n) - n), n)
        return row, self.key[at], self.at[at]

    def groups(self, most: int, live: np.ndarray):
        """(text, begin, end) of the texts with windows at live words by about GROUP words; of longer ones, pieces that share most words."""
        n = np.diff(self.first)
        step = max(GROUP, 2 * most)
        each = np.where(n > 0, np.maximum(1, -(-(n - most) // step)), 0)
        doc = np.repeat(np.arange(len(n)), each)
        begin = self.first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * step
        end = np.minimum(begin + step + most, self.first[doc + 1])
        live = np.concatenate([[0], np.cumsum(live)])
        ok = live[end] > live[begin]
        doc, begin, end = doc[ok], begin[ok], end[ok]
        group = (np.cumsum(end - begin) - 1) // step
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                yield doc[part], begin[part], end[part]

    def latent(self, scaled: np.ndarray, begin: np.ndarray, end: np.ndarray, live: dict[int, np.ndarray]):
        """(size, text number, begin, latent vector) of the live windows of each size over some texts.

        Windows overlap by half, so each is the sum of two cells, and two cells are one of the next size.
        """
        cell = LEAST_WINDOW // 2
        n = -(-(end - begin) // cell)
        row, key, at = self.entries(begin, end)
        most = max(live)
        sums = np.concatenate([[0], np.cumsum(live[most])])
        used = sums[at + 1] > sums[np.maximum(at + 1 - most, 0)]  # words in live windows
        row, key, at = row[used], key[used], at[used]
        place = (np.cumsum(n) - n)[row] + (at - begin[row]) // cell
        cells, slot = _summed(scaled, key, place, int(n.sum()))
        while True:
            # slot: the row of each cell in cells; the first row is nothing
            first, text = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            k = np.arange(len(text)) - first[text]
            more = k + 1 < n[text]
            at = begin[text] + k * cell
            beside = np.where(more, np.r_[slot[1:], 0], 0) if len(slot) else slot
            one = np.flatnonzero((more | (k == 0)) & live[2 * cell][at] & ((slot > 0) | (beside > 0)))
            yield 2 * cell, text[one], at[one], _added(cells, slot[one], beside[one])
            if 2 * cell >= most:
                break
            even = np.flatnonzero(k % 2 == 0)
            a, b = slot[even], beside[even]
            full = (a > 0) | (b > 0)
            cells = np.concatenate([cells[:1], _added(cells, a[full], b[full])])
            slot = np.where(full, np.cumsum(full), 0)
            n, cell = -(-n // 2), 2 * cell


def _added(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = rows.take(a, axis=0)
    some = np.flatnonzero(b)
    if 2 * len(some) > len(b):
        out += rows.take(b, axis=0)
    else:
        out[some] += rows.take(b[some], axis=0)
    return out


def _summed(scaled: np.ndarray, key: np.ndarray, place: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows scaled[key] of each place (places in order), and the row of every place; row 0 is zero.

    Places are taken by their number of keys, largest first, so the j-th keys are added in one go.
    """
    slot = np.zeros(places, np.int64)
    cut = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else place
    size = np.diff(np.r_[cut, len(place)])
    order = np.argsort(-size, kind="stable")
    cut, size = cut[order], size[order]
    out = np.zeros((len(cut) + 1, scaled.shape[1]), np.float32)
    if len(cut):
        slot[place[cut]] = np.arange(1, len(cut) + 1)
        scaled.take(key[cut], axis=0, out=out[1:], mode="clip")
        held = np.empty((int((size > 1).sum()), scaled.shape[1]), np.float32)
        for j in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -j, "left"))  # places of more than j keys
            scaled.take(key[cut[:m] + j], axis=0, out=held[:m], mode="clip")
            out[1 : m + 1] += held[:m]
    return out, slot


class Short:
    """Where items of fewer than SHORT words stand word by word."""

    def __init__(self, items: Items):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SHORT):
            item = np.array([i for i, t in enumerate(items.texts) if len(t) == n], np.int64)
            if len(item):
                key = self.joined(np.stack([items.texts[i] for i in item]).T)
                order = np.argsort(key, kind="stable")
                self.by[n] = key[order], item[order]

    @staticmethod
    def joined(columns) -> np.ndarray:
        """One hash for the words that stand beside each other in some columns."""
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
        return key

    def found(self, h: np.ndarray, doc: np.ndarray):
        """(text, item, begin, end) of the first place of every such item in every text."""
        for n, (keys, items) in self.by.items():
            m = len(h) - n + 1
            if m < 1:
                continue
            key = self.joined([h[i : i + m] for i in range(n)])
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            at = np.flatnonzero((hi > lo) & (doc[:m] == doc[n - 1 :]))
            _, first = np.unique(np.stack([doc[at], lo[at]]), axis=1, return_index=True)
            for b in at[first].tolist():
                for t in items[lo[b] : hi[b]].tolist():
                    yield int(doc[b]), t, b, b + n


class Rarest:
    """Where so many of an item's rarest words stand that it may be found there.

    A leak has at least MOST of the n words of an item in order.  Of the ``n - MOST n + m``
    rarest ones at least m are then there, whatever the others are.
    """

    def __init__(self, items: Items, idf: np.ndarray, share: float):
        self.length = np.array([len(t) for t in items.texts])
        self.least = np.ceil(share * self.length - 1e-9).astype(np.int64)  # m of each item
        count = self.length - np.ceil(MOST * self.length - 1e-9).astype(np.int64) + self.least
        key, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(items.texts):
            k = np.searchsorted(items.keys, t)
            k = np.unique(k[np.argsort(-idf[k], kind="stable")][: count[i]])
            key.append(k)
            item.append(np.full(len(k), i))
        key, item = np.concatenate(key), np.concatenate(item)
        order = np.argsort(key, kind="stable")
        self.item = item[order]
        self.head = np.searchsorted(key[order], np.arange(len(items.keys) + 1))

    def places(self, w: Windows) -> np.ndarray:
        """Item and word number of every such word of a slice as one number, in order."""
        head = self.head[w.key]
        n = self.head[w.key + 1] - head
        item = self.item[np.arange(int(n.sum())) + np.repeat(head - (np.cumsum(n) - n), n)]
        return np.sort(item * w.words + np.repeat(w.at, n))

    def runs(self, w: Windows, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first and last word number of runs of m such words in a text."""
        item, at = np.divmod(places, max(1, w.words))
        last = np.arange(len(item)) + self.least[item] - 1
        ok = last < len(item)
        item, at, last = item[ok], at[ok], last[ok]
        end = places[last] - item * w.words
        ok = end < w.first[np.searchsorted(w.first, at, "right")]  # also of the same item: others are a slice away
        return item[ok], at[ok], end[ok]

    def live(self, runs: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, n: int) -> np.ndarray:
        """Whether a window of a size that begins at a word has such a run around it."""
        item, at, end = runs
        low, high = np.maximum(end - self.length[item] - size + 1, 0), np.minimum(at + self.length[item], n - 1) + 1
        ok = low < high
        return np.cumsum(np.bincount(low[ok], minlength=n + 1) - np.bincount(high[ok], minlength=n + 1))[:n] > 0


def _sketch(w: Windows, omega: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A omega) of the passages of a slice to total, a block of passages at a time."""
    _, begin, end = w.cut(PASSAGE, PASSAGE, SPARSE)
    for i in range(0, len(begin), ROWS):
        _sketch_rows(w, omega, total, begin[i : i + ROWS], end[i : i + ROWS])


def _sketch_rows(w: Windows, omega: np.ndarray, total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
    row, key, at = w.entries(begin, end)
    weight = (w.weight[at] / np.sqrt(w.square[end] - w.square[begin])[row]).astype(np.float32)
    y = np.add.reduceat(omega[key] * weight[:, None], np.flatnonzero(np.r_[True, np.diff(row) > 0]), axis=0)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
    total[key[order][cut]] += np.add.reduceat(y[row[order]] * weight[order][:, None], cut, axis=0)


def _partial(fn):
    """mapInArrow function with one (part, vec) row for each partition: fn(batches) -> array or None."""

    def run(batches):
        from pyspark import TaskContext

        total = fn(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "vec"])

    return run


@dataclass
class Model:
    items: Items
    idf: np.ndarray
    rare: float
    basis: np.ndarray
    vectors: np.ndarray
    ready: tuple | None = None

    def leaks(self, column: pa.Array):
        """(row, item, cosine, lcs, share, answer share) of the items found."""
        look, mark = K.Lookup(self.items.keys), np.zeros(len(self.items.keys), np.int64)
        length = np.array([len(t) for t in self.items.texts])
        longest = max(int(length.max()), LEAST_WINDOW)
        most = LEAST_WINDOW
        while most < longest:
            most *= 2
        if self.ready is None:  # once a worker
            self.ready = [Rarest(self.items, self.idf, x) for x in RAREST], Short(self.items), self.basis * self.idf[:, None].astype(np.float32)
        every_rarest, short, scaled = self.ready
        rarest = every_rarest[0]
        some = np.flatnonzero((length > 0) & (length < FINE))
        every = np.flatnonzero(length > 0)
        for a, _, buf, off in K.slices(column, SLICE):
            h, doc = words(buf, off)
            if not len(h):
                continue
            w = Windows(look, h, doc)
            places, live = rarest.places(w), {}
            for r in every_rarest:
                runs = r.runs(w, places if r is rarest else r.places(w))
                size = LEAST_WINDOW
                while size <= most:
                    there = r.live(runs, size, len(h))
                    live[size] = live[size] & there if size in live else there
                    size *= 2
            near: dict[tuple[int, int], list] = {}
            for d, t, b, e in short.found(h, doc):
                near[d, t] = [(1.0, b, e)]
            for of, lo, hi in w.groups(most, live[most]):
                for size, text, b, v in w.latent(scaled, lo, hi, live):
                    items = some if size == LEAST_WINDOW else every
                    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                    some_word = np.flatnonzero(norm > 1e-9)
                    if not len(items) or not len(some_word):
                        continue
                    text, b, norm = text[some_word], b[some_word], norm[some_word]
                    s = v[some_word] @ self.vectors[items].T
                    r, t = np.nonzero(s >= (COSINE * norm)[:, None])
                    cosine, t = s[r, t] / norm[r], items[t]
                    of_, b, e = of[text[r]], b[r], np.minimum(b[r] + size, hi[text[r]])
                    low, high = np.maximum(b - length[t], w.first[of_]), np.minimum(e + length[t], w.first[of_ + 1])
                    ok = np.searchsorted(places, t * len(h) + high) - np.searchsorted(places, t * len(h) + low) >= rarest.least[t]
                    for c, d, i, x, y in zip(cosine[ok].tolist(), of_[ok].tolist(), t[ok].tolist(), b[ok].tolist(), e[ok].tolist(), strict=True):
                        near.setdefault((d, i), []).append((c, x, y))
            for (d, t), found in near.items():
                best = self.check(w, d, t, found, mark)
                if best:
                    yield (a + d, t, max(f[0] for f in found), *best)

    def check(self, w: Windows, d: int, t: int, found: list, mark: np.ndarray) -> tuple[int, float, float] | None:
        """Longest common subsequence and answer of an item around its candidate windows.

        Only the words that are the item's can count, and no more of them than it has of each.
        """
        item = np.searchsorted(self.items.keys, self.items.texts[t])
        own, number = np.unique(item, return_counts=True)
        n, lo, hi = len(item), int(w.first[d]), int(w.first[d + 1])
        mark[own] = np.arange(1, len(own) + 1)
        i, j = np.searchsorted(w.at, (lo, hi))
        word = mark[w.key[i:j]]
        mark[own] = 0
        at, word = w.at[i:j][word > 0], word[word > 0] - 1
        item = np.searchsorted(own, item).tolist()
        answer = item[-max(3, n // 5) :]
        best, done = None, set()
        for _, b, e in sorted(found, reverse=True):
            i, j = (int(x) for x in np.searchsorted(at, (max(lo, b - n), min(hi, e + n))))
            least = max(MOST * n - 1e-9, best[0] + 1 if best else 0)
            if (i, j) in done or j - i < least:
                continue
            done.add((i, j))
            if np.minimum(np.bincount(word[i:j], minlength=len(own)), number).sum() < least:
                continue
            near = word[i:j].tolist()
            got = lcs(item, near)
            if got < least:
                continue
            share, end = got / n, lcs(answer, near) / len(answer)
            leak = share >= NEARLY_ALL or share >= MOST and end >= ANSWER
            if got == n if n < SHORT else leak:
                best = (got, share, end)
                if got == n:
                    break
        return best


class Weighted:
    """TF-IDF of the items, of length 1, as a sparse matrix (items by words)."""

    def __init__(self, items: Items, idf: np.ndarray):
        self.count, self.size = len(items.texts), len(idf)
        row = np.repeat(np.arange(self.count), [len(t) for t in items.texts])
        key = np.searchsorted(items.keys, np.concatenate(items.texts))
        code, n = np.unique(row * self.size + key, return_counts=True)
        self.row, self.key = np.divmod(code, self.size)
        weight = n * idf[self.key]
        norm = np.sqrt(np.bincount(self.row, weight * weight, minlength=self.count))
        self.weight = (weight / norm[self.row]).astype(np.float32)[:, None]

    @staticmethod
    def _added(rows: int, to: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of the values by row; to is in order."""
        out = np.zeros((rows, values.shape[1]), np.float32)
        if len(to):
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            out[to[cut]] = np.add.reduceat(values, cut, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._added(self.count, self.row, dense[self.key] * self.weight)

    def back(self, dense: np.ndarray) -> np.ndarray:
        """The transposed matrix times a dense one."""
        order = np.argsort(self.key, kind="stable")
        return self._added(self.size, self.key[order], dense[self.row[order]] * self.weight[order])


def singular_vectors(y: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A with the largest singular values, from the sketch y = A'A omega.

    Nystroem's approximation of A'A, shifted a little to be safely positive definite.
    """
    y, omega = y.astype(np.float64), omega.astype(np.float64)
    shift = 1e-6 * np.linalg.norm(y)  # the sketch is in single precision
    moved = y + shift * omega
    core = omega.T @ moved
    values, turn = np.linalg.eigh((core + core.T) / 2)
    ok = values > shift / 2
    half = moved @ (turn[:, ok] / np.sqrt(values[ok]))
    left, size, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, :rank][:, (size * size - shift > 1e-3 * shift)[:rank]]


def fit(docs: DataFrame, items: Items, rank: int = RANK) -> Model | None:
    """IDF weights and latent space from all documents and one block of the benchmark."""
    size = len(items.keys)
    if not size:
        return None
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("text")
    n_parts = parts_of(texts)
    keys = spark.sparkContext.broadcast(items.keys)

    def frequencies(batches):
        look, total = K.Lookup(keys.value), np.zeros(size + 1)
        for batch in batches:
            for a, b, buf, off in K.slices(batch.column(0)):
                h, doc = words(buf, off)
                at, key = look.hits(h)
                if (b - a) * size <= PRESENT:
                    present = np.zeros((b - a, size), bool)
                    present[doc[at], key] = True
                    total[:-1] += present.sum(0)
                else:  # very many short texts
                    total[:-1] += np.bincount(np.unique(doc[at] * np.int64(size) + key) % size, minlength=size)
                total[-1] += b - a
        return total

    df = packed.summed(texts.mapInArrow(streamed(_partial(frequencies)), "part long, vec binary"), n_parts)
    df = np.zeros(size + 1) if df is None else df
    count = df[-1] + len(items.ids)
    idf = np.log((count + 1) / (df[:-1] + 1)) + 0.1
    rare = float(np.log(count + 1) + 0.1)
    omega = np.linalg.qr(np.random.default_rng(11).standard_normal((size, min(rank + EXTRA, size))))[0].astype(np.float32)
    sent = spark.sparkContext.broadcast((items.keys, idf, rare, omega))

    def sketch(batches):
        keys, idf, rare, omega = sent.value
        look, total = K.Lookup(keys), np.zeros_like(omega)
        for batch in batches:
            for _, _, buf, off in K.slices(batch.column(0), SKETCH_SLICE):
                h, doc = words(buf, off)
                if len(h):
                    _sketch(Windows(look, h, doc).weigh(idf, rare), omega, total)
        return total if total.any() else None

    total = packed.summed(texts.mapInArrow(streamed(_partial(sketch)), "part long, vec binary"), n_parts, fan_in=8, kind=np.float32)
    own = Weighted(items, idf)
    mine = own.back(own.times(omega))
    y = mine * (ITEM_WEIGHT / max(np.linalg.norm(mine), 1e-9))
    if total is not None:
        y = y + (total / max(np.linalg.norm(total), 1e-9)).reshape(omega.shape)
    basis = singular_vectors(y, omega, rank).astype(np.float32)
    vectors = own.times(basis)
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-9)
    return Model(items, idf, rare, basis, vectors.astype(np.float32))


def item_blocks(benchmark: DataFrame):
    """The benchmark in blocks of about BLOCK_BYTES, on the driver one after another."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        yield Items.of(got["item_id"].to_pylist(), got["text"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and evidence for every item found in a document."""
    spark, found = docs.sparkSession, None
    for items in item_blocks(benchmark):
        model = fit(docs, items)
        if model is None:
            continue
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            m = shared.value
            for batch in batches:
                rows = list(m.leaks(batch.column("text")))
                who = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [who, pa.array([m.items.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([len(m.items.texts[r[1]]) for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64()), pa.array([r[5] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "lcs", "item_words", "share", "answer_share"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(streamed(run), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Every block of the benchmark is weighed by all documents that came in, so that
    this keeps what `leaks` doesn't find, and no block repeats the search of others.
    """
    spark, at, kept = docs.sparkSession, docs.columns.index("text"), docs
    for items in item_blocks(benchmark):
        model = fit(docs, items)
        if model is None:
            continue
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in shared.value.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(streamed(run), docs.schema)
    return kept
