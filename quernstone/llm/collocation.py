"""Phrase collocation mining: n-grams that hold together better than chance, by language.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and
those into words.  The n-grams of the pieces become rows (lang, phrase, c), counted
within a block of text first, and are hash-aggregated by language with partial sums
before the shuffle.  That goes level by level, from words to max_n-grams: a phrase
occurs at most as often as what lies inside it, so of n-grams only those become rows
whose two (n-1)-grams are frequent, as far as a table of bits of their hashes can
tell (``MAX_BITS`` bounds the table that tasks get; it lets too many through, never
too few).  Counts of what is kept are complete.

A candidate has 2 to max_n words and at least ``least`` occurrences a.  Cutting it
after k words gives the counts l and r of both parts, joined from the same counts;
a part is as frequent as its phrase, so it is there.  The score ``floor(1000000 * a
* a / (l * r))`` is found in Decimal(38, 0), exact up to 10^16 occurrences; the
least cut counts, of equal ones the first.

A candidate inside a longer phrase that has half of its occurrences goes.  If
any longer one has, so has one that is longer by one word (what lies between
them occurs at least as often as the longer), so an anti-join with one-word
extensions is enough.

The first ``top`` of a language are ranked in two steps: in each of ``CELLS``
cells of phrases, then among what those kept, which is bounded.  Parts that very
many candidates share are joined apart, by a broadcast of at most ``HOT`` rows.

Defined cases: a null text is empty; a null lang is ``und``; a text without words
adds nothing; repeated rows count each; scores that tie are ranked by a, then by
the bytes of the phrase; an empty table gives an empty result; other columns of
any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .session import bounded_batches, cut, partitions, streamed

MAX_N = 3
LEAST = 10
SHARE = 50  # of 100 occurrences, from which a longer phrase stands for a shorter one
TOP = 2000
CELLS = 64
HOT = 2048  # parts that are joined by broadcast have more than this part of all requests
BLOCK = 4 << 20  # bytes of text that are counted together
MAX_BITS = 27  # the table of bits has at most 2^27 of them, 16 MB
GRAMS = "lang string, phrase string, c long"

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space, _break = np.zeros(256, bool), np.zeros(256, bool)
_space[[0x20, 0x09]] = True
_break[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_odd = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    h = (h ^ word) * _odd
    return h ^ (h >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of stretches of about BLOCK bytes that end with a piece; at: where texts begin."""
    start = 0
    while start < len(data):
        stop = start + BLOCK
        if stop < len(data):
            k = int(np.searchsorted(at, stop))  # the next text, or an end of a piece before it
            limit = int(at[k]) if k < len(at) else len(data)
            while stop < limit:
                found = np.flatnonzero(_break[data[stop : min(stop + BLOCK, limit)]])
                if len(found):
                    stop += int(found[0])
                    break
                stop = min(stop + BLOCK, limit)
        stop = min(stop, len(data))
        yield start, stop
        start = stop


def counted(data: np.ndarray, at: np.ndarray, lang: np.ndarray, langs: pa.Array, n: int, table: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase, c of the n-grams of some bytes; texts begin at `at` and have the languages `lang`."""
    data = _lower[data]
    first = np.zeros(len(data), bool)
    first[at[at < len(data)]] = True
    breaks = _break[data]
    inside = ~(breaks | _space[data])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if len(starts) < n:
        return pa.RecordBatch.from_pylist([], pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())]))
    piece = np.cumsum(breaks | first)[starts]
    ends = np.append((np.cumsum(inside) - inside)[starts], inside.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
    word, known = words.indices.to_numpy(), words.dictionary
    of = lang[np.searchsorted(at, starts, "right") - 1]
    last = len(starts) - n + 1
    keep = piece[:last] == piece[n - 1 :]
    if table is not None:
        h, seed = _hashes(known)[word], _hashes(langs.cast(pa.large_binary()))[of]
        shift = np.uint64(64 - (len(table) * 8).bit_length() + 1)
        for side in (0, 1):  # the (n-1)-grams at either end
            slot = seed[:last]
            for k in range(side, side + n - 1):
                slot = _mixed(slot, h[k : k + last])
            slot = slot >> shift
            keep &= (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    where = np.flatnonzero(keep)
    key, size = of[where].astype(np.int64), max(len(langs), 1)
    for k in range(n):
        if size > (1 << 62) // max(len(known), 1):
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max(initial=0)) + 1
        key, size = key * len(known) + word[where + k], size * max(len(known), 1)
    _, one, c = np.unique(key, return_index=True, return_counts=True)
    some = where[one]
    parts = [known.take(pa.array(word[some + k])) for k in range(n)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(of[some])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(c.astype(np.int64))], ["lang", "phrase", "c"])


def grams(docs: DataFrame, n: int, table: Broadcast | None = None) -> DataFrame:
    """lang, phrase, c: n-grams and how often they are in a block of text; with a table, only those that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else table.value
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            text = batch.column(1).cast(pa.large_binary())
            lang, at = codes.indices.to_numpy(), np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            at = at[:-1] - at[0]
            filled = np.append(np.diff(at) > 0, at[-1:] < len(data))  # of texts that begin at one place the last has the bytes
            at, lang = at[filled], lang[filled]
            for start, stop in _blocks(data, at):
                a, b = int(np.searchsorted(at, start, "right")) - 1, int(np.searchsorted(at, stop))
                yield counted(data[start:stop], np.maximum(at[a:b] - start, 0), lang[a:b], codes.dictionary, n, bits)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(streamed(run), GRAMS)


def counts(docs: DataFrame, n: int, table: Broadcast | None = None) -> DataFrame:
    """lang, phrase, words (n), a: occurrences of n-grams."""
    return grams(docs, n, table).groupBy("lang", "phrase").agg(F.sum("c").alias("a")).select("lang", "phrase", F.lit(n).alias("words"), "a")


def bits(frequent: DataFrame) -> Broadcast:
    """Table of bits of the hashes of (lang, phrase); a power of two of them, about 16 a phrase."""
    size = min(MAX_BITS, max(10, (16 * frequent.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lang = _hashes(batch.column(0)), None
            for k, phrase in enumerate(batch.column(1).to_pylist()):
                lang = h[k : k + 1]
                for w in _hashes(pa.array(phrase.split(" "))):
                    lang = _mixed(lang, w)
                h[k] = lang[0]
            slot = (h >> np.uint64(64 - size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64))], ["cell", "mask"])

    cells = frequent.select("lang", "phrase").mapInArrow(run, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
    found = np.zeros((1 << size) >> 6, np.int64)
    for batch in cells.toArrow().to_batches():  # at most 2^(MAX_BITS - 6) rows
        found[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(found.view(np.uint8))


def _looked_up(rows: DataFrame, asked: DataFrame, known: DataFrame, part: str, name: str, most: int) -> DataFrame:
    """rows with the count of (lang, part) as `name`; parts that over `most` rows of asked share don't meet in one task."""
    hot = asked.groupBy("lang", F.col(part).alias("phrase")).agg(F.count("*").alias("asks")).where(F.col("asks") > most)
    hot = hot.join(known, ["lang", "phrase"]).select("lang", F.col("phrase").alias(part), F.col("a").alias("hot"))
    rows = rows.join(F.broadcast(hot), ["lang", part], "left")
    # no phrase begins with a space: rows that have their count are spread and find nothing
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), "phrase")))
    found = rows.join(known.select("lang", F.col("phrase").alias("key"), F.col("a").alias("found")), ["lang", "key"], "left")
    return found.withColumn(name, F.coalesce("hot", "found")).drop("key", "hot", "found")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, score, l, r of candidates, by their lowest-scoring cut."""
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    parts = frequent.where("words > 1").coalesce(partitions(frequent.sparkSession)).select("lang", "phrase", "words", "a", k)
    parts = cut(parts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - words)")}))
    known, most = frequent.select("lang", "phrase", "a"), parts.count() // HOT + 1  # so fewer than HOT parts are hot
    parts = _looked_up(_looked_up(parts, parts, known, "head", "l", most), parts, known, "tail", "r", most)
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.call_function("div", big["a"] * big["a"] * F.lit(1_000_000), big["l"] * big["r"])
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return parts.groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "cut.score", "cut.l", "cut.r")


def covered(frequent: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a phrase that is longer by one word at either end."""
    longer = frequent.where("words > 2")
    inner = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    return longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    words = cut(counts(docs, 1))
    n = words.groupBy("lang").agg(F.sum("a").alias("n"))
    levels = [words.where(F.col("a") >= least)]
    for k in range(2, max_n + 1):
        levels.append(cut(counts(docs, k, bits(levels[-1])).where(F.col("a") >= least)))
    frequent = reduce(DataFrame.unionByName, levels)
    kept = scored(frequent).join(covered(frequent), ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share)).drop("most", "words")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    cells = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(CELLS))).orderBy(*order)
    first = kept.withColumn("place", F.row_number().over(cells)).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
cuts AS (SELECT lang, words, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
         FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (SELECT x.lang, x.words, x.phrase, x.a, k, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words
           AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
