"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, batch string, score string, key string, rank string"


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rng = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def texts() -> list[tuple]:
    """(doc_id, text)"""
    shared = words(1000, 80)
    rows = [(i, words(i, 40 + 7 * i)) for i in range(20)]
    rows += [(30 + i, words(3, 61)) for i in range(3)]  # equal texts
    rows += [(40 + i, edited(words(77, 300), i, i % 9)) for i in range(24)]  # near copies
    rows += [(70 + i, words(500 + i, 60) + "\n" + shared + "\n" + words(600 + i, 50)) for i in range(20)]  # one passage
    rows += [(100, None), (101, ""), (102, "  \n"), (103, "One"), (104, "one"), (105, "A b c d"), (106, "a b c d"), (107, "a b c d e"), (108, "é ß — 漢字 ñ")]
    rows += [(110, words(9, 20_000)), (111, "Orre " * 3000), (112, "x" * 5000), (113, "123 456 !!!")]
    rows += [(120, "null id twin"), (None, "null id twin"), (None, "alone without id"), (5, words(5, 75)), (5, words(5, 75))]
    return rows


def documents(spark, rows=None):
    rng = random.Random(1)
    rows = texts() if rows is None else rows
    full = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None, "ä", "Z"]), 0, "h", "b", "s", "k", "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
