"""Packing, fill-in-the-middle and phrases against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import canonical
from quernstone.llm import collocation, infill, packing, queries

from . import data

SMALL = "/root/testdata/sf0.001"


# ---- packing


def pieces_of(rows, capacity=2048):
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for i, text in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        at, k, stop = 0, 0, len(ids) % capacity or capacity
        while at < len(ids):
            yield i, k, at, stop - at, zlib.crc32(np.asarray(ids[at:stop], "<u4").tobytes())
            at, k, stop = stop, k + 1, stop + capacity


def check_places(got, capacity=2048):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_all_documents(spark):
    got = queries.op11_best_fit_packing(spark, SMALL).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = Counter(pieces_of(rows))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins, total = check_places(got), sum(p[3] * n for p, n in want.items())
    assert bins <= math.ceil(total / 2048) + 3


def test_packing_of_odd_rows(spark):
    rows = [*data.texts(), (200, "<|endoftext|> x <|endoftext|>"), (201, " " * 400_000 + "x"), (202, "漢字 é\u0000\u0085 a\r\n\t 's"), (203, "y" * 50_000)]
    got = packing.packed(data.documents(spark, rows), capacity=300).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(pieces_of(rows, 300))
    check_places(got, 300)
    assert packing.packed(data.empty(spark)).count() == 0
    joined = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(data.documents(spark, rows), capacity=300).collect()}
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sorted(joined.values()) == sorted(sizes.values())


def test_the_encoder_is_the_tokenizer():
    own, encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(1)
    draw = [lambda: rng.randrange(32, 127), lambda: rng.randrange(160, 0x600), lambda: rng.randrange(0x2000, 0x3100), lambda: rng.randrange(0x1F300, 0x1F600), lambda: rng.choice([9, 10, 13, 32, 39])]
    for _ in range(1500):
        text = "".join(chr(rng.choice(draw)()) for _ in range(60))
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["spread", "thirds", "large", "one", "few", "hot"])
def test_plans_hold_every_piece_in_few_bins(kind):
    rng, cap = random.Random(kind), 2048
    draw = {"spread": lambda: rng.randrange(1, cap + 1), "thirds": lambda: rng.choice([682, 683, 700, 648]), "large": lambda: rng.randrange(1100, cap + 1), "one": lambda: 700, "few": lambda: rng.choice([1, 2047, 5]), "hot": lambda: 683 if rng.random() < 0.4 else rng.randrange(1, 900)}[kind]
    histogram = Counter(draw() for _ in range(1 if kind == "one" else 9000))
    plan, held = packing.solve(dict(histogram), cap), Counter()
    for content, copies in plan:
        assert sum(n * t for n, t in content.items()) <= cap
        for n, t in content.items():
            held[n] += t * copies
    assert held == histogram
    bins = sum(c for _, c in plan)
    floor = max(math.ceil(sum(n * c for n, c in histogram.items()) / cap), sum(c for n, c in histogram.items() if n > cap // 2))
    best = sum(c for _, c in packing.best_fit([], dict(histogram), cap))
    assert floor <= bins <= best * 1.005 + 2
    ranks = Counter()
    for length, first, stop, times, _, _ in packing.slots(plan):
        assert first == ranks[length] and (stop - first) % times == 0
        ranks[length] = stop
    assert ranks == histogram


def test_the_knapsack_by_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.randrange(5, 40)
        lengths = np.array(sorted(rng.sample(range(1, cap + 1), rng.randrange(1, 6))))
        value = np.array([rng.random() for _ in lengths])
        best, last = packing.knapsack(lengths, value, cap)
        want = [0.0] * (cap + 1)
        for w in range(1, cap + 1):
            want[w] = max([want[w - 1], *(want[w - n] + v for n, v in zip(lengths, value) if n <= w)])
        assert np.allclose(best, want)
        found = packing.configuration(last, lengths, cap)
        assert sum(int(lengths[k]) * n for k, n in found.items()) <= cap
        assert math.isclose(sum(float(value[k]) * n for k, n in found.items()), want[cap])


# ---- fill in the middle


def infilled(i, text, seed=1, rate=90, suffix_first=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    return i, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def digests(row):
    return (*row[:5], *(hashlib.sha256(t.encode()).hexdigest() for t in row[5:]))


def test_infill_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {tuple(r) for r in queries.op12_fill_in_middle(spark, folder).collect()}
    assert got == {digests(infilled(r.doc_id, r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_infill_of_odd_rows(spark):
    odd = ["<P>", "a <M> b", "< P >", "<", "<P", "S>x<", "漢字 é word\r\n\u0085 \U0001f600end", "x" * 9000 + "é" * 9000, "a" * 3_000_000 + " b", "\n\n\n", "1"]
    rows = [*data.texts(), *((1000 + 50 * k + i, t) for i, t in enumerate(odd) for k in range(40))]
    docs = data.documents(spark, rows).withColumn("n", F.lit("n")).withColumn("form", F.lit("f"))
    got = infill.fill_in_middle(docs)
    out = got.withColumn("back", infill.restored(F.col("form"), F.col("output")))
    want = Counter((*r[:5], r[5], r[6]) for r in (infilled(i, t) for i, t in rows))
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r) for r in infill.infill_query(docs).collect()) == Counter({digests(k): n for k, n in want.items()})
    assert infill.infill_query(data.empty(spark)).count() == 0
    other = {r.doc_id: r.output for r in infill.fill_in_middle(docs, seed=7, rate=50, suffix_first=90).collect() if r.doc_id}
    assert all(other[i] == infilled(i, t, 7, 50, 90)[5] for i, t in rows if i and i >= 1000)


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_the_index_finds_every_unit(block):
    rng = random.Random(block)
    for every in (1, 2, 7, 256):
        for _ in range(30):
            text = "".join(rng.choice(["word", "a", " ", "é", "漢", "\U0001f600", ".", "longerword" * 9]) for _ in range(rng.randrange(40)))
            index = infill.UnitIndex(np.frombuffer(text.encode(), np.uint8), every, block)
            units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
            assert (index.units, index.chars) == (len(units), len(text)) and len(index.bytes_at) == -(-len(units) // every)
            for u, c in enumerate([*units, len(text)]):
                assert index.cut(u) == (len(text[:c].encode()), c)


# ---- phrases


def mined(rows, max_n=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = (b for q, b in some.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * b >= share * a for b in inside):
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_of_all_documents(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert canonical(queries.op13_collocations(spark, folder).toPandas()) == canonical(con.execute(collocation.SQL).df())


def phrase_rows():
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr", None, ""]), " ".join(rng.choice("abcdeé") * rng.choice([1, 1, 2]) + rng.choice(["", "", ".", ",", "\n", "\t", "  ", "!"]) for _ in range(rng.randrange(120)))) for _ in range(60)]
    rows += [("en", None), ("fr", ""), ("en", " \n"), ("und", "A b A b A B" * 9), ("en", "The x y " * 500), ("en", " w  w  " * 30), ("de", "Z" * 70_000 + " q")]
    return rows


@pytest.mark.parametrize("max_n,least,share,top,block,bits", [(3, 10, 50, 2000, 1 << 22, 27), (4, 4, 80, 7, 50, 27), (2, 2, 1, 5, 7, 10), (5, 3, 100, 2000, 1 << 22, 10)])
def test_phrases_by_brute_force(spark, monkeypatch, max_n, least, share, top, block, bits):
    """Whatever the blocks of text and however full the table of bits is."""
    monkeypatch.setattr(collocation, "BLOCK", block)
    monkeypatch.setattr(collocation, "MAX_BITS", bits)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, g, "p", 1) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, a int").repartition(3)
    assert as_rows(collocation.collocations(docs, max_n, least, share, top)) == mined(rows, max_n, least, share, top)


def test_phrases_of_hot_parts_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(collocation, "HOT", 3)  # so that some parts are hot
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    assert as_rows(collocation.collocations(docs, 3, 4)) == mined(rows, 3, 4)
    assert collocation.collocations(data.empty(spark)).count() == 0
    assert collocation.collocations(docs.where("text = ''")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Counts far above what a product of longs holds."""
    big = 3_000_000_019
    frequent = spark.createDataFrame([("x", "a", 1, 7 * big), ("x", "b", 1, 5 * big), ("x", "a b", 2, 4 * big)], "lang string, phrase string, words int, a long")
    got = collocation.scored(frequent).collect()
    assert [(r.score, r.l, r.r) for r in got] == [(1_000_000 * 16 // 35, 7 * big, 5 * big)]
