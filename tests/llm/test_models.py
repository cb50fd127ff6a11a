"""Classifiers and the language model: held-out accuracy, exact figures, odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import chain, hmm, language, quality, sample, session, toxicity

from . import data

FOLDER = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_chain_matches_brute_force():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 4, 2])
    emit, start, move = rng.random((10, 3)) + 0.1, rng.random(3), rng.random((3, 3))
    alpha, scale = chain.forward(emit, lengths, start, move)
    p = alpha * chain.backward(emit, scale, lengths, move)
    at = 0
    pairs = np.zeros((3, 3))
    for n in lengths:
        total, by = 0.0, np.zeros((n, 3))
        moves = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = start[path[0]] * math.prod(emit[at + i, s] for i, s in enumerate(path)) * math.prod(move[a, b] for a, b in zip(path, path[1:]))
            total += w
            for i, s in enumerate(path):
                by[i, s] += w
            for a, b in zip(path, path[1:]):
                moves[a, b] += w
        assert np.isclose(np.log(scale[at : at + n]).sum(), np.log(total))
        assert np.allclose(p[at : at + n], by / total)
        pairs += moves / total
        at += n
    assert np.allclose(chain.pair_counts(alpha, chain.backward(emit, scale, lengths, move), emit, scale, lengths, move), pairs)
    assert chain.segments(np.array([5, 0, 4]), 2).tolist() == [2, 2, 1, 2, 2]


def test_chain_is_exact_over_long_sequences(monkeypatch):
    """Parts of long sequences give the same as one run over each sequence."""
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 700, 64, 65, 1, 128, 17])
    emit, start, move = rng.random((lengths.sum(), 3)) + 1e-3, rng.random(3), rng.random((3, 3)) ** 3
    want = chain.forward(emit, lengths, start, move)
    monkeypatch.setattr(chain, "LONG", 16)
    alpha, scale = chain.forward(emit, lengths, start, move)
    assert np.allclose(alpha, want[0]) and np.allclose(scale, want[1])
    beta = chain.backward(emit, scale, lengths, move)
    monkeypatch.setattr(chain, "LONG", 10_000)
    assert np.allclose(beta, chain.backward(emit, scale, lengths, move)) and np.allclose((alpha * beta).sum(1), 1)
    # step by step
    a, at = start * emit[4], 4
    for t in range(1, 700):
        a = (a / a.sum() @ move) * emit[at + t]
    assert np.isclose(a.sum(), scale[at + 699])


def test_a_sample_has_rows_and_bytes(spark):
    """Different texts of one doc_id are rows of their own, with their own values; repeated rows count once."""
    rows = [(1, "good text", "en"), (1, "texte sans langue", None), (1, "andere", "de")] + [(2, "again", "fr")] * 50 + [(None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sample.texts(docs.where("lang is not null"), sample.F.col("lang"), 100)
    assert sorted(zip(got["text"].to_pylist(), got["value"].to_pylist(), strict=True)) == [("again", "fr"), ("andere", "de"), ("good text", "en")]
    assert sum(map(len, sample.texts(docs, sample.F.lit(0), 100, 15)["text"].to_pylist())) <= 15
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (2, None)], "doc_id long, toxic int")
    got = sample.labelled(docs, labels, "toxic", 100)
    assert sorted(zip(got["text"].to_pylist(), got["value"].to_pylist(), strict=True)) == [("again", 0), ("andere", 1), ("good text", 1), ("texte sans langue", 1)]
    assert sample.texts(docs.limit(0), sample.F.lit(0), 5).num_rows == 0


def test_a_sample_starts_no_other_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one", "en"), (2, "two", "de")], "doc_id long, text string, lang string")

    def rows_of_python(*args, **more):
        raise AssertionError("a list goes through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", rows_of_python)
    assert sample.texts(docs, sample.F.col("lang"), 5).num_rows == 2


def test_expected_moves_of_a_long_text():
    """Every token but the first of a text is moved to, however long the text is."""
    rng = np.random.default_rng(2)
    groups, sizes = rng.integers(0, hmm.CLASSES, 10_300), np.array([10_000, 300])
    v = hmm.Model.first(groups).expected(groups, sizes)
    s = hmm.STATES
    assert np.isclose(v[:s].sum(), 2) and np.isclose(v[s : s + s * s].sum(), 10_298) and np.isclose(v[s + s * s : -1].sum(), 10_300)


def test_toxicity_held_out(spark):
    larger = FOLDER.replace("0.01", "0.1")  # of ten toxic words or stems each must be seen
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(sample.remainder("doc_id", 3) != 0))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if crc(r.doc_id, 3) == 0]
    right = sum(g.is_toxic == (t == 1) for g, t in held)
    assert right / len(held) > 0.95
    hits = sum(g.is_toxic and t == 1 for g, t in held)
    assert hits >= 0.9 * sum(t == 1 for _, t in held) and hits >= 0.9 * sum(g.is_toxic for g, _ in held)
    assert all(0 <= g.severity <= 3 and 0 <= g.grade <= 3 for g in got.values())
    assert (np.diff(model.thetas) > 0).all()


def test_toxicity_grades_in_order():
    rng = random.Random(0)
    texts, toxic = [], []
    for i in range(400):
        n = rng.choice([0, 0, 2, 4, 8])
        w = data.words(i, 60, 300).split() + ["scumbag", "rotter"] * (n // 2)
        rng.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(n > 0)
    model = toxicity.train(pa.array(texts), np.array(toxic))
    severity = model.above(pa.array(["hello there", "a scumbag", "scumbag rotter " * 2, "scumbag rotter " * 9, None, ""])).sum(1)
    assert severity[0] < severity[1] < severity[2] < severity[3] and severity[4] == severity[5] == severity[0]


def test_toxicity_by_brute_force(docs, labels):
    """Severity of every document, word by word from the model's weights."""
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    hashed: dict = {}

    def features(word: bytes):
        if word not in hashed:
            buf = np.frombuffer(word, np.uint8)
            h = toxicity.K.Hasher(buf)
            ends = [(len(word), 1)] + [(n, n + 1) for n in toxicity.PREFIXES if len(word) >= n]
            hashed[word] = [int(h(np.array([0]), np.array([e]), tag)[0]) for e, tag in ends]
        return hashed[word]

    marks = toxicity.PUNCTUATION.tobytes()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(150).collect():
        words = toxicity.K.folded(np.frombuffer((r.text or "").encode(), np.uint8)).tobytes()
        count = Counter()
        for w in re.split(rb"[\x20\x09-\x0D]+", words):
            for _ in range(3):
                w = w[:-1] if len(w) > 1 and w[-1:] in [marks[i : i + 1] for i in range(len(marks))] else w
            for _ in range(2):
                w = w[1:] if len(w) > 1 and w[:1] in [marks[i : i + 1] for i in range(len(marks))] else w
            if w:
                count.update(f for f in features(w) if f in weight)
        x = sum(weight[f] * math.log1p(n) for f, n in count.items())
        above = [1 / (1 + math.exp(t - x)) for t in model.thetas]
        assert math.isclose(got[r.doc_id].severity, sum(above), abs_tol=1e-6) and got[r.doc_id].grade == sum(a > 0.5 for a in above)


def test_toxicity_odd_cases(spark, labels):
    rows = toxicity.toxicity(data.documents(spark), labels).collect()
    assert len(rows) == len(data.texts())
    none = spark.createDataFrame([], labels.schema)
    assert {r.severity for r in toxicity.toxicity(data.documents(spark), none).collect()} == {0.0}
    assert toxicity.toxicity(data.empty(spark), labels).count() == 0
    kept = toxicity.keep_clean(data.documents(spark), labels)
    assert kept.columns == data.documents(spark).columns


def test_quality_held_out(spark, docs, labels):
    rows = {r.doc_id: r for r in quality.quality_query(docs, labels).collect()}
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(rows) == docs.count() and len(held) > 50
    assert sum(g.predicted == q for g, q in held) / len(held) > 0.95
    assert all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    odd = quality.quality_query(data.documents(spark), labels).collect()
    assert len(odd) == len(data.texts()) and all(r.score is not None for r in odd)
    none = quality.quality_query(data.documents(spark), spark.createDataFrame([], labels.schema)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_query(data.empty(spark), labels).count() == 0


def test_quality_votes_by_brute_force():
    """Scores are the similarity-weighted votes of the nearest labelled vectors, and words count."""
    texts = [data.words(i, 30 + i, 200) for i in range(60)]
    y = np.arange(60) % 3 > 0
    m = quality.train(pa.array(texts), y)
    asked = [data.words(900 + i, 50, 200) for i in range(20)] + [None, ""]
    v = np.concatenate([m.latent(quality.features(buf, off)) for _, _, buf, off in quality.K.slices(pa.array(asked))])
    for got, x in zip(m.score(pa.array(asked)), v, strict=True):
        near = sorted(((float(x @ z), bool(k)) for z, k in zip(m.vectors, y, strict=True)), key=lambda p: -p[0])[: quality.NEIGHBOURS]
        w = [math.exp(quality.SHARPNESS * (s - near[0][0])) for s, _ in near]
        assert abs(got - sum(a for a, (_, k) in zip(w, near, strict=True) if k) / sum(w)) < 1e-3
    both = quality.features(*next(iter(quality.K.slices(pa.array(["abcd efgh", "abcf efgk"]))))[2:])
    assert (both[0, : quality.SHAPES] == both[1, : quality.SHAPES]).all() and (both[0] != both[1]).any()


def test_language(spark, docs):
    rows = language.language_query(docs).collect()
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97
    model = language.fit(docs, ~(sample.remainder("doc_id", 5) == 0), 300)
    assert model.labels == sorted({x for x in langs.values() if x})
    mixed = "Le êeaux de la une que réeau pour les dans " * 3 + "the of and that thing with there for are " * 3
    found = [w for _, w in model.words(mixed)]
    assert found[5] == "fr" and found[-5] == "en"
    assert (np.array(model.predict(pa.array(["ª", "µ 12", "º"]))[0]) != "und").all()
    names, score = model.predict(pa.array([None, "", "123 !!!", "—…", "the and of"]))
    assert names[:4] == ["und"] * 4 and score[:4].tolist() == [0] * 4 and names[4] == "en"


def test_language_by_brute_force(docs):
    """Predictions of short texts, by the sum over all labellings of their words."""
    model = language.fit(docs, ~(sample.remainder("doc_id", 5) == 0), 200)
    k, weights = len(model.labels), model.weights.astype(float)

    def scores(word: bytes) -> np.ndarray:
        h = language.K.Hasher(np.frombuffer(word, np.uint8))
        spans = [(0, len(word), 1)] + [x for n in language.AFFIXES if len(word) >= n for x in ((0, n, 2 * n), (len(word) - n, len(word), 2 * n + 1))]
        spans += [(i, i + 3, 20) for i in range(len(word) - 2)]
        return sum(weights[int(h(np.array([a]), np.array([b]), tag)[0]) >> 47] for a, b, tag in spans)

    texts = ["the and of", "le êeaux que", "der und 12 die", "x", "for the que de", "Ñ los el"]
    names, share = model.predict(pa.array(texts))
    for text, name, got in zip(texts, names, share, strict=True):
        words = text.encode().split()
        emit = [scores(w) for w in words]
        by, total = np.zeros((len(words), k)), 0.0
        for path in np.ndindex(*[k] * len(words)):
            w = math.exp(model.start[path[0]] + sum(e[s] for e, s in zip(emit, path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])) - sum(e.max() for e in emit))
            total += w
            for i, s_ in enumerate(path):
                by[i, s_] += w
        has = [any(map(str.isalpha, w.decode())) for w in words]
        want = (by[has] / total).sum(0)
        assert name == model.labels[int(want.argmax())] and math.isclose(got, want.max() / want.sum(), abs_tol=1e-5)


def test_language_odd_cases(spark):
    rows = language.language_query(data.documents(spark)).collect()
    assert len(rows) == len(data.texts())
    assert {r.lang_pred for r in rows if r.doc_id in (100, 101, 102, 113)} == {"und"}
    unlabelled = data.documents(spark).withColumn("lang", sample.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_query(unlabelled).collect()} == {"und"}
    assert language.language_query(data.empty(spark)).count() == 0


@pytest.mark.parametrize("most", [session.BATCH_BYTES, 20_000])
def test_language_model(spark, monkeypatch, most):
    monkeypatch.setattr(session, "BATCH_BYTES", most)
    rows = data.texts()
    got = hmm.lm_query(data.documents(spark)).collect()
    assert len(got) == len(rows)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0end"]) for i, t in rows]
    held = lambda i: i is not None and crc(i, 5) == 1
    c = Counter(w for i, t in tokens for w in t if not held(i))
    n, v = c.total(), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.lm_query(data.empty(spark)).count() == 0


def test_language_model_is_a_distribution_and_exact(spark):
    rng = np.random.default_rng(1)
    groups = rng.integers(0, hmm.CLASSES, 50)
    m = hmm.Model.from_counts(hmm.Model.first(groups).expected(groups, np.array([30, 20])))
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and np.isclose(m.start.sum(), 1)
    state = m.start * m.emit[groups[0]]
    for g in groups[1:5]:
        state = (state @ m.move) * m.emit[g]
    assert np.isclose(m.log10(groups[:5], np.array([5]))[0], np.log10(state.sum()))


def test_language_model_beats_its_base(docs):
    rows = hmm.lm_query(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.97


def test_trained_states_gain_over_one_state(docs):
    """Held-out likelihood of the classes under the trained chain and under their shares alone."""
    held = sample.remainder("doc_id", 5) == 1
    model = hmm.train(docs, ~held)
    seen = np.full(hmm.CLASSES, 1e-3 * hmm.STATES)
    for r in docs.where(~held).select("text").toLocalIterator():
        buf = np.frombuffer((r.text or "").encode(), np.uint8)
        seen += np.bincount(hmm.group_of(hmm.tokens(buf, np.array([0, len(buf)]))[0]), minlength=hmm.CLASSES)
    chain_, shares = 0.0, 0.0
    for r in docs.where(held).select("text").toLocalIterator():
        buf = np.frombuffer((r.text or "").encode(), np.uint8)
        keys, sizes = hmm.tokens(buf, np.array([0, len(buf)]))
        g = hmm.group_of(keys)
        chain_ += model.log10(g, sizes)[0]
        shares += np.log10(seen[g] / seen.sum()).sum()
    assert chain_ > shares * 0.97
