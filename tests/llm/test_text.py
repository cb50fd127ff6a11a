"""HTML extraction, decontamination, mixing and the pipeline."""

import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import canonical
from quernstone.llm import decontamination, htmltext, mixing, packed, queries, session

from . import data

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div id="sidebar">Side <div>inner</div> more</div><!-- <p>gone</p> --><div class="ad">Buy</div>
<article><h1>Head&amp;line</h1><p>First   para
graph with <b>bold &lt;b&gt;<p>Second<br>line &#233;&nbsp;x</p><form><p>form</p><input></form><ul><li>one</li><li>two</li></ul>
<div class="ad"><p>Advert</p></div><p>Last.</p></article><section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert htmltext.main_text(PAGE) == "Head&line\n\nFirst para graph with bold <b>\n\nSecond line é x\n\none\n\ntwo\n\nLast."
    plain = "<body><nav>Menu</nav><p>One.</p><p>Two two.</p><div class='footer'>foot</div></body>"
    assert htmltext.main_text(plain) == "One.\n\nTwo two."
    for odd in (None, "", "<p>", "<nav>only</nav>", "<!-- never closed <p>x</p>", "<script>x"):
        assert htmltext.main_text(odd) == ""
    assert htmltext.main_text("no markup at all") == "no markup at all"
    rows = [(1, "u", PAGE, "t"), (1, None, None, "t"), (None, "v", "<p>a</p>", "t"), (2, "w", "<p>" + "long " * 50_000 + "</p>", "t")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in got) == sorted([0, 1, 249_999, len(htmltext.main_text(PAGE))])
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unmarked_pages_keep_text_on_both_sides_of_an_advert():
    for box in ('<div class="ad">Buy</div>', "<aside>Buy</aside>", "<form><input>Buy</form>", '<div class="share">Buy</div>'):
        page = f"<body><nav>Menu</nav><p>{'a' * 1000}</p><p>{'b' * 1000}</p>{box}<p>{'c' * 900}</p><footer>f</footer></body>"
        assert htmltext.main_text(page) == "\n\n".join(("a" * 1000, "b" * 1000, "c" * 900))


def test_layout_wrappers_keep_their_article():
    for layout in ("page has-sidebar", "layout no-sidebar", "wrapper sticky-header", "with_nav"):
        for tag in ("article", "main"):
            page = f'<body><div class="{layout}"><div class="sidebar">Side</div><{tag}><p>One.</p><div class="ad">Buy</div><p>Two.</p></{tag}></div><div class="footer">f</div></body>'
            assert htmltext.main_text(page) == "One.\n\nTwo."
    assert htmltext.main_text('<div class="no-sidebar"><p>One.</p></div>') == "One."
    related = '<article><p>One.</p></article><div class="related"><article>Other</article><p>more</p></div>'
    assert htmltext.main_text(related) == "One."
    inside = '<article><p>One.</p><div class="related"><article>Other</article><p>more</p></div><p>Two.</p></article>'
    assert htmltext.main_text(inside) == "One.\n\nTwo."


class Plain(HTMLParser):
    """Text of article by the standard parser: what the query must give on pages that mark it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.text, self.blocks = 0, 0, [], []

    def end(self):
        t = " ".join("".join(self.text).split())
        self.text = []
        if t:
            self.blocks.append(t)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        elif tag not in ("b", "i", "em", "a", "span", "strong"):
            self.end()
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "a", "span", "strong"):
            self.end()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.text.append(data)


def test_html_of_all_pages_by_the_standard_parser(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries.op7_html_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        p = Plain()
        p.feed(r.html)
        p.end()
        assert got[r.page_id] == "\n\n".join(p.blocks)


def test_unmarked_pages_lose_their_menus():
    """No listed names: lengths alone decide."""
    texts = [" ".join(f"Sentence {i} of paragraph {k} has some words." for i in range(4)) for k in range(4)]
    body = f"<h2>Headline</h2><p>{texts[0]}</p><p>Short one.</p><ul><li>one</li><li>two</li></ul><p>{texts[1]}</p><p>{texts[2]}</p><p>The end.</p>"
    want = "\n\n".join(["Headline", texts[0], "Short one.", "one", "two", texts[1], texts[2], "The end."])
    menu = "<ul><li>Home</li><li>News</li><li>Contact</li></ul>"
    links = "".join(f'<li><a href="/{i}">A rather long name of another page of this site, number {i}</a></li>' for i in range(9))
    for top in (f"<div class='top'>{menu}</div>", f"<div><ul>{links}</ul></div>", f"<table><tr><td>{menu}</td></tr></table>"):
        for bottom in ("<div class='bottom'>Copyright", f"<div><ul>{links}</ul></div>", "<div>Imprint</div><div>Terms</div><div>Privacy</div><div>All rights reserved</div>"):
            assert htmltext.main_text(f"<body>{top}<div>{body}</div>{bottom}</body>") == want
    assert htmltext.main_text("<form id=f><div>" + body + "</div></form>") == want


def test_surges_and_dives_by_brute_force():
    """Lines kept lie within WINDOW lines of a long one, and every long line of the largest stretch is kept."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 40)
        size = np.array([rng.choice([0, 3, 10, 10, 80, 300]) for _ in range(n)])
        whole = size + np.array([rng.choice([0, 0, 20]) for _ in range(n)]) + 1
        box = np.array([rng.randrange(4) for _ in range(n)])
        keep = htmltext.distribution(size, whole, box, np.zeros(n, bool))
        if not size.any():
            continue
        long = min(htmltext.LONG, size.max() / 4)
        on = [any(sum(size[max(0, j) : j + 3]) >= long for j in (i - 2, i) if j + 3 > 0) for i in range(n)]
        runs, start = [], None
        for i, o in enumerate([*on, False]):
            if o and start is None:
                start = i
            elif not o and start is not None:
                runs.append((start, i))
                start = None
        assert not any(k and not o for k, o in zip(keep, on, strict=True))
        a, b = max(runs, key=lambda r: sum(size[r[0] : r[1]]))
        assert all(keep[i] for i in range(a, b) if size[i] >= long)


def test_lines_between_paragraphs_of_one_box_stay():
    long = [" ".join(f"Sentence {i} of paragraph {k} has some words." for i in range(8)) for k in range(2)]
    for tag, line in (("<div><p>{}</p></div>", "Yes, he said."), ('<li><a href="/x">{}</a></li>', "A source"), ("<p>{}</p>", "No.")):
        for n in (1, 4, 5, 12):
            page = f"<body><p>{long[0]}</p>{tag.format(line) * n}<p>{long[1]}</p><div>Imprint</div><div>Terms</div></body>"
            assert htmltext.main_text(page) == "\n\n".join([long[0], *[line] * n, long[1]]), (tag, n)


def test_lengths_decide_on_marked_pages_too(monkeypatch):
    """Every page with text is decided by its distribution; an advert or a teaser that is an article is not the text."""
    calls, distribution = [], htmltext.distribution
    monkeypatch.setattr(htmltext, "distribution", lambda *a: calls.append(1) or distribution(*a))
    long = " ".join(f"Sentence {i} has some words." for i in range(20))
    assert htmltext.main_text(f"<article class='ad'><p>buy</p></article><div><p>{long}</p></div>") == long
    assert htmltext.main_text(f"<article><p>buy</p></article><div><p>{long}</p></div>") == long
    assert htmltext.main_text(f"<article><p>{long}</p></article><div><p>{long} {long} {long}</p></div>") == long
    assert htmltext.main_text(f"<main><p>{long}</p><section class='kommentare'><p>{long}</p></section><article class='teaser'>Next</article></main>") == long
    assert htmltext.main_text("<article class='ad'><p>All there is</p></article>") == "All there is"
    assert len(calls) == 5


def test_odd_markup_loses_no_text():
    article = "<article>{}</article>".format
    assert htmltext.main_text(article("<p don't>He said it's fine</p><p>Next.</p>")) == "He said it's fine\n\nNext."
    assert htmltext.main_text(article("<p>One.</p><section id='related-work'><h2>Related work</h2><p>Two.</p></section>")) == "One.\n\nRelated work\n\nTwo."
    assert htmltext.main_text(article('<p title="a > b">One.</p><p>1 < 2 and <b>3</b> > 2</p>')) == "One.\n\n1 < 2 and 3 > 2"
    assert htmltext.main_text(article("<header><h1>Own</h1></header><p>Text <button>Like</button> goes on</p><article class='comment'><p>Nice</p></article>")) == "Own\n\nText goes on"
    assert htmltext.main_text(article("<p>a<div class='related-posts'><p>b</p></div><p>c <i>d</p><p>e</i></p>")) == "a\n\nc d\n\ne"
    assert htmltext.main_text("<p>x <y") == "x <y"
    assert htmltext.main_text("<head><meta charset=utf-8><title>t</title><p>No end of head") == "No end of head"


@pytest.mark.parametrize("part", ['<a href="x ', "<a href='", "<div>", "</div>", "<!-", "<", "<p class=", "<b><i>", "<div class=ad><article>", "<script", "&#", '="', "<nav>", "</p><p>x", "<script></script "])
def test_broken_markup_takes_linear_time(part):
    began = time.time()
    htmltext.main_text(part * (1_000_000 // len(part)))
    htmltext.main_text(f"<p {part * (300_000 // len(part))}>x</p>")
    assert time.time() - began < 12


def test_inline_ends_behind_a_block_take_linear_time():
    n = 1_000_000 // 14
    began = time.time()
    htmltext.main_text("<b><div>" + "<span>" * n + "</b>x" * n)
    assert time.time() - began < 12


def test_decontamination(spark):
    items = [(i, data.words(9000 + i, 20 + 5 * i, 100_000)) for i in range(12)]
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(60):
        text = data.words(i, 150, 100_000)
        if i % 4 == 0:
            t, item = items[(i // 4) % 12]
            kind = i % 3
            words = item.split()
            if kind == 1:
                words = [w.upper() + "," for w in words]
            elif kind == 2:  # a paraphrase: some words differ
                for k in rng.sample(range(len(words)), len(words) // 8):
                    words[k] = f"other{k}"
            text = data.words(i, 100, 100_000) + " " + " ".join(words) + ". " + text
            want.add((i, t))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    want.add((102, 3))
    docs = data.documents(spark, rows)
    bench = spark.createDataFrame([(*x, "extra") for x in items] + [(99, None, "e"), (98, "", "e"), (97, "two words", "e"), (96, items[3][1], "e")], "item_id long, text string, doc_id string")
    got = decontamination.leaks(docs, bench).collect()
    pairs = Counter((r.doc_id, r.item_id) for r in got)
    assert set(pairs) == want | {(d, 96) for d, t in want if t == 3} and pairs[(102, 3)] == 2
    kept = decontamination.keep_uncontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in {d for d, _ in want})
    assert decontamination.leaks(data.empty(spark), bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(i, data.words(9000 + i, 30, 100_000)) for i in range(20)]
    docs = spark.createDataFrame([(i, data.words(i, 50, 100_000) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1000)
    assert len(list(decontamination.item_blocks(bench))) > 3
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {(i, i) for i, _ in items}
    # the stage drops what the query finds
    both = docs.unionByName(spark.createDataFrame([(100 + i, data.words(i, 90, 100_000)) for i in range(20)], docs.schema))
    hit = {r.doc_id for r in decontamination.leaks(both, bench).collect()}
    assert {r.doc_id for r in decontamination.keep_uncontaminated(both, bench).collect()} == {r.doc_id for r in both.collect()} - hit


def test_sums_of_many_partitions_stay_in_small_groups(spark):
    for most, fan_in in ((1, 8), (8, 8), (9, 8), (200, 8), (780_000, 8), (780_000, 64)):
        before = most
        for n in packed.rounds(most, fan_in):
            assert max(-(-before // n), 1) <= fan_in
            before = n
        assert before == 1
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        parts = spark.range(0, 200, 1, 200)
        assert session.parts_of(parts) == 200

        def vectors(batches):
            from pyspark import TaskContext

            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.arange(3.0).tobytes()], pa.binary())], ["part", "vec"])

        assert packed.summed(parts.mapInArrow(vectors, "part long, vec binary"), 200, 8).tolist() == [0, 200, 400]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def planted(texts, docs, rows, scale=1):
    """What a model of given items finds, with document frequencies of docs times scale."""
    items = decontamination.Items.of(list(range(len(texts))), pa.array(texts))
    keys = items.keys.tolist()
    df = Counter(k for t in docs for k in set(decontamination.Items.of([0], pa.array([t])).texts[0].tolist()))
    count = len(docs) * scale + len(texts)
    idf = np.log((count + 1) / (np.array([df[k] for k in keys]) * scale + 1)) + 0.1
    own = np.zeros((len(texts), len(keys)))
    for i, t in enumerate(items.texts):
        np.add.at(own[i], np.searchsorted(items.keys, t), idf[np.searchsorted(items.keys, t)])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    model = decontamination.Model(items, idf, float(np.log(count + 1) + 0.1), np.eye(len(keys), dtype=np.float32), own.astype(np.float32))
    return {(r[0], r[1]) for r in model.leaks(pa.array(rows))}


def test_decontamination_finds_edited_items_in_any_corpus():
    rng = random.Random(4)
    docs = [data.words(i, 200, 1500) for i in range(60)]
    texts = [data.words(7000 + i, 25 + i, 1500) for i in range(20)]
    rows, want = [], set()
    for share in (0.2, 0.3, 0.35):
        for t, text in enumerate(texts):
            w = text.split()
            ask = len(w) - max(3, len(w) // 5)
            for k in rng.sample(range(ask), round(share * len(w))):
                w[k] = f"unseen{rng.randrange(10**6)}"
            want.add((len(rows), t))
            rows.append(docs[t] + " " + " ".join(w) + " " + docs[t + 20])
    for scale in (1, 100_000):  # 6M documents
        assert planted(texts, docs, rows, scale) == want


def test_decontamination_finds_short_items_in_long_texts():
    docs = [data.words(i, 400, 1500) for i in range(60)]
    texts = [data.words(7000 + i, n, 1500) for i, n in enumerate((1, 2, 3, 4, 5, 7, 7, 30))]
    texts.append(texts[1])
    rows, want = [], set()
    for t, text in enumerate(texts[1:7], 1):
        want |= {(len(rows), i) for i, x in enumerate(texts) if x == text}
        rows.append(docs[t] + " " + text + " " + docs[t + 20])
    got = planted(texts, docs, rows + [" ".join(texts[1].split()[:1]), ""])
    assert want <= got
    for r, t in got - want:  # else only what is there in order
        assert decontamination.lcs(texts[t].split(), (rows[r] if r < len(rows) else texts[1].split()[0]).split()) == len(texts[t].split())


def test_decontamination_finds_items_longer_than_512_words():
    docs = [data.words(i, 400, 20_000) for i in range(20)]
    texts = [data.words(7000, 6000, 20_000), data.words(7001, 30, 20_000)]
    assert planted(texts, docs, [docs[0] + " " + texts[0] + " " + docs[1], docs[2]]) == {(0, 0)}


def test_singular_vectors_match_an_exact_decomposition():
    rng = np.random.default_rng(5)
    a = (rng.standard_normal((300, 40)) * 0.7 ** np.arange(40)) @ np.linalg.qr(rng.standard_normal((400, 40)))[0].T
    omega = np.linalg.qr(rng.standard_normal((400, 42)))[0]
    got = decontamination.singular_vectors(a.T @ (a @ omega), omega, 10)
    want = np.linalg.svd(a)[2][:10].T
    assert got.shape == (400, 10) and np.linalg.norm(got.T @ got - np.eye(10)) < 1e-6
    assert np.allclose(np.abs((got * want).sum(0)), 1, atol=1e-3)


def test_decontamination_recall_against_all_windows(spark):
    """Of all that passes the check in some window of a document, found by comparing every item with every document."""
    rng = random.Random(12)
    texts = [data.words(100 + i, n, 3000) for i, n in enumerate((8, 9, 12, 20, 31, 33, 60, 120, 500, 3000))]
    rows = []
    for i in range(80):
        w = texts[i % 10].split()
        for k in rng.sample(range(len(w)), len(w) * (i // 10) // 20):
            w[k] = f"other{rng.randrange(10**5)}"
        rows.append((i, " ".join([data.words(i, 150, 3000), *w, data.words(i + 50, 90, 3000)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()}
    want = set()
    for i, t in rows:
        h = t.split()
        for k, text in enumerate(texts):
            item = text.split()
            n, answer = len(item), item[-max(3, len(item) // 5) :]
            for at in range(0, len(h), max(1, n // 2)):  # every window of twice the item's length
                near = h[at : at + 2 * n]
                share = decontamination.lcs(item, near) / n
                if share >= 0.8 or share >= 0.6 and decontamination.lcs(answer, near) >= 0.6 * len(answer):
                    want.add((i, k))
    assert len(want) > 60 and len(got & want) >= 0.9 * len(want)


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(8)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert decontamination.lcs(a, b) == slow(a, b)


def test_mixing_matches_sql(spark):
    rows = data.texts()
    docs = data.documents(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = mixing.mix(docs)
    assert canonical(got.toPandas()) == canonical(con.execute(mixing.SQL).df())
    by = defaultdict(list)
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r.size
        by[(r.source_size, r.target)].append(r)
    total = sum(r.size for rs in by.values() for r in rs)
    for (size, target), rs in by.items():
        assert target <= 3 * size
        assert abs(sum(r.taken for r in rs) - target) <= max(100, 0.02 * total)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    again = mixing.mix(docs.repartition(7))
    assert canonical(again.toPandas()) == canonical(got.toPandas())
    assert mixing.mix(data.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(nothing).collect()} == {(0, 0.0, 0)}


def test_targets_by_hand(spark):
    rows = [("a", 100), ("b", 10), ("c", 500), ("d", 390)]  # weights 1, 2, 3, 1
    sizes = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long")
    got = {r.source: round(r.target, 6) for r in mixing.targets(sizes).collect()}
    # b stops at 30; 970 are shared 1 : 3 : 1
    assert got == {"a": 194, "b": 30, "c": 582, "d": 194}


def test_small_sources_of_a_large_corpus_reach_their_targets(spark, monkeypatch):
    small = {"a": 500, "b": 2000, "c": 5000, "d": 7000, "e": 12_000}
    rows = [(i, s, n // 10) for s, n in small.items() for i in range(10)] + [(i, "huge", 5_000_000) for i in range(100)]
    monkeypatch.setattr(mixing, "sized", lambda docs: docs.select("doc_id", "source", "size"))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).groupBy("source_size", "target").sum("taken").collect()
    assert {r.source_size for r in got} == {*small.values(), 500_000_000}
    for size, target, taken in got:
        assert taken <= 3 * size and abs(taken - target) <= 16 * 5


def test_pipeline_against_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quernstone.llm import toxicity

    from .test_dedup import brute_components

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.is_toxic}
    left = {i: t for i, t in rows.items() if i not in toxic}
    last = {}
    for i, t in left.items():
        last[t or ""] = max(i, last.get(t or "", -1))
    left = {i: left[i] for i in last.values()}
    comps = brute_components(sorted(left.items()))
    left = {i: t for i, t in left.items() if comps[i] == i}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i for i, t in left.items() if not any(x.lower() in (t or "").lower() for x in items)}
    assert set(got) == clean
    assert sum(r.size for r in got.values()) == sum(len((left[i] or "").split()) for i in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "mixing"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, different texts of one doc_id, clashing columns; and no rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c = data.words(1, 60), data.words(2, 60), data.words(3, 300)
    near = [data.edited(c, k, 3) for k in (2, 3)]
    rows = [r for r in data.texts() if r[0] is None or r[0] >= 100] + [(3, a), (5, data.edited(a, 1, 1)), (5, b), (9, c), (9, near[0]), (10, near[1]), (3, a), (None, None), (None, None)]
    folder = "/root/testdata/sf0.001"
    clashing = {**{c: F.lit(c) for c in ("_id", "_hash", "row", "text_hash", "first", "text_sha256", "h")}, "tags": F.create_map(F.lit("k"), F.lit(1))}
    for name, docs in (("some", data.documents(spark, rows)), ("none", data.empty(spark))):
        at = str(tmp_path / name)
        docs = docs.withColumns(clashing)
        names = docs.columns
        docs.write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for step, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            assert docs.columns == names
        kept = Counter((r.doc_id, r.text) for r in docs.collect())
        got = corpus_pipeline.run(spark, at).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in kept.elements())
        if name == "none":
            assert not got
            continue
        assert kept[3, a] == 1 and kept[5, b] == 1 and (5, data.edited(a, 1, 1)) not in kept
        assert sum(kept[x] for x in ((9, c), (9, near[0]), (10, near[1]))) == 1
        assert sum(n for (_, t), n in kept.items() if not t) == 1  # of null and empty texts the one with the largest doc_id
        assert kept[None, "alone without id"] == 1 and kept[120, "null id twin"] == 1 and kept[None, "null id twin"] == 0
        assert kept[110, data.words(9, 20_000)] == 1 and all(0 <= r.taken <= 3 * r.size for r in got)


def test_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))
