import html
import re
import time

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pytest

import corpus_pipeline
from skycap.llm import html_text, langid, vector_dedup


def vectors(seed=1, n=300, d=16):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, d))
    return centres[rnd.integers(0, 40, n)] + rnd.normal(size=(n, d)) * rnd.choice([0.05, 0.3], size=(n, 1))


def plain(rows, least=0.9):
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    comps, links = brute.Components(len(rows)), [0] * len(rows)
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in ok}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                comps.join(a, b)
    least_id = {}
    for i in ok:
        r = comps.find(i)
        least_id[r] = min(least_id.get(r, rows[i][0]), rows[i][0])
    return [(k, links[i], least_id.get(comps.find(i), k) if i in unit else k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_dedup_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "PER_CELL", block)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors())]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0, None]), (1004, [float("nan")] * 16), (1005, [float("inf")] * 16),
             (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, rows[3][1]), (3, rows[3][1]), (None, [1.0, 2.0]), (1009, [1e300] * 16)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label string, k1 long, cell long")
    got = [(r.vec_id, r.n_links, r.component_id) for r in vector_dedup.vector_dedup(df, spread=None).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_vector_dedup_recall_and_precision(spark):
    """The usual margin finds nine of ten links or more, and none below the bound."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(2, 1500, 32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_dedup(df, sample=500).collect()}
    exact = {k: n for k, n, _ in plain([(i, np.float32(v).astype(float).tolist()) for i, v in rows])}
    assert sum(got.values()) >= 0.9 * sum(exact.values()) > 0
    assert all(got[i] <= exact[i] for i in got)


def test_vector_dedup_of_few_directions(spark, monkeypatch):
    """The registered query loses no link where vectors lie in few of many dimensions."""
    monkeypatch.setattr(vector_dedup, "PER_CELL", 30)
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(1200, 4)) @ np.linalg.qr(rnd.normal(size=(64, 4)))[0].T
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: n for k, n, _ in plain(rows)}


def test_vector_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.vector_dedup(df).count() == 0


def test_article_text(spark, sf):
    """On whole pages: the article's blocks, whatever is not closed."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        text = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body)))
        assert out[r.page_id] == " ".join(text.split())


LONG = "A long paragraph of running text that says a good deal about its subject, in many words."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("just text &amp; more", "just text & more"), ("<p>a<b>b</b>c<br>d", "abc d"),
    (f"<div class='sidebar'>x</div><div><p>{LONG}</p><p>Short.</p></div><div id=comments><p>first!</p></div><footer>f</footer>", f"{LONG} Short."),
    (f"<header>Site</header><main><header><h1>T</h1></header><p>{LONG}</p><form>f<input></form><aside>s</aside></main>", f"T {LONG}"),
    (f"<div><a href=1>{LONG}</a></div><div><p>{LONG}</p></div>", LONG),
    ("<nav>never closed <p>text", "never closed text"), ("<script>var a = '</p>';</script><p>x &eacute;&#8212;", "x é—"),
    (f"<article><p>{LONG}</p></article><div class='cookie-notice'>We use cookies</div><p cut", LONG),
    ("<p>" * 3000 + "deep", "deep"),
])
def test_pages(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    # an unmarked advert and blocks of links inside the article go by their ratio and links
    (f"<article><p>{LONG}</p><div><b>Buy</b> <i>now</i></div><p>{LONG}</p><ul><li><a>One thing</a></li><li><a>Other</a></li></ul></article>",
     f"{LONG} {LONG}"),
    # a real block stays although its class holds a marked word
    (f"<article><p>{LONG}</p><div class='social-history'><p>{LONG}</p><p>{LONG}</p></div></article><nav><a>x</a></nav>", " ".join([LONG] * 3)),
    (f"<article><p>{LONG}</p><ul><li>One thing</li></ul><section><h2>More</h2><p>{LONG}</p></section></article><footer>f</footer>",
     f"{LONG} One thing More {LONG}"),
    # no line reaches the threshold by its weight: the likeliest region
    (f"<nav><a>x</a></nav><article><h1>Short one.</h1></article><footer>{LONG}</footer>", "Short one."),
])
def test_ratios_decide_within_articles(page, text):
    assert html_text.page_text(page) == text


def _article(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_ratios_alone_tell_the_pages_apart(spark, sf, monkeypatch):
    """Without the names of classes and elements nearly all pages keep their text; without ratios most lose it."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    same = lambda: sum(html_text.page_text(p) == _article(p) for p in pages)
    monkeypatch.setattr(html_text, "MARKS", frozenset())
    assert same() >= 0.9 * len(pages)
    monkeypatch.setattr(html_text, "ASIDE_WEIGHT", 1 - 1e-9)  # below one: still a region
    monkeypatch.setattr(html_text, "OUTSIDE_WEIGHT", 1.0)
    assert same() >= 0.9 * len(pages)
    monkeypatch.setattr(html_text, "ratio", lambda text, tags, links: 5.0)
    assert same() <= 0.5 * len(pages)


def test_end_tags_without_start():
    page = "<div>" * 20_000 + "<i>" * 20_000 + "</b></p>" * 200_000 + "x"
    t0 = time.process_time()
    assert html_text.page_text(page) == "x"
    assert time.process_time() - t0 < 20


def test_pages_with_other_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>x</p>", "old", 3)], "page_id long, url string, html string, text string, n_chars long")
    row = html_text.extract_text(df).first()
    assert (row.page_id, row.url, row.text, row.n_chars) == (1, None, "x", 3)
    assert html_text.extract_text(df.where("false")).count() == 0


def test_pipeline_stages(spark, sf, small):
    """Each stage against a plain version on what the stage before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "personal_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "12 34 !!", "en", "x", 8)], small.schema)
    docs = small.unionByName(extra).cache()
    one = stages["language_id"](spark, docs, sf).cache()
    assert one.columns == small.columns
    kept = {r.doc_id for r in one.collect()}
    assert not kept & {9001, 9002}
    pred = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert kept == {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    two = stages["jaccard_join"](spark, one, sf).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {c for (i, _), (n, _, c) in zip(rows, brute.jaccard_join(rows)) if n}
    three = stages["substring_dedup"](spark, two, sf).cache()
    assert three.columns == small.columns
    rows = [(r.doc_id, r.text) for r in two.collect()]
    got = {r.doc_id: r for r in three.collect()}
    for (i, t), (_, gone, text) in zip(rows, brute.substring_dedup([t for _, t in rows])):
        assert got[i].text == (text if gone else t) and got[i].n_chars == len(got[i].text)
    four = stages["personal_data"](spark, three, sf).cache()
    assert four.columns == small.columns and four.count() == three.count()
    for r in four.collect():
        assert not brute.personal_data(r.text)
        if not brute.personal_data(got[r.doc_id].text):
            assert r.text == got[r.doc_id].text
    five = stages["packing"](spark, four, sf)
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}


def test_pipeline_keeps_one_row_of_repeated_texts(spark, sf, small):
    """Rows that repeat under one id or stand without one lose neither their text nor another row's."""
    text = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (None, text("b")), (None, text("c")), (None, text("c")),
            (None, text("d") + " more"), (3, text("d")), (4, text("e")), (4, text("f")), (None, text("g")), (5, ""), (5, " \n"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], small.schema)
    stages = dict(corpus_pipeline.STAGES)
    two = stages["jaccard_join"](spark, docs, sf).cache()
    assert two.columns == small.columns
    order = lambda r: tuple((x is None, x) for x in r)
    expected = [(1, text("a")), (2, text("b")), (None, text("c")), (3, text("d")), (4, text("e")), (4, text("f")), (None, text("g")),
                (5, ""), (5, " \n"), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=order) == sorted(expected, key=order)
    three = stages["substring_dedup"](spark, two, sf)
    assert sorted(((r.doc_id, r.text) for r in three.collect()), key=order) == sorted(((i, t or "") for i, t in expected), key=order)


def test_pipeline_of_nothing(spark, sf, small):
    docs = small.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


class _Sent:
    def __init__(self, value):
        self.value = value


def test_vector_dedup_hands_on_a_bounded_number_of_rows():
    """A batch of vectors that meet 900 blocks each leaves in parts, and links to all vectors do not pile up in a unit."""
    rnd = np.random.default_rng(4)
    n, blocks = 100, 900
    x = rnd.normal(size=(n, 4))
    c = np.eye(4)[:1]
    batch = pa.RecordBatch.from_pydict({
        "id": pa.array(range(n), pa.int64()), "emb": pa.array(x.tolist(), pa.list_(pa.float64())), "copies": pa.array([1] * n, pa.int64()),
        "dim": pa.array([4] * n, pa.int64()), "cell": pa.array([0] * n, pa.int64()), "hash": pa.array(range(0, 7 * n, 7), pa.int64())})
    deal = vector_dedup._deal(_Sent(({(4, 0): 5}, {(4, 0): blocks}, {(4, 0): 0.5})), _Sent({4: c}), lambda d: 1.0, 0.4)
    out = list(deal([batch]))
    assert len(out) > 1 and max(b.num_rows for b in out) <= vector_dedup.ROWS
    rows = [r for b in out for r in zip(*(b.column(k).to_pylist() for k in ("unit", "kind", "id")))]
    assert rows == [(5 + u, int(u > 7 * i % blocks), i) for i in range(n) for u in range(7 * i % blocks, blocks)]

    one = lambda lo, hi, kind: pa.RecordBatch.from_pydict({
        "unit": pa.array([0] * (hi - lo), pa.int64()), "kind": pa.array([kind] * (hi - lo), pa.int64()),
        "id": pa.array(range(lo, hi), pa.int64()), "copies": pa.array([1] * (hi - lo), pa.int64()),
        "emb": pa.array([[1.0, 0.0]] * (hi - lo), pa.list_(pa.float64()))})
    found = list(vector_dedup._compare(0.9)([one(0, 10, 0), one(10, 1010, 1), one(1010, 2010, 1)]))
    edges = [b.num_rows - b.column("dst").null_count for b in found]
    assert edges == [1000, 1000, 9]  # with each batch, not all at the end
    assert sum(b.filter(pa.compute.equal(b.column("id"), 0)).column("n_links")[0].as_py() for b in found[-1:]) == 2009
