"""Long texts, hot groups, small languages and clashing columns."""

import time
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skycap.llm import common as C
from skycap.llm import components, jaccard_join, langid, packing, pii, quality


def test_many_matches_in_one_text(spark):
    """50,000 values in one text: spans and rewritten text as the plain version has them, in linear time."""
    text = " ".join(f"+1 319 555 {i % 10000:04d}, x{i}@y.org" for i in range(25_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.base_spans(df.select(F.lit("a@b.org").alias("text"))).collect()  # start the session
    began = time.time()
    r = pii.base_spans(df).select("email", "phone").first()
    assert time.time() - began < 30
    assert [(s.start, s.end) for s in r.email] == [(s, e) for s, k, e in brute.personal_data(text) if k == 0]
    assert [(s.start, s.end) for s in r.phone] == [(s, e) for s, k, e in brute.personal_data(text) if k == 3]
    began = time.time()
    clean = pii.sanitised(df).first().text
    assert time.time() - began < 90
    assert clean == ", ".join(["[PHONE], [EMAIL]"] * 25_000).replace("[EMAIL], ", "[EMAIL] ")


def test_terms_that_disclose(spark):
    """A name that stands with one address is found everywhere; rare words near any address are not."""
    rnd = np.random.default_rng(1)
    letters = np.array(list("ghijklmnopqrstuvwxyz"))
    word = lambda: "".join(rnd.choice(letters, 8))
    rare = [word() for _ in range(1000)]
    rows = []
    for i in range(3000):
        near = f" mail p{i}@host{i % 40}.org b c" if i % 3 == 0 else ""
        rows.append(f"plain words {word()} {rare[rnd.integers(1000)]} {rare[rnd.integers(1000)]}{near} end {i}")
    rows += [f"Note {i}: Quillonimus wrote from q.n@secret.org about item {word()}" for i in range(12)]
    rows.append("Quillonimus came without any address")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.term for r in pii.scored_terms(df).collect()}
    assert "quillonimus" in found and not found & set(rare) and not {"b", "c"} & found
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert not any("Quillonimus" in t for t in out.values()) and out[len(rows) - 1].endswith("came without any address")


def test_terms_beside_values_that_never_recur(spark):
    """No address, domain or area stands twice: a name beside addresses is found by their kind, rare words that
    met some by chance are not; once a domain recurs, the kind stands for nothing."""
    rnd = np.random.default_rng(3)
    letters = np.array(list("ghijklmnopqrstuvwxyz"))
    rare = ["".join(rnd.choice(letters, 8)) for _ in range(300)]
    rows = []
    for i in range(1500):
        near = f" p{i}@host{i}.org" if i % 5 == 0 else ""
        rows.append(f"plain words {rare[rnd.integers(300)]} {rare[rnd.integers(300)]}{near} end {i}")
    rows += [f"plain words of Quillonimus at q{i}@far{i}.org end" for i in range(14)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.term for r in pii.scored_terms(df).collect()} == {"quillonimus"}
    again = spark.createDataFrame([(5000 + i, f"plain words z{i}@same.org end") for i in range(3)], df.schema)
    assert {r.term for r in pii.scored_terms(df.unionByName(again)).collect()} == set()


def test_long_texts_of_quality(edge, small, monkeypatch):
    """Texts beyond the packed positions are measured alike."""
    want = {tuple(r) for r in quality.quality(small).select("doc_id", "n_repeat_words", "kept").collect()}
    monkeypatch.setattr(quality, "MAX_PACKED", 30)
    assert {tuple(r) for r in quality.quality(small).select("doc_id", "n_repeat_words", "kept").collect()} == want


def test_leftovers_of_mid_size_documents(spark, monkeypatch):
    """No two documents fit one window: only windows open at a partition's end are merged."""
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 4)
    merged = []
    merge = packing._merge
    monkeypatch.setattr(packing, "_merge", lambda size: merge(size))
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rnd.integers(55, 95, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.pack_documents(df, size=100, open_windows=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter(r.doc_id for r in out) == Counter(range(300)) and not merged
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 100


def test_small_languages_stay(spark):
    share = langid.shares({"a": 10_000_000, "b": 20, "c": 0 + 300}, 10_000)
    assert share["b"] == 1.0 and share["c"] == 1.0 and share["a"] == pytest.approx(9680 / 10_000_000)
    rows = [(i, f"the cat sat on mat number{i % 50}", "en") for i in range(4000)] + [(10_000 + i, "kio estas tio kaj kiel", "eo") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, max_rows=200)
    assert model.langs == ["en", "eo"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[10_003] == "eo" and got[5] == "en"


def test_lists_skip_and_answers_derive():
    """Similar sets: most answers come from others, and blocks of lists stay unread."""
    rnd = np.random.default_rng(4)
    base = [np.sort(rnd.choice(1 << 40, n, replace=False).astype(np.uint64)) for n in (60, 100, 200)]
    sets = [np.sort(np.append(b[rnd.permutation(len(b))[:-2]], rnd.integers(1 << 41, 1 << 42, 2).astype(np.uint64))) for b in base for _ in range(20)]
    tally = Counter()
    lists = jaccard_join.Lists(sets)
    links = {(q, int(lists.order[p])) for q, at in jaccard_join.overlaps(sets, lists, 80, tally) for p in at}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
    assert links == want and tally["derived"] > tally["scratch"] > 0


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001)]
    nodes = sorted({x for e in edges for x in e})
    got = components.connected_components(spark.createDataFrame([(x,) for x in nodes], "id long").checkpoint(),
                                          spark.createDataFrame(edges, "src long, dst long").checkpoint())
    assert {r.id: r.comp for r in got.collect()} == {x: 0 if x < 1000 else 1000 if x < 5000 else 5000 for x in nodes}


def test_pipeline_keeps_clashing_columns(spark, sf, small):
    """Columns named as the stages name their own come through the first four unchanged."""
    docs = small.limit(40).select("*", F.lit(-5.0).alias("score"), F.lit("x").alias("k1"), F.lit("y").alias("kept"),
                                  F.lit(7).alias("a.b"), F.lit("p").alias("lang_pred"), F.lit(1).alias("doc"), F.lit(2).alias("row")).cache()
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    rows = docs.collect()
    assert rows and all((r["score"], r["k1"], r["kept"], r["a.b"], r["lang_pred"], r["doc"], r["row"]) == (-5.0, "x", "y", 7, "p", 1, 2) for r in rows)


def test_first_of_each_in_pieces():
    """A batch of long texts is passed on in pieces, as it is where nothing goes; texts come once, then without text."""
    texts = [f"{i % 90} " * 20_000 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"chunk": [0] * 200, "k1": [i % 90 for i in range(200)], "k2": [0] * 200, "text": texts})
    got = list(C._first_of_each([batch]))
    assert max(pa.compute.sum(pa.compute.binary_length(b.column("text"))).as_py() or 0 for b in got) <= C.PIECE_BYTES + 60_000
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["k1"], r["text"]) for r in rows] == [(i, texts[i]) for i in range(90)] + [(i, None) for i in range(90)]
    assert all(b.validate(full=True) is None and b.schema.names == ["chunk", "k1", "k2", "text"] for b in got)


def test_joins_of_growing_tables_are_not_broadcast(spark):
    """Spark takes the side that explode lays out 32 times, and tables that compress well, for small ones."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many, one = spark.range(1000).select(F.col("id").alias("key"), "id"), spark.range(1000).select(F.col("id").alias("key"))
    for how in ("inner", "left"):
        df = components.salted_join(many, one, "key", "id", how)
        assert "Broadcast" not in plan(df) and df.count() == 1000
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(40)], "doc_id long, text string")
    out = jaccard_join.jaccard_join(docs)
    assert "Broadcast" not in plan(out) and {r.n_links for r in out.collect()} == {1}
