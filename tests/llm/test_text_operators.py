"""Each operator on texts against a plain version, on odd rows, real rows and no rows."""

import zlib

import brute
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skycap.llm import bpe, common, jaccard_join, langid, packing, pii, quality, substring_dedup, suffix_dedup


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def same(got, expected):
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.fixture(params=["edge", "small", "none"])
def docs(request):
    return request.getfixturevalue(request.param)


def texts(docs):
    return rows_of(docs, "doc_id", "text")


def test_quality(docs):
    out = quality.quality(docs)
    got = rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for i, t in texts(docs):
        m = brute.quality(t)
        expected.append((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    same(got, expected)
    assert out.where("kept and base_failed").count() == 0
    assert set(docs.columns) <= set(out.columns)


def test_quality_rules_are_a_table(edge):
    strict = quality.quality(edge, rules=(quality.Rule("n_symbols", "n_words", 0.0, 0.0),))
    assert strict.where("kept and n_symbols > 0").count() == 0


def test_quality_is_native(small):
    plan = quality.quality(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_suffix_dedup(docs):
    res = suffix_dedup.suffix_dedup(docs)
    got = rows_of(common.attach(docs, "doc_id", "text", res), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    t = texts(docs)
    same([(*g[:4], bytes(g[4])) for g in got], [(i, *r) for (i, _), r in zip(t, brute.suffix_dedup([x for _, x in t]))])


def test_suffix_dedup_shorter_strings(edge):
    res = suffix_dedup.suffix_dedup(edge, min_bytes=64)
    got = rows_of(common.attach(edge, "doc_id", "text", res), "doc_id", "n_removed", "n_spans")
    t = texts(edge)
    same(got, [(i, r[1], r[2]) for (i, _), r in zip(t, brute.suffix_dedup([x for _, x in t], 64))])


def test_maximal_repeats_of_a_known_string():
    """All groups of maximal repeats of a text, with every occurrence."""
    text = b"abcXabcYabcXab"
    data = np.frombuffer(text, np.uint8)
    sa = suffix_dedup.SuffixArray(data, np.full(len(text), len(text)), np.arange(len(text)))
    assert [text[i:] for i in sa.order] == sorted(text[i:] for i in range(len(text)))
    plain = [next((k for k, (x, y) in enumerate(zip(text[a:], text[b:])) if x != y), min(len(text) - a, len(text) - b))
             for a, b in zip(sa.order[:-1], sa.order[1:])]
    left = np.array([data[i - 1] if i else -1 for i in sa.order], np.int64)
    found = {(text[sa.order[f]:sa.order[f] + n], tuple(sorted(sa.order[f:z + 1].tolist())))
             for n, f, z in suffix_dedup.maximal_repeats(np.array(plain), left, 2)}
    expected = set()
    for n in range(2, len(text)):
        for s in {text[i:i + n] for i in range(len(text) - n + 1)}:
            at = tuple(i for i in range(len(text)) if text.startswith(s, i))
            differ = lambda xs: len(set(xs)) > 1 or None in xs
            if len(at) > 1 and differ([text[i - 1] if i else None for i in at]) and differ(
                    [text[i + n] if i + n < len(text) else None for i in at]):
                expected.add((s, at))
    assert found == expected


def test_substring_dedup(docs):
    res = substring_dedup.substring_dedup(docs)
    got = rows_of(common.attach(docs, "doc_id", "text", res), "doc_id", "n_words", "n_removed", "kept")
    t = texts(docs)
    same(got, [(i, *r) for (i, _), r in zip(t, brute.substring_dedup([x for _, x in t]))])


def test_substring_dedup_other_windows(edge):
    res = substring_dedup.substring_dedup(edge, window=9, block=4, keep_layout=True)
    got = rows_of(common.attach(edge, "doc_id", "text", res), "doc_id", "n_removed", "kept")
    t = texts(edge)
    plain = brute.substring_dedup([x for _, x in t], 9)
    same(got, [(i, r[1], r[2] if r[1] else x or "") for (i, x), r in zip(t, plain)])
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(edge, window=9, block=6)


@pytest.mark.parametrize("most", [jaccard_join.BLOCK_SETS, 2])
def test_jaccard_join(docs, most, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", most)
    got = rows_of(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "n_links", "component_id")
    t = texts(docs)
    plain = brute.jaccard_join(t)
    same(got, [(i, n, k, c if n else i) for (i, _), (n, k, c) in zip(t, plain)])


def test_jaccard_join_with_empty_blocks(spark, monkeypatch):
    """A few long texts make many blocks, most of them without a set."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ITEMS", 8)
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "n_links", "component_id")
    same(got, [(i, n, k, c) for (i, _), (n, k, c) in zip(rows, brute.jaccard_join(rows))])
    assert sum(n for _, _, n, _ in got) == 2


def test_overlaps_are_derived_from_similar_sets():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.random(200) > 0.06], rnd.integers(0, 1 << 60, 5, dtype=np.uint64)])) for _ in range(60)]
    lists = jaccard_join.Lists(sets)
    got = {q: set(lists.order[hit].tolist()) for q, hit in jaccard_join.overlaps(sets, lists, 80)}
    for i, a in enumerate(sets):
        expected = {j for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        assert got[i] == expected


def test_personal_data(docs):
    out = pii.personal_data(docs)
    got = [(r.doc.doc_id, sorted((s.start, k, s.end) for k, name in enumerate(pii.KINDS[:4]) for s in r[name])) for r in out.collect()]
    same([(i, str(s)) for i, s in got], [(i, str(brute.personal_data(t))) for i, t in texts(docs)])


def test_personal_data_is_native(small):
    plan = pii.personal_data(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_terms_that_disclose(spark):
    """A name found near one address only is removed, common words stay."""
    rows = [(i, f"note {i} from Zerlina at zz@mail.org about the day") for i in range(4)]
    rows += [(10 + i, f"the day from note {i} about nothing at all") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = dict(rows_of(pii.sanitised(docs), "doc_id", "text"))
    assert clean[2] == "note 2 from  at [EMAIL] about the day"
    assert all(clean[i] == t for i, t in rows if i >= 10)
    terms = [[s.value for s in r.terms] for r in pii.personal_data(docs).collect() if r.doc.doc_id < 10]
    assert terms == [["Zerlina"]] * 4


def test_terms_of_values_that_stand_once(spark):
    """Terms go by the kind of value where no value recurs, and everywhere: far from the value, twice, without one."""
    far = " and".join([""] * 30)
    rows = [(i, f"Write to Zerlina {far} u{i}@m{i}.org is the address of zerlina.") for i in range(5)]
    rows += [(9, "Nothing but ZERLINA and the address."), (8, "Zerlinas and the address.")]
    rows += [(10 + i, f"The day to write nothing of the address and note is {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in pii.scored_terms(docs).collect()} == {"zerlina"}
    clean = dict(rows_of(pii.sanitised(docs), "doc_id", "text"))
    assert clean[2] == f"Write to [TERM] {far} [EMAIL] is the address of [TERM]."
    assert clean[9] == "Nothing but [TERM] and the address."
    assert all(clean[i] == t for i, t in rows if i >= 10 or i == 8)


def test_sanitised_keeps_columns(edge, none):
    out = pii.sanitised(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    row = out.where("doc_id = 20").first().text
    assert row == "mail [EMAIL] and [EMAIL][EMAIL] ip [IP] [IP].5 999.1.1.1 card [CARD], [PHONE]"
    assert pii.sanitised(none).count() == 0


def test_packing(docs):
    pieces = packing.pack_documents(docs).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]) for i, t in texts(docs)),
                      key=lambda x: key((x[0], len(x[1]))))
    total = 0
    for i, ids in {str(x): x for x in expected}.values():
        copies = sum(1 for x in expected if x == (i, ids))
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i and p.doc_tokens == len(ids))
        starts = range(0, len(ids), packing.SIZE)
        plain = [(s, len(ids[s:s + packing.SIZE]), zlib.crc32(np.array(ids[s:s + packing.SIZE], "<u4").tobytes())) for s in starts]
        assert [m for m in mine if m in plain] == sorted(plain * copies)
        total += len(plain) * copies
    assert total == len(pieces)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.SIZE


def test_open_windows_are_bounded_and_best_fit():
    w = packing.OpenWindows(100, 2, 0)
    assert w.place(60) == (0, 0)
    assert w.place(70) == (1, 0)
    assert w.place(30) == (1, 70)      # fills window 1, which is closed
    assert w.place(35) == (0, 60)
    assert w.place(90) == (2, 0)
    assert w.place(50) == (3, 0)       # fits none: the fullest of two is emitted
    assert len(w.rooms) == 2 and w.place(50) == (3, 50)
    assert w.place(100) == (4, 0)


def test_bpe_round_trip(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_of(bpe.bpe_round_trip(docs), "doc_id", "ids", "decoded")
    expected = []
    for i, t in texts(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected.append((i, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)))
    same([(i, bytes(b), t) for i, b, t in got], expected)


def test_bpe_merges_rows_as_one_by_one():
    enc = bpe.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    words = [b"aaaaaaaaab", b"internationalisation", b" hello", "Müßiggängerei".encode(), b"x", b"10000000000", b"ababababab"]
    flat, n = enc.merge_rows(words)
    assert flat.tolist() == [i for w in words for i in enc.merge_one(w)]


def test_language_id(small, edge, none):
    model = langid.train(small)
    out = langid.identify(small, model)
    held = out.where(langid.held_out("doc_id"))
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert out.where("score < 0 or score > 1").count() == 0
    odd = {r.doc_id: r for r in langid.identify(edge, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1, 2, 3, 22))
    assert set(langid.identify(edge, model).columns) == set(edge.columns) | {"lang_pred"}
    empty = langid.train(none)
    assert empty.langs == [] and langid.identify(edge, empty).where("lang_pred != 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_language_id_learns_only_from_rows_not_held_out(small):
    lied = small.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.train(lied).langs
    assert langid.train(small.withColumn("lang", F.lit(None).cast("string"))).langs == []


def test_unseen_words_fall_back():
    table = lambda **rows: langid.Table(list(rows), np.array([*rows.values()]).reshape(len(rows), 2))
    model = langid.Model(["a", "b"], table(), [table(q=[-1.0, -2.0]), table(qu=[-3.0, -1.0]), table(), table()])
    scorer = langid.Scorer(model)
    assert scorer.score_unseen("zqu").tolist() == [-3.0, -1.0]
    assert scorer.score_unseen("zq").tolist() == [-1.0, -2.0]
    assert scorer.score_unseen("zz").tolist() == [0.0, 0.0]


def test_packing_copies_texts_by_slices(monkeypatch):
    """A batch of many texts is not copied whole."""
    import tracemalloc

    import pyarrow as pa

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("One", (), {"partitionId": lambda self: 0})())}))
    text = "some words of a text " * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([f"{i} {text}" for i in range(1500)])], ["doc_id", "text"])
    run = packing._pack(type("Shared", (), {"value": spec}), packing.SIZE, packing.OPEN_WINDOWS, packing.END_ID)
    next(run(iter([batch.slice(0, 1)])))  # the tokenizer is there
    tracemalloc.start()
    try:
        ids = sum(b.column("length").to_numpy()[b.column("start").to_numpy() >= 0].sum() for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids > 1500 * 2500 and peak < 22 << 20, peak
