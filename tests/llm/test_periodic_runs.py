"""op12 against a plain search for runs."""

import random
import zlib

import brute
import numpy as np
import pytest

from skycap.llm import periodic_runs as P
from skycap.llm import queries


def plain_runs(w, least=24, times=3):
    """(start, length, period) of all runs, period by period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def digest(w):
    found = plain_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *head, brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            brute.sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def random_words(rnd):
    """Words with planted repeats inside repeats, powers, and near powers."""
    out = []
    while len(out) < rnd.randrange(1, 400):
        unit = [rnd.choice("abcd") for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 9, 13, 40]))]
        if rnd.random() < 0.3:
            unit = unit * rnd.randrange(1, 4) + [rnd.choice("abcd")]
        out += unit * rnd.choice([1, 1, 2, 3, 4, 7, 20]) + unit[:rnd.randrange(len(unit) + 1)]
    return out


def test_random_texts():
    rnd = random.Random(11)
    texts = [random_words(rnd) for _ in range(300)] + [[], ["a"] * 23, ["a"] * 24, ["a"] * 5000, list("ab") * 700]
    words, first, _ = P.numbered([" ".join(t) for t in texts])
    for least, times in ((24, 3), (8, 3), (12, 4)):
        got = list(zip(*(x.tolist() for x in P.runs(words, first, least, times))))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, least, times)]


def test_extensions_of_random_positions():
    """Grammar extensions equal a comparison word by word, both ways."""
    rnd = random.Random(2)
    parts = [random_words(rnd) for _ in range(40)]
    symbols, mark = [-1], 1
    for t in parts:
        mark += 1
        symbols += [ord(c) for c in t] + [-mark]
    s = np.array(symbols, np.int64)
    grammar = P.Grammar(s)
    assert len(grammar.up) > 8 and any(grammar.block) and not all(grammar.block)
    i = np.array([rnd.randrange(len(s)) for _ in range(4000)])
    j = np.array([rnd.randrange(len(s)) for _ in range(4000)])
    i, j = i[i != j], j[i != j]
    for step in (1, -1):
        got = grammar.extension(i, j, step)
        for a, b, n in zip(i, j, got):
            k = 0
            while s[a + k * step] == s[b + k * step]:
                k += 1
            assert n == k


def test_grid_in_small_chunks(monkeypatch):
    rnd = random.Random(4)
    texts = [random_words(rnd) for _ in range(60)]
    words, first, _ = P.numbered([" ".join(t) for t in texts])
    want = [x.tolist() for x in P.runs(words, first)]
    monkeypatch.setattr(P, "GRID_POINTS", 7)
    monkeypatch.setattr(P, "ROUNDS", 1)
    assert [x.tolist() for x in P.runs(words, first)] == want


@pytest.mark.parametrize("name", ["edge", "small", "none"])
def test_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        w = brute.words(r.text)
        found = plain_runs(w)
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r.doc_id, len(w), found, " ".join(x for i, x in enumerate(w) if i not in drop)))
    order = lambda x: (x[0] is None, x[0], x[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_planted_rows(edge, small):
    for docs in (edge, small):
        got = {(r.doc_id, " ".join(brute.words(r.text))) for r in P.planted(docs).collect()}
        assert got == {(r.doc_id, " ".join(planted(r.doc_id, brute.words(r.text)))) for r in docs.select("doc_id", "text").collect()}


def test_query(spark, sf):
    docs = {r.doc_id: brute.words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r)[1:] == digest(planted(r.doc_id, docs[r.doc_id]))


def test_one_very_long_text():
    """A million words, with runs of few and of many words, one long text alone."""
    rnd = random.Random(8)
    w = [f"w{rnd.randrange(50_000)}" for _ in range(400_000)]
    unit = [f"u{rnd.randrange(90)}" for _ in range(70_000)]
    text = w + unit * 3 + ["x", "y"] * 150_000 + ["z"] * 90_000 + w[:1000]
    words, first, _ = P.numbered([" ".join(text)])
    got = list(zip(*(x.tolist() for x in P.runs(words, first))))
    n = len(w)
    assert (0, n, 210_000, 70_000) in got and (0, n + 210_000, 300_000, 2) in got and (0, n + 510_000, 90_000, 1) in got
