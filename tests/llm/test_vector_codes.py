"""op13 against plain Lloyd rounds on Python integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from skycap.llm import queries, vector_codes as V


def plain(rows, parts=16, entries=64, rounds=2):
    """rows of (id, vector, label) -> ((id, code, error, label error) of each, digest of the codebooks)."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(v) for _, v, _ in fine), default=0) // parts))
    cut = lambda v: [[math.floor(256 * x) for x in [*v, *[0.0] * (parts * width - len(v))][k * width:(k + 1) * width]] for k in range(parts)]
    fine.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    vecs = [cut(v) for _, v, _ in fine]
    books = [[v[k] for v in vecs[:entries]] for k in range(parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            got = defaultdict(list)
            for v in vecs:
                got[near(v[k], books[k])[1]].append(v[k])
            books[k] = [[sum(x) // len(got[i]) for x in zip(*got[i])] if i in got else c for i, c in enumerate(books[k])]
    out, by_label = [], defaultdict(int)
    for (i, _, label), v in zip(fine, vecs):
        best = [near(v[k], books[k]) for k in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label])
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[x]) for i, c, e, x in out), key=str), digest


def got(df, **kw):
    out = V.vector_codes(df, **kw)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in V.label_totals(out.codes).collect()), key=str), out.sha256()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(V, "OWNER_MEMBERS", 16)  # several owners an entry
    rnd = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rnd.normal(size=32)], f"l{i % 3}") for i in range(150)]
    rows += [(1000, None, "l1"), (1001, [], "l1"), (1002, [0.0] * 32, None), (1003, [1.0, None], "l0"), (1004, [float("nan")] * 32, "l0"),
             (1005, [float("-inf")] * 32, "l0"), (1006, [1.0, 2.0], None), (5, rows[5][1], "l9"), (None, [0.25] * 32, "l2")]
    rows += [(2000 + i, [-0.7] * 32, "hot") for i in range(90)]
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in rows],
                               "vec_id long, embedding array<double>, label string, row long, entry string, position int")
    assert got(df) == plain(rows)
    assert got(df, parts=5, entries=7, rounds=4) == plain(rows, 5, 7, 4)
    assert got(df, parts=8, entries=200, rounds=0) == plain(rows, 8, 200, 0)


def test_few_rows_and_none(spark):
    schema = "vec_id int, embedding array<float>, label int"
    few = [(3, [0.5] * 16, 1), (1, [-0.25] * 16, None)]
    assert got(spark.createDataFrame(few, schema)) == plain(few)
    none = V.vector_codes(spark.createDataFrame([], schema))
    assert V.label_totals(none.codes).count() == 0
    with pytest.raises(ValueError):
        V.vector_codes(spark.createDataFrame(few, schema), entries=300)


def test_only_movers_are_shuffled(spark, sf, monkeypatch):
    """After the first deal, what is dealt again is what changes its entry."""
    dealt = []
    deal = V._dealt
    monkeypatch.setattr(V, "_dealt", lambda m, n: dealt.append(m) or deal(m, n))
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    V.vector_codes(emb)
    assert len(dealt) == 2 and dealt[0].count() == 16 * emb.count()
    assert 0 < dealt[1].count() < dealt[0].count()
    plan = V._reassigned(dealt[1], np.zeros((16, 64, 4), np.int64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = plain(rows)
    out = queries.QUERIES["op13_vector_codes"](spark, sf).collect()
    assert sorted((tuple(r)[:4] for r in out), key=str) == want and {r.codebooks_sha256 for r in out} == {digest}
