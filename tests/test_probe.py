"""Interval labelling edge cases, ROC/AUC and splits against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycap.operators import probe as PR


def _storms(spark, rows):
    raw = spark.createDataFrame(rows, "seq long, Hurricane string, Regions string, `Start Date` string, `End Date` string")
    return PR.explode_regions(PR.parse_storms(raw))


def test_lookahead_edges(spark):
    storms = _storms(spark, [
        (1, "A", "Northeast", "Jul 10, 2019", "Jul 12, 2019"),
        (2, "B", "Northeast, South", "Jul 13, 2019", "Jul 14, 2019"),
        (3, "C", "Continental US", "Jul 11, 2019", "Jul 12, 2019"),
        (4, "D", "Gulf", "Jul 11, 2019", "Jul 12, 2019"),
    ])
    samples = spark.createDataFrame([
        ("s1", "2019-07-10", "Northeast"),   # A starts on the sample date (excluded); B on day 13 = 10+3 -> B
        ("s2", "2019-07-07", "Northeast"),   # start on the last lookahead day (10 = 7+3): included -> A
        ("s3", "2019-07-09", "Northeast"),   # A (10) and B? (13 > 12) -> A
        ("s4", "2019-07-10", "South"),       # B on day 13 = 10+3 -> B
        ("s5", "2019-07-08", "Mars"),        # unmapped -> Continental US -> C
        ("s6", "bad-date", "Northeast"),     # unparseable -> no label
        ("s7", "2019-07-13", "Northeast"),   # B starts on the sample date -> excluded, nothing later
    ], "sample_id string, date string, region string")
    out = {r["sample_id"]: (r["label"], r["storm"]) for r in PR.label_samples(samples, storms, 3).collect()}
    assert out == {"s1": (1, "B"), "s2": (1, "A"), "s3": (1, "A"), "s4": (1, "B"), "s5": (1, "C"),
                   "s6": (0, None), "s7": (0, None)}


@pytest.mark.parametrize("days", [1, 3, 30, 365])
def test_windows_of_any_width_equal_all_pairs(spark, days):
    import datetime as dt
    rnd = np.random.default_rng(days)
    day = lambda: dt.date(1969, 6, 1) + dt.timedelta(days=int(rnd.integers(0, 900)))  # noqa: E731  days before 1970 as well
    storms = [(i, f"S{i}", r, day()) for i, r in enumerate(rnd.choice(["South", "West"], 60).tolist())]
    samples = [(f"s{i}", str(day()), "South" if i % 4 else "West") for i in range(400)]
    df = spark.createDataFrame(samples, "sample_id string, date string, region string")
    st = spark.createDataFrame(storms, "seq long, name string, region string, start_date date")
    got = {r.sample_id: (r.label, r.storm, r.n_matches) for r in PR.label_samples(df, st, days, counts=True).collect()}
    for k, date, region in samples:
        d = dt.date.fromisoformat(date)
        hits = [(q, n) for q, n, r, s in storms if r == region and d < s <= d + dt.timedelta(days=days)]
        assert got[k] == (int(bool(hits)), min(hits)[1] if hits else None, len(hits))


def test_first_storm_in_file_order(spark):
    storms = _storms(spark, [(5, "Late", "West", "Aug 02, 2020", "Aug 03, 2020"),
                             (2, "Early", "West", "Aug 03, 2020", "Aug 04, 2020")])
    s = spark.createDataFrame([("x", "2020-08-01", "West")], "sample_id string, date string, region string")
    assert PR.label_samples(s, storms, 7).first()["storm"] == "Early"


def _auc_brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_auc_and_roc(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)  # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, predicted_probability double")
    assert PR.auc_roc(df).first()[0] == pytest.approx(_auc_brute(y, p), abs=1e-12)
    roc = sorted((r["point"], r["fpr"], r["tpr"], r["threshold"]) for r in PR.roc_curve(df).collect())
    thr = np.unique(p)[::-1]
    tps = np.array([(p[y == 1] >= t).sum() for t in thr])
    fps = np.array([(p[y == 0] >= t).sum() for t in thr])
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    exp = [(0.0, 0.0)] + [(f / fps[-1], t / tps[-1]) for f, t, k in zip(fps, tps, keep) if k]
    assert [(round(a, 12), round(b, 12)) for _, a, b, _ in roc] == [(round(a, 12), round(b, 12)) for a, b in exp]
    assert roc[0][3] == float("inf")


def test_stratified_split_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    out = PR.stratified_split(df, "label", 0.2, 42)
    counts = {(r["label"], r["is_test"]): r["count"] for r in out.groupBy("label", "is_test").count().collect()}
    n1 = 143
    assert counts[(1, True)] == round(0.2 * n1) and counts[(0, True)] == round(0.2 * (1000 - n1))


def test_random_split_exact(spark):
    df = spark.range(101).select(F.col("id").alias("idx"))
    c = {r["split"]: r["count"] for r in PR.random_split(df, 0.8, 0.1).groupBy("split").count().collect()}
    assert c == {"train": 80, "val": 10, "test": 11}


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 5))
    y = (X @ np.array([1.0, -2.0, 0.5, 0.0, 0.3]) + rng.normal(scale=0.8, size=300) > 0.4).astype(int)
    df = spark.createDataFrame([(list(map(float, x)), int(t)) for x, t in zip(X, y)], "scaled array<double>, label int")
    model = PR.fit_logistic(df, C=1.0)
    # sklearn objective: 0.5 |w|^2 + C * sum_i s_i * logloss_i, balanced sample weights
    n, n1 = len(y), y.sum()
    s = np.where(y == 1, n / (2.0 * n1), n / (2.0 * (n - n1)))
    Z = np.c_[X, np.ones(n)]
    w = np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-Z @ w))
        g = Z.T @ (s * (p - y)) + np.r_[w[:5], 0.0]
        H = (Z * (s * p * (1 - p))[:, None]).T @ Z + np.diag([1, 1, 1, 1, 1, 0.0])
        w -= np.linalg.solve(H, g)
    assert np.allclose(model.coefficients.toArray(), w[:5], atol=1e-4)
    assert model.intercept == pytest.approx(w[5], abs=1e-4)


def test_folds_fitted_together(spark):
    """Coefficients of each fold equal a fit of its own; passes do not grow with the folds."""
    from skycap.operators.newton import fit_folds, predict_folds
    rng = np.random.default_rng(5)
    X = rng.normal(size=(400, 6))
    y = (X @ np.array([2.0, -1.0, 0.5, 0.0, 0.3, 1.0]) + rng.normal(scale=0.5, size=400) > 0.8).astype(int)
    rows = [(i, list(map(float, x)), int(t), i % 5) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "idx long, scaled array<double>, label int, fold int").repartition(4)
    models, passes = fit_folds(df, [-1, 0, 1, 2, 3, 4])
    _, one = fit_folds(df, [0])
    assert passes <= one + 2
    for m, beta in models.items():
        keep = np.arange(400) % 5 != m
        Z, t = np.c_[X, np.ones(400)][keep], y[keep]
        s = np.where(t == 1, len(t) / (2.0 * t.sum()), len(t) / (2.0 * (len(t) - t.sum())))
        p = 1 / (1 + np.exp(-Z @ beta))
        gradient = Z.T @ (s * (p - t)) + np.r_[beta[:6], 0.0]
        assert np.abs(gradient).max() < 1e-6, m
    pred = {r.idx: r.predicted_probability for r in predict_folds(df, models).collect()}
    assert all(np.isclose(pred[i], 1 / (1 + np.exp(-(X[i] @ models[i % 5][:6] + models[i % 5][6])))) for i in range(400))
    scores = PR.cross_validate(df.drop("fold"), 5, 42).collect()
    assert sorted(r.fold for r in scores) == [0, 1, 2, 3, 4] and all(0.5 < r.f1 <= 1 for r in scores)


def test_folds_of_nothing_and_of_one_class(spark):
    from skycap.operators.newton import fit_folds
    schema = "scaled array<double>, label int, fold int"
    assert fit_folds(spark.createDataFrame([], schema), [0, 1]) == ({}, 0)
    df = spark.createDataFrame([([1.0, 2.0], 1, 0), ([2.0, 1.0], 1, 1), (None, 1, 0), ([None, 1.0], 0, 1), ([1.0, 1.0], None, 1)], schema)
    models, _ = fit_folds(df, [0, 1], max_iter=30)
    assert all(np.isfinite(b).all() for b in models.values()) and len(models) == 2


def test_classification_report(spark):
    # tp=3, fp=1, fn=2, tn=4
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "label int, predicted_label int")
    rep = {r["class"]: r for r in PR.classification_report(df).collect()}
    assert rep["1"]["precision"] == pytest.approx(3 / 4) and rep["1"]["recall"] == pytest.approx(3 / 5)
    assert rep["0"]["precision"] == pytest.approx(4 / 6) and rep["0"]["recall"] == pytest.approx(4 / 5)
    assert rep["1"]["support"] == 5 and rep["0"]["support"] == 5
    assert rep["accuracy"]["f1"] == pytest.approx(0.7)
    f1_1, f1_0 = 2 * 3 / (6 + 1 + 2), 2 * 4 / (8 + 2 + 1)
    assert rep["macro avg"]["f1"] == pytest.approx((f1_0 + f1_1) / 2)
    assert rep["weighted avg"]["f1"] == pytest.approx((f1_0 * 5 + f1_1 * 5) / 10)
    empty = spark.createDataFrame([(0, 0)], "label int, predicted_label int")
    assert {r["class"]: r["precision"] for r in PR.classification_report(empty).collect()}["1"] == 0.0


def test_linear_probe_invariants(spark, sf):
    from skycap.plans import derive
    from skycap.plans import derive
    from skycap.plans.q_probe import _storms
    res = PR.linear_probe(derive.probe_samples(spark, sf), _storms(spark, sf), 7)
    m = res["metrics"].first()
    for k in ("accuracy", "precision", "recall", "f1", "auc"):
        assert 0.0 <= m[k] <= 1.0
    conf = res["confusion"].collect()
    assert len(conf) == 4 and sum(r["count"] for r in conf) == m["support"]
    roc = sorted((r["point"], r["fpr"], r["tpr"]) for r in res["roc"].collect())
    assert roc[0][1:] == (0.0, 0.0) and roc[-1][1:] == (1.0, 1.0)
    preds = res["predictions"]
    assert preds.count() == m["support"] and preds.select("sample_id").distinct().count() == m["support"]
    assert len(res["importance"]) == 64


def test_splits_of_ids_that_share_a_hash(spark):
    """Ids that meet modulo 2^31-1 are ordered by the id: splits are exact and repeatable."""
    ids = [2**31 - 1 + d for d in range(-4, 4)] + [2**62 + d for d in range(8)] + list(range(4))
    df = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "idx long, label int")
    one = {r["idx"]: r["split"] for r in PR.random_split(df, 0.5, 0.25).collect()}
    two = {r["idx"]: r["split"] for r in PR.random_split(df.repartition(7), 0.5, 0.25).collect()}
    assert one == two and sorted(one.values()).count("train") == 10
    test = PR.stratified_split(df, "label", 0.2).where("is_test").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in test} == {0: 2, 1: 2}


def test_probe_of_nothing(spark, sf):
    from skycap.plans import derive
    from skycap.plans.q_probe import _storms
    assert PR.linear_probe(derive.probe_samples(spark, sf).where("false"), _storms(spark, sf)) == {}


def test_days_of_one_digit(spark):
    raw = spark.createDataFrame([(1, "A", "South", "Aug 5, 2020", "Aug 15, 2020")], "seq long, Hurricane string, Regions string, `Start Date` string, `End Date` string")
    row = PR.parse_storms(raw).first()
    assert str(row["start_date"]) == "2020-08-05" and str(row["end_date"]) == "2020-08-15"
