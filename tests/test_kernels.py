"""Blocked all-pairs kernels against brute force on small data.

Tiny blocks force many block pairs, so the per-block partials and their
merge are exercised, not just the single-block path."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skycap.functions.scoring import Weights, np_relevance
from skycap.operators import cells as CE
from skycap.operators import cluster as CL
from skycap.operators import retrieval as R
from skycap.plans import derive

W = {"region": 0.8, "season": 0.6, "temp": 0.7, "cond": 0.5}
ORDER = ["winter", "spring", "summer", "fall"]


def _season_sim(a, b):
    if a == b:
        return 1.0
    a, b = a.replace("autumn", "fall").split()[-1], b.replace("autumn", "fall").split()[-1]
    if a not in ORDER or b not in ORDER:
        return 0.0
    d = abs(ORDER.index(a) - ORDER.index(b))
    d = min(d, 4 - d)
    return {0: 1.0, 1: 0.5}.get(d, 0.0)


def _rel(p, q):
    if p["caption"] == q["caption"]:
        return 1.0
    s = 0.0
    if p["region"] != "Unknown" and q["region"] != "Unknown":
        s += (1.0 if p["region"] == q["region"] else 0.0) * W["region"]
    if p["season"] != "Unknown" and q["season"] != "Unknown":
        s += _season_sim(p["season"], q["season"]) * W["season"]
    if p["t"] is not None and q["t"] is not None:
        d = abs(p["t"] - q["t"])
        s += (1.0 - d / 5.0 if d <= 5.0 else 0.0) * W["temp"]
    if p["cond"] != "Unknown" and q["cond"] != "Unknown":
        s += (1.0 if p["cond"] == q["cond"] else 0.0) * W["cond"]
    return s / 2.6


@pytest.fixture(scope="module")
def samples(spark, sf):
    from skycap.functions import parse as P
    s = derive.emb_samples(spark, sf).withColumn("p", P.parse_caption(F.col("caption")))
    return R.parse_features(derive.emb_samples(spark, sf)), s


def _brute(rows, qv, cv):
    n = len(rows)
    Q = np.array([r[qv] for r in rows], dtype=np.float64)
    Cm = np.array([r[cv] for r in rows], dtype=np.float64)
    sim = Q @ Cm.T
    rel = np.array([[1.0 if i == j else _rel(rows[i], rows[j]) for j in range(n)] for i in range(n)])
    ids = np.arange(n)
    out = {}
    ranks = [np.lexsort((ids, -sim[i])) for i in range(n)]
    for k in (1, 5, 10):
        out[f"recall_at_{k}"] = np.mean([i in ranks[i][:min(k, n)] for i in range(n)])
    rr = []
    for i in range(n):
        hit = [r for r, j in enumerate(ranks[i]) if rel[i, j] >= 0.8]
        rr.append(1.0 / (hit[0] + 1) if hit else 0.0)
    out["mrr"] = np.mean(rr)
    for k in (5, 10):
        vals = []
        for i in range(n):
            dcg = sum(rel[i, ranks[i][r]] / math.log2(r + 2) for r in range(min(k, n)))
            ideal = np.sort(rel[i])[::-1]
            idcg = sum(ideal[r] / math.log2(r + 2) for r in range(min(k, n)))
            vals.append(dcg / idcg if idcg > 0 else 0.0)
        out[f"ndcg_at_{k}"] = np.mean(vals)
    return out


def test_retrieval_report_matches_brute_force(spark, samples):
    feats, parsed = samples
    pdf = parsed.select("idx", "image_emb", "text_emb", "caption", F.col("p.region").alias("region"),
                        F.col("p.season").alias("season"), F.col("p.avg_temperature").alias("t"),
                        F.col("p.conditions").alias("cond")).orderBy("idx").collect()
    rows = [r.asDict() for r in pdf]
    rep = R.retrieval_report(feats, block_rows=64).first().asDict()
    for tag, qv, cv in (("i2t", "image_emb", "text_emb"), ("t2i", "text_emb", "image_emb")):
        exp = _brute(rows, qv, cv)
        for name, v in exp.items():
            assert rep[f"{tag}_{name}"] == pytest.approx(v, abs=1e-9), (tag, name)


def test_top_columns_with_ties():
    rnd = np.random.default_rng(2)
    for k in (1, 3, 7):
        x = rnd.integers(0, 4, (50, 7)).astype(float)
        assert (R.top_columns(x, k) == np.lexsort((np.broadcast_to(np.arange(7), x.shape), -x), axis=1)[:, :k]).all()


def test_rank_of_first_relevant_beyond_the_first_k(spark, samples):
    """With few places a second pass counts; the ranks are those found with many, also among equal vectors."""
    feats, _ = samples
    shifted = feats.where("idx < 40").withColumn("idx", F.col("idx") + 100_000)  # same vectors and captions, other ids
    both = feats.unionByName(shifted)  # every other image looks away from its own text
    both = both.withColumn("image_emb", F.transform("image_emb", lambda x: F.when(F.col("idx") % 2 == 0, -x).otherwise(x)))
    rows = lambda k: {(r.dir, r.qid): (r.rank_true, r.rank_first_rel, r.pos_n)
                      for r in R.ranked_partials(both, [R.I2T, R.T2I], k_max=k, block_rows=70).collect()}
    few, many = rows(1), rows(1000)
    assert few == many and len(few) == 2 * both.count()
    assert any(first is not None and first > 1 for _, first, _ in few.values())


def test_silhouette_and_neighbours(spark, sf):
    s = derive.emb_samples(spark, sf).select("idx", F.col("label").cast("long").alias("cluster"),
                                             F.col("image_emb").cast("array<double>").alias("x"))
    rows = s.orderBy("idx").collect()
    X = np.array([r["x"] for r in rows])
    lab = np.array([r["cluster"] for r in rows])
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    sil = []
    for i in range(len(X)):
        own = (lab == lab[i])
        own[i] = False
        a = D[i, own].mean() if own.any() else 0.0
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        sil.append(0.0 if not own.any() else (b - a) / max(a, b))
    assert CL.silhouette(s, "cluster", "x", block_rows=50) == pytest.approx(np.mean(sil), abs=1e-9)
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    nb = ((1.0 - U @ U.T) <= 0.7).sum(axis=1)
    got = {r["qid"]: r["neighbours"] for r in CL.neighbour_counts(s, 0.7, "x", block_rows=50).collect()}
    assert [got[i] for i in range(len(X))] == nb.tolist()


def _dbscan_reference(U, eps, min_samples):
    n = len(U)
    nbrs = [np.nonzero((1.0 - U[i] @ U.T) <= eps)[0] for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nbrs])
    labels = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = c
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nbrs[p]:
                if labels[q] == -1:
                    labels[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    return labels


@pytest.mark.parametrize("eps", [0.6, 0.7])
def test_dbscan_matches_reference_rules(spark, sf, eps):
    s = derive.emb_samples(spark, sf).select("idx", F.col("image_emb").cast("array<double>").alias("x"))
    rows = s.orderBy("idx").collect()
    X = np.array([r["x"] for r in rows])
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    exp = _dbscan_reference(U, eps, 5)
    got = {r["idx"]: r["cluster"] for r in CL.dbscan(s, eps, 5, "x", block_rows=64).collect()}
    assert [got[i] for i in range(len(X))] == exp.tolist()


def test_distractor_repeat_and_skip(spark):
    from skycap.operators.zeroshot import distractors
    # 6 samples: 5 share one caption, one differs -> the shared ones have 1 potential distractor
    rows = [(i, "same" if i < 5 else "other") for i in range(6)]
    s = spark.createDataFrame(rows, "idx long, caption string")
    out = {}
    for r in distractors(s, k=3, seed=1).collect():
        out.setdefault(r["q_idx"], []).append((r["pos"], r["c_idx"]))
    for q in range(5):
        assert sorted(out[q]) == [(0, q), (1, 5), (2, 5), (3, 5)]
    assert sorted(c for p, c in out[5] if p > 0) == sorted(c for p, c in out[5] if p > 0)
    assert len(out[5]) == 4 and len({c for p, c in out[5] if p > 0}) == 3
    only = spark.createDataFrame([(0, "a"), (1, "a")], "idx long, caption string")
    assert distractors(only, k=2).count() == 0


def test_silhouette_of_singletons_and_equal_points(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [0.0, 0.0], 1), (2, [5.0, 0.0], 2), (3, [0.0, 0.0], 0), (4, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "idx long, x array<double>, cluster long")
    got = {r["qid"]: r["silhouette"] for r in CL.silhouette_per_point(df).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    same = df.withColumn("cluster", F.col("idx") % 2)
    assert CL.calinski_harabasz_frame(df.where("idx <> 2"), "cluster", "x").first()[0] == 1.0
    assert len(CL.silhouettes(same, ["cluster", "idx"])) == 2


def test_distractors_with_a_common_caption(spark):
    """Every query gets k different samples of other captions, also where one caption fills nearly all."""
    from skycap.operators.zeroshot import distractors
    rows = [(i, "common" if i >= 12 else f"c{i}") for i in range(800)]
    s = spark.createDataFrame(rows, "idx long, caption string")
    got = {}
    for r in distractors(s, k=9).where("pos > 0").collect():
        got.setdefault(r["q_idx"], []).append(r["c_idx"])
    caption = dict(rows)
    assert len(got) == 800
    for q, c in got.items():
        assert len(c) == 9 == len(set(c)) and all(caption[x] != caption[q] for x in c)


def test_many_models_in_one_pass(spark):
    """Sweep with ten starts: no worse than ten single fits, labels and scores of the same centres, few scans."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from skycap.operators import lloyd as LL
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(6, 5))[rnd.integers(0, 6, 240)] * 6 + rnd.normal(size=(240, 5))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "idx long, x array<double>")
    vectors = df.select(F.col("idx").alias("id"), F.col("x").alias("v"))
    fits = LL.fit_many(vectors, [1, 5, 6], n_init=10)
    single = df.withColumn("v", array_to_vector("x")).cache()
    for k in (5, 6):
        costs = [KMeans(k=k, seed=42 + i, featuresCol="v").fit(single).summary.trainingCost for i in range(4)]
        assert fits.inertia[k] <= min(costs) * (1 + 1e-9)
    assert fits.passes <= 40  # not 3 * 10 fits of several passes each
    lab = {r.idx: r.k6 for r in LL.with_labels(df, {"k6": fits.centres[6]}, "x").collect()}
    near = ((x[:, None] - fits.centres[6][None]) ** 2).sum(-1)
    assert [lab[i] for i in range(240)] == near.argmin(1).tolist()
    assert fits.inertia[6] == pytest.approx(near.min(1).sum())
    assert fits.inertia[1] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    sweep = {r.k: r for r in CL.find_optimal_k(df, (5, 6), n_init=3).collect()}
    y = df.join(LL.with_labels(df, {"cluster": fits.centres[6]}, "x").select("idx", "cluster"), "idx")
    assert sweep[6].calinski_harabasz == pytest.approx(CL.calinski_harabasz_frame(y).first()[0])
    assert sweep[6].silhouette == pytest.approx(CL.silhouette(y))


def test_pivot_cells_shuffle_less_than_blocks(spark):
    """Clustered vectors: equal counts, less than half of the rows that the block join deals."""
    from skycap.operators import cells as CE
    from skycap.operators.pairs import n_blocks
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(24, 12))[rnd.integers(0, 24, 1500)] + 0.05 * rnd.normal(size=(1500, 12))
    x[7] = 0.0
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "idx long, x array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    got = {r.qid: r.neighbours for r in CL.neighbour_counts(df, 0.05, block_rows=60).collect()}
    want = ((1.0 - u @ u.T) <= 0.05).sum(axis=1)
    assert [got.get(i, 0) for i in range(1500)] == want.tolist()
    pts = df.select(F.col("idx").alias("id"), F.col("x").alias("v"))
    q, c = CE.Cells(pts, 0.05, 60).dealt(pts, pts)
    assert 2 * (q.count() + c.count()) < 2 * 1500 * n_blocks(1500, 60)


def test_clustering_bundle(spark, tmp_path):
    rows = [(i, [float(i // 4), float(i % 4) / 9], (i // 4 if i else -1), "r" + "ab"[i % 2], "winter", "dry", 1.0 * i, None, 2.0) for i in range(12)]
    df = spark.createDataFrame(rows, "idx long, x array<double>, cluster long, region string, season string, precipitation string, "
                                     "avg_temperature double, wind_speed double, humidity double")
    res = CL.clustering_results(df.select("idx", "x"), df.select("idx", "cluster"), df.drop("x", "cluster"), [[0.0, 0.0], [1.0, 0.1], [2.0, 0.2]])
    back = CL.read_results(spark, CL.write_results(res, str(tmp_path)))
    o = back.overall.first()
    assert (o.n_clusters, o.noise) == (3, 1) and o.silhouette == pytest.approx(CL.silhouette(df)) and len(o.explained_variance) == 2
    c = {r.cluster: r for r in back.clusters.collect()}
    assert set(c) == {0, 1, 2} and c[1].size == 4 and c[1].region_hist == "ra:2;rb:2" and c[1].dominant_region == "ra" and c[1].centre == [1.0, 0.1]
    assert back.samples.count() == 12 and all(len(r.reduced) == 2 for r in back.samples.collect())
    with pytest.raises(ValueError):
        CL.prepared(df, "sound")


def test_scorer_with_other_weights(spark):
    """Columns and blocked kernel agree for given weights and tolerance, also where nothing weighs."""
    from skycap.functions import scoring as M
    fields = "region string, season string, avg_temperature double, conditions string, raw_caption string"
    a = ("south", "mid winter", 10.0, "rain", "a")
    others = [("south", "early fall", 12.0, "rain", "b"), ("north", "late spring", 40.0, "Unknown", "c"), ("Unknown", "mid winter", None, "dry", "a")]
    df = spark.createDataFrame([(a, o) for o in others], f"x struct<{fields.replace(' string', ':string').replace(' double', ':double')}>, "
                                                          f"y struct<{fields.replace(' string', ':string').replace(' double', ':double')}>")
    code = {"south": 0, "north": 1, "rain": 0, "dry": 1, "Unknown": -1}
    feats = lambda rows, ids: {
        "region": np.array([code[r[0]] for r in rows]), "season": np.array([ORDER.index(r[1].split()[-1]) for r in rows]),
        "temp": np.array([np.nan if r[2] is None else r[2] for r in rows]), "conditions": np.array([code[r[3]] for r in rows]),
        "caption": np.array([ord(r[4]) for r in rows]), "id": np.array(ids)}
    for w in (M.Weights(), M.Weights(region=1.0, season=0.0, tolerance=20.0), M.Weights(tolerance=0.0), M.Weights(0.0, 0.0, 0.0, 0.0)):
        got = [r[0] for r in df.select(M.weather_similarity("x", "y", w)).collect()]
        assert got == pytest.approx(M.np_relevance(feats([a], [0]), feats(others, [1, 2, 3]), w)[0].tolist())
    assert M.Weights().total == M.MAX_TOTAL_WEIGHT


def test_silhouette_of_many_blocks(spark):
    """Arrays of sums over many block pairs, the rows for more clusters than fit an array, repeated ids and no label."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(90, 3))
    rows = [(i % 80, x[i % 80].tolist(), None if i == 7 else i % 80 % 4, i % 80 % 9) for i in range(90)]
    df = spark.createDataFrame(rows, "idx long, x array<double>, a long, b long")
    got = {(r.qid, r.which): r.silhouette for r in CL.silhouette_points(df, ["a", "b"], block_rows=20).collect()}
    assert len(got) == 160 and got[7, 0] == 0.0
    ids, b = np.arange(90) % 80, np.arange(90) % 80 % 9
    for i in range(80):
        d = np.sqrt(((x[ids] - x[i]) ** 2).sum(axis=1))
        mean = {c: d[(b == c) & (ids != i)].mean() for c in range(9)}
        near = min(v for c, v in mean.items() if c != i % 9)
        assert got[i, 1] == pytest.approx((near - mean[i % 9]) / max(near, mean[i % 9]))
    once = df.where("idx >= 10")
    rows = {(r.qid, r.which): r.silhouette for r in CL._silhouette_rows(once, ["a", "b"], "x", "idx", 20).collect()}
    assert rows == pytest.approx({(r.qid, r.which): r.silhouette for r in CL.silhouette_points(once, ["a", "b"], block_rows=20).collect()})
    # an array of sums a point and block pair, not a row for every cluster
    many = CL.silhouette_points(df, ["a", "b"], block_rows=20)
    assert "SortMergeJoin" not in many._jdf.queryExecution().executedPlan().toString()


def test_tiles_of_relevance_and_partials():
    """Tiles equal the relevance of whole blocks to the last bit, and partials over many tiles those over one."""
    rnd = np.random.default_rng(2)

    def side(key, n):
        x = np.round(rnd.normal(size=(n, 3)), 1)
        return pd.DataFrame({key: rnd.permutation(n), "vec": list(x), "self": np.round(rnd.normal(size=n), 1), "f_region": rnd.integers(-1, 3, n),
                             "f_season": rnd.integers(-1, 4, n), "f_temp": np.where(rnd.random(n) < 0.2, np.nan, np.round(rnd.normal(size=n) * 4, 1)),
                             "f_cond": rnd.integers(-1, 3, n), "f_cap1": rnd.integers(0, 40, n), "f_cap2": 0})

    q, c = side("qid", 90), side("cid", 70)
    feats = lambda p: {"region": p.f_region.to_numpy(), "season": p.f_season.to_numpy(), "temp": p.f_temp.to_numpy(),
                       "conditions": p.f_cond.to_numpy()}
    want = {**feats(q), "id": np.full(90, -1), "caption": np.full(90, -1)}, {**feats(c), "id": np.full(70, -2), "caption": np.full(70, -2)}
    tile = R._Relevances(R._Feats(q), R._Feats(c), Weights()).tile(slice(10, 60), slice(5, 70))
    assert (tile == np_relevance(*want)[10:60, 5:70]).all()
    kernel = R._phase1_kernel(10, 0.8, [R.I2T, R.T2I])
    one = kernel(q, c)
    before, R.TILE = R.TILE, 16
    try:
        many = kernel(q, c)
    finally:
        R.TILE = before
    for a, b in zip(one.to_dict("records"), many.to_dict("records")):
        assert list(a.pop("ideal")) == list(b.pop("ideal"))
        assert a.pop("pos_sum") == pytest.approx(b.pop("pos_sum"))
        assert str(a) == str(b)
    sim = np.round(np.stack(c.sort_values("cid").vec) @ np.stack(q.sort_values("qid").vec).T, R.DECIMALS)
    t2i = one[one.dir == "t2i"].reset_index(drop=True)
    own = c.sort_values("cid").self.to_numpy()
    for r in range(70):
        cols = np.arange(90)
        assert t2i.better_self[r] == ((cols != r) & ((sim[r] > own[r]) | ((sim[r] == own[r]) & (cols < r)))).sum()
        order = np.lexsort((cols, -sim[r]))[:10]
        assert [x["cid"] for x in t2i.top[r]] == order.tolist()


def test_relevances_only_where_they_are_needed(spark):
    """The pass over all pairs looks relevances up one by one; statistics over all pairs come from classes of equal
    features, each counted as often as it has rows, and equal those of the pass that scores every pair."""
    rnd = np.random.default_rng(4)
    n, k = 150, 5
    kind = rnd.integers(0, 30, 80)[(cap := rnd.integers(0, 80, n))]  # several captions a class, several rows a caption
    x, y = np.round(rnd.normal(size=(2, n, 3)), 1)
    pdf = pd.DataFrame({"idx": rnd.permutation(n), "image_emb": list(x), "text_emb": list(y), "self": np.round((x * y).sum(axis=1), R.DECIMALS),
                        "f_region": kind % 4 - 1, "f_season": kind % 5 - 1, "f_temp": np.where(kind % 7 == 0, np.nan, kind % 11 / 2),
                        "f_cond": kind % 3 - 1, "f_cap1": cap, "f_cap2": 0})
    side = lambda key, v: pdf.rename(columns={"idx": key, v: "vec"})[[key, "vec", "self", *R._FEATS]]
    args = side("qid", "image_emb"), side("cid", "text_emb")
    full = R._phase1_kernel(k, 0.8, [R.I2T, R.T2I])(*args)
    before = R._Relevances.tile
    R._Relevances.tile = None  # no tile of relevances is made
    try:
        lean = R._phase1_kernel(k, 0.8, [R.I2T, R.T2I], relevance=False)(*args)
    finally:
        R._Relevances.tile = before
    assert lean.astype(str).equals(full[lean.columns].astype(str))
    one = full[full.dir == "i2t"].set_index("qid")
    rows = spark.createDataFrame(pdf.drop(columns=["image_emb", "text_emb"])).withColumn("f_temp", F.nanvl("f_temp", F.lit(None).cast("double")))
    got = {r.qid: r for r in R._relevance_rows(rows, k, Weights()).collect()}
    assert set(got) == set(one.index)
    for q, r in got.items():
        w = one.loc[q]
        assert r.ideal == pytest.approx(list(w.ideal)) and r.pos_n == w.pos_n and r.pos_max == w.pos_max
        assert r.pos_sum == pytest.approx(w.pos_sum)


def test_cells_by_strips():
    """Blocks of many strips: counts, links and labels are those of the whole matrix, which is never held."""
    rnd = np.random.default_rng(8)
    v = np.concatenate([rnd.normal(size=(9, 4))[rnd.integers(0, 9, 500)] + 0.05 * rnd.normal(size=(500, 4)), rnd.normal(size=(100, 4))])
    q = pd.DataFrame({"id": rnd.permutation(600), "v": list(v)})
    c = q.sample(frac=0.7, random_state=1).assign(label=lambda d: d["id"] % 13)
    x, y = CE.unit(np.stack(q.v)), CE.unit(np.stack(c.v))
    near = (1.0 - x @ y.T) <= 0.01
    assert len(list(CE.strips(q, c, 0.01))) == 3
    assert (CE.count_kernel(0.01)(q, c).n == near.sum(axis=1)).all()
    want = np.where(near, c.label.to_numpy()[None, :], 99).min(axis=1)
    got = CE.least_label_kernel(0.01)(q, c).set_index("id").label
    assert all(got.get(i, 99) == w for i, w in zip(q["id"], want))
    least = {i: i for i in q["id"]}
    links = [(q["id"][i], c["id"].to_numpy()[j]) for i, j in zip(*np.nonzero(near))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    stars = CE.forest_kernel(0.01)(q, c)
    assert dict(zip(stars.src, stars.dst)) == {i: m for i, m in least.items() if m != i}


def _numbered(rnd, n, key, v, own):
    return pd.DataFrame({key: rnd.permutation(n), "vec": list(v), "self": own, "f_region": rnd.integers(-1, 3, n), "f_season": -1,
                         "f_temp": np.nan, "f_cond": -1, "f_cap1": np.arange(n), "f_cap2": 0})


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e8, 1e20])
def test_single_precision_only_sifts(scale):
    """Products that differ by less than single precision holds, copies, and lengths it holds no product of: ranks and
    first ones are those of rounded double products."""
    rnd = np.random.default_rng(3)
    n = 1100
    base = rnd.normal(size=(n, 16))
    base[100:160] = base[100] + 1e-9 * rnd.normal(size=(60, 16))
    base[200:230] = base[200]
    x, y = base * scale, base + 0.3 * np.roll(base, 1, axis=1)
    q, c = _numbered(rnd, n, "qid", x, 0.0), _numbered(rnd, n, "cid", y, 0.0)
    cols = c.sort_values("cid")
    sim = np.round(np.einsum("id,jd->ij", x, np.stack(cols.vec)), R.DECIMALS)
    q["self"] = np.where(rnd.random(n) < 0.1, np.nan, sim[np.arange(n), rnd.integers(0, n, n)])
    got = R._phase1_kernel(10, 0.8, [R.I2T], relevance=False)(q, c).set_index("qid")
    ids = np.arange(n)
    near = 1e-11 * max(1.0, scale)
    for i, (qid, own) in enumerate(zip(q.qid, q.self)):
        sure = ((sim[i] > own + near) & (ids != qid)).sum()
        most = ((sim[i] > own - near) & (ids != qid)).sum()
        assert sure <= got.better_self[qid] <= most
        assert [-t["neg_sim"] for t in got.top[qid]] == pytest.approx(np.sort(sim[i])[::-1][:10], rel=1e-12, abs=1e-11)
    pairs = R._Products(x, y)
    assert pairs.a.dtype == (np.float64 if scale > 1e15 else np.float32)
    exact, slack = x @ y.T, 1e-30
    assert (np.abs(pairs.a.astype(float) @ pairs.b.astype(float).T - exact) <= pairs.row_err[:, None] + slack).all() or scale > 1e15
    q["vec"] = list(x[rnd.permutation(n)])
    best = q[["qid", "vec"]].assign(best_sim=q.self, best_cid=0)
    assert len(R._phase2_kernel(best, c[["cid", "vec"]])) == n


def test_relevances_without_similarities(spark, samples, monkeypatch):
    """What follows from the relevances alone is the same without a pass over all pairs of rows."""
    feats, _ = samples
    dirs = [R.I2T, R.T2I]
    rows = lambda p: {(r.dir, r.qid): (r.ideal, r.pos_n, round(r.pos_sum, 9), r.pos_max) for r in p.collect()}
    want = rows(R.ranked_partials(feats, dirs))
    monkeypatch.setattr(R, "_phase1_kernel", None)
    got = R.ranked_partials(feats, dirs, similarity=False)
    assert rows(got) == want and len(want) == 2 * feats.count()
    assert got.select("qid", "ideal").count() == len(want) and len(got.select("ideal").collect()) == len(want)


def test_full_ranking_has_every_candidate(spark, sf):
    """w01: every candidate of every query, best first, equal ones by id; blocks of 16 rows."""
    from skycap.plans import q_retrieval
    rnd = np.random.default_rng(8)
    x, y = rnd.normal(size=(60, 5)), rnd.normal(size=(60, 5))
    y[7] = y[3] = y[41]  # ties
    ids = [int(i) for i in rnd.permutation(1000)[:60]]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, a, b in zip(ids, x, y)], "idx long, image_emb array<double>, text_emb array<double>")
    want = []
    for i, a in zip(ids, x):
        best = sorted((-round(float(a @ b), 12), c) for b, c in zip(y, ids))
        want += [(i, r, c) for r, (_, c) in enumerate(best, 1)]
    got = R.full_ranking(df, block_rows=16).collect()
    assert sorted((r.qid, r["rank"], r.cid) for r in got) == sorted(want)
    t2i = R.full_ranking(df, R.T2I, block_rows=16).where("rank = 60").collect()
    assert len(t2i) == 60 and all(r.cid == min((float(y[ids.index(r.qid)] @ a), i) for a, i in zip(x, ids))[1] for r in t2i)
    n = derive.emb_samples(spark, sf).count()
    assert q_retrieval.w01(spark, sf).agg(F.count("*"), F.max("rank")).first() == (n * n, n)


def test_kmeans_pass_adds_up_in_slices(spark, monkeypatch):
    """Sums, sizes and costs of several models from slices of 7 numbers; of equally near centres the first."""
    from skycap.operators import lloyd as LL
    monkeypatch.setattr(LL, "SLICE", 7)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 4)).round(1)
    models = {5: x[:3].copy(), 2: x[[4, 4, 9]].copy(), 9: x[20:21].copy(), 30: x[30:36].copy()}
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
    got = LL._pass(df, models)
    assert list(got) == list(models)
    for m, c in models.items():
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        label = d2.argmin(axis=1)
        sums, sizes, cost = got[m]
        assert sizes.tolist() == np.bincount(label, minlength=len(c)).tolist() and cost == pytest.approx(d2.min(axis=1).sum())
        assert np.allclose(sums, [x[label == j].sum(axis=0) for j in range(len(c))])
    assert [s.tolist() for s in LL._pass(df.where("false"), models)[5][:2]] == [[[0.0] * 4] * 3, [0] * 3]
