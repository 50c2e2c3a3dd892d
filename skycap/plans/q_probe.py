"""Registered queries: storm events, interval labelling, features, splits,
scaling, probe metrics and the logistic-regression probe."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.functions.scoring import DEFAULT_SCALE, dot, sigmoid_probability
from skycap.operators import probe as PR
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.registry import query, rounded
from skycap.schemas import CONUS, REGION_NAMES
from skycap.session import ensure_checkpoint_dir, scratch_path
from skycap.sources.events import read_storm_csv, write_storm_csv
from skycap.sources.sinks import read_predictions_csv

LOOKAHEAD = 7
SEED = 42
NAMES11 = S._names_list(REGION_NAMES + [CONUS])

STORMS = f"""
st AS (
  SELECT o_orderkey AS seq, 'Storm ' || CAST(o_orderkey AS VARCHAR) AS name,
    CASE WHEN o_custkey % 13 = 0 THEN 'Gulf Coast'
         WHEN o_custkey % 4 = 0 THEN {NAMES11}[o_custkey % 11 + 1] || ', ' || {NAMES11}[(o_custkey // 4) % 11 + 1]
         ELSE {NAMES11}[o_custkey % 11 + 1] END AS regions,
    make_date(year(o_orderdate) + 24, month(o_orderdate), day(o_orderdate)) AS start_date,
    make_date(year(o_orderdate) + 24, month(o_orderdate), day(o_orderdate)) + CAST(o_orderkey % 7 AS INTEGER) AS end_date
  FROM orders
),
sr AS (SELECT seq, name, trim(unnest(string_split(regions, ','))) AS region, start_date FROM st)"""


def _mapped(r: str) -> str:
    return f"(CASE WHEN {r} IN {tuple(REGION_NAMES + [CONUS])} THEN {r} ELSE 'Continental US' END)"


def _labels_sql(n: int) -> str:
    return S.EMB_PARSED + "," + STORMS + f""",
hit AS (
  SELECT s.sample_id, arg_min(sr.name, sr.seq) AS storm, count(*) AS n_matches
  FROM ep s JOIN sr ON sr.region = {_mapped("COALESCE(s.region, '')")}
    AND sr.start_date > CAST(s.date AS DATE) AND sr.start_date <= CAST(s.date AS DATE) + {n}
  GROUP BY s.sample_id
),
lab AS (
  SELECT ep.* EXCLUDE (label), hit.storm, COALESCE(hit.n_matches, 0) AS n_matches, CASE WHEN hit.storm IS NULL THEN 0 ELSE 1 END AS label,
    ((ep.idx * 48271 + {SEED * 16807 + 11}) % 2147483647) AS h,
    1.0 / (1.0 + exp(-({DEFAULT_SCALE!r})::DOUBLE * list_dot_product(ep.image_emb, ep.text_emb))) AS score
  FROM ep LEFT JOIN hit USING (sample_id)
),
spl AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) - 1 < round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test,
         (row_number() OVER (PARTITION BY label ORDER BY ((idx * 48271 + {(SEED + 1) * 16807 + 11}) % 2147483647)) - 1) % 5 AS fold
  FROM lab
),
pr AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM spl)"""


LAB = _labels_sql(LOOKAHEAD)


def _storms(spark, sf):
    return PR.explode_regions(PR.parse_storms(derive.storms_raw(spark, sf)))


def _labelled(spark, sf, n=LOOKAHEAD):
    return PR.label_samples(derive.probe_samples(spark, sf), _storms(spark, sf), n)


def _scored(spark, sf):
    lab = _labelled(spark, sf)
    return lab.withColumn("score", sigmoid_probability(dot("image_emb", "text_emb"))).withColumn(
        "pred", (F.col("score") > 0.5).cast("int"))


@query("s08_scan_event_csv", "WITH " + STORMS + """
SELECT name, regions, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date FROM st
""")
def s08(spark, sf):
    path = scratch_path(spark, "storms-csv")
    write_storm_csv(derive.storms_raw(spark, sf), path)
    st = PR.parse_storms(read_storm_csv(spark, path))
    return st.select("name", "regions", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
                     F.date_format("end_date", "yyyy-MM-dd").alias("end_date"))


@query("j15_event_region_explode", "WITH " + STORMS + "\nSELECT seq, name, region FROM sr")
def j15(spark, sf):
    return _storms(spark, sf).select("seq", "name", "region")


@query("p16_region_mapper", "WITH " + STORMS + f"""
SELECT DISTINCT region, {_mapped('region')} AS mapped_region FROM sr
""")
def p16(spark, sf):
    return _storms(spark, sf).select("region").distinct().select("region", PR.map_region(F.col("region")).alias("mapped_region"))


@query("j06_event_lookahead", LAB + "\nSELECT sample_id, CAST(label AS BIGINT) AS label, storm FROM lab")
def j06(spark, sf):
    return rounded(_labelled(spark, sf).select("sample_id", "label", "storm"))


@query("w07_first_event", _labels_sql(30) + "\nSELECT sample_id, n_matches, storm AS first_storm FROM lab WHERE n_matches > 0")
def w07(spark, sf):
    lab = PR.label_samples(derive.probe_samples(spark, sf), _storms(spark, sf), 30, counts=True)
    return lab.where("n_matches > 0").select("sample_id", "n_matches", F.col("storm").alias("first_storm"))


@query("j06_lookahead_of_a_year", _labels_sql(365) + "\nSELECT sample_id, n_matches, CAST(label AS BIGINT) AS label, storm FROM lab")
def j06_year(spark, sf):
    lab = PR.label_samples(derive.probe_samples(spark, sf), _storms(spark, sf), 365, counts=True)
    return rounded(lab.select("sample_id", "n_matches", "label", "storm"))


@query("p06_filter_date_cutoff", S.EMB + "\nSELECT sample_id, date FROM es WHERE TRY_CAST(date AS DATE) <= DATE '2023-06-30'")
def p06(spark, sf):
    return PR.filter_by_date(derive.probe_samples(spark, sf), "2023-06-30").select("sample_id", "date")


def _season_sql(d: str) -> str:
    m = f"month(CAST({d} AS DATE))"
    return (f"(CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring' "
            f"WHEN {m} IN (6, 7, 8) THEN 'summer' ELSE 'fall' END)")


def _flags_sql() -> str:
    s = f"lower({_season_sql('date')})"
    flags = [f"contains({s}, 'winter')", f"contains({s}, 'spring')", f"contains({s}, 'summer')",
             f"(contains({s}, 'autumn') OR contains({s}, 'fall'))"]
    flags += [f"region = {S._lit(r)}" for r in REGION_NAMES]
    flags.append(f"region NOT IN {tuple(REGION_NAMES)}")
    return " || ".join(f"CAST(CAST({f} AS INTEGER) AS VARCHAR)" for f in flags)


@query("p15_one_hot_features", S.EMB + f"\nSELECT sample_id, {_flags_sql()} AS flags FROM es")
def p15(spark, sf):
    s = derive.probe_samples(spark, sf)
    f = PR.weather_features(F.col("season"), F.col("region"))
    return s.select("sample_id", F.concat_ws("", F.transform(f, lambda x: x.cast("int").cast("string"))).alias("flags"))


@query("p17_feature_vector", LAB + f"""
SELECT sample_id, CAST(len(image_emb) + 15 AS BIGINT) AS n_features,
       {S.R('list_sum(image_emb) + 2.0')} AS feature_sum,
       date || '_' || region || '_' || COALESCE(storm, 'no_hurricane') AS sample_info
FROM lab
""")
def p17(spark, sf):
    f = PR.feature_vector(_labelled(spark, sf))
    return rounded(f.select("sample_id", F.size("features").cast("long").alias("n_features"),
                            F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("feature_sum"), "sample_info"))


@query("w05_stratified_split", LAB + "\nSELECT sample_id, CAST(label AS BIGINT) AS label, is_test FROM spl")
def w05(spark, sf):
    return rounded(PR.stratified_split(_labelled(spark, sf), "label", 0.2, SEED).select("sample_id", "label", "is_test"))


@query("w06_random_split", S.EMB + f"""
SELECT sample_id, CASE WHEN r < {int(500 * 0.8)} THEN 'train' WHEN r < {int(500 * 0.8) + int(500 * 0.1)} THEN 'val' ELSE 'test' END AS split
FROM (SELECT sample_id, row_number() OVER (ORDER BY (idx * 48271 + {SEED * 16807 + 11}) % 2147483647) - 1 AS r,
             count(*) OVER () AS n FROM es)
""".replace("500", "n"))
def w06(spark, sf):
    return PR.random_split(derive.probe_samples(spark, sf), 0.8, 0.1, SEED).select("sample_id", "split")


@query("ml01_standardise", LAB + f"""
SELECT CAST(j - 1 AS BIGINT) AS dim, {S.R('avg(x)')} AS mean, {S.R('stddev_pop(x)')} AS std
FROM (SELECT unnest(image_emb) AS x, generate_subscripts(image_emb, 1) AS j FROM spl WHERE NOT is_test)
GROUP BY j
""")
def ml01(spark, sf):
    split = PR.stratified_split(PR.feature_vector(_labelled(spark, sf), use_weather_features=False), "label", 0.2, SEED)
    train = split.where(~F.col("is_test"))
    st = train.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return rounded(st.select(F.col("dim").cast("long"), "mean", "std"))


@query("a27_confusion_matrix", LAB + """
SELECT CAST(t.a AS BIGINT) AS true_label, CAST(t.b AS BIGINT) AS predicted_label, count(pr.sample_id) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b) LEFT JOIN pr ON pr.label = t.a AND pr.pred = t.b
GROUP BY ALL
""")
def a27(spark, sf):
    return PR.confusion_matrix(_scored(spark, sf), "label", "pred")


def _report_sql() -> str:
    def ratio(a, b):
        return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 0.0)"
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
    s0, s1, n = "(tn + fp)", "(tp + fn)", "(tp + fp + fn + tn)"
    rows = [("'0'", p0, r0, f0, s0), ("'1'", p1, r1, f1, s1),
            ("'accuracy'", "NULL", "NULL", ratio("tp + tn", n), n),
            ("'macro avg'", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("'weighted avg'", ratio(f"{p0} * {s0} + {p1} * {s1}", n), ratio(f"{r0} * {s0} + {r1} * {s1}", n),
             ratio(f"{f0} * {s0} + {f1} * {s1}", n), n)]
    sel = "\nUNION ALL\n".join(
        f"SELECT {c} AS class, {S.R(pr) if pr != 'NULL' else 'NULL::DOUBLE'} AS precision, "
        f"{S.R(rc) if rc != 'NULL' else 'NULL::DOUBLE'} AS recall, {S.R(f)} AS f1, CAST({sp} AS BIGINT) AS support FROM cm"
        for c, pr, rc, f, sp in rows)
    return LAB + """,
cm AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM pr)
""" + sel


@query("a28_classification_metrics", _report_sql())
def a28(spark, sf):
    return rounded(PR.classification_report(_scored(spark, sf), "label", "pred"))


@query("a29_auc_roc", LAB + f""",
rr AS (SELECT label, avg(rn) OVER (PARTITION BY score) AS ar FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS rn FROM pr)),
cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, sum(ar) FILTER (WHERE label = 1) AS rs FROM rr)
SELECT {S.R('CASE WHEN n1 > 0 AND n0 > 0 THEN (rs - n1 * (n1 + 1) / 2.0) / (n1 * n0) ELSE 0.0 END')} AS auc FROM cnt
""")
def a29(spark, sf):
    return rounded(PR.auc_roc(_scored(spark, sf), "label", "score"))


@query("w03_roc_curve", LAB + f""",
g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM pr GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
             row_number() OVER (ORDER BY score DESC) - 1 AS i FROM g),
k AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp_prev, lead(tps) OVER (ORDER BY i) AS tp_next,
             lag(fps) OVER (ORDER BY i) AS fp_prev, lead(fps) OVER (ORDER BY i) AS fp_next FROM c),
tot AS (SELECT max(tps) AS P, max(fps) AS N FROM c),
pts AS (SELECT i, score, tps, fps FROM k WHERE tp_prev IS NULL OR tp_next IS NULL
          OR fp_next - 2 * fps + fp_prev <> 0 OR tp_next - 2 * tps + tp_prev <> 0
        UNION ALL SELECT -1, 'inf'::DOUBLE, 0, 0)
SELECT CAST(i AS BIGINT) AS point, {S.R('fps / N')} AS fpr, {S.R('tps / P')} AS tpr,
       CASE WHEN isinf(score) THEN score ELSE {S.R('score')} END AS threshold
FROM pts, tot
""")
def w03(spark, sf):
    return rounded(PR.roc_curve(_scored(spark, sf), "label", "score"))


@query("a30_cv_summary", LAB + f""",
ff AS (
  SELECT fold, COALESCE(2.0 * count(*) FILTER (WHERE label = 1 AND pred = 1) / NULLIF(2 * count(*) FILTER (WHERE label = 1 AND pred = 1)
         + count(*) FILTER (WHERE label = 0 AND pred = 1) + count(*) FILTER (WHERE label = 1 AND pred = 0), 0), 0.0) AS f1
  FROM pr GROUP BY fold
)
SELECT {S.R('avg(f1)')} AS cv_f1_mean, {S.R('stddev_pop(f1)')} AS cv_f1_std, count(*) AS folds FROM ff
""")
def a30(spark, sf):
    sc = _scored(spark, sf)
    folds = PR.fold_assignment(sc, 5, SEED + 1)
    per = folds.groupBy("fold").agg(PR.f1_expr("label", "pred").alias("f1"))
    return rounded(PR.cv_summary(per))


# ML (no SQL oracle: invariants are checked in tests) -------------------------
@query("ml08_logistic_l2")
def ml08(spark, sf):
    res = PR.linear_probe(derive.probe_samples(spark, sf), _storms(spark, sf), LOOKAHEAD, cv_folds=0)
    return rounded(spark.createDataFrame(list(zip(res["feature_names"], res["importance"])), "feature string, importance double"))


@query("ml09_cross_validate")
def ml09(spark, sf):
    lab = PR.feature_vector(_labelled(spark, sf), use_weather_features=False)
    ensure_checkpoint_dir(spark)
    split = PR.stratified_split(lab, "label", 0.2, SEED).checkpoint(eager=True)
    train = split.where(~F.col("is_test"))
    means, stds = PR.fit_standardiser(train)
    folds = PR.cross_validate(PR.apply_standardiser(train, means, stds), 5, SEED)
    return rounded(PR.cv_summary(folds))


@query("ml10_linear_probe")
def ml10(spark, sf):
    path = scratch_path(spark, "probe")
    res = PR.linear_probe(derive.probe_samples(spark, sf), _storms(spark, sf), 3, save_to=path)
    saved = read_predictions_csv(spark, path).agg(F.count("*").alias("saved_predictions"))
    return rounded(PR.one_row_join(PR.one_row_join(res["metrics"], res["cv"]), saved))
