"""Storm labelling and the linear probe (p06, p15-p17, j06, j13, j15, w03,
w05-w07, ml01, ml08-ml10, a27-a30).

The interval join ``date < start <= date + N`` is a binned equi-join: days are
cut into bins as wide as the window, so the sample dates that see a storm
(``start - N .. start - 1``) lie in two bins at most, whatever N.  Storms meet
the distinct (region, date) pairs of the samples, not the samples, so a region
that holds most samples adds no pairs; the samples then look up their date.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.operators.newton import fit_folds, predict_folds
from skycap.operators.ordered import dense_positions, running_sums
from skycap.schemas import CONUS, REGION_NAMES
from skycap.session import ensure_checkpoint_dir
from skycap.sources.sinks import write_probe_results

DEFAULT_LOOKAHEAD = 3
HURRICANE_REGIONS = REGION_NAMES + [CONUS]


# s08 / j15 -------------------------------------------------------------------
def parse_storms(raw: DataFrame) -> DataFrame:
    """s08: ``MMM d, yyyy`` strings (one or two digits for the day) to DATE; keeps file order as ``seq``."""
    return raw.select(
        F.col("seq"), F.col("Hurricane").alias("name"), F.col("Regions").alias("regions"),
        F.to_date(F.col("Start Date"), "MMM d, yyyy").alias("start_date"),
        F.to_date(F.col("End Date"), "MMM d, yyyy").alias("end_date"),
    )


def explode_regions(storms: DataFrame) -> DataFrame:
    """j15: one row per (storm, region), trimmed."""
    return storms.select("*", F.explode(F.transform(F.split("regions", ","), lambda r: F.trim(r))).alias("region"))


# p16 ----------------------------------------------------------------------
def map_region(region: Column) -> Column:
    return F.when(region.isin(*HURRICANE_REGIONS), region).otherwise(F.lit(CONUS))


# p06 ----------------------------------------------------------------------
def filter_by_date(samples: DataFrame, cutoff: str = "2025-05-31", date_col: str = "date") -> DataFrame:
    """Keep samples whose date parses and is on or before the cutoff."""
    d = F.try_to_date(F.col(date_col), "yyyy-M-d")
    return samples.where(d.isNotNull() & (d <= F.to_date(F.lit(cutoff))))


# j06 / w07 ----------------------------------------------------------------
def window_hits(dates: DataFrame, storm_regions: DataFrame, lookahead_days: int) -> DataFrame:
    """Per distinct (_r, _d) of ``dates`` that sees a storm: ``storm`` (first in file order) and ``n_matches``.

    A storm is dealt to the bins of the first and the last date that see it."""
    n = F.lit(int(lookahead_days))
    day = lambda c: F.unix_date(c)
    seen = dates.select("_r", "_d").where(F.col("_d").isNotNull()).distinct().withColumn("_bin", F.floor(day(F.col("_d")) / n))
    start = day(F.col("start_date"))
    bins = F.array_distinct(F.array(F.floor((start - n) / n), F.floor((start - 1) / n)))
    dealt = storm_regions.select(F.col("region").alias("_r"), "seq", F.col("name").alias("_storm"), "start_date", F.explode(bins).alias("_bin"))
    after = F.datediff(F.col("start_date"), F.col("_d"))
    return (seen.join(dealt, ["_r", "_bin"]).where((after > 0) & (after <= n))
            .groupBy("_r", "_d").agg(F.min_by("_storm", "seq").alias("storm"), F.count(F.lit(1)).alias("n_matches")))


def label_samples(samples: DataFrame, storm_regions: DataFrame, lookahead_days: int = DEFAULT_LOOKAHEAD,
                  id_col: str = "sample_id", counts: bool = False) -> DataFrame:
    """Adds ``label`` (1 if a storm starts in the sample's mapped region within
    (date, date + N]) and ``storm`` (first such storm in file order); with ``counts``
    also ``n_matches``, the number of such storms."""
    d = F.try_to_date(F.col("date"), "yyyy-M-d")
    s = samples.withColumn("_d", d).withColumn("_r", map_region(F.coalesce(F.col("region"), F.lit(""))))
    hits = window_hits(s, storm_regions, lookahead_days)
    out = s.join(hits if counts else hits.drop("n_matches"), ["_r", "_d"], "left").drop("_d", "_r")
    if counts:
        out = out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return out.withColumn("label", F.col("storm").isNotNull().cast("int"))


# p15 / p17 ------------------------------------------------------------------
FEATURE_NAMES = (["is_winter", "is_spring", "is_summer", "is_autumn"]
                 + [f"is_region_{r.lower().replace(' ', '_')}" for r in REGION_NAMES] + ["is_region_continental_us"])


def weather_features(season: Column, region: Column) -> Column:
    """15 one-hot flags as array<double>: 4 seasons (substring on the lowered
    season; autumn also matches fall), 10 regions, continental fallback."""
    s = F.lower(F.coalesce(season, F.lit("Unknown")))
    r = F.coalesce(region, F.lit("Unknown"))
    flags = [s.contains("winter"), s.contains("spring"), s.contains("summer"), s.contains("autumn") | s.contains("fall")]
    flags += [r == name for name in REGION_NAMES]
    flags.append(~r.isin(*REGION_NAMES))
    return F.array(*[f.cast("double") for f in flags])


def feature_vector(samples: DataFrame, *, use_embeddings: bool = True, use_weather_features: bool = True) -> DataFrame:
    parts = []
    if use_embeddings:
        parts.append(F.col("image_emb").cast("array<double>"))
    if use_weather_features:
        parts.append(weather_features(F.col("season"), F.col("region")))
    feats = F.concat(*parts) if len(parts) > 1 else parts[0]
    missing = lambda c, other: F.coalesce(F.col(c), F.lit(other))  # noqa: E731  a NULL keeps its field
    info = F.concat(missing("date", ""), F.lit("_"), missing("region", ""), F.lit("_"), missing("storm", "no_hurricane"))
    return samples.withColumn("features", feats).withColumn("sample_info", info)


def feature_names(dim: int, *, use_embeddings: bool = True, use_weather_features: bool = True) -> list[str]:
    names = [f"img_emb_{j}" for j in range(dim)] if use_embeddings else []
    return names + (FEATURE_NAMES if use_weather_features else [])


# w05 / w06 ------------------------------------------------------------------
def split_hash(id_col: Column, seed: int) -> Column:
    """Seeded arithmetic hash of an integer id: a permutation below 2^31-1;
    larger ids meet, and the id itself then breaks the tie."""
    return (F.pmod(id_col, F.lit(2147483647)) * F.lit(48271) + F.lit(seed * 16807 + 11)) % F.lit(2147483647)


def stratified_split(df: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     id_col: str = "idx") -> DataFrame:
    """Adds ``is_test``: per class the ``round(test_size * n_class)`` rows
    first in seeded order.  Positions come from running counts over range
    partitions, so a dominant class is not sorted in one task."""
    h = df.withColumn("_h", split_hash(F.col(id_col), seed))
    keyed = h.withColumn("_key", F.col(label).cast("double") * F.lit(4294967296.0) + F.col("_h").cast("double"))
    pos = dense_positions(keyed, ["_key", id_col], "_gpos")
    counts = pos.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # of the written rows: the input runs once
    offsets = running_sums(counts, label, ["_n"], bounded=True).select(label, "_n", (F.col("cum__n") - F.col("_n")).alias("_off"))
    out = pos.join(F.broadcast(offsets), label)
    n_test = F.round(F.lit(test_size) * F.col("_n"))
    return out.withColumn("is_test", (F.col("_gpos") - F.col("_off")) < n_test).drop("_h", "_key", "_gpos", "_n", "_off")


def random_split(df: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42, id_col: str = "idx") -> DataFrame:
    """Adds ``split`` with exact sizes int(n*train), int(n*val), remainder."""
    n = df.count()
    n_train, n_val = int(n * train), int(n * val)
    pos = dense_positions(df.withColumn("_h", split_hash(F.col(id_col), seed)), ["_h", id_col], "_pos")
    split = F.when(F.col("_pos") < n_train, "train").when(F.col("_pos") < n_train + n_val, "val").otherwise("test")
    return pos.withColumn("split", split).drop("_h", "_pos")


# ml01 ---------------------------------------------------------------------
def fit_standardiser(train: DataFrame, col: str = "features") -> tuple[list[float], list[float]]:
    """Per-dimension mean and population std (0 -> 1) of the training rows.
    The result has one entry per feature dimension (bounded by the model's
    width, not by the data)."""
    stats = (train.select(F.posexplode(col).alias("j", "x")).groupBy("j")
             .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("j").collect())
    means = [r["m"] for r in stats]
    stds = [r["s"] if r["s"] not in (None, 0.0) else 1.0 for r in stats]
    return means, stds


def apply_standardiser(df: DataFrame, means: list[float], stds: list[float], col: str = "features",
                       out: str = "scaled") -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in means])
    s = F.array(*[F.lit(float(v)) for v in stds])
    return df.withColumn(out, F.transform(F.col(col), lambda x, i: (x - F.get(m, i)) / F.get(s, i)))


# ml08 ---------------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """sklearn 'balanced': n / (n_classes * n_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = df.count()
    k = counts.count()
    return df.join(F.broadcast(counts), label).withColumn("w", F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).drop("_nc")


def fit_logistic(train: DataFrame, *, C: float = 1.0, max_iter: int = 1000, features: str = "scaled",
                 label: str = "label"):
    """L2 logistic regression matching sklearn's objective: with balanced
    weights summing to n, ``regParam = 1 / (C * n)``."""
    n = train.count()
    data = balanced_weights(train, label).withColumn("fv", array_to_vector(features)).withColumn(label, F.col(label).cast("double"))
    lr = LogisticRegression(featuresCol="fv", labelCol=label, weightCol="w", regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, tol=1e-6, fitIntercept=True)
    return lr.fit(data)


def predict(model, df: DataFrame, features: str = "scaled") -> DataFrame:
    out = model.transform(df.withColumn("fv", array_to_vector(features)))
    return (out.withColumn("predicted_probability", vector_to_array("probability")[1])
            .withColumn("predicted_label", (F.col("predicted_probability") > 0.5).cast("int"))
            .drop("fv", "rawPrediction", "probability", "prediction"))


# a27-a30 ------------------------------------------------------------------
def confusion_matrix(pred: DataFrame, label: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """2x2 counts, all four cells present."""
    cells = pred.groupBy(label, pred_col).agg(F.count(F.lit(1)).alias("count"))
    grid = pred.sparkSession.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], f"{label} int, {pred_col} int")
    return grid.join(cells, [label, pred_col], "left").select(
        F.col(label).cast("long").alias("true_label"), F.col(pred_col).cast("long").alias("predicted_label"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def classification_metrics(pred: DataFrame, label: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """Accuracy, and precision / recall / F1 of class 1 (0 on zero division)."""
    y, p = F.col(label) == 1, F.col(pred_col) == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    n = F.count(F.lit(1))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return pred.agg(
        F.coalesce(F.try_divide(F.count_if(F.col(label) == F.col(pred_col)), n), F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        n.alias("support"),
    )


def classification_report(pred: DataFrame, label: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    support-weighted averages (0 on zero division), as rows."""
    y, p = F.col(label) == 1, F.col(pred_col) == 1
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    per = {
        "0": (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp),
        "1": (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    n = tp + fp + fn + tn
    rows = [F.struct(F.lit(k).alias("class"), pr.alias("precision"), rc.alias("recall"), f.alias("f1"),
                     sup.cast("long").alias("support")) for k, (pr, rc, f, sup) in per.items()]
    rows.append(F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), ratio(tp + tn, n).alias("f1"), n.cast("long").alias("support")))
    macro = [(per["0"][i] + per["1"][i]) / 2 for i in range(3)]
    weighted = [ratio(per["0"][i] * per["0"][3] + per["1"][i] * per["1"][3], n) for i in range(3)]
    for name, vals in (("macro avg", macro), ("weighted avg", weighted)):
        rows.append(F.struct(F.lit(name).alias("class"), vals[0].alias("precision"), vals[1].alias("recall"),
                             vals[2].alias("f1"), n.cast("long").alias("support")))
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _score_counts(pred: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score, written to the checkpoint folder:
    it is reused by several passes and its size is bounded by the number of
    distinct scores."""
    counts = pred.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ensure_checkpoint_dir(pred.sparkSession)
    return counts.checkpoint(eager=True)


def auc_roc(pred: DataFrame, label: str = "label", score: str = "predicted_probability") -> DataFrame:
    """Exact ROC AUC (ties at half weight); 0.0 with a single class."""
    c = running_sums(_score_counts(pred, label, score), "score", ["pos"], descending=True)
    part = c.agg(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))).alias("u"),
                 F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return part.select(F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0")))
                       .otherwise(F.lit(0.0)).alias("auc"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "predicted_probability") -> DataFrame:
    """w03: (fpr, tpr, threshold) at each distinct score, descending, with
    collinear points dropped and the (0, 0, inf) origin prepended."""
    counts = _score_counts(pred, label, score).withColumn("one", F.lit(1))
    c = running_sums(counts, "score", ["pos", "neg", "one"], descending=True)
    p = c.select((F.col("cum_one") - 1).alias("i"), "score", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))
    p = p.checkpoint(eager=True)
    tot = p.agg(F.max("tps").alias("P"), F.max("fps").alias("N")).first()
    P, N = (tot["P"] or 0), (tot["N"] or 0)
    # neighbours in descending score order: equi-joins on the position
    prev = p.select((F.col("i") + 1).alias("i"), F.col("tps").alias("tp_prev"), F.col("fps").alias("fp_prev"))
    nxt = p.select((F.col("i") - 1).alias("i"), F.col("tps").alias("tp_next"), F.col("fps").alias("fp_next"))
    j = p.join(prev, "i", "left").join(nxt, "i", "left")
    keep = (F.col("tp_prev").isNull() | F.col("tp_next").isNull()
            | ((F.col("fp_next") - 2 * F.col("fps") + F.col("fp_prev")) != 0)
            | ((F.col("tp_next") - 2 * F.col("tps") + F.col("tp_prev")) != 0))
    pts = j.where(keep).select(F.col("i").cast("long"), "score", F.col("tps").cast("long"), F.col("fps").cast("long"))
    origin = pts.sparkSession.createDataFrame([(-1, float("inf"), 0, 0)], "i long, score double, tps long, fps long")
    allp = origin.unionByName(pts)
    nan = F.lit(float("nan"))
    return allp.select(F.col("i").alias("point"),
                       (F.col("fps") / F.lit(float(N))) if N > 0 else nan,
                       (F.col("tps") / F.lit(float(P))) if P > 0 else nan,
                       F.col("score")).toDF("point", "fpr", "tpr", "threshold")


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side columns of two one-row aggregates (constant-key join)."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def cv_summary(fold_scores: DataFrame, col: str = "f1") -> DataFrame:
    """a30: mean and population std of the fold scores."""
    return fold_scores.agg(F.avg(col).alias("cv_f1_mean"), F.stddev_pop(col).alias("cv_f1_std"),
                           F.count(F.lit(1)).alias("folds"))


# ml09 ---------------------------------------------------------------------
def fold_assignment(df: DataFrame, folds: int = 5, seed: int = 43, label: str = "label",
                    id_col: str = "idx") -> DataFrame:
    """Stratified folds: position within class (seeded order) mod ``folds``."""
    h = df.withColumn("_h", split_hash(F.col(id_col), seed))
    keyed = h.withColumn("_key", F.col(label).cast("double") * F.lit(4294967296.0) + F.col("_h").cast("double"))
    pos = dense_positions(keyed, ["_key", id_col], "_gpos")
    counts = pos.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_sums(counts, label, ["_n"], bounded=True).select(label, (F.col("cum__n") - F.col("_n")).alias("_off"))
    out = pos.join(F.broadcast(offsets), label).withColumn("fold", ((F.col("_gpos") - F.col("_off")) % folds).cast("int"))
    return out.drop("_h", "_key", "_gpos", "_off")


def f1_expr(label: str = "label", pred: str = "predicted_label") -> Column:
    y, p = F.col(label) == 1, F.col(pred) == 1
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def cross_validate(train: DataFrame, folds: int = 5, seed: int = 42, C: float = 1.0, features: str = "scaled",
                   label: str = "label", id_col: str = "idx") -> DataFrame:
    """Stratified k-fold F1 of class 1 inside the training split (features
    scaled once).  All folds are fitted together, one pass over the rows per
    Newton step, and scored in one more."""
    ensure_checkpoint_dir(train.sparkSession)
    assigned = fold_assignment(train, folds, seed + 1, label, id_col).checkpoint(eager=True)
    models, _ = fit_folds(assigned, list(range(folds)), C=C, features=features, label=label)
    return predict_folds(assigned, models, features=features).groupBy("fold").agg(f1_expr(label).alias("f1"))


# ml10 ---------------------------------------------------------------------
def linear_probe(samples: DataFrame, storm_regions: DataFrame, lookahead_days: int = DEFAULT_LOOKAHEAD, *,
                 test_size: float = 0.2, seed: int = 42, C: float = 1.0, cv_folds: int = 5,
                 save_to: str | None = None) -> dict:
    """End to end: image embeddings -> label -> stratified split -> scale ->
    fit -> evaluate.  Returns DataFrames for metrics, confusion, ROC and
    predictions (keyed by sample, not by position), fold scores, and the
    absolute coefficient of every named feature; nothing without samples.
    ``save_to`` writes metrics, predictions and ROC there."""
    labelled = feature_vector(label_samples(samples, storm_regions, lookahead_days), use_weather_features=False)
    ensure_checkpoint_dir(samples.sparkSession)
    # the labelled sample table feeds the split's bucket bounds, the scaler,
    # the fit and the evaluation: derive it once
    labelled = labelled.checkpoint(eager=True)
    first = labelled.select(F.size("features").alias("n")).first()
    if first is None:
        return {}
    split = stratified_split(labelled, "label", test_size, seed).cache()
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    means, stds = fit_standardiser(train)
    train_s, test_s = apply_standardiser(train, means, stds), apply_standardiser(test, means, stds)
    model = fit_logistic(train_s, C=C)
    pred = predict(model, test_s)
    out = {
        "predictions": pred.select("sample_id", "sample_info", F.col("label").alias("true_label"),
                                   "predicted_probability", "predicted_label"),
        "metrics": one_row_join(classification_metrics(pred), auc_roc(pred)),
        "confusion": confusion_matrix(pred),
        "roc": roc_curve(pred),
        "importance": [abs(c) for c in model.coefficients.toArray().tolist()],
        "feature_names": feature_names(first["n"], use_weather_features=False),
    }
    if cv_folds:
        out["cv"] = cv_summary(cross_validate(train_s, cv_folds, seed, C))
    if save_to:
        write_probe_results(out["predictions"], out["metrics"], out["roc"], save_to)
    return out
