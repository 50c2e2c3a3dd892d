"""Clustering and cluster analysis (ml02-ml07, a21-a26, j11, j12, t03, w04).

* k-means / bisecting k-means / PCA are ``pyspark.ml`` stages.
* Exact silhouette and eps-neighbourhoods use the blocked pair kernel: per
  task one block of points against one block of candidates, emitting only
  per-point partials (per-cluster distance sums, neighbour counts, a spanning
  forest of core-core links), never all pairs.
* DBSCAN: neighbour counts -> core points -> connected components of core
  points by min-label propagation with pointer jumping over the forest links
  (checkpointed each round) -> border points take the lowest neighbouring
  cluster -> others are noise (-1).  Clusters are numbered by their lowest
  core index, which reproduces the reference's discovery order.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skycap.operators import cells as CE
from skycap.operators import lloyd as LL
from skycap.operators.ordered import dense_positions
from skycap.operators.pairs import TILE, TILED_BLOCK_ROWS, auto_block_rows, block_pairs, n_blocks, stack
from skycap.operators.probe import apply_standardiser, fit_standardiser
from skycap.session import ensure_checkpoint_dir, ship_package

CHUNK = 64


# ml01 helpers ---------------------------------------------------------------
def standardise(df: DataFrame, col: str = "features", out: str = "x") -> DataFrame:
    """Population z-scores per dimension (constant dimension -> divided by 1)."""
    means, stds = fit_standardiser(df, col)
    return apply_standardiser(df, means, stds, col, out)


def prepared(samples: DataFrame, embedding: str = "combined", scale: bool = True, id_col: str = "idx") -> DataFrame:
    """(idx, x): the chosen vectors of an embedding set (image, text, or both one after the
    other), as z-scores unless ``scale`` is off."""
    parts = {"image": ["image_emb"], "text": ["text_emb"], "combined": ["image_emb", "text_emb"]}
    if embedding not in parts:
        raise ValueError(f"Unsupported embedding type '{embedding}'; use {', '.join(parts)}")
    v = F.concat(*[F.col(c).cast("array<double>") for c in parts[embedding]])
    if not scale:
        return samples.select(id_col, v.alias("x"))
    return standardise(samples.select(id_col, v.alias("features")))


# ml02 ------------------------------------------------------------------------
def kmeans_best(df: DataFrame, k: int = 8, *, n_init: int = 10, max_iter: int = 300, seed: int = 42,
                col: str = "x", pred: str = "cluster", id_col: str = "idx"):
    """Best (lowest within-cluster cost) of ``n_init`` seeded k-means runs, fitted together.
    Returns (labelled frame, cost, centres)."""
    ensure_checkpoint_dir(df.sparkSession)
    data = df.repartition(id_col).checkpoint(eager=True)  # a file of one row group is one task, in every pass
    fits = LL.fit_many(data.select(F.col(id_col).alias("id"), F.col(col).cast("array<double>").alias("v")), [k],
                       n_init=n_init, max_iter=max_iter, seed=seed)
    if k not in fits.centres:  # no rows
        return data.withColumn(pred, F.lit(0)), 0.0, []
    return LL.with_labels(data, {pred: fits.centres[k]}, col), fits.inertia[k], fits.centres[k].tolist()


# ml04 ------------------------------------------------------------------------
def bisecting(df: DataFrame, k: int = 8, *, seed: int = 42, col: str = "x", pred: str = "cluster") -> DataFrame:
    """Top-down hierarchical clustering into at most ``k`` clusters."""
    data = df.withColumn("_v", array_to_vector(col))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol=pred).fit(data)
    return model.transform(data).drop("_v")


# ml06 ------------------------------------------------------------------------
def pca(df: DataFrame, n_components: int = 2, col: str = "x", out: str = "reduced"):
    """Principal components of centred vectors; returns (frame, explained variance)."""
    means, _ = fit_standardiser(df, col)
    centred = apply_standardiser(df, means, [1.0] * len(means), col, "_c").withColumn("_v", array_to_vector("_c"))
    model = PCA(k=n_components, inputCol="_v", outputCol="_p").fit(centred)
    out_df = model.transform(centred).withColumn(out, vector_to_array("_p")).drop("_c", "_v", "_p")
    return out_df, model.explainedVariance.toArray().tolist()


# a25 -------------------------------------------------------------------------
SIL_SCHEMA = "qid long, which int, cluster long, dsum double, n long"
SIL_PARTS = "qid long, own array<long>, sums array<double>, same array<long>, selfs int"
#: Most clusters of all labellings whose sums travel as one array, and points whose arrays are added up together.
SLOTS = 1024
GROUP = 1024


def _sil_kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
    """Per query and cluster: sum of distances and number of other points, for
    each labelling.  Squared distances come from norms and one matrix product."""
    q, c = stack(qpdf["q_vec"]), stack(cpdf["c_vec"])
    qid, cid = qpdf["qid"].to_numpy(np.int64), cpdf["cid"].to_numpy(np.int64)
    labels = np.stack(cpdf["c_labels"].to_numpy())
    c2 = (c * c).sum(axis=1)
    parts = []
    for s in range(0, len(qid), CHUNK):
        x = q[s:s + CHUNK]
        d2 = (x * x).sum(axis=1)[:, None] + c2[None, :] - 2.0 * (x @ c.T)
        other = qid[s:s + CHUNK, None] != cid[None, :]
        d = np.sqrt(np.maximum(d2, 0.0)) * other
        for w in range(labels.shape[1]):
            names = np.unique(labels[:, w])
            onehot = (labels[:, w][:, None] == names[None, :]).astype(np.float64)
            parts.append(pd.DataFrame({
                "qid": np.repeat(qid[s:s + CHUNK], len(names)), "which": w, "cluster": np.tile(names, len(x)),
                "dsum": (d @ onehot).ravel(), "n": (other @ onehot).ravel().astype(np.int64)}))
    return pd.concat(parts)


def _silhouette_rows(df: DataFrame, labels: list[str], col: str, id_col: str, block_rows: int | None) -> DataFrame:
    """The same for any number of clusters: a row for every point, block and cluster."""
    n = df.count()
    every = F.array(*[F.col(x).cast("long") for x in labels])
    q = df.select(F.col(id_col).alias("qid"), F.col(col).cast("array<double>").alias("q_vec"))
    c = df.select(F.col(id_col).alias("cid"), F.col(col).cast("array<double>").alias("c_vec"), every.alias("c_labels"))
    part = block_pairs(q, c, _sil_kernel, SIL_SCHEMA, block_rows=block_rows, q_rows=n, c_rows=n)
    per = part.groupBy("qid", "which", "cluster").agg(F.sum("dsum").alias("dsum"), F.sum("n").alias("n"))
    own = df.select(F.col(id_col).alias("qid"), F.posexplode(every).alias("which", "own"))
    same = F.col("cluster") == F.col("own")
    mean = F.try_divide("dsum", "n")
    agg = per.join(own, ["qid", "which"]).groupBy("qid", "which").agg(
        F.max(F.when(same, mean)).alias("a"), F.max(F.when(same, F.col("n"))).alias("own_others"),
        F.min(F.when(~same & (F.col("n") > 0), mean)).alias("b"))
    ratio = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    score = F.when(F.coalesce(F.col("own_others"), F.lit(0)) == 0, F.lit(0.0)).otherwise(ratio)
    return agg.select("qid", "which", score.alias("silhouette"))


def _sil_tiles(slots: list[dict[int, int]], width: int):
    """Every point's sums of distances to the clusters of all labellings, from the points of two blocks: one product of a
    tile serves both sides.  ``same`` holds the slots of the points that a sum leaves out for having the point's id."""
    def side(pdf):
        pdf = pdf.sort_values("qid", kind="stable")
        own = np.array([[slots[w].get(c, -1) for w, c in enumerate(r)] for r in np.array(pdf["labels"].tolist(), object)], np.int64)
        onehot = np.zeros((len(pdf), width))
        at = own >= 0
        onehot[np.nonzero(at)[0], own[at]] = 1.0
        x = stack(pdf["v"])
        return pdf["qid"].to_numpy(np.int64), x, (x * x).sum(axis=1), own, onehot

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [side(g) for _, g in pdf.groupby("blk", sort=True)]
        a, b = blocks[0], blocks[-1]
        alone = len(blocks) == 1
        if alone and pdf["i"].iloc[0] != pdf["j"].iloc[0]:  # the other block is empty
            return pd.DataFrame({f: [] for f in ("qid", "own", "sums", "same", "selfs")})
        sums = [np.zeros((len(s[0]), width)) for s in blocks]
        same = [[[] for _ in s[0]] for s in blocks]
        for lo in range(0, len(a[0]), TILE):
            for at in range(0, len(b[0]), TILE):
                p, q = slice(lo, lo + TILE), slice(at, at + TILE)
                d = a[1][p] @ b[1][q].T
                d *= -2.0
                d += a[2][p, None]
                d += b[2][None, q]
                np.maximum(d, 0.0, out=d)
                np.sqrt(d, out=d)
                if alone:  # equal ids share their block
                    for r, c in zip(*np.nonzero(a[0][p, None] == b[0][None, q])):
                        d[r, c] = 0.0
                        same[0][lo + r] += [int(o) for o in b[3][at + c] if o >= 0]
                sums[0][p] += d @ b[4][q]
                if not alone:
                    sums[1][q] += d.T @ a[4][p]
        return pd.concat([pd.DataFrame({"qid": s[0], "own": list(s[3]), "sums": list(t), "same": e, "selfs": int(alone)})
                          for s, t, e in zip(blocks, sums, same)])

    return run


def _sil_scores(starts: np.ndarray, counts: np.ndarray):
    """Silhouettes of the points of a group from all their partial sums."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qid, at, row = np.unique(pdf["qid"].to_numpy(np.int64), return_index=True, return_inverse=True)
        own = np.stack(pdf["own"].to_numpy())[at]
        sums = np.zeros((len(qid), len(counts)))
        np.add.at(sums, row, stack(pdf["sums"]))
        n = np.zeros(len(qid))
        np.add.at(n, row, pdf["selfs"].to_numpy(np.float64))  # rows of the same id
        n = n[:, None] * counts[None, :]
        for r, e in zip(row, pdf["same"]):
            np.subtract.at(n[r], np.asarray(e, np.int64), 1.0)
        mean = np.divide(sums, n, out=np.full_like(sums, np.inf), where=n > 0)
        out = []
        index = np.arange(len(qid))
        for w in range(own.shape[1]):
            mine = own[:, w]
            known = mine >= 0
            others = mean[:, starts[w]:starts[w + 1]].copy()
            others[index[known], mine[known] - starts[w]] = np.inf
            a = np.where(known, mean[index, np.maximum(mine, 0)], np.inf)
            b = others.min(axis=1, initial=np.inf)
            ok = np.isfinite(a) & np.isfinite(b) & (np.maximum(a, b) > 0)
            s = np.zeros(len(qid))
            s[ok] = (b[ok] - a[ok]) / np.maximum(a[ok], b[ok])
            out.append(pd.DataFrame({"qid": qid, "which": w, "silhouette": s}))
        return pd.concat(out)

    return run


def silhouette_points(df: DataFrame, labels: list[str], col: str = "x", id_col: str = "idx",
                      block_rows: int | None = None) -> DataFrame:
    """(qid, which, silhouette): exact euclidean silhouette of every point under
    every labelling (``which`` counts ``labels``), in one all-pairs pass.  A
    singleton scores 0, and so does a point at distance 0 from both clusters.

    Points meet as two blocks, each pair of blocks once, and leave one array of
    sums a point and pair; more than ``SLOTS`` clusters leave rows instead."""
    every = F.array(*[F.col(x).cast("long") for x in labels])
    sizes = df.select(F.posexplode(every).alias("which", "cluster")).where("cluster is not null").groupBy("which", "cluster").agg(
        F.count(F.lit(1)).alias("n")).limit(SLOTS + 1).collect()
    if len(sizes) > SLOTS:
        return _silhouette_rows(df, labels, col, id_col, block_rows)
    sizes.sort()
    slots = [{r.cluster: i for i, r in enumerate(sizes) if r.which == w} for w in range(len(labels))]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in slots])])
    spark = df.sparkSession
    ship_package(spark)
    n = df.count()
    blocks = n_blocks(n, block_rows or auto_block_rows(n, 2 * spark.sparkContext.defaultParallelism, TILED_BLOCK_ROWS))
    points = df.select(F.col(id_col).alias("qid"), F.col(col).cast("array<double>").alias("v"), every.alias("labels"))
    points = points.withColumn("blk", F.pmod(F.xxhash64("qid", F.lit(17)), F.lit(blocks)).cast("int"))
    dealt = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select(
        "qid", "v", "labels", "blk", F.least("o", "blk").alias("i"), F.greatest("o", "blk").alias("j"))
    part = dealt.groupBy("i", "j").applyInPandas(_sil_tiles(slots, len(sizes)), SIL_PARTS)
    counts = np.array([r.n for r in sizes], float)
    groups = F.pmod(F.xxhash64("qid", F.lit(18)), F.lit(n_blocks(n, GROUP)))
    return part.groupBy(groups).applyInPandas(_sil_scores(starts, counts), "qid long, which int, silhouette double")


def silhouette_per_point(df: DataFrame, label: str = "cluster", col: str = "x", id_col: str = "idx",
                         block_rows: int | None = None) -> DataFrame:
    return silhouette_points(df, [label], col, id_col, block_rows).drop("which")


def silhouettes(df: DataFrame, labels: list[str], col: str = "x", id_col: str = "idx", block_rows: int | None = None) -> list[float]:
    """Mean silhouette of every labelling; -1 with fewer than two clusters (noise counts as a cluster)."""
    ks = df.agg(*[F.countDistinct(x) for x in labels]).first()
    means = {r["which"]: r["s"] for r in silhouette_points(df, labels, col, id_col, block_rows).groupBy("which").agg(
        F.avg("silhouette").alias("s")).collect()}
    return [-1.0 if k < 2 else float(means[i]) for i, k in enumerate(ks)]


def silhouette(df: DataFrame, label: str = "cluster", col: str = "x", id_col: str = "idx", block_rows: int | None = None) -> float:
    return silhouettes(df, [label], col, id_col, block_rows)[0]


# a26 -------------------------------------------------------------------------
def calinski_harabasz_frame(df: DataFrame, label: str = "cluster", col: str = "x") -> DataFrame:
    """(B/(k-1)) / (W/(n-k)) as a one-row frame; 0 with fewer than 2 clusters, 1 without spread within them.

    One pass: size, centroid and spread of each cluster as vector aggregates, combined map-side;
    the rest is over one row a cluster."""
    v = array_to_vector(F.col(col).cast("array<double>"))
    moments = df.select(F.col(label).alias("_l"), v.alias("_v")).groupBy("_l").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("m"), Summarizer.variance(F.col("_v")).alias("s"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    per = moments.select("n", "m", (add(vector_to_array("s")) * (F.col("n") - 1)).alias("w"))
    total = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("w").alias("W"),
                    Summarizer.mean(F.col("m"), F.col("n").cast("double")).alias("g"),
                    Summarizer.variance(F.col("m"), F.col("n").cast("double")).alias("u"),
                    F.sum(F.col("n") * F.col("n")).alias("n2"))
    # the unbiased weighted variance times its divisor: the spread of the centroids
    between = add(vector_to_array("u")) * (F.col("n") - F.col("n2") / F.col("n"))
    # no spread within the clusters: 1, as scikit-learn has it
    ratio = F.try_divide(between / (F.col("k") - 1), F.try_divide(F.col("W"), F.col("n") - F.col("k")))
    ch = F.when(F.col("k") < 2, F.lit(0.0)).when(F.col("W") == 0, F.lit(1.0)).otherwise(ratio)
    return total.select(ch.alias("calinski_harabasz"))


# a23 / a21 / a22 / a24 / j12 -------------------------------------------------
def cluster_sizes(labels: DataFrame, label: str = "cluster") -> DataFrame:
    """a23: size of every label, with the number of clusters and of noise rows of all."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.count(F.when(F.col(label) >= 0, 1)).alias("n_clusters"),
                      F.coalesce(F.sum(F.when(F.col(label) < 0, F.col("size"))), F.lit(0)).alias("noise"))
    return sizes.crossJoin(F.broadcast(total))  # one row


def cluster_profile(df: DataFrame, label: str = "cluster") -> DataFrame:
    """a21: size and population moments of the numeric metadata per cluster
    (noise excluded); NULLs skipped."""
    d = df.where(F.col(label) >= 0)
    aggs = [F.count(F.lit(1)).alias("size")]
    for name, c in (("temperature", "avg_temperature"), ("wind", "wind_speed"), ("humidity", "humidity")):
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    aggs += [F.min("avg_temperature").alias("temperature_min"), F.max("avg_temperature").alias("temperature_max")]
    return d.groupBy(label).agg(*aggs)


def category_histogram(df: DataFrame, category: str, label: str = "cluster") -> DataFrame:
    """a21 histograms in long form: (cluster, value, count)."""
    return df.where(F.col(label) >= 0).groupBy(label, category).agg(F.count(F.lit(1)).alias("count"))


def histogram_text(df: DataFrame, category: str, label: str = "cluster") -> DataFrame:
    """Per cluster, the histogram as ``value:count`` entries sorted and joined
    with ``;`` (a cluster has at most one entry per category value)."""
    h = category_histogram(df, category, label).select(
        label, F.concat(F.coalesce(F.col(category).cast("string"), F.lit("NULL")), F.lit(":"), F.col("count").cast("string")).alias("e"))
    return h.groupBy(label).agg(F.concat_ws(";", F.array_sort(F.collect_list("e"))).alias(f"{category}_hist"))


def dominant_category(df: DataFrame, category: str, label: str = "cluster", seq: str = "idx") -> DataFrame:
    """a22: most common value per cluster; ties -> the value seen first."""
    h = df.where(F.col(label) >= 0).groupBy(label, category).agg(
        F.count(F.lit(1)).alias("count"), F.min(seq).alias("first_seq"))
    best = F.max_by(F.col(category), F.struct(F.col("count"), -F.col("first_seq")))
    return h.groupBy(label).agg(best.alias(f"dominant_{category}"))


def category_centroid(df: DataFrame, category: str, col: str = "x", method: str = "mean") -> DataFrame:
    """a24: element-wise mean or median vector per category (long form:
    category, dim, value)."""
    if method not in ("mean", "median"):
        raise ValueError(f"Unknown aggregation method '{method}'; use mean or median")
    e = df.select(category, F.posexplode(col).alias("dim", "v"))
    agg = F.avg("v") if method == "mean" else F.median("v")
    return e.groupBy(category, "dim").agg(agg.alias("value"))


def centroid_distances(centroids: DataFrame, category: str) -> DataFrame:
    """j12: euclidean distance between every two category centroids
    (category count is bounded by the dimension table, e.g. 11 regions)."""
    a = centroids.select(F.col(category).alias("a"), "dim", F.col("value").alias("va"))
    b = centroids.select(F.col(category).alias("b"), "dim", F.col("value").alias("vb"))
    j = a.join(b, "dim").where(F.col("a") < F.col("b"))
    return j.groupBy("a", "b").agg(F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2)).alias("distance"))


# w04 / t03 ------------------------------------------------------------------
def elbow(metrics: DataFrame) -> DataFrame:
    """Largest second difference of inertia over k, plus one (needs >= 3 k)."""
    w = Window.orderBy("k")  # one row per k: bounded by the k range
    d2 = metrics.select("k", (F.lead("inertia", 2).over(w) - 2 * F.lead("inertia", 1).over(w) + F.col("inertia")).alias("d2"))
    return d2.where(F.col("d2").isNotNull()).agg(F.max_by(F.col("k") + 1, F.struct("d2", -F.col("k"))).alias("elbow_k"))


def argmax_k(metrics: DataFrame, score: str) -> DataFrame:
    """First k with the maximum score."""
    return metrics.agg(F.max_by("k", F.struct(F.col(score), -F.col("k"))).alias(f"best_k_{score}"))


# ml03 ------------------------------------------------------------------------
def find_optimal_k(df: DataFrame, k_range: tuple[int, int] = (2, 15), *, method: str = "kmeans", n_init: int = 10,
                   seed: int = 42, col: str = "x", id_col: str = "idx", block_rows: int | None = None) -> DataFrame:
    """Silhouette, Calinski-Harabasz and inertia for every k in the range."""
    if method != "kmeans":
        raise NotImplementedError(f"Method '{method}' is not implemented; use kmeans")
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select(id_col, F.col(col).cast("array<double>").alias(col)).repartition(id_col).checkpoint(eager=True)  # as in kmeans_best
    ks = list(range(k_range[0], k_range[1] + 1))
    fits = LL.fit_many(df.select(F.col(id_col).alias("id"), F.col(col).alias("v")), ks, n_init=n_init, seed=seed)
    schema = "k int, silhouette double, calinski_harabasz double, inertia double"
    if not fits.inertia:
        return df.sparkSession.createDataFrame([], schema)
    wide = LL.with_labels(df, {f"k{k}": fits.centres[k] for k in ks}, col).checkpoint(eager=True)
    sils = silhouettes(wide, [f"k{k}" for k in ks], col, id_col, block_rows)
    used = wide.agg(F.count("*").alias("n"), *[F.countDistinct(f"k{k}").alias(f"k{k}") for k in ks]).first()
    n, total = used["n"], total_spread(df, col)
    rows = []
    for k, sil in zip(ks, sils):
        w, c = fits.inertia[k], used[f"k{k}"]
        ch = 0.0 if c < 2 else 1.0 if w <= 1e-12 * total else (total - w) / (c - 1) / (w / (n - c)) if n > c else None
        rows.append((k, sil, ch, w))
    return df.sparkSession.createDataFrame(rows, schema)


def total_spread(df: DataFrame, col: str) -> float:
    """Sum of squared distances of all rows to their mean."""
    v = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(col)))
    r = df.agg(v.alias("m")).first().m
    return float(sum(r.variance) * (r["count"] - 1))


# j11 / ml05 -----------------------------------------------------------------
def _points(df: DataFrame, col: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(col).cast("array<double>").alias("v"))


def neighbour_counts(df: DataFrame, eps: float, col: str = "x", id_col: str = "idx", block_rows: int | None = None) -> DataFrame:
    """j11: points within cosine distance ``eps`` (the point itself included)."""
    pts = _points(df, col, id_col)
    counts = CE.Cells(pts, eps, block_rows).pairs(pts, pts, CE.count_kernel(eps), "id long, n long")
    found = counts.groupBy("id").agg(F.sum("n").alias("neighbours"))
    return found.select(F.col("id").alias("qid"), "neighbours")


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, comp) with comp = smallest id in the component.  Min-label
    propagation plus pointer jumping; every round is checkpointed so lineage
    stays short and lost executors recompute one round only.  Runs until no
    label changes (the bound only guards against a bug, it raises)."""
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    und = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lab = nodes.select(F.col("id"), F.col("id").alias("comp")).checkpoint(eager=True)
    for _ in range(max_rounds):
        nb = und.join(lab.withColumnRenamed("id", "dst").withColumnRenamed("comp", "c"), "dst").groupBy("src").agg(
            F.min("c").alias("c"))
        new = lab.join(nb.withColumnRenamed("src", "id"), "id", "left").select(
            "id", F.least("comp", F.coalesce("c", F.col("comp"))).alias("comp"))
        jump = new.join(new.select(F.col("id").alias("comp"), F.col("comp").alias("c2")), "comp", "left").select(
            "id", F.least("comp", F.coalesce("c2", F.col("comp"))).alias("comp"))
        jump = jump.checkpoint(eager=True)  # lineage cut every round
        changed = jump.join(lab.withColumnRenamed("comp", "old"), "id").where(F.col("comp") != F.col("old")).limit(1).count()
        lab = jump
        if changed == 0:
            return lab
    raise RuntimeError("connected components did not converge")


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, col: str = "x", id_col: str = "idx",
           block_rows: int | None = None) -> DataFrame:
    """ml05: (idx, cluster) with noise = -1 (cosine metric).

    Three joins over the same pivot cells: neighbour counts of all points, links of core
    points (stars of each block pair's components), least cluster near each other point."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    pts = _points(df, col, id_col).checkpoint(eager=True)
    cells = CE.Cells(pts, eps, block_rows)
    counts = cells.pairs(pts, pts, CE.count_kernel(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("neighbours"))
    pts = pts.join(counts, "id").checkpoint(eager=True)  # the counting join runs once
    core = pts.where(F.col("neighbours") >= min_samples).select("id", "v")
    edges = cells.pairs(core, core, CE.forest_kernel(eps), "src long, dst long")
    comps = connected_components(core.select("id"), edges.distinct().checkpoint(eager=True))
    # canonical numbering: by the lowest core id of each component
    ranked = dense_positions(comps.select("comp").distinct(), ["comp"], "label")
    core_lab = comps.join(ranked, "comp").select("id", "label").checkpoint(eager=True)
    # border points: lowest label among core neighbours
    others = pts.where(F.col("neighbours") < min_samples).select("id", "v")
    border = cells.pairs(others, core.join(core_lab, "id"), CE.least_label_kernel(eps), "id long, label long").groupBy("id").agg(
        F.min("label").alias("label"))
    found = core_lab.unionByName(border).select(F.col("id").alias("idx"), "label")
    return df.select(F.col(id_col).alias("idx")).join(found, "idx", "left").select(
        "idx", F.coalesce("label", F.lit(-1)).cast("long").alias("cluster"))


# ml07 ------------------------------------------------------------------------
@dataclass
class ClusteringResults:
    """samples (idx, cluster, reduced), clusters (cluster, size, profile, histograms, dominant
    categories, centre) without noise, overall (n_clusters, noise, scores, explained variance)."""

    samples: DataFrame
    clusters: DataFrame
    overall: DataFrame


def clustering_results(df: DataFrame, labels: DataFrame, metadata: DataFrame, centres: list[list[float]] | None = None, *,
                       col: str = "x", id_col: str = "idx", n_components: int = 2) -> ClusteringResults:
    """ml07: everything known of one clustering of ``df`` (idx, x).  ``metadata`` holds idx,
    region, season, precipitation and the numeric fields of ``cluster_profile``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    own = labels.select(F.col("idx").alias(id_col), F.col("cluster").cast("long").alias("cluster"))
    j = df.select(id_col, col).join(own, id_col).checkpoint(eager=True)
    reduced, explained = pca(j, n_components, col)
    # the score counts noise as a cluster of its own, as the original does
    sil, ch = silhouette(j, "cluster", col, id_col), calinski_harabasz_frame(j, "cluster", col)
    k = j.where("cluster >= 0").select("cluster").distinct().count()
    if k < 2:
        sil, ch = -1.0, ch.select(F.lit(0.0).alias("calinski_harabasz"))
    overall = cluster_sizes(j).select("n_clusters", "noise").distinct().crossJoin(ch).select(
        "n_clusters", "noise", F.lit(sil).alias("silhouette"), "calinski_harabasz",
        F.array(*[F.lit(v) for v in explained]).alias("explained_variance"))
    m = metadata.join(own, id_col).checkpoint(eager=True)
    clusters = cluster_profile(m)
    for cat in ("region", "season", "precipitation"):
        clusters = clusters.join(histogram_text(m, cat), "cluster")
    for cat in ("region", "season"):
        clusters = clusters.join(dominant_category(m, cat), "cluster")
    at = spark.createDataFrame([(i, c) for i, c in enumerate(centres or [])], "cluster long, centre array<double>")
    return ClusteringResults(reduced.select(id_col, "cluster", "reduced"), clusters.join(at, "cluster", "left"), overall)


def write_results(results: ClusteringResults, path: str) -> str:
    """Three Parquet tables below ``path``."""
    for f in fields(results):
        getattr(results, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
    return path


def read_results(spark, path: str) -> ClusteringResults:
    return ClusteringResults(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(ClusteringResults)])
