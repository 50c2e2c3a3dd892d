"""Registered queries: cluster analysis (label-based metrics have oracle SQL;
fitted models are checked by invariants in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.functions import captions as C
from skycap.functions import parse as P
from skycap.operators import cluster as CL
from skycap.operators import linkage as LK
from skycap.operators.encode import embed_batch, hashing_text_encoder
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.registry import query, rounded
from skycap.session import scratch_path

EPS = 0.7


def _labelled(spark, sf):
    """Embedding set with the table's own label as the clustering."""
    s = derive.emb_samples(spark, sf)
    return s.select("idx", "sample_id", F.col("label").cast("long").alias("cluster"),
                    F.col("image_emb").cast("array<double>").alias("x"), "region",
                    C.season_from_date(F.col("date")).alias("season"),
                    F.col("t_mean").alias("avg_temperature"), F.col("w_mean").alias("wind_speed"),
                    F.col("h_mean").alias("humidity"), P.extract_precipitation(F.col("caption")).alias("precipitation"))


CL_SQL = S.EMB + f""",
cl AS (
  SELECT e.idx, e.sample_id, CAST(f.label AS BIGINT) AS cluster, e.image_emb AS x, e.region,
         CASE WHEN month(CAST(e.date AS DATE)) IN (12, 1, 2) THEN 'winter' WHEN month(CAST(e.date AS DATE)) IN (3, 4, 5) THEN 'spring'
              WHEN month(CAST(e.date AS DATE)) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
         e.t_mean AS avg_temperature, e.w_mean AS wind_speed, e.h_mean AS humidity,
         {S.first_term('e.caption', P.PRECIP_TERMS)} AS precipitation
  FROM es e JOIN embeddings f ON f.vec_id = e.idx
),
ux AS (SELECT idx, cluster, region, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM cl)"""


@query("a23_cluster_sizes", CL_SQL + """
SELECT cluster, count(*) AS size, (SELECT count(DISTINCT cluster) FROM cl WHERE cluster >= 0) AS n_clusters,
       (SELECT count(*) FROM cl WHERE cluster < 0) AS noise FROM cl GROUP BY cluster""")
def a23(spark, sf):
    return CL.cluster_sizes(_labelled(spark, sf))


def _hist_sql(cat: str) -> str:
    return (f"(SELECT cluster, string_agg(e, ';' ORDER BY e) AS {cat}_hist FROM (SELECT cluster, COALESCE(CAST({cat} AS VARCHAR), 'NULL') "
            f"|| ':' || CAST(count(*) AS VARCHAR) AS e FROM cl WHERE cluster >= 0 GROUP BY cluster, {cat}) GROUP BY cluster) h_{cat}")


@query("a21_cluster_profile", CL_SQL + f""",
prof AS (
SELECT cluster, count(*) AS size,
  {S.R('avg(avg_temperature)')} AS temperature_mean, {S.R('stddev_pop(avg_temperature)')} AS temperature_std,
  {S.R('avg(wind_speed)')} AS wind_mean, {S.R('stddev_pop(wind_speed)')} AS wind_std,
  {S.R('avg(humidity)')} AS humidity_mean, {S.R('stddev_pop(humidity)')} AS humidity_std,
  {S.R('min(avg_temperature)')} AS temperature_min, {S.R('max(avg_temperature)')} AS temperature_max
FROM cl WHERE cluster >= 0 GROUP BY cluster)
SELECT prof.*, h_region.region_hist, h_season.season_hist, h_precipitation.precipitation_hist
FROM prof JOIN {_hist_sql('region')} USING (cluster) JOIN {_hist_sql('season')} USING (cluster)
     JOIN {_hist_sql('precipitation')} USING (cluster)
""")
def a21(spark, sf):
    df = _labelled(spark, sf)
    out = CL.cluster_profile(df)
    for cat in ("region", "season", "precipitation"):
        out = out.join(CL.histogram_text(df, cat), "cluster")
    return rounded(out)


@query("a22_dominant_category", CL_SQL + """,
h AS (SELECT cluster, region, count(*) AS c, min(idx) AS f FROM cl GROUP BY ALL),
hs AS (SELECT cluster, season, count(*) AS c, min(idx) AS f FROM cl GROUP BY ALL)
SELECT r.cluster, r.dominant_region, s.dominant_season FROM
  (SELECT cluster, arg_max(region, (c, -f)) AS dominant_region FROM h GROUP BY cluster) r
  JOIN (SELECT cluster, arg_max(season, (c, -f)) AS dominant_season FROM hs GROUP BY cluster) s USING (cluster)
""")
def a22(spark, sf):
    df = _labelled(spark, sf)
    return CL.dominant_category(df, "region").join(CL.dominant_category(df, "season"), "cluster")


@query("a24_category_centroid", CL_SQL + f"""
SELECT region, CAST(dim AS BIGINT) AS dim, {S.R('avg(v)')} AS mean, {S.R('quantile_cont(v, 0.5)')} AS median
FROM ux GROUP BY region, dim
""")
def a24(spark, sf):
    df = _labelled(spark, sf)
    m = CL.category_centroid(df, "region", method="mean").withColumnRenamed("value", "mean")
    md = CL.category_centroid(df, "region", method="median").withColumnRenamed("value", "median")
    return rounded(m.join(md, ["region", "dim"]).select("region", F.col("dim").cast("long"), "mean", "median"))


@query("j12_centroid_distances", CL_SQL + f""",
cen AS (SELECT region, dim, avg(v) AS m FROM ux GROUP BY ALL)
SELECT a.region AS a, b.region AS b, {S.R('sqrt(sum((a.m - b.m) * (a.m - b.m)))')} AS distance
FROM cen a JOIN cen b ON a.dim = b.dim AND a.region < b.region GROUP BY a.region, b.region
""")
def j12(spark, sf):
    cen = CL.category_centroid(_labelled(spark, sf), "region", method="mean")
    return rounded(CL.centroid_distances(cen, "region"))


@query("a25_silhouette", CL_SQL + f""",
d AS (SELECT p.idx, q.cluster AS c, p.cluster AS own, list_distance(p.x, q.x) AS dist
      FROM cl p JOIN cl q ON p.idx <> q.idx),
m AS (SELECT idx, c, own, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT idx, max(md) FILTER (WHERE c = own) AS a, min(md) FILTER (WHERE c <> own) AS b FROM m GROUP BY idx)
SELECT {S.R('avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM s
""")
def a25(spark, sf):
    v = CL.silhouette(_labelled(spark, sf), "cluster", "x")
    return rounded(spark.createDataFrame([(v,)], "silhouette double"))


@query("a26_calinski_harabasz", CL_SQL + f""",
cc AS (SELECT cluster, dim, avg(v) AS cm, count(*) AS nk FROM ux GROUP BY ALL),
gc AS (SELECT dim, avg(v) AS gm FROM ux GROUP BY dim),
bw AS (SELECT sum(nk * (cm - gm) * (cm - gm)) AS B FROM cc JOIN gc USING (dim)),
ww AS (SELECT sum((v - cm) * (v - cm)) AS W FROM ux JOIN cc USING (cluster, dim)),
nk AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM cl)
SELECT {S.R('CASE WHEN k < 2 THEN 0.0 WHEN W = 0 THEN 1.0 ELSE (B / (k - 1)) / (W / (n - k)) END')} AS calinski_harabasz FROM bw, ww, nk
""")
def a26(spark, sf):
    return rounded(CL.calinski_harabasz_frame(_labelled(spark, sf), "cluster", "x"))


@query("j11_eps_neighbours", CL_SQL + f"""
SELECT p.idx AS qid, count(*) AS neighbours FROM cl p JOIN cl q
  ON 1.0 - list_dot_product(p.x, q.x) / (sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))) <= {EPS}
GROUP BY p.idx
""")
def j11(spark, sf):
    return CL.neighbour_counts(_labelled(spark, sf), EPS, "x")


# fitted models: rows-only checks, invariants in tests ---------------------------
def _std(spark, sf):
    return CL.prepared(derive.emb_samples(spark, sf), "combined")


@query("ml02_kmeans")
def ml02(spark, sf):
    lab, _, centres = CL.kmeans_best(_std(spark, sf), 8, n_init=10)
    at = spark.createDataFrame([(i, c) for i, c in enumerate(centres)] or [(0, [])], "cluster int, centre array<double>")
    return lab.select("idx", "cluster").join(F.broadcast(at), "cluster").select(  # 8 rows
        "idx", F.col("cluster").cast("long").alias("cluster"), "centre")


def _sweep(spark, sf):
    return CL.find_optimal_k(_std(spark, sf), (2, 15))


@query("ml03_find_optimal_k")
def ml03(spark, sf):
    return rounded(_sweep(spark, sf))


@query("t03_argmax_k")
def t03(spark, sf):
    m = _sweep(spark, sf)
    return CL.argmax_k(m, "silhouette").withColumn("_o", F.lit(1)).join(
        CL.argmax_k(m, "calinski_harabasz").withColumn("_o", F.lit(1)), "_o").drop("_o")


@query("w04_elbow")
def w04(spark, sf):
    return CL.elbow(_sweep(spark, sf))


@query("ml04_hierarchical")
def ml04(spark, sf):
    lab = CL.bisecting(_std(spark, sf), 8)
    return lab.select("idx", F.col("cluster").cast("long").alias("cluster"))


@query("ml04_single_linkage")
def ml04_single(spark, sf):
    return LK.hierarchical(_std(spark, sf), 8, method="single")


@query("ml04_ward_linkage")
def ml04_ward(spark, sf):
    return LK.hierarchical(_std(spark, sf), 8)


@query("ml05_dbscan")
def ml05(spark, sf):
    return CL.dbscan(_labelled(spark, sf), EPS, 5, "x")


@query("ml06_pca")
def ml06(spark, sf):
    out, ev = CL.pca(_std(spark, sf), 2)
    return rounded(out.select("idx", F.posexplode("reduced").alias("component", "value")).select(
        "idx", F.col("component").cast("long").alias("component"), "value",
        F.element_at(F.array(*[F.lit(v) for v in ev]), F.col("component") + 1).alias("explained_variance")))


@query("ml07_clustering_results")
def ml07(spark, sf):
    """The bundle of one clustering, written and read back: a row a sample with its reduced vector, and
    what holds for its cluster and for all clusters."""
    labelled = CL.prepared(derive.emb_samples(spark, sf), "combined")
    lab, _, centres = CL.kmeans_best(labelled, 8, n_init=10)
    meta = _labelled(spark, sf).drop("x", "cluster")
    b = CL.read_results(spark, CL.write_results(CL.clustering_results(labelled, lab.select("idx", "cluster"), meta, centres),
                                                scratch_path(spark, "clusters")))
    samples = b.samples.withColumnRenamed("reduced", "r")
    out = samples.join(b.clusters, "cluster", "left").crossJoin(F.broadcast(b.overall))  # one row
    return rounded(out.select("idx", "cluster", F.col("r")[0].alias("reduced_1"), F.col("r")[1].alias("reduced_2"), "size", "temperature_mean",
                              "wind_mean", "humidity_mean", "region_hist", "season_hist", "precipitation_hist", "dominant_region",
                              "dominant_season", F.size("centre").alias("width"), "n_clusters", "noise", "silhouette", "calinski_harabasz"))


@query("ml11_embed_batch")
def ml11(spark, sf):
    s = derive.emb_samples(spark, sf)
    e = embed_batch(s, "caption", hashing_text_encoder(256))
    return rounded(e.select("sample_id", F.size("embedding").cast("long").alias("dim"),
                            F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
