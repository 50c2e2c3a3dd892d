"""Registered queries: caption parsing, scoring and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.functions import parse as P
from skycap.functions import scoring as M
from skycap.operators import retrieval as R
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.registry import query, rounded


def _samples(spark, sf) -> DataFrame:
    return R.parse_features(derive.emb_samples(spark, sf))


# x01-x09: one field per query over the embedding-set captions ---------------
def _parse_query(key, expr, sql_col):
    @query(key, S.EMB_PARSED + f"\nSELECT sample_id, {sql_col} AS value FROM ep")
    def fn(spark, sf):
        s = derive.emb_samples(spark, sf)
        return rounded(s.select("sample_id", expr(F.col("caption")).alias("value")))

    return fn


_parse_query("x01_region", P.extract_region, "p_region")
_parse_query("x02_date", P.extract_date, "p_date")
_parse_query("x03_season", P.extract_season, "p_season")
_parse_query("x05_avg_temperature", P.extract_avg_temperature, "round(p_avg_temperature, 6)")
_parse_query("x06_wind_speed", P.extract_wind_speed, "round(p_wind_speed, 6)")
_parse_query("x07_precipitation", P.extract_precipitation, "p_precipitation")
_parse_query("x08_humidity", P.extract_humidity, "round(p_humidity, 6)")
_parse_query("x09_conditions", P.extract_conditions, "p_conditions")


@query("x04_temperature_range", S.EMB_PARSED + """
SELECT sample_id, round(p_tmin, 6) AS range_min, round(p_tmax, 6) AS range_max FROM ep
""")
def x04(spark, sf):
    s = derive.emb_samples(spark, sf).select("sample_id", P.extract_temperature_range(F.col("caption")).alias("r"))
    return rounded(s.select("sample_id", F.col("r.min").alias("range_min"), F.col("r.max").alias("range_max")))


_X10_COLS = ["region", "date", "season", "avg_temperature", "wind_speed", "precipitation", "humidity", "conditions"]


@query("x10_parse_caption", "WITH d AS (SELECT doc_id, text FROM documents)\nSELECT doc_id, "
       + S.parsed_columns("text").replace("AS p_tmin", "AS p_range_min").replace("AS p_tmax", "AS p_range_max")
       .replace(" AS p_", " AS ") + " FROM d")
def x10(spark, sf):
    """Whole-document parse: every field of every document text."""
    d = derive.table(spark, sf, "documents").select("doc_id", P.parse_caption(F.col("text")).alias("p"))
    return rounded(d.select("doc_id", *[F.col(f"p.{c}").alias(c) for c in _X10_COLS],
                            F.col("p.temperature_range.min").alias("range_min"),
                            F.col("p.temperature_range.max").alias("range_max")))


# m01-m05: scores of each sample against its successor (an equi-join) ---------
def _neighbours(spark, sf) -> DataFrame:
    s = _samples(spark, sf).withColumn("p", P.parse_caption(F.col("caption")))
    a = s.select(F.col("idx").alias("a_idx"), F.col("p").alias("a_p"), F.col("image_emb").alias("a_img"))
    b = s.select((F.col("idx") - 1).alias("a_idx"), F.col("idx").alias("b_idx"), F.col("p").alias("b_p"),
                 F.col("text_emb").alias("b_txt"))
    return a.join(b, "a_idx")


@query("m01_season_similarity", S.EMB_PARSED + f"""
SELECT a.idx AS a_idx, b.idx AS b_idx, a.p_season AS a_season, b.p_season AS b_season,
       {S.season_sim('a.p_season', 'b.p_season', 'a.p_sidx', 'b.p_sidx')} AS season_similarity
FROM ep a JOIN ep b ON b.idx = a.idx + 1
""")
def m01(spark, sf):
    nb = _neighbours(spark, sf)
    return rounded(nb.select("a_idx", "b_idx", F.col("a_p.season").alias("a_season"), F.col("b_p.season").alias("b_season"),
                             M.season_similarity(F.col("a_p.season"), F.col("b_p.season")).alias("season_similarity")))


@query("m02_temperature_similarity", S.EMB_PARSED + f"""
SELECT a.idx AS a_idx, b.idx AS b_idx,
       {S.R(S.temp_sim('a.p_avg_temperature', 'b.p_avg_temperature'))} AS temperature_similarity
FROM ep a JOIN ep b ON b.idx = a.idx + 1
""")
def m02(spark, sf):
    nb = _neighbours(spark, sf)
    return rounded(nb.select("a_idx", "b_idx", M.temperature_similarity(F.col("a_p.avg_temperature"),
                                                                         F.col("b_p.avg_temperature")).alias("temperature_similarity")))


@query("m03_weather_similarity", S.EMB_PARSED + f"""
SELECT q.idx AS a_idx, c.idx AS b_idx, {S.R(S.weather_sim('q', 'c'))} AS relevance
FROM ep q JOIN ep c ON c.idx = q.idx + 1
""")
def m03(spark, sf):
    nb = _neighbours(spark, sf)
    return rounded(nb.select("a_idx", "b_idx", M.weather_similarity(F.col("a_p"), F.col("b_p")).alias("relevance")))


@query("m04_cosine_score", S.EMB_PARSED + f"""
SELECT a.idx AS a_idx, b.idx AS b_idx, {S.R('list_dot_product(a.image_emb, b.text_emb)')} AS cosine
FROM ep a JOIN ep b ON b.idx = a.idx + 1
""")
def m04(spark, sf):
    nb = _neighbours(spark, sf)
    return rounded(nb.select("a_idx", "b_idx", M.dot("a_img", "b_txt").alias("cosine")))


@query("m05_sigmoid_probability", S.EMB_PARSED + f"""
SELECT a.idx AS a_idx, b.idx AS b_idx,
       {S.R(f'1.0 / (1.0 + exp(-({M.DEFAULT_SCALE!r})::DOUBLE * list_dot_product(a.image_emb, b.text_emb)))')} AS probability
FROM ep a JOIN ep b ON b.idx = a.idx + 1
""")
def m05(spark, sf):
    nb = _neighbours(spark, sf)
    return rounded(nb.select("a_idx", "b_idx", M.sigmoid_probability(M.dot("a_img", "b_txt")).alias("probability")))


# retrieval -------------------------------------------------------------------
def _partials(spark, sf, **options):
    return R.ranked_partials(_samples(spark, sf), [R.I2T], **options)


@query("j07_all_pairs_relevance", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + f"""
SELECT qid, count(*) FILTER (WHERE rel > 0) AS relevant, {S.R('sum(rel) FILTER (WHERE rel > 0)')} AS relevance_sum,
       {S.R('max(rel) FILTER (WHERE rel > 0)')} AS relevance_max
FROM pr_x GROUP BY qid
""")
def j07(spark, sf):
    p = _partials(spark, sf, similarity=False)
    return rounded(p.select("qid", F.col("pos_n").alias("relevant"), F.col("pos_sum").alias("relevance_sum"),
                            F.col("pos_max").alias("relevance_max")))


@query("a14_relevance_stats", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + f"""
SELECT count(*) AS non_zero_entries, {S.R('COALESCE(avg(rel), 0.0)')} AS mean_relevance,
       {S.R('COALESCE(max(rel), 0.0)')} AS max_relevance
FROM pr_x WHERE rel > 0
""")
def a14(spark, sf):
    p = _partials(spark, sf, similarity=False)
    out = p.agg(F.sum("pos_n").alias("n"), F.sum("pos_sum").alias("s"), F.max("pos_max").alias("m"))
    return rounded(out.select(F.coalesce("n", F.lit(0)).alias("non_zero_entries"),
                              F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("mean_relevance"),
                              F.coalesce("m", F.lit(0.0)).alias("max_relevance")))


@query("j08_similarity_cross", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + S.pairs_cte("text_emb", "image_emb", "t") + """
SELECT a.qid, a.i2t_rank, b.t2i_rank FROM
  (SELECT qid, r AS i2t_rank FROM rk_x WHERE cid = qid) a JOIN (SELECT qid, r AS t2i_rank FROM rk_t WHERE cid = qid) b USING (qid)
""")
def j08(spark, sf):
    p = R.ranked_partials(_samples(spark, sf), [R.I2T, R.T2I])
    return p.groupBy("qid").agg(F.max(F.when(F.col("dir") == "i2t", F.col("rank_true"))).alias("i2t_rank"),
                                F.max(F.when(F.col("dir") == "t2i", F.col("rank_true"))).alias("t2i_rank"))


@query("w01_similarity_rank", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + f"""
SELECT qid, r AS rank, cid, {S.R('sim')} AS similarity FROM rk_x
""")
def w01(spark, sf):
    return rounded(R.full_ranking(derive.emb_samples(spark, sf)))


@query("t01_top_k", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + f"""
SELECT qid, r AS rank, cid, {S.R('rel')} AS relevance FROM rk_x WHERE r <= 5
""")
def t01(spark, sf):
    p = R.ranked_partials(_samples(spark, sf), [R.I2T], k_max=5)
    p = p.select("qid", F.posexplode("top").alias("pos", "t"))
    return rounded(p.select("qid", (F.col("pos") + 1).cast("long").alias("rank"), F.col("t.cid").alias("cid"),
                            F.col("t.rel").alias("relevance")))


@query("w02_ideal_rank", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + f"""
SELECT qid, ir AS rank, {S.R('rel')} AS relevance FROM rk_x WHERE ir <= 10
""")
def w02(spark, sf):
    p = _partials(spark, sf, similarity=False).select("qid", F.posexplode("ideal").alias("pos", "rel"))
    return rounded(p.select("qid", (F.col("pos") + 1).cast("long").alias("rank"), F.col("rel").alias("relevance")))


def _graded_sql(k: int, test: str, name: str) -> str:
    return f"{S.R(f'avg(CASE WHEN EXISTS (SELECT 1 FROM rk_x x WHERE x.qid = q.qid AND x.r <= {k} AND x.{test}) THEN 1.0 ELSE 0.0 END)')} AS {name}_{k}"


@query("a15_graded_recall", S.EMB_PARSED + S.pairs_cte("image_emb", "text_emb") + "SELECT " + ", ".join(
    _graded_sql(k, test, name) for test, name in (("rel > 0", "any_at"), ("rel >= 0.8", "threshold_at")) for k in (1, 5, 10))
    + " FROM (SELECT DISTINCT qid FROM rk_x) q")
def a15_graded(spark, sf):
    p = _partials(spark, sf).checkpoint(eager=True)
    some = R.graded_recall(p).toDF("dir", *[f"any_at_{k}" for k in R.DEFAULT_K])
    return rounded(some.join(R.graded_recall(p, threshold=0.8).toDF("dir", *[f"threshold_at_{k}" for k in R.DEFAULT_K]), "dir").drop("dir"))


_BOTH = S.EMB_PARSED + S.direction_metrics_sql("image_emb", "text_emb", "i2t") + S.direction_metrics_sql("text_emb", "image_emb", "t2i")


def _report(spark, sf) -> DataFrame:
    return R.retrieval_report(_samples(spark, sf))


def _report_query(key, cols):
    sql_cols = []
    for c in cols:
        if c.startswith("mean_"):
            base = c[len("mean_"):]
            sql_cols.append(f"{S.R(f'(i2t_{base} + t2i_{base}) / 2')} AS {c}")
        else:
            sql_cols.append(f"{S.R(c)} AS {c}")

    @query(key, _BOTH + "\nSELECT " + ", ".join(sql_cols) + " FROM m_i2t, m_t2i")
    def fn(spark, sf):
        return rounded(_report(spark, sf).select(*cols))

    return fn


def _dirs(metrics):
    return [f"{d}_{m}" for m in metrics for d in ("i2t", "t2i", "mean")]


_report_query("a15_recall_at_k", _dirs(["recall_at_1", "recall_at_5", "recall_at_10"]))
_report_query("a16_mrr", _dirs(["mrr"]))
_report_query("a17_ndcg_at_k", _dirs(["ndcg_at_5", "ndcg_at_10"]))
_report_query("a18_retrieval_report", _dirs(["recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_5", "ndcg_at_10"]))
