"""Registered queries: validation, profiles, record-side caption helpers,
embedding selection / normalisation, limits and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.functions import captions as C
from skycap.functions import parse as P
from skycap.functions.vectors import l2_norm, l2_normalise, select_embedding
from skycap.operators import grid as G
from skycap.operators import profile as PF
from skycap.operators import quality as QL
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.q_io import RULES, _jsonl
from skycap.plans.registry import query, rounded
from skycap.sources import records as RC


def _required(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_required(lines, listing, base, f"{base}/images")
    return good


def _strict(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_strict(lines, listing, base)
    return good


REQ = RULES + """,
req AS (
  SELECT sample_id, CASE WHEN idx % 7 = 2 THEN '  ' || caption || ' ' ELSE caption END AS caption,
         'temperature' AS variable, model, CASE WHEN null_date THEN NULL ELSE date END AS date,
         CASE WHEN no_region THEN 'Unknown' ELSE region END AS region,
         CASE WHEN null_date THEN 'unknown' ELSE season END AS season
  FROM rl WHERE NOT (bad_json OR no_date OR no_image)
),
strict AS (
  SELECT sample_id, 'temperature' AS variable, model, date FROM rl
  WHERE NOT (bad_json OR no_date OR extra_key OR null_date OR bare OR no_image)
)"""


# p09-p11 ----------------------------------------------------------------------
@query("p09_validate_bounds", S.GRID + """,
bx AS (SELECT variable, strftime(valid_time, '%Y-%m-%d') AS valid_date, min(lon_raw) AS lon0, max(lon_raw) AS lon1,
              min(lat) AS lat0, max(lat) AS lat1 FROM grid0 GROUP BY ALL)
SELECT variable, valid_date,
  (lon0 < lon1) AND (lat0 < lat1) AND lat0 BETWEEN -90 AND 90 AND lat1 BETWEEN -90 AND 90
    AND lon0 BETWEEN -180 AND 180 AND lon1 BETWEEN -180 AND 180 AS valid,
  CAST((CASE WHEN lon0 < lon1 THEN 0 ELSE 1 END) + (CASE WHEN lat0 < lat1 THEN 0 ELSE 1 END)
    + (CASE WHEN lat0 BETWEEN -90 AND 90 AND lat1 BETWEEN -90 AND 90 THEN 0 ELSE 1 END)
    + (CASE WHEN lon0 BETWEEN -180 AND 180 AND lon1 BETWEEN -180 AND 180 THEN 0 ELSE 1 END) AS BIGINT) AS n_reasons
FROM bx
""")
def p09(spark, sf):
    g = derive.grid(spark, sf)
    bx = g.groupBy("variable", F.date_format("valid_time", "yyyy-MM-dd").alias("valid_date")).agg(
        F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    v = QL.validate_bounds(bx)
    return v.select("variable", "valid_date", "valid", F.size("reasons").cast("long").alias("n_reasons"))


@query("p10_validate_statistics", S.FIELD_STATS + """
SELECT model, variable, strftime(valid_time, '%Y-%m-%d') AS valid_date, CAST(forecast_hour AS BIGINT) AS forecast_hour, region,
  COALESCE(std >= 0, FALSE) AND COALESCE(mad >= 0, FALSE) AND COALESCE(coeff_variation >= 0, FALSE) AND count_valid >= 0
    AND count_missing >= 0 AND forecast_hour >= 0 AND min IS NOT NULL AND max IS NOT NULL AND mean IS NOT NULL
    AND std IS NOT NULL AND median IS NOT NULL AND unit IS NOT NULL AND valid_time_str IS NOT NULL AS valid
FROM fstats
""")
def p10(spark, sf):
    s = G.field_statistics(derive.grid(spark, sf))
    v = QL.validate_statistics(s)
    return rounded(v.select("model", "variable", F.date_format("valid_time", "yyyy-MM-dd").alias("valid_date"),
                            "forecast_hour", "region", "valid"))


@query("p11_validate_range", """
WITH f AS (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1)
SELECT o_orderkey, NOT ((year(o_orderdate), month(o_orderdate)) < (year(first_ship), month(first_ship))) AS valid
FROM orders JOIN f ON f.l_orderkey = o_orderkey
""")
def p11(spark, sf):
    li = derive.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    o = derive.table(spark, sf, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    r = o.select("o_orderkey", F.year("first_ship").alias("start_year"), F.month("first_ship").alias("start_month"),
                 F.year("o_orderdate").alias("end_year"), F.month("o_orderdate").alias("end_month"))
    return QL.validate_range(r).select("o_orderkey", "valid")


# profiles ---------------------------------------------------------------------
def _long_sql(src: str, dims: list[str], date_expr: str | None = None, default: str | None = None) -> str:
    parts = [f"SELECT 'total' AS dimension, NULL::VARCHAR AS key, count(*) AS count FROM {src}"]
    parts += [f"SELECT '{d}', CAST({d} AS VARCHAR), count(*) FROM {src} GROUP BY {d}" for d in dims]
    body = "\nUNION ALL\n".join(parts)
    if date_expr is None:
        return f"SELECT u.* FROM ({body}) u"
    lo = f"min({date_expr})" if default is None else f"COALESCE(min({date_expr}), '{default}')"
    hi = f"max({date_expr})" if default is None else f"COALESCE(max({date_expr}), '{default}')"
    return (f"SELECT u.*, CASE WHEN u.dimension = 'total' THEN r.min_date END AS min_date, "
            f"CASE WHEN u.dimension = 'total' THEN r.max_date END AS max_date "
            f"FROM ({body}) u, (SELECT {lo} AS min_date, {hi} AS max_date FROM {src}) r")


@query("a10_dataset_statistics", REQ + "\n" + _long_sql("strict", ["variable", "model"], "date"))
def a10(spark, sf):
    return PF.dataset_statistics(_strict(spark, sf))


@query("a11_weather_statistics", REQ + "\n" + _long_sql("req", ["variable", "model", "region", "season"],
                                                          "NULLIF(date, '')", "unknown"))
def a11(spark, sf):
    return PF.weather_statistics(_required(spark, sf))


@query("a12_generation_summary", S.SAMPLES + ",\ngm AS (SELECT 'temperature' AS variable, model, COALESCE(region, 'full_domain') AS region FROM samples)\n"
       + _long_sql("gm", ["variable", "model", "region"]))
def a12(spark, sf):
    s = G.caption_samples(derive.grid(spark, sf)).withColumn("variable", F.lit("temperature"))
    return PF.generation_summary(s)


@query("a13_generation_stats", S.SAMPLES + f""",
att AS (SELECT count(*) AS attempted FROM (SELECT DISTINCT valid_time FROM grid0), {S.PAIRS} p),
ok AS (SELECT count(*) AS successful FROM samples)
SELECT attempted, successful, attempted - successful AS failed,
       {S.R('CASE WHEN attempted > 0 THEN successful / attempted ELSE 0.0 END')} AS success_rate FROM att, ok
""")
def a13(spark, sf):
    g = derive.grid(spark, sf)
    dates = g.select(F.date_format("valid_time", "yyyy-MM-dd").alias("date")).distinct()
    return rounded(PF.generation_stats(G.request_work_list(dates, spark), G.caption_samples(g)))


# caption helpers on records -----------------------------------------------------
@query("c11_enhance_caption", REQ + """
SELECT sample_id, CASE WHEN length(e) > 160 THEN substring(e, 1, 157) || '...' ELSE e END AS enhanced FROM (
  SELECT sample_id, caption || ' Generated from ' || upper(model) || ' model during ' || season || ' season'
         || CASE WHEN trim(COALESCE(region, '')) <> '' AND trim(COALESCE(region, '')) <> 'Unknown'
                 THEN ' in the ' || trim(region) || ' region' ELSE '' END || '.' AS e
  FROM req)
""")
def c11(spark, sf):
    r = _required(spark, sf)
    return r.select("sample_id", C.enhance_caption("caption", "model", "season", "region", max_length=160).alias("enhanced"))


@query("c12_truncate_caption", S.EMB + """
SELECT sample_id, CASE WHEN length(caption) > 200 THEN substring(caption, 1, 197) || '...' ELSE caption END AS text FROM es
""")
def c12(spark, sf):
    s = derive.emb_samples(spark, sf)
    return s.select("sample_id", C.truncate_for_tokens(F.col("caption"), 50).alias("text"))


@query("c13_season_from_date", REQ + "\nSELECT sample_id, season FROM req")
def c13(spark, sf):
    r = _required(spark, sf)
    return r.select("sample_id", C.season_from_date(F.col("date")).alias("season"))


def _c14_sql() -> str:
    cap = "lower(caption)"
    kw = (f"CASE WHEN contains({cap}, 'winter') OR contains({cap}, 'cold') OR contains({cap}, 'snow') THEN 'winter' "
          f"WHEN contains({cap}, 'spring') OR contains({cap}, 'mild') THEN 'spring' "
          f"WHEN contains({cap}, 'summer') OR contains({cap}, 'hot') THEN 'summer' "
          f"WHEN contains({cap}, 'autumn') OR contains({cap}, 'fall') THEN 'autumn' END")
    m = "month(TRY_CAST(date AS DATE))"
    md = (f"CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring' "
          f"WHEN {m} IN (6, 7, 8) THEN 'summer' WHEN {m} IN (9, 10, 11) THEN 'autumn' END")
    meta = "CASE WHEN idx % 4 = 0 THEN NULL WHEN idx % 4 = 1 THEN 'Unknown' ELSE season END"
    return f"""
SELECT sample_id, COALESCE(CASE WHEN ({meta}) IS NOT NULL AND ({meta}) <> 'Unknown' THEN ({meta}) END, {kw}, {md}, 'unknown') AS season
FROM rl"""


@query("c14_season_fallback", RULES + _c14_sql())
def c14(spark, sf):
    s = derive.emb_samples(spark, sf)
    meta = F.when(F.col("idx") % 4 == 0, F.lit(None).cast("string")).when(F.col("idx") % 4 == 1, "Unknown").otherwise(F.col("season"))
    return s.select("sample_id", C.season_fallback(meta, F.col("caption"), F.col("date")).alias("season"))


@query("c15_weekly_mondays", S.GRID + """,
rg AS (SELECT min(valid_time) AS lo, max(valid_time) AS hi FROM grid0),
se AS (SELECT make_date(year(lo), month(lo), 1) AS s, last_day(make_date(year(hi), month(hi), 1)) AS e FROM rg)
SELECT strftime(d, '%Y-%m-%d') AS monday FROM se,
  unnest(generate_series(s + CAST((7 - (isodow(s) - 1)) % 7 AS INTEGER), e, INTERVAL 7 DAY)) t(d)
""")
def c15(spark, sf):
    g = derive.grid(spark, sf).agg(F.min("valid_time").alias("lo"), F.max("valid_time").alias("hi"))
    arr = C.weekly_mondays(F.year("lo"), F.month("lo"), F.year("hi"), F.month("hi"))
    return g.select(F.explode(arr).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("monday"))


# filters / vectors / limits -----------------------------------------------------
@query("p05_filter_variable", S.FIELD_STATS + """
SELECT region, count(*) AS fields FROM fstats WHERE variable = 'humidity' GROUP BY region
""")
def p05(spark, sf):
    s = G.field_statistics(derive.grid(spark, sf), with_mad=False).where(F.col("variable") == "humidity")
    return s.groupBy("region").agg(F.count(F.lit(1)).alias("fields"))


@query("p12_select_embedding", S.EMB + f"""
SELECT sample_id, CAST(len(list_concat(image_emb, text_emb)) AS BIGINT) AS dim,
       {S.R('list_sum(list_transform(list_concat(image_emb, text_emb), lambda x: x * x))')} AS sq_norm FROM es
""")
def p12(spark, sf):
    s = derive.emb_samples(spark, sf)
    v = select_embedding(F.col("image_emb"), F.col("text_emb"), "combined")
    return rounded(s.select("sample_id", F.size(v).cast("long").alias("dim"),
                            F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("sq_norm")))


@query("p13_l2_normalise", S.EMB + f""",
cv AS (SELECT sample_id, list_concat(image_emb, text_emb) AS v FROM es),
nv AS (SELECT sample_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM cv)
SELECT sample_id, {S.R('sqrt(list_sum(list_transform(u, lambda x: x * x)))')} AS norm, {S.R('u[1]')} AS first FROM nv
""")
def p13(spark, sf):
    s = derive.emb_samples(spark, sf)
    u = l2_normalise(select_embedding(F.col("image_emb"), F.col("text_emb"), "combined"))
    return rounded(s.select("sample_id", l2_norm(u).alias("norm"), F.get(u, 0).alias("first")))


@query("t02_limit_samples", S.EMB + "\nSELECT sample_id FROM es ORDER BY idx LIMIT 100")
def t02(spark, sf):
    return derive.emb_samples(spark, sf).orderBy("idx").limit(100).select("sample_id")


@query("t04_distinct_sorted", S.EMB_PARSED + "\nSELECT DISTINCT p_season AS season FROM ep ORDER BY 1")
def t04(spark, sf):
    s = derive.emb_samples(spark, sf)
    return s.select(P.extract_season(F.col("caption")).alias("season")).distinct().orderBy("season")
