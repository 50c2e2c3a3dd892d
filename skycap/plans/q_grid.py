"""Registered queries over the derived grid: scans, projections, the region
range join, field statistics, variable combination and caption rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.functions import captions as C
from skycap.operators import grid as G
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.registry import query, rounded
from skycap.schemas import FIELD_KEYS
from skycap.sources import grid as SG


def _cells(spark, sf):
    return G.convert_units(G.wrap_longitude(derive.grid(spark, sf)), spark)


def _stats(spark, sf, with_mad=False):
    """Only queries that read the MAD pay for its second pass over the cells."""
    return G.field_statistics(derive.grid(spark, sf), with_mad=with_mad)


def _date(c="valid_time"):
    return F.date_format(c, "yyyy-MM-dd")


# s01 ----------------------------------------------------------------------
@query("s01_scan_grid", S.GRID + """
SELECT model, variable, strftime(valid_time, '%Y-%m-%d') AS valid_date, forecast_hour, lat, lon_raw AS lon,
       round(raw_value, 6) AS raw_value
FROM grid0
WHERE model = 'hrrr' AND variable = 'temperature' AND valid_time = TIMESTAMP '1996-03-01 00:00:00' AND forecast_hour = 0
""")
def s01(spark, sf):
    g = SG.select_field(derive.grid(spark, sf), "hrrr", "temperature", "1996-03-01", 0)
    return rounded(g.select("model", "variable", _date().alias("valid_date"), "forecast_hour", "lat", "lon", "raw_value"))


# s02 ----------------------------------------------------------------------
@query("s02_forecast_hour_rule", S.GRID + """,
req AS (SELECT DISTINCT variable, h AS requested_hour FROM grid0, (VALUES (0), (1)) t(h)),
rd AS (SELECT variable, requested_hour,
              CASE WHEN variable = 'precipitation' AND requested_hour = 0 THEN 1 ELSE requested_hour END AS read_hour
       FROM req)
SELECT rd.variable, CAST(rd.requested_hour AS BIGINT) AS requested_hour, CAST(rd.read_hour AS BIGINT) AS read_hour,
       count(g.variable) AS cells
FROM rd LEFT JOIN grid0 g ON g.variable = rd.variable AND g.forecast_hour = rd.read_hour
GROUP BY ALL
""")
def s02(spark, sf):
    g = derive.grid(spark, sf)
    req = g.select("variable").distinct().select("variable", F.explode(F.array(F.lit(0), F.lit(1))).alias("requested_hour"))
    req = req.withColumn("read_hour", SG.requested_forecast_hour(F.col("variable"), F.col("requested_hour")))
    counts = g.groupBy("variable", F.col("forecast_hour").alias("read_hour")).agg(F.count(F.lit(1)).alias("cells"))
    out = req.join(counts, ["variable", "read_hour"], "left").select(
        "variable", "requested_hour", "read_hour", F.coalesce("cells", F.lit(0)).alias("cells"))
    return rounded(out)


# s03 ----------------------------------------------------------------------
@query("s03_list_variables", S.GRID + """
SELECT variable, COALESCE(grib_name, 'unknown') AS level, count(*) AS cells FROM grid0 GROUP BY ALL
""")
def s03(spark, sf):
    inv = derive.grid(spark, sf).select("variable", F.coalesce("grib_name", F.lit("unknown")).alias("level"))
    return SG.list_variables(inv).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("cells"))


# p01 ----------------------------------------------------------------------
@query("p01_convert_units", S.CELLS + """
SELECT variable, unit, count(*) AS cells, count(value) AS valid,
       round(sum(raw_value), 6) AS sum_raw, round(sum(value), 6) AS sum_value,
       round(min(value), 6) AS min_value, round(max(value), 6) AS max_value
FROM cells GROUP BY ALL
""")
def p01(spark, sf):
    c = _cells(spark, sf)
    return rounded(c.groupBy("variable", "unit").agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"),
        F.sum("raw_value").alias("sum_raw"), F.sum("value").alias("sum_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value")))


# p02 ----------------------------------------------------------------------
@query("p02_wrap_longitude", S.CELLS + """
SELECT round(lon_raw, 6) AS lon_in, round(lon, 6) AS lon_out, count(*) AS cells FROM cells GROUP BY ALL
""")
def p02(spark, sf):
    g = derive.grid(spark, sf).withColumnRenamed("lon", "lon_in")
    out = G.wrap_longitude(g.withColumn("lon", F.col("lon_in")))
    return rounded(out.groupBy("lon_in", F.col("lon").alias("lon_out")).agg(F.count(F.lit(1)).alias("cells")))


# j02 / p03 ----------------------------------------------------------------
@query("j02_cell_region_range", S.TAGGED + """
SELECT region, count(*) AS cells, count(value) AS valid, round(sum(value), 6) AS sum_value
FROM tagged WHERE region <> '__field__' GROUP BY region
""")
def j02(spark, sf):
    c = _cells(spark, sf).select(*FIELD_KEYS, "lat", "lon", "value")
    t = G.tag_regions(c, spark).where(F.col("region") != G.WHOLE_FIELD)
    return rounded(t.groupBy("region").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"),
                                           F.sum("value").alias("sum_value")))


@query("p03_region_mask", S.FIELD_STATS + """
SELECT region, variable, strftime(valid_time, '%Y-%m-%d') AS valid_date, CAST(forecast_hour AS BIGINT) AS forecast_hour,
       count_valid, count_missing, count_valid + count_missing AS cells
FROM fstats
""")
def p03(spark, sf):
    s = _stats(spark, sf)
    return rounded(s.select("region", "variable", _date().alias("valid_date"), "forecast_hour", "count_valid",
                            "count_missing", (F.col("count_valid") + F.col("count_missing")).alias("cells")))


# p04 ----------------------------------------------------------------------
@query("p04_region_display_name", S.TAGGED + """,
r AS (SELECT DISTINCT CASE WHEN region = '__field__' THEN NULL ELSE region END AS region FROM tagged)
SELECT region,
       CASE WHEN COALESCE(region, 'Continental US') IN ('Alaska', 'Continental US') THEN COALESCE(region, 'Continental US')
            ELSE 'US ' || region || ' region' END AS display_name
FROM r
""")
def p04(spark, sf):
    c = _cells(spark, sf).select(*FIELD_KEYS, "lat", "lon", "value")
    r = G.tag_regions(c, spark).select(
        F.when(F.col("region") == G.WHOLE_FIELD, F.lit(None).cast("string")).otherwise(F.col("region")).alias("region")
    ).distinct()
    return r.select("region", G.region_display_name(F.col("region"), F.lit("Continental US")).alias("display_name"))


# j01 / p07 ----------------------------------------------------------------
@query("j01_request_cross", S.GRID + f"""
SELECT DISTINCT strftime(valid_time, '%Y-%m-%d') AS date, p.region, p.model, CAST(p.pair_seq AS BIGINT) AS pair_seq
FROM grid0, {S.PAIRS} p
""")
def j01(spark, sf):
    dates = derive.grid(spark, sf).select(_date().alias("date")).distinct()
    return rounded(G.request_work_list(dates, spark).select("date", "region", "model", "pair_seq"))


@query("p07_filter_region_pairs", S.GRID + f"""
SELECT DISTINCT strftime(valid_time, '%Y-%m-%d') AS date, p.region, p.model
FROM grid0, {S.PAIRS} p WHERE p.region IN ('Northeast', 'South', 'West')
""")
def p07(spark, sf):
    dates = derive.grid(spark, sf).select(_date().alias("date")).distinct()
    return G.request_work_list(dates, spark, regions=["Northeast", "South", "West"]).select("date", "region", "model")


@query("u01_union_all", S.TAGGED + """
SELECT CASE WHEN region = '__field__' THEN 'whole' ELSE 'box' END AS part, count(*) AS cells FROM tagged GROUP BY 1
""")
def u01(spark, sf):
    c = _cells(spark, sf).select(*FIELD_KEYS, "lat", "lon", "value")
    t = G.tag_regions_join(c, spark)  # the union of whole-field rows and in-box rows
    return t.groupBy(F.when(F.col("region") == G.WHOLE_FIELD, "whole").otherwise("box").alias("part")).agg(
        F.count(F.lit(1)).alias("cells"))


# a01-a09 ------------------------------------------------------------------
_KEYS_OUT = ["model", "variable", "valid_date", "forecast_hour", "region"]
_KEYS_SQL = "model, variable, strftime(valid_time, '%Y-%m-%d') AS valid_date, CAST(forecast_hour AS BIGINT) AS forecast_hour, region"


def _stat_query(key, cols):
    sql_cols = ", ".join(f"{S.R(c)} AS {c}" if c not in ("count_valid", "count_missing") else c for c in cols)

    @query(key, S.FIELD_STATS + f"\nSELECT {_KEYS_SQL}, {sql_cols} FROM fstats")
    def fn(spark, sf):
        s = _stats(spark, sf, "mad" in cols).withColumn("valid_date", _date())
        return rounded(s.select(*_KEYS_OUT, *cols))

    return fn


_stat_query("a01_min_max_mean_range", ["min", "max", "mean", "range"])
_stat_query("a02_std_var", ["std", "var"])
_stat_query("a03_median_percentiles_iqr", ["median", "percentile_25", "percentile_75", "percentile_90",
                                           "percentile_95", "iqr"])
_stat_query("a04_skewness", ["skewness"])
_stat_query("a05_kurtosis", ["kurtosis"])
_stat_query("a06_mad", ["mad"])
_stat_query("a07_coeff_variation", ["coeff_variation"])
_stat_query("a08_valid_missing_counts", ["count_valid", "count_missing"])

_ALL_STATS = G.STAT_COLUMNS + ["count_valid", "count_missing"]


@query("a09_field_statistics", S.FIELD_STATS + f"""
SELECT {_KEYS_SQL}, {", ".join(f"{S.R(c)} AS {c}" if not c.startswith("count") else c for c in _ALL_STATS)},
       unit, description, valid_time_str, model_upper, grib_name, domain
FROM fstats
""")
def a09(spark, sf):
    s = _stats(spark, sf, True).withColumn("valid_date", _date())
    return rounded(s.select(*_KEYS_OUT, *_ALL_STATS, "unit", "description", "valid_time_str", "model_upper",
                            "grib_name", "domain"))


_QUANTILE_STATS = ["median", "percentile_25", "percentile_75", "percentile_90", "percentile_95", "iqr", "mad", "count_valid"]


@query("a03_quantiles_by_selection", S.FIELD_STATS + f"""
SELECT {_KEYS_SQL}, {", ".join(f"{S.R(c)} AS {c}" if not c.startswith("count") else c for c in _QUANTILE_STATS)} FROM fstats
""")
def a03_selection(spark, sf):
    s = G.field_statistics(derive.grid(spark, sf), percentiles="selection").withColumn("valid_date", _date())
    return rounded(s.select(*_KEYS_OUT, *_QUANTILE_STATS))


# j03 ----------------------------------------------------------------------
@query("j03_primary_additional", S.COMBINED + """
SELECT strftime(valid_time, '%Y-%m-%d') AS date, model, region,
       round(t_mean, 6) AS temperature_mean, round(w_mean, 6) AS wind_speed_mean,
       round(p_mean, 6) AS precipitation_mean, round(h_mean, 6) AS humidity_mean
FROM combined
""")
def j03(spark, sf):
    comb = G.combine_variables(_stats(spark, sf), 0)
    return rounded(comb.select(
        _date().alias("date"), "model", "region",
        F.col("temperature.mean").alias("temperature_mean"), F.col("wind_speed.mean").alias("wind_speed_mean"),
        F.col("precipitation.mean").alias("precipitation_mean"), F.col("humidity.mean").alias("humidity_mean")))


# c01 / c02 / c16 ----------------------------------------------------------
@query("c16_valid_time_format", S.GRID + """
SELECT DISTINCT strftime(valid_time, '%Y-%m-%d') AS valid_date, strftime(valid_time, '%H:%M UTC %d %b %Y') AS valid_time_str
FROM grid0
""")
def c16(spark, sf):
    g = derive.grid(spark, sf).select("valid_time").distinct()
    return g.select(_date().alias("valid_date"), C.valid_time_string(F.col("valid_time")).alias("valid_time_str"))


@query("c01_format_date", S.GRID + """
SELECT DISTINCT strftime(valid_time, '%H:%M UTC %d %b %Y') AS valid_time_str, strftime(valid_time, '%d %b %Y') AS date_text
FROM grid0
""")
def c01(spark, sf):
    g = derive.grid(spark, sf).select(C.valid_time_string(F.col("valid_time")).alias("valid_time_str")).distinct()
    return g.select("valid_time_str", C.format_date(F.col("valid_time_str")).alias("date_text"))


@query("c02_season_descriptor", S.GRID + f"""
SELECT DISTINCT strftime(valid_time, '%Y-%m-%d') AS valid_date, {S.season_descriptor('month(valid_time)')} AS season,
       'mid winter' AS legacy_season
FROM grid0
""")
def c02(spark, sf):
    g = derive.grid(spark, sf).select("valid_time").distinct()
    vt = C.valid_time_string(F.col("valid_time"))
    return g.select(_date().alias("valid_date"), C.season_descriptor(vt, ts=F.col("valid_time")).alias("season"),
                    C.season_descriptor(vt, legacy=True).alias("legacy_season"))


# c03 / c04 ----------------------------------------------------------------
@query("c03_region_descriptor", S.FIELD_STATS + f"""
SELECT DISTINCT region, {S.region_descriptor('region')} AS descriptor FROM fstats
""")
def c03(spark, sf):
    s = _stats(spark, sf).select("region").distinct()
    return s.select("region", C.region_descriptor(F.col("region")).alias("descriptor"))


@query("c04_opening", S.FIELD_STATS + f"""
SELECT DISTINCT region, strftime(valid_time, '%Y-%m-%d') AS valid_date,
       {S.opening('region', 'month(valid_time)', "strftime(valid_time, '%d %b %Y')")} AS opening
FROM fstats
""")
def c04(spark, sf):
    s = _stats(spark, sf).select("region", "valid_time").distinct()
    vt = C.valid_time_string(F.col("valid_time"))
    return s.select("region", _date().alias("valid_date"),
                    C.opening(F.col("region"), C.season_descriptor(vt, ts=F.col("valid_time")), C.format_date(vt)).alias("opening"))


# c05-c09 ------------------------------------------------------------------
def _describe_query(key, variable, simple_sql, detailed_sql, simple_col, detailed_col):
    @query(key, S.FIELD_STATS + f"""
SELECT {_KEYS_SQL}, {simple_sql} AS simple_text, {detailed_sql} AS detailed_text
FROM fstats WHERE variable = '{variable}' AND count_valid > 0
""")
    def fn(spark, sf):
        s = _stats(spark, sf).where((F.col("variable") == variable) & (F.col("count_valid") > 0))
        s = s.withColumn("valid_date", _date())
        return rounded(s.select(*_KEYS_OUT, simple_col().alias("simple_text"), detailed_col().alias("detailed_text")))

    return fn


_describe_query("c05_describe_temperature", "temperature",
                S.temp_simple("mean", "unit"), S.temp_detailed("mean", "min", "max", "unit"),
                lambda: C.describe_temperature("mean", "min", "max", "unit"),
                lambda: C.describe_temperature("mean", "min", "max", "unit", detailed=True))
_describe_query("c06_describe_wind", "wind_speed",
                S.wind_simple("mean", "unit"), S.wind_detailed("mean", "max", "unit"),
                lambda: C.describe_wind("mean", "max", "unit"),
                lambda: C.describe_wind("mean", "max", "unit", detailed=True))
_describe_query("c07_describe_precipitation", "precipitation",
                S.precip_simple("mean"), S.precip_detailed("mean", "max", "unit"),
                lambda: C.describe_precipitation("mean", "max", "unit"),
                lambda: C.describe_precipitation("mean", "max", "unit", detailed=True))
_describe_query("c08_describe_humidity", "humidity",
                S.humidity_simple("mean", "unit"), S.humidity_detailed("mean", "min", "max", "unit"),
                lambda: C.describe_humidity("mean", "min", "max", "unit"),
                lambda: C.describe_humidity("mean", "min", "max", "unit", detailed=True))


@query("c09_describe_variable", S.FIELD_STATS + f"""
SELECT {_KEYS_SQL},
  CASE variable WHEN 'wind_speed' THEN {S.wind_simple('mean', 'unit')}
                WHEN 'precipitation' THEN {S.precip_simple('mean')}
                WHEN 'humidity' THEN {S.humidity_simple('mean', 'unit')} ELSE '' END AS text
FROM fstats WHERE count_valid > 0
""")
def c09(spark, sf):
    s = _stats(spark, sf).where(F.col("count_valid") > 0).withColumn("valid_date", _date())
    return rounded(s.select(*_KEYS_OUT, C.describe_variable("variable", "mean", "min", "max", "unit").alias("text")))


# c10 / p08 (flagship) -----------------------------------------------------
@query("c10_generate_caption", S.SAMPLES + "\nSELECT sample_id, date, model, region, domain, caption FROM samples")
def c10(spark, sf):
    return G.caption_samples(derive.grid(spark, sf))


@query("p08_sample_identity", S.SAMPLES + """
SELECT sample_id, sample_id || '.png' AS image_filename, sample_id || '.txt' AS caption_filename FROM samples
""")
def p08(spark, sf):
    s = G.caption_samples(derive.grid(spark, sf))
    return s.select("sample_id", F.concat("sample_id", F.lit(".png")).alias("image_filename"),
                    F.concat("sample_id", F.lit(".txt")).alias("caption_filename"))
