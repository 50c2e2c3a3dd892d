"""Domain tables derived from the driver's TPC-H-like tables.

Each derivation is a plain projection (no shuffle) written with explicit
double literals so the DuckDB oracle computes bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.sources.grid import nan_to_null


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Grid from lineitem: one cell per line item.
#   variable by l_linenumber % 4 (1 temperature, 2 wind, 3 precipitation, 0 humidity)
#   lat 24.0 .. 49.9, lon -130.0 .. -64.1 (a third stored as 0-360)
#   valid_time = month of l_shipdate, forecast_hour = l_suppkey % 2
# ---------------------------------------------------------------------------
def grid_from_lineitem(lineitem: DataFrame) -> DataFrame:
    ln = F.col("l_linenumber") % 4
    variable = (F.when(ln == 1, "temperature").when(ln == 2, "wind_speed")
                .when(ln == 3, "precipitation").otherwise("humidity"))
    grib = (F.when(ln == 1, "TMP:2 m above ground").when(ln == 2, "WIND:10 m above ground")
            .when(ln == 3, "APCP:surface"))
    lat_step = (F.col("l_orderkey") % 260).cast("double")
    lat = F.lit(24.0) + lat_step / F.lit(10.0)
    lon0 = F.lit(-130.0) + ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 660).cast("double") / F.lit(10.0)
    lon = F.when(F.col("l_orderkey") % 3 == 0, lon0 + F.lit(360.0)).otherwise(lon0)
    q = F.col("l_quantity")
    price = F.col("l_extendedprice")
    raw = (F.when(ln == 1, (((F.lit(303.0) - lat_step * F.lit(0.12)) + q * F.lit(0.2)) - F.lit(5.0)) + price % F.lit(3.0))
           .when(ln == 2, q * F.col("l_discount") * F.lit(4.0) + price % F.lit(2.0))
           .when(ln == 3, F.col("l_discount") * F.col("l_tax") * F.lit(60.0) + (price % F.lit(1.0)) * F.lit(0.01))
           .otherwise(F.when(q > 48.0, F.lit(float("nan"))).otherwise(price % F.lit(97.0))))
    return lineitem.select(
        F.lit("hrrr").alias("model"),
        F.lit("conus").alias("domain"),
        variable.alias("variable"),
        grib.alias("grib_name"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("valid_time"),
        (F.col("l_suppkey") % 2).cast("int").alias("forecast_hour"),
        lat.alias("lat"),
        lon.alias("lon"),
        raw.alias("raw_value"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived grid with the scan-time NaN -> NULL rule applied."""
    g = grid_from_lineitem(table(spark, sf_dir, "lineitem"))
    return g.withColumn("raw_value", nan_to_null(F.col("raw_value")))


# ---------------------------------------------------------------------------
# Embedding evaluation set from `embeddings`: one sample per vector.
#   image_emb = embedding; text_emb = normalise(e[j] + 0.3 * e[(j+1) mod d])
#   metadata and caption are rendered from the vector's own components, so
#   parse-based relevance is a function of the data.
# ---------------------------------------------------------------------------
def _comp(i: int):
    return F.get(F.col("embedding"), i).cast("double")


def emb_sample_fields(embeddings: DataFrame) -> DataFrame:
    from skycap.schemas import REGION_NAMES

    region = F.element_at(F.array(*[F.lit(r) for r in REGION_NAMES]), (F.col("label") % 10 + 1).cast("int"))
    v = F.col("vec_id")
    date = F.make_date((F.lit(2019) + v % 6).cast("int"), (F.lit(1) + v % 12).cast("int"), (F.lit(1) + v % 28).cast("int"))
    t_mean = _comp(0) * F.lit(100.0) + F.lit(12.0)
    w_mean = F.abs(_comp(3)) * F.lit(150.0)
    p_mean = F.abs(_comp(4)) * F.lit(2.0)
    h_mean = F.least(F.abs(_comp(5)) * F.lit(300.0), F.lit(100.0))
    return embeddings.select(
        v.alias("idx"),
        F.concat(F.lit("sample_"), v.cast("string")).alias("sample_id"),
        "label", "embedding",
        region.alias("region"),
        F.when(region == "Alaska", F.lit("hrrrak")).otherwise(F.lit("hrrr")).alias("model"),
        date.alias("date"),
        t_mean.alias("t_mean"),
        (t_mean - (F.lit(5.0) + F.abs(_comp(1)) * F.lit(20.0))).alias("t_min"),
        (t_mean + (F.lit(5.0) + F.abs(_comp(2)) * F.lit(20.0))).alias("t_max"),
        F.when(v % 7 != 6, w_mean).alias("w_mean"),
        F.when(v % 7 != 6, w_mean + F.abs(_comp(6)) * F.lit(40.0)).alias("w_max"),
        p_mean.alias("p_mean"),
        (p_mean + F.abs(_comp(7)) * F.lit(3.0)).alias("p_max"),
        F.when(v % 5 != 4, h_mean).alias("h_mean"),
        F.when(v % 5 != 4, h_mean * F.lit(0.5)).alias("h_min"),
        F.when(v % 5 != 4, F.least(h_mean * F.lit(1.5), F.lit(100.0))).alias("h_max"),
        (v % 3 == 0).alias("detailed"),
    )


def emb_caption(detailed_col=None):
    from skycap.functions import captions as C

    def part(simple, detailed):
        return F.when(F.col("detailed"), detailed).otherwise(simple)

    op = C.opening(F.col("region"), C.season_descriptor_from_month(F.month("date")),
                   F.date_format("date", "dd MMM yyyy"))
    temp = part(C.describe_temperature("t_mean", "t_min", "t_max", F.lit("°C")),
                C.describe_temperature("t_mean", "t_min", "t_max", F.lit("°C"), detailed=True))
    wind = F.when(F.col("w_mean").isNotNull(), part(C.describe_wind("w_mean", "w_max", F.lit("km/h")),
                                                    C.describe_wind("w_mean", "w_max", F.lit("km/h"), detailed=True)))
    prec = part(C.describe_precipitation("p_mean", "p_max", F.lit("mm")),
                C.describe_precipitation("p_mean", "p_max", F.lit("mm"), detailed=True))
    hum = F.when(F.col("h_mean").isNotNull(), part(C.describe_humidity("h_mean", "h_min", "h_max", F.lit("%")),
                                                   C.describe_humidity("h_mean", "h_min", "h_max", F.lit("%"), detailed=True)))
    return C.generate_caption(op, temp, wind, prec, hum)


def emb_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding set: idx, sample_id, label, image_emb, text_emb, caption and
    sample metadata (date string, model, region, season)."""
    from skycap.functions import captions as C
    from skycap.functions.vectors import l2_normalise, shifted_mix

    f = emb_sample_fields(table(spark, sf_dir, "embeddings"))
    return f.select(
        "idx", "sample_id", "label",
        F.col("embedding").alias("image_emb"),
        l2_normalise(shifted_mix(F.col("embedding"), 0.3)).alias("text_emb"),
        emb_caption().alias("caption"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "model", "region",
        C.season_from_date(F.date_format("date", "yyyy-MM-dd")).alias("season"),
        "t_mean", "w_mean", "h_mean", "p_mean",
    )


# ---------------------------------------------------------------------------
# Storm events from `orders`: every order, dated +24 years
# (2019-2025).  Regions: one or two of the 11 storm regions (or an unmapped
# name); file order = order key.
# ---------------------------------------------------------------------------
def storms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.schemas import CONUS, REGION_NAMES

    names = F.array(*[F.lit(r) for r in REGION_NAMES + [CONUS]])
    o = table(spark, sf_dir, "orders")
    ck = F.col("o_custkey")
    r1 = F.element_at(names, (ck % 11 + 1).cast("int"))
    r2 = F.element_at(names, (F.floor(ck / 4) % 11 + 1).cast("int"))
    regions = F.when(ck % 13 == 0, F.lit("Gulf Coast")).when(ck % 4 == 0, F.concat(r1, F.lit(", "), r2)).otherwise(r1)
    d = F.to_date("o_orderdate")
    start = F.make_date(F.year(d) + 24, F.month(d), F.dayofmonth(d))
    end = F.date_add(start, (F.col("o_orderkey") % 7).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Storm "), F.col("o_orderkey").cast("string")).alias("Hurricane"),
        regions.alias("Regions"),
        F.date_format(start, "MMM d, yyyy").alias("Start Date"),
        F.date_format(end, "MMM d, yyyy").alias("End Date"),
    )


def probe_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_samples(spark, sf_dir)


# ---------------------------------------------------------------------------
# Training-record JSONL lines from the embedding set, with defects by index:
#   idx % 17 == 3 malformed JSON      idx % 19 == 5 missing "date"
#   idx % 23 == 7 extra key           idx % 29 == 11 "date": null
#   idx % 13 == 6 metadata w/o region idx % 7 == 2 caption padded with spaces
#   idx % 9 == 8 bare file name       idx % 11 == 4 image file missing
# ---------------------------------------------------------------------------
GENERATION_TIME = "2024-01-01T00:00:00"


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = emb_samples(spark, sf_dir)
    i = F.col("idx")
    cap = F.when(i % 7 == 2, F.concat(F.lit("  "), F.col("caption"), F.lit(" "))).otherwise(F.col("caption"))
    img = F.when(i % 9 == 8, F.concat("sample_id", F.lit(".png"))).otherwise(F.concat(F.lit("images/"), "sample_id", F.lit(".png")))
    domain = F.when(F.col("model") == "hrrrak", F.lit("alaska")).otherwise(F.lit("conus"))
    return s.select("idx", "sample_id", "caption", "date", "model", "region", "season",
                    cap.alias("caption_out"), img.alias("image_path"), domain.alias("domain"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = record_fields(spark, sf_dir)
    i = F.col("idx")
    domain = F.col("domain")
    meta_full = F.struct(F.col("region").alias("region"), domain.alias("domain"), F.lit(GENERATION_TIME).alias("generation_time"))
    meta_noreg = F.struct(domain.alias("domain"), F.lit(GENERATION_TIME).alias("generation_time"))
    opts = {"ignoreNullFields": "false"}

    def js(meta, *, date=True, extra=False):
        cols = [F.col("image_path"), F.col("caption_out").alias("caption"), F.col("sample_id"),
                F.lit("temperature").alias("variable"), F.col("model")]
        if date:
            cols.append(F.when(i % 29 == 11, F.lit(None).cast("string")).otherwise(F.col("date")).alias("date"))
        cols.append(meta.alias("metadata"))
        if extra:
            cols.append(F.lit(1).alias("quality"))
        return F.to_json(F.struct(*cols), opts)

    full = F.when(i % 13 == 6, js(meta_noreg)).otherwise(js(meta_full))
    missing = F.when(i % 13 == 6, js(meta_noreg, date=False)).otherwise(js(meta_full, date=False))
    extra = F.when(i % 13 == 6, js(meta_noreg, extra=True)).otherwise(js(meta_full, extra=True))
    value = (F.when(i % 17 == 3, F.expr("substring(_full, 1, length(_full) - 2)"))
             .when(i % 19 == 5, missing).when(i % 23 == 7, extra).otherwise(full))
    return f.withColumn("_full", full).select("idx", "sample_id", value.alias("value"))


def image_listing(spark: SparkSession, sf_dir: str, base_dir: str) -> DataFrame:
    """Paths of the image files that exist: every sample but idx % 11 == 4."""
    s = emb_samples(spark, sf_dir).where(F.col("idx") % 11 != 4)
    return s.select(F.concat(F.lit(base_dir.rstrip("/") + "/images/"), "sample_id", F.lit(".png")).alias("path"))
