"""Schemas and the small fixed dimension tables.

The dimension tables are tiny and fixed (10 regions, 4 variables, 2 models,
11 region/model pairs), so joining them with ``broadcast`` is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Regions: name, lon_min, lon_max, lat_min, lat_max, description (dict order).
REGIONS = [
    ("Alaska", -180.0, -130.0, 55.0, 68.0, "Alaska region"),
    ("Northeast", -80.0, -67.0, 39.0, 47.5, "Northeastern United States"),
    ("Northern Rockies and Plains", -114.5, -96.0, 41.0, 49.5, "Northern Rockies and Plains region"),
    ("Northwest", -128.0, -112.0, 41.5, 49.0, "Pacific Northwest"),
    ("Ohio Valley", -95.5, -78.5, 35.0, 41.5, "Ohio River Valley"),
    ("South", -106.0, -88.5, 25.0, 40.0, "South Central United States"),
    ("Southeast", -88.0, -75.0, 25.0, 39.0, "Southeastern United States"),
    ("Southwest", -115.0, -102.0, 31.5, 42.0, "Southwestern United States"),
    ("Upper Midwest", -97.5, -82.5, 40.0, 48.5, "Upper Midwest"),
    ("West", -125.0, -113.5, 32.5, 42.0, "Western United States"),
]
REGION_NAMES = [r[0] for r in REGIONS]
CONUS = "Continental US"

# Models: name, product, domain, default_region, available_regions, map_resolution.
MODELS = [
    ("hrrr", "sfc", "conus", "Continental US",
     ["Northeast", "Upper Midwest", "Ohio Valley", "Southeast", "Northern Rockies and Plains",
      "South", "Southwest", "Northwest", "West"], "10m"),
    ("hrrrak", "sfc", "alaska", "Alaska", ["Alaska"], "50m"),
]

# Variables: variable, search_string, unit, description, conversion_factor, conversion_offset.
VARIABLES = [
    ("temperature", "TMP:2 m above", "°C", "2-meter temperature", None, -273.15),
    ("wind_speed", "WIND:10 m above", "km/h", "10-meter wind speed", 3.6, None),
    ("precipitation", "APCP:surface", "mm", "accumulated precipitation", 1.0, 0.0),
    ("humidity", "RH:2 m above", "%", "2-meter relative humidity", 1.0, None),
]
VARIABLE_NAMES = [v[0] for v in VARIABLES]
PRIMARY_VARIABLE = "temperature"
ADDITIONAL_VARIABLES = ["wind_speed", "precipitation", "humidity"]

# Fixed region/model combinations of the dataset build, in order.
REGION_MODEL_PAIRS = [
    ("Continental US", "hrrr"),
    ("Alaska", "hrrrak"),
    ("Northeast", "hrrr"),
    ("Northern Rockies and Plains", "hrrr"),
    ("Northwest", "hrrr"),
    ("Ohio Valley", "hrrr"),
    ("South", "hrrr"),
    ("Southeast", "hrrr"),
    ("Southwest", "hrrr"),
    ("Upper Midwest", "hrrr"),
    ("West", "hrrr"),
]
# ---------------------------------------------------------------------------

REGION_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("lon0", T.DoubleType(), False),
    T.StructField("lon1", T.DoubleType(), False),
    T.StructField("lat0", T.DoubleType(), False),
    T.StructField("lat1", T.DoubleType(), False),
    T.StructField("description", T.StringType(), False),
])

VARIABLE_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType(), False),
    T.StructField("search_string", T.StringType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("conversion_factor", T.DoubleType(), True),
    T.StructField("conversion_offset", T.DoubleType(), True),
])

MODEL_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("product", T.StringType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("default_region", T.StringType(), False),
    T.StructField("available_regions", T.ArrayType(T.StringType(), False), False),
    T.StructField("map_resolution", T.StringType(), False),
])

PAIR_SCHEMA = T.StructType([
    T.StructField("pair_seq", T.IntegerType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("model", T.StringType(), False),
])

# Long-form grid: one row per cell of one field.
GRID_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("domain", T.StringType(), True),
    T.StructField("variable", T.StringType(), False),
    T.StructField("grib_name", T.StringType(), True),
    T.StructField("valid_time", T.TimestampNTZType(), False),
    T.StructField("forecast_hour", T.IntegerType(), False),
    T.StructField("lat", T.DoubleType(), False),
    T.StructField("lon", T.DoubleType(), False),
    T.StructField("raw_value", T.DoubleType(), True),
])

# A field is one (model, variable, valid time, forecast hour) grid.
FIELD_KEYS = ["model", "variable", "valid_time", "forecast_hour"]

# Training record written to / read from JSONL.
RECORD_METADATA_SCHEMA = T.StructType([
    T.StructField("region", T.StringType(), True),
    T.StructField("domain", T.StringType(), True),
    T.StructField("generation_time", T.StringType(), True),
])
RECORD_SCHEMA = T.StructType([
    T.StructField("image_path", T.StringType(), True),
    T.StructField("caption", T.StringType(), True),
    T.StructField("sample_id", T.StringType(), True),
    T.StructField("variable", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("date", T.StringType(), True),
    T.StructField("metadata", RECORD_METADATA_SCHEMA, True),
])
RECORD_KEYS = ["image_path", "caption", "sample_id", "variable", "model", "date", "metadata"]

# Storm events CSV.
EVENT_CSV_SCHEMA = T.StructType([
    T.StructField("Hurricane", T.StringType(), True),
    T.StructField("Regions", T.StringType(), True),
    T.StructField("Start Date", T.StringType(), True),
    T.StructField("End Date", T.StringType(), True),
])

# Epoch log CSV.
EPOCH_LOG_SCHEMA = T.StructType([
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("train_loss", T.DoubleType(), True),
    T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("val_accuracy", T.DoubleType(), True),
])


def region_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, REGION_SCHEMA)


def variable_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIABLES, VARIABLE_SCHEMA)
