"""Grid tables (s01-s03).

A grid is stored long-form, one row per cell, ideally partitioned on disk by
``model, variable, valid_date`` so that a field request prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.schemas import GRID_SCHEMA, MODELS


def nan_to_null(c: Column) -> Column:
    """Spark treats NaN as a value (avg/max/percentile return NaN); missing
    cells must be NULL so aggregates skip them."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Scan a long-form grid with a fixed schema; NaN cells become NULL."""
    df = spark.read.schema(GRID_SCHEMA).parquet(path)
    return df.withColumn("raw_value", nan_to_null(F.col("raw_value")))


def check_model(model: str) -> str:
    names = [m[0] for m in MODELS]
    if model not in names:
        raise ValueError(f"Unknown model '{model}'. Available models: {', '.join(names)}")
    return model


def select_field(grid: DataFrame, model: str, variable: str, valid_date: str, forecast_hour: int = 0) -> DataFrame:
    """s01: the cells of one field.  All predicates are simple comparisons so
    they reach the Parquet scan (partition pruning / row-group skipping)."""
    check_model(model)
    fxx = requested_forecast_hour_value(variable, forecast_hour)
    day = F.lit(valid_date).cast("date")
    start = day.cast("timestamp_ntz")
    end = F.date_add(day, 1).cast("timestamp_ntz")
    # half-open range on the raw column (not to_date(col) = d) so Parquet can
    # push it down and skip row groups
    return grid.where(
        (F.col("model") == model)
        & (F.col("variable") == variable)
        & (F.col("valid_time") >= start) & (F.col("valid_time") < end)
        & (F.col("forecast_hour") == fxx)
    )


def requested_forecast_hour_value(variable: str, forecast_hour: int) -> int:
    return 1 if (variable == "precipitation" and forecast_hour == 0) else forecast_hour


def requested_forecast_hour(variable: Column, forecast_hour: Column) -> Column:
    """s02: accumulations do not exist at hour 0, so precipitation requested at
    hour 0 is read at hour 1."""
    return F.when((variable == "precipitation") & (forecast_hour == 0), F.lit(1)).otherwise(forecast_hour)


def list_variables(inventory: DataFrame, *, distinct: bool = False) -> DataFrame:
    """s03: variable names of an inventory table (file order, duplicates kept
    unless ``distinct``)."""
    out = inventory.select("variable", "level")
    return out.distinct() if distinct else out
