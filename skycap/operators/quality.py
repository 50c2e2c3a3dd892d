"""Validation as data (p09-p11): each rule is a boolean column and failures
are collected into a ``reasons`` array, so bad rows can be reported or
filtered instead of raising one at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    arr = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks])
    return F.filter(arr, lambda x: x.isNotNull())


def validate_bounds(df: DataFrame, lon0="lon0", lon1="lon1", lat0="lat0", lat1="lat1", strict: bool = False) -> DataFrame:
    """p09: lon0 < lon1, lat0 < lat1, latitudes within +-90, longitudes within
    +-180.  ``strict=True`` fails the job on the first invalid row."""
    c = F.col
    checks = [
        (c(lon0) < c(lon1), "lon_min_not_below_lon_max"),
        (c(lat0) < c(lat1), "lat_min_not_below_lat_max"),
        (c(lat0).between(-90, 90) & c(lat1).between(-90, 90), "latitude_out_of_range"),
        (c(lon0).between(-180, 180) & c(lon1).between(-180, 180), "longitude_out_of_range"),
    ]
    out = df.withColumn("reasons", _reasons(checks)).withColumn("valid", F.size("reasons") == 0)
    if strict:
        out = out.withColumn("valid", F.when(~F.col("valid"), F.raise_error(
            F.concat(F.lit("invalid bounds: "), F.array_join("reasons", ", ")))).otherwise(F.lit(True)))
    return out


def validate_statistics(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """p10: non-negative spread measures and counts, required fields present."""
    c = F.col
    required = required or ["min", "max", "mean", "std", "median", "variable", "unit", "valid_time_str"]
    checks = [(c(x) >= 0, f"{x}_negative") for x in ("std", "mad", "coeff_variation", "count_valid",
                                                       "count_missing", "forecast_hour")]
    checks += [(c(x).isNotNull(), f"{x}_missing") for x in required]
    return df.withColumn("reasons", _reasons(checks)).withColumn("valid", F.size("reasons") == 0)


def validate_range(df: DataFrame, sy="start_year", sm="start_month", ey="end_year", em="end_month",
                   strict: bool = False) -> DataFrame:
    """p11: the end (year, month) must not come before the start."""
    bad = F.struct(F.col(ey), F.col(em)) < F.struct(F.col(sy), F.col(sm))
    out = df.withColumn("valid", ~bad)
    if strict:
        out = out.withColumn("valid", F.when(bad, F.raise_error(F.lit("end date before start date"))).otherwise(F.lit(True)))
    return out
