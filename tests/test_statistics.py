"""Field statistics against numpy, with one field holding > 1/3 of all cells."""

import datetime as dt

import numpy as np
import pytest

from skycap.operators import grid as G


def test_hot_field_statistics(spark):
    rng = np.random.default_rng(7)
    t0, t1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)
    rows = []
    # hot field: 6000 temperature cells in the Northeast box (lon -80..-67, lat 39..47.5), some NaN
    for i in range(6000):
        v = float(rng.normal(280, 8)) if i % 50 else float("nan")
        rows.append(("hrrr", "conus", "temperature", "TMP", t0, 0, float(40 + (i % 70) / 10), float(-79 + (i % 120) / 10), v))
    # many small fields elsewhere
    for j in range(300):
        for i in range(20):
            rows.append(("hrrr", "conus", "wind_speed", "WIND", t1 + dt.timedelta(days=j), 0, 30.0 + i, -100.0 + i, float(i)))
    grid = spark.createDataFrame(rows, "model string, domain string, variable string, grib_name string, "
                                       "valid_time timestamp_ntz, forecast_hour int, lat double, lon double, raw_value double")
    from skycap.sources.grid import nan_to_null
    from pyspark.sql import functions as F
    grid = grid.withColumn("raw_value", nan_to_null(F.col("raw_value")))
    out = {r["region"]: r for r in G.field_statistics(grid).where("variable = 'temperature'").collect()}
    vals = np.array([r[-1] for r in rows[:6000] if not np.isnan(r[-1])]) - 273.15
    ne = out["Northeast"]
    assert ne["count_valid"] == len(vals) and ne["count_missing"] == 6000 - len(vals)
    assert ne["mean"] == pytest.approx(vals.mean(), abs=1e-9)
    assert ne["std"] == pytest.approx(vals.std(), abs=1e-9)
    for col, q in (("median", 50), ("percentile_25", 25), ("percentile_90", 90), ("percentile_95", 95)):
        assert ne[col] == pytest.approx(np.percentile(vals, q), abs=1e-9)
    assert ne["mad"] == pytest.approx(np.median(np.abs(vals - np.median(vals))), abs=1e-9)
    m2 = ((vals - vals.mean()) ** 2).mean()
    assert ne["skewness"] == pytest.approx(((vals - vals.mean()) ** 3).mean() / m2 ** 1.5, abs=1e-9)
    assert ne["kurtosis"] == pytest.approx(((vals - vals.mean()) ** 4).mean() / m2 ** 2 - 3, abs=1e-9)
    # the whole field equals the box here; a box with no cells keeps a row
    assert out["Continental US"]["count_valid"] == len(vals)
    assert out["South"]["count_valid"] == 0 and out["South"]["count_missing"] == 6000 and out["South"]["mean"] is None


def test_approx_percentiles_close_to_exact(spark, sf):
    from skycap.plans import derive
    g = derive.grid(spark, sf)
    key = ["variable", "valid_time", "forecast_hour", "region"]
    ex = {tuple(r[k] for k in key): r for r in G.field_statistics(g).where("count_valid >= 5").collect()}
    ap = {tuple(r[k] for k in key): r for r in G.field_statistics(g, percentiles="approx").where("count_valid >= 5").collect()}
    assert ex.keys() == ap.keys() and len(ex) > 0
    for k, e in ex.items():
        a = ap[k]
        spread = (e["max"] - e["min"]) or 1.0
        for col in ("median", "percentile_25", "percentile_75", "percentile_90", "mad"):
            # percentile_approx returns an observed value next to the exact (interpolated) one
            assert abs(a[col] - e[col]) <= spread * 0.5, (k, col)
        assert a["mean"] == pytest.approx(e["mean"])
