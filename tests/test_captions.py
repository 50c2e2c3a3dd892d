"""Caption rendering: exact strings (fixture statistics as in the reference tests)."""

from pyspark.sql import functions as F

from skycap.functions import captions as C


def _one(spark, col, **values):
    cols = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], cols)
    return df.select(col.alias("x")).first()["x"]


def test_temperature_classes(spark):
    for mean, expected in [(5.0, "Cold temperatures averaging 5.0°C"), (30.0, "Hot temperatures averaging 30.0°C"),
                           (15.0, "Mild temperatures averaging 15.0°C"), (10.0, "Cold temperatures averaging 10.0°C"),
                           (25.0, "Hot temperatures averaging 25.0°C")]:
        assert _one(spark, C.describe_temperature("mean", "mn", "mx", "unit"), mean=mean, mn=5.0, mx=25.0, unit="°C") == expected


def test_temperature_detailed(spark):
    out = _one(spark, C.describe_temperature("mean", "mn", "mx", "unit", detailed=True), mean=15.0, mn=5.0, mx=25.0, unit="°C")
    assert out == "Temperature ranges from 5°C to 25°C across the region with mild conditions averaging 15°C"


def test_wind_quirks(spark):
    cases = [(0.0, "Calm and no winds"), (8.0, "Light breeze averaging 8.0 km/h"), (30.0, "Fresh breeze averaging 30.0 km/h"),
             (70.0, "Gale winds averaging 70.0 km/h"), (120.0, "Hurricane averaging 120.0 km/h ")]
    for mean, expected in cases:
        assert _one(spark, C.describe_wind("mean", "mx", "unit"), mean=mean, mx=40.0, unit="km/h") == expected


def test_precipitation_and_humidity(spark):
    for mean, expected in [(0.05, "low precipitation"), (0.2, "moderate precipitation"), (0.5, "heavy precipitation")]:
        assert _one(spark, C.describe_precipitation("mean", "mx", "unit"), mean=mean, mx=1.0, unit="mm") == expected
    for mean, expected in [(25.0, "low humidity (25.0%)"), (45.0, "moderate humidity (45.0%)"), (75.0, "high humidity (75.0%)"),
                           (30.0, "moderate humidity (30.0%)"), (60.0, "high humidity (60.0%)")]:
        assert _one(spark, C.describe_humidity("mean", "mn", "mx", "unit"), mean=mean, mn=10.0, mx=90.0, unit="%") == expected
    scattered = _one(spark, C.describe_precipitation("mean", "mx", "unit", detailed=True), mean=0.05, mx=0.5, unit="mm")
    assert scattered == "Precipitation shows scattered activity with accumulations up to 0.5mm in some areas"


def test_number_format_matches_python(spark):
    vals = [2.25, 0.35, -0.04, 1.05, 2.675, 15.0, 0.15, 1234.56, -7.25, 99.95]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(C.fmt1("v")).collect()]
    assert got == [f"{v:.1f}" for v in vals]
    got0 = [r[0] for r in df.select(C.fmt0("v")).collect()]
    assert got0 == [f"{v:.0f}" for v in vals]


def test_whole_caption_legacy_string_rule(spark):
    vt = "Mon Apr 15 12:00:00 2019 UTC"
    df = spark.createDataFrame([(vt, "Continental US", 15.0)], "vt string, region string, mean double")
    season = C.season_descriptor(F.col("vt"), legacy=True)
    cap = C.generate_caption(C.opening(F.col("region"), season, C.format_date(F.col("vt"))),
                             C.describe_temperature("mean", "mean", "mean", F.lit("°C")))
    assert df.select(cap).first()[0] == "Continental US, mid spring, 15 12:00:00 2019. Mild temperatures averaging 15.0°C."


def test_invalid_valid_time(spark):
    df = spark.createDataFrame([("invalid",)], "vt string")
    row = df.select(C.format_date(F.col("vt")), C.season_descriptor(F.col("vt"), legacy=True)).first()
    assert row[0] == "unknown date" and row[1] == "early summer"


def test_region_descriptors(spark):
    df = spark.createDataFrame([("Northeast",), ("Ohio Valley",), ("Gulf",), ("",), ("Alaska",)], "r string")
    out = [r[0] for r in df.select(C.opening(F.col("r"), F.lit("mid winter"), F.lit("01 Jan 2020"))).collect()]
    assert out == ["Northeastern US, mid winter, 01 Jan 2020", "Ohio River Valley, mid winter, 01 Jan 2020",
                   "Gulf region, mid winter, 01 Jan 2020", "Continental US, mid winter, 01 Jan 2020",
                   "Alaska, mid winter, 01 Jan 2020"]


def test_enhance_and_truncate(spark):
    df = spark.createDataFrame([("Cap.", "hrrr", "spring", " Northeast "), ("x" * 400, "hrrrak", "fall", "Unknown")],
                               "c string, m string, s string, r string")
    out = [r[0] for r in df.select(C.enhance_caption("c", "m", "s", "r", max_length=50)).collect()]
    assert out[0] == "Cap. Generated from HRRR model during spring season in the Northeast region."[:47] + "..."
    assert len(out[1]) == 50 and out[1].endswith("...")


def test_season_from_date(spark):
    df = spark.createDataFrame([("2019-04-15",), ("2019-07-20",), ("2019-01-10",), ("bad",), ("2019-13-01",), (None,)], "d string")
    assert [r[0] for r in df.select(C.season_from_date(F.col("d"))).collect()] == \
        ["spring", "summer", "winter", "unknown", "fall", "unknown"]


def test_weekly_mondays(spark):
    df = spark.createDataFrame([(2019, 1, 2025, 6)], "a int, b int, c int, d int")
    legacy = df.select(F.size(C.weekly_mondays("a", "b", "c", "d", legacy_day30=True))).first()[0]
    assert legacy == 339
    first = df.select(F.get(C.weekly_mondays("a", "b", "c", "d"), 0)).first()[0]
    assert str(first) == "2019-01-07"
