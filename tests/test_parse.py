"""Caption parsing, including the first-substring and wind-pattern quirks."""

from pyspark.sql import functions as F

from skycap.functions import parse as P
from skycap.functions import scoring as M


def _parse(spark, text):
    return spark.createDataFrame([(text,)], "c string").select(P.parse_caption(F.col("c")).alias("p")).first()["p"]


def test_round_trip_fields(spark):
    p = _parse(spark, "Northeastern US, early spring, 04 Mar 2019. Mild temperatures averaging 12.3°C. "
                      "Gale winds averaging 70.1 km/h. low precipitation. moderate humidity (45.0%).")
    assert p["region"] == "Northeast"
    assert p["date"] == "04 Mar 2019"
    assert p["season"] == "early spring"
    assert p["avg_temperature"] == 12.3
    assert p["wind_speed"] == 70.1
    assert p["precipitation"] == "low precipitation"
    assert p["humidity"] == 45.0
    assert p["conditions"] == "Unknown"
    assert p["temperature_range"] is None


def test_quirks(spark):
    assert _parse(spark, "Southeastern US, mid summer")["region"] == "South"
    assert _parse(spark, "Rockies and Plains, mid summer")["region"] == "Unknown"
    assert _parse(spark, "Gentle breeze averaging 14.0 km/h")["wind_speed"] is None
    p = _parse(spark, "Temperature ranges from -3°C to 9°C across the region with cold conditions averaging 2°C")
    assert p["temperature_range"]["min"] == -3.0 and p["temperature_range"]["max"] == 9.0
    assert p["conditions"] == "cold conditions"
    assert _parse(spark, "nothing here")["season"] == "Unknown"
    assert _parse(spark, "averaging 1.2.3°C")["avg_temperature"] is None


def test_season_similarity(spark):
    pairs = [("early spring", "late spring", 1.0), ("winter", "spring", 0.5), ("winter", "fall", 0.5),
             ("winter", "summer", 0.0), ("autumn", "fall", 1.0), ("mid autumn", "summer", 0.5), ("foo", "bar", 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(M.season_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [e for _, _, e in pairs]


def test_weather_similarity_identical_caption(spark):
    df = spark.createDataFrame([("Alaska, mid winter. Cold temperatures averaging 1.0°C.",)], "c string")
    p = df.select(P.parse_caption(F.col("c")).alias("p"))
    assert p.select(M.weather_similarity(F.col("p"), F.col("p"))).first()[0] == 1.0
