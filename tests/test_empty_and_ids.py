"""Totals of empty tables, ids that look like numbers, distinct draws."""

from skycap.operators import profile as PF
from skycap.sources import records as RC


def test_totals_of_empty_tables(spark):
    none = spark.createDataFrame([], "variable string, model string, region string, season string, date string")
    for rows in (PF.generation_summary(none), PF.dataset_statistics(none), PF.weather_statistics(none)):
        got = rows.collect()
        assert [(r["dimension"], r["key"], r["count"]) for r in got] == [("total", None, 0)]
    assert PF.weather_statistics(none).first()["min_date"] == "unknown"


def test_caption_ids_stay_text(spark, tmp_path):
    path = str(tmp_path / "captions")
    RC.write_caption_files(spark.createDataFrame([("007", "seven"), ("1e3", "thousand")], "sample_id string, caption string"), path)
    got = {r["caption_file"]: r["caption_text"] for r in RC.read_caption_files(spark, path).collect()}
    assert got == {"007.txt": "seven", "1e3.txt": "thousand"}
