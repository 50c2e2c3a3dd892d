"""JSONL readers on literal lines (bad-row cases of the reference tests)."""

import json

import pytest

from skycap.sources import records as RC

GOOD = {"image_path": "images/a.png", "caption": " Warm day ", "sample_id": "sample_1", "variable": "temperature",
        "model": "hrrr", "date": "2019-04-15", "metadata": {"region": "continental_us", "domain": "conus",
                                                            "generation_time": "2024-01-01T00:00:00"}}


def _lines(spark, objs):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objs], "value string")


def test_strict_and_required(spark, tmp_path):
    base = str(tmp_path)
    listing = spark.createDataFrame([(f"{base}/images/a.png",)], "path string")
    missing = dict(GOOD)
    del missing["date"]
    extra = dict(GOOD, quality=1)
    nulldate = dict(GOOD, date=None)
    noimg = dict(GOOD, image_path="images/zzz.png", sample_id="s9")
    lines = _lines(spark, [GOOD, "{not json", missing, extra, nulldate, noimg])
    good, rej = RC.read_records_strict(lines, listing, base)
    assert [r["sample_id"] for r in good.collect()] == ["sample_1"]
    assert good.first()["caption"] == "Warm day"
    reasons = sorted(r["reason"] for r in rej.collect())
    assert reasons == ["image_missing", "malformed_json", "missing_or_extra_fields", "missing_or_extra_fields", "null_field"]
    good2, rej2 = RC.read_records_required(lines, listing, base, f"{base}/images")
    got = sorted((r["sample_id"], r["season"], r["region"]) for r in good2.collect())
    assert got == [("sample_1", "spring", "continental_us"), ("sample_1", "spring", "continental_us"),
                   ("sample_1", "unknown", "continental_us")]
    assert sorted(r["reason"] for r in rej2.collect()) == ["image_missing", "malformed_json", "missing_required_fields"]


def test_required_region_absent_and_fallback_dir(spark, tmp_path):
    base = str(tmp_path)
    listing = spark.createDataFrame([(f"{base}/imgs/b.png",)], "path string")
    rec = dict(GOOD, image_path="b.png", metadata={"domain": "conus"})
    good, _ = RC.read_records_required(_lines(spark, [rec]), listing, base, f"{base}/imgs")
    r = good.first()
    assert r["region"] == "Unknown" and r["resolved_image_path"] == f"{base}/imgs/b.png" and r["image_filename"] == "b.png"


def test_numeric_suffix(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("sample_17",), ("abc",), ("x_3_y",), ("42",)], "s string")
    assert [r[0] for r in df.select(RC.numeric_suffix(F.col("s"))).collect()] == [17, -1, -1, 42]


def test_failfast_reader_raises_on_a_bad_line(spark, tmp_path):
    path = str(tmp_path / "bad")
    _lines(spark, [GOOD, "{not json"]).write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        RC.read_records_failfast(spark, path).collect()
    fine = str(tmp_path / "fine")
    _lines(spark, [GOOD]).write.text(fine)
    assert [r.sample_id for r in RC.read_records_failfast(spark, fine).collect()] == ["sample_1"]


def test_embedding_store_forms(spark, tmp_path):
    df = spark.createDataFrame([("sample_1", [0.25, -1.0]), ("sample_2", [1e-9, 3.5])], "sample_id string, image_emb array<double>")
    for form in ("parquet", "json"):
        got = RC.load_embeddings(spark, RC.save_embeddings(df, str(tmp_path / form), form), form)
        assert sorted((r.sample_id, r.image_emb) for r in got.collect()) == sorted((r.sample_id, r.image_emb) for r in df.collect())
    with pytest.raises(ValueError, match="Unknown save format"):
        RC.save_embeddings(df, str(tmp_path / "x"), "pickle")
    with pytest.raises(ValueError, match="Unknown load format"):
        RC.load_embeddings(spark, str(tmp_path / "json"), "pickle")


def test_equal_lines_and_null_paths_stay(spark, tmp_path):
    """Equal lines are rows of their own; the first candidate wins; a null path finds nothing; no row key in the plan."""
    base = str(tmp_path)
    listing = spark.createDataFrame([(f"{base}/images/a.png",), (f"{base}/images/a.png",), (f"{base}/other/a.png",)], "path string")
    good, rejects = RC.read_records_required(_lines(spark, [GOOD, GOOD, dict(GOOD, image_path=None)]), listing, base, f"{base}/other")
    assert [r.resolved_image_path for r in good.collect()] == [f"{base}/images/a.png"] * 2
    assert [r.reason for r in rejects.collect()] == ["image_missing"]


def test_caption_files_are_written_by_many_tasks(spark, tmp_path):
    """A table of one partition is dealt before its files are written; every file holds its caption."""
    from skycap.sources import records as RC

    n = 200
    df = spark.createDataFrame([(f"s_{i}", f"caption {i}") for i in range(n)], "sample_id string, caption string").coalesce(1)
    RC.write_caption_files(df, f"{tmp_path}/c")
    got = {r.caption_file: r.caption_text for r in RC.read_caption_files(spark, f"{tmp_path}/c").collect()}
    assert len(got) == n and got["s_7.txt"].strip() == "caption 7"
    tasks = {p.name.split("-")[1] for p in (tmp_path / "c").glob("sample_id=*/part-*")}
    assert len(tasks) > 1
