"""Plan-shape checks: pushdown, no cartesian / nested-loop joins, scan counts."""

import pytest
from pyspark.sql import functions as F

from skycap.operators import grid as G
from skycap.operators import probe as PR
from skycap.operators import retrieval as R
from skycap.plans import derive
from skycap.sources import grid as SG


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_field_selection_pushdown(spark, sf, tmp_path):
    path = str(tmp_path / "grid")
    derive.grid(spark, sf).write.partitionBy("model", "variable").parquet(path)
    q = SG.select_field(SG.read_grid(spark, path), "hrrr", "temperature", "1996-03-01", 0).select("lat", "lon", "raw_value")
    plan = _plan(q)
    assert "PartitionFilters: [isnotnull(model" in plan and "(variable#" in plan
    assert "GreaterThanOrEqual(valid_time" in plan and "LessThan(valid_time" in plan and "EqualTo(forecast_hour,0)" in plan
    assert "ReadSchema: struct<valid_time:timestamp_ntz,forecast_hour:int,lat:double,lon:double,raw_value:double>" in plan
    with pytest.raises(ValueError, match="Available models: hrrr, hrrrak"):
        SG.select_field(SG.read_grid(spark, path), "gfs", "temperature", "1996-03-01")


def test_statistics_plan(spark, sf):
    plan = _plan(G.field_statistics(derive.grid(spark, sf)))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # formatted explain names each scan twice (tree + details): statistics
    # pass + MAD pass
    assert plan.count("Scan parquet ") // 2 <= 2


def test_interval_join_is_equi(spark, sf):
    from skycap.plans.q_probe import _storms
    lab = PR.label_samples(derive.emb_samples(spark, sf), _storms(spark, sf), 7)
    plan = _plan(lab)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_retrieval_has_no_pair_join(spark, sf):
    samples = R.parse_features(derive.emb_samples(spark, sf)).withColumn("image_emb", F.transform("image_emb", lambda x: -x))
    parts = R.ranked_partials(samples, [R.I2T, R.T2I], k_max=1)  # the second pass is needed
    plan = _plan(parts)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "FlatMapCoGroupsInPandas" in plan


def test_caption_plan_single_scan(spark, sf):
    plan = _plan(G.caption_samples(derive.grid(spark, sf)))
    assert plan.count("Scan parquet ") // 2 == 1
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
