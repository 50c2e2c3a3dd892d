"""Quantiles by selection against numpy and ``percentile``."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skycap.operators import grid as G
from skycap.operators.quantiles import exact_quantiles, median_deviation

PROBS = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]


def _plain(rows, keys):
    return {k: np.percentile([v for g, v in rows if g == k and v is not None], [100 * p for p in PROBS]) for k in keys}


@pytest.mark.parametrize("small", [50_000, 20])
def test_quantiles_of_hot_tied_and_wide_groups(spark, small):
    """``small`` = 20 sends brackets through further rounds."""
    rnd = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rnd.normal(size=20_000)]
    rows += [("ties", float(x)) for x in rnd.choice([1.0, 2.0, 7.5], 3000, p=[0.5, 0.4, 0.1])]
    rows += [("wide", float(s * 10.0 ** e)) for s, e in zip(rnd.choice([-1, 1], 2000), rnd.uniform(-300, 300, 2000))]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 5.0), ("null", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", PROBS, small=small).collect()}
    want = _plain(rows, ["hot", "ties", "wide", "one", "two", None])
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert np.allclose(got[k], q, rtol=1e-12, atol=0), k
    same = df.where("x is not null").groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()
    assert {r.g: r.q for r in same} == got


def test_deviation_empty_table_and_no_keys(spark):
    xs = [1.0, 2.0, 4.0, 9.0, 100.0]
    df = spark.createDataFrame([("a", x) for x in xs], "g string, x double")
    q = exact_quantiles(df, ["g"], "x", [0.5]).select("g", F.get("quantiles", 0).alias("m"))
    assert median_deviation(df, ["g"], "x", q, "m").first().mad == float(np.median(np.abs(np.array(xs) - 4.0)))
    assert exact_quantiles(df, [], "x", [0.5]).first().quantiles == [4.0]
    assert exact_quantiles(df.where("false"), ["g"], "x", [0.5]).count() == 0
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double")
    assert exact_quantiles(nan, [], "x", [0.5]).first().quantiles == [2.0]


def test_field_statistics_by_selection(spark, sf):
    from skycap.plans import derive
    g = derive.grid(spark, sf)
    key = ["variable", "valid_time", "forecast_hour", "region"]
    rows = lambda p: {tuple(r[k] for k in key): r.asDict() for r in G.field_statistics(g, percentiles=p).collect()}
    exact, chosen = rows("exact"), rows("selection")
    assert exact.keys() == chosen.keys() and exact
    for k, e in exact.items():
        for c in G.STAT_COLUMNS + ["count_valid", "count_missing"]:
            assert chosen[k][c] == (e[c] if e[c] is None else pytest.approx(e[c], abs=1e-9)), (k, c)


def test_written_values_are_not_written_again(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3, float(i * i % 101)) for i in range(400)], "g long, x double")
    frame, wrote = type(df), []
    plain = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: (wrote.append(self.columns), plain(self, *a, **k))[1])
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", PROBS, written=True).collect()}
    assert ["_g0", "_v"] not in wrote
    for g, q in got.items():
        assert q == pytest.approx(np.percentile([i * i % 101 for i in range(g, 400, 3)], [100 * p for p in PROBS]))
