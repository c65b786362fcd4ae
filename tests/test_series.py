"""Detectors against their recurrences, lookbacks, percentiles, runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnstrata.operators import series, statistics


def frame(spark, named):
    rows = [(n, t, float(x)) for n, xs in named.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "name string, t int, x double").repartition(6)


def cusum_loop(xs, drift):
    pos = neg = 0.0
    out = []
    for x in xs:
        pos, neg = max(0.0, pos + x - drift), max(0.0, neg - x + drift)
        out.append((pos, neg))
    return out


def named_series():
    rng = np.random.default_rng(1)
    return {
        "zeros": np.zeros(100),
        "up": np.r_[np.zeros(20), np.ones(30)],
        "down": np.r_[np.zeros(30), -np.ones(30)],
        "noise": rng.normal(size=257),
        "walk": rng.normal(size=400).cumsum(),
        "one": [3.0],
    }


@pytest.mark.parametrize("block,drift", [(65_536, 0.0), (16, 0.0), (7, 0.3), (1, -0.2)])
def test_cusum_equals_recurrence(spark, block, drift):
    data = named_series()
    out = series.cusum(
        frame(spark, data), ["name"], ["t"], "x", threshold=5.0, drift=drift, block=block,
        segment=F.expr("t div 10"),
    )
    got = {(r["name"], r["idx"]): (r["positive_cusum"], r["negative_cusum"]) for r in out.collect()}
    alarms = {r["name"]: r["first_alarm_idx"] for r in series.first_alarm(out, ["name"]).collect()}
    for n, xs in data.items():
        want = cusum_loop(xs, drift)
        assert np.allclose([got[(n, i)] for i in range(len(xs))], want, atol=1e-9)
        hit = [i for i, (p, q) in enumerate(want) if p > 5 or q > 5]
        assert alarms[n] == (hit[0] if hit else -1)


@pytest.mark.parametrize("block,smoothing,drift", [(65_536, 0.3, 0.0), (16, 0.3, 5.0), (5, 1.0, 0.0), (3, 0.01, -1.0)])
def test_ewma_equals_recurrence(spark, block, smoothing, drift):
    data = named_series()
    out = series.ewma(
        frame(spark, data), ["name"], ["t"], "x", smoothing=smoothing, threshold=3.0, drift=drift, block=block
    )
    got = {(r["name"], r["idx"]): (r["ewma"], r["alarm"]) for r in out.collect()}
    for n, xs in data.items():
        e = drift
        for i, x in enumerate(xs):
            e = smoothing * x + (1 - smoothing) * e
            assert got[(n, i)][0] == pytest.approx(e, abs=1e-9)
            assert got[(n, i)][1] == (abs(e - drift) > 3.0)


@pytest.mark.parametrize("bad", [0.0, 1.5])
def test_ewma_refuses_bad_smoothing(spark, bad):
    with pytest.raises(ValueError):
        series.ewma(frame(spark, {"a": [1.0]}), ["name"], ["t"], "x", smoothing=bad)


def test_lookback_windows(spark):
    commits = spark.createDataFrame([(c,) for c in (254, 255, 256, 500, 1000)], "commit int")
    dense = {
        r["commit"]: (r["n"], r["lo"], r["hi"])
        for r in series.dense_lookback(commits, F.col("commit")).groupBy("commit").agg(
            F.count("position").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi")
        ).collect()
    }
    assert dense == {
        254: (0, None, None), 255: (256, 0, 255), 256: (256, 1, 256), 500: (256, 245, 500), 1000: (256, 745, 1000),
    }
    sparse = series.sparse_lookback(commits, F.col("commit")).filter("commit = 500").orderBy("lookback_j")
    assert [r["position"] for r in sparse.collect()] == [500, 499, 498, 496, 492, 484, 468, 436, 372, 244]
    assert series.sparse_lookback(commits, F.col("commit")).filter("commit = 255").first()["position"] is None
    one = spark.createDataFrame([(1,)], "head int")
    assert series.broadcast_positions(one).filter(series.in_lookback(F.col("rel_pos"))).count() == 256


@pytest.mark.parametrize("segments", [1, 7, 1024])
def test_group_percentiles_equal_numpy(spark, segments):
    rng = np.random.default_rng(4)
    data = {
        "tail": np.exp(rng.normal(size=501) * 4),
        "ties": rng.integers(0, 4, 300).astype(float),
        "nan": np.r_[1.0, np.nan, 2.0, 4.0],
        "same": np.full(9, 2.5),
    }
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    out = statistics.group_percentiles(frame(spark, data), ["name"], "x", qs, segments=segments)
    for r in out.collect():
        want = np.nanpercentile(data[r["name"]], [100 * q for q in qs])
        assert np.allclose([r[f"q{i}"] for i in range(5)], want)


@pytest.mark.parametrize("large", [False, True])
def test_summary_equals_numpy_and_keeps_nan(spark, large):
    data = {"a": np.random.default_rng(9).normal(size=256), "bad": np.array([1.0, np.nan, 2.0])}
    out = {r["name"]: r for r in statistics.summarize(frame(spark, data), ["name"], ["x"], large_groups=large).collect()}
    a = data["a"]
    want = [a.mean(), *np.percentile(a, [10, 50, 90]), a.std()]
    assert np.allclose([out["a"][c] for c in ("mean", "p10", "p50", "p90", "std")], want)
    assert all(np.isnan(out["bad"][c]) for c in ("mean", "p10", "p50", "p90", "std"))


def test_imputation(spark):
    df = spark.createDataFrame(
        [("a", 1.0, float("nan")), ("a", float("nan"), None), ("a", 3.0, float("nan")), ("a", 10.0, None), ("b", float("nan"), 2.0)],
        "k string, x double, y double",
    )
    rows = statistics.impute_median(df, ["k"], ["x", "y"], add_indicator=True).collect()
    a = sorted((r["x"], r["x_imputed"], r["y"]) for r in rows if r["k"] == "a")
    assert a == [(1.0, False, 0.0), (3.0, False, 0.0), (3.0, True, 0.0), (10.0, False, 0.0)]
    assert [(r["x"], r["y"]) for r in rows if r["k"] == "b"] == [(0.0, 2.0)]


def test_islands(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i, bool(f)) for i, f in enumerate(flags)], "k string, layer int, f boolean")
    got = sorted((r["lo"], r["hi"]) for r in statistics.islands(df, ["k"], "layer", F.col("f")).collect())
    assert got == [(1, 2), (4, 4), (7, 9)]
