"""Scores, intervals and fits against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnstrata.functions import fixed_values as fixed
from attnstrata.operators import compare, composite, functional, pooled_control, statistics
from attnstrata.operators.moments import fit_logistic


def direct_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("segments", [1, 5, 1024])
def test_auroc_with_ties(spark, segments):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(4):
        y, s = rng.integers(0, 2, 200), np.round(rng.normal(size=200) * (10 ** g), 1)
        want[g] = direct_auroc(y, s)
        rows += [(g, int(a), float(b)) for a, b in zip(y, s)]
    rows += [(9, 1, 0.5), (9, 1, 0.7)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    got = {r["g"]: r["auroc"] for r in statistics.auroc(df, ["g"], "y", "s", segments=segments).collect()}
    assert got[9] is None
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def newton(x, y, l2):
    x1 = np.column_stack([np.ones(len(x)), x])
    reg = np.diag([0.0] + [l2] * x.shape[1])
    b = np.zeros(x1.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ b))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + reg, x1.T @ (p - y) + reg @ b)
        b = b - step
    return b


def test_logistic_equals_newton_for_all_groups(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(3):
        x = rng.normal(size=(120, 3)) * [1, 5, 0.1] + g
        y = (x @ [1, 0.3, -2] + rng.normal(size=120) > 0).astype(int)
        want[g] = newton(x, y, 0.5)
        rows += [(g, [float(v) for v in a], int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "g int, x array<double>, y int").repartition(5)
    fitted, still_open = fit_logistic(df, ["g"], 3, [(g, 0) for g in range(3)], l2=0.5)
    for g in range(3):
        assert np.allclose(fitted[(g,)][0], want[g], atol=1e-7)


def study_rows(spark, n=150):
    rng = np.random.default_rng(6)
    rows = []
    for b in ("B1", "B2"):
        y = rng.integers(0, 2, n)
        x = rng.normal(size=(n, 7)) + 0.8 * y[:, None] * np.r_[1, 1, np.zeros(5)]
        x[::5, 6] = np.nan
        rows += [(f"{b}-{i}", b, bool(y[i]), *map(float, x[i])) for i in range(n)]
    rows += [(f"B3-{i}", "B3", i % 2 == 0, *[0.0] * 7) for i in range(20)]
    cols = ", ".join(f"{f} double" for f in fixed.FEATURES)
    return spark.createDataFrame(rows, f"event_id string, bin_id string, is_fail boolean, {cols}")


def test_composite_fit(spark):
    df = study_rows(spark)
    fits = {r["bin_id"]: r for r in composite.fit_composite(df, replicates=60).collect()}
    assert set(fits) == {"B1", "B2"}  # B3 has too few rows
    prepared = statistics.impute_median(df.filter("bin_id = 'B1'"), ["bin_id"], list(fixed.FEATURES))
    split = statistics.stratified_split(prepared, ["bin_id"], "is_fail", id_col="event_id", seed="composite").toPandas()
    train, test = split[~split.held_out], split[split.held_out]
    names = list(fixed.FEATURES)
    b = newton(train[names].to_numpy(), train.is_fail.to_numpy().astype(int), 1.0)
    r = fits["B1"]
    assert np.allclose([r["intercept"], *r["coefficients"]], b, atol=1e-7)
    score = test[names].to_numpy() @ b[1:] + b[0]
    assert r["auroc"] == pytest.approx(direct_auroc(test.is_fail.to_numpy().astype(int), score))
    assert 0 <= r["auroc_ci_lower"] <= r["auroc_ci_upper"] <= 1
    assert (r["n_events_train"], r["n_events_held_out"]) == (len(train), len(test))
    assert r["feature_names"] == names


def test_a_bin_of_one_class_stays_without_a_fit(spark):
    df = study_rows(spark).withColumn("is_fail", F.col("is_fail") | (F.col("bin_id") == "B1"))
    fits = {r["bin_id"]: r for r in composite.fit_composite(df, replicates=5).collect()}
    assert fits["B1"]["status"] == "single_class" and fits["B1"]["coefficients"] is None
    assert fits["B1"]["auroc"] is None and fits["B2"]["status"] == "fitted"


def test_pooled_control_is_its_own_table(spark):
    out = pooled_control.fit_pooled_control(study_rows(spark), replicates=20)
    assert out.first()["control"] == "pooled_negative_control" and "bin_id" not in out.columns
    assert not hasattr(composite, "fit_pooled_control")
    with pytest.raises(Exception, match="single known bin"):
        composite.fit_composite(study_rows(spark).withColumn("bin_id", F.lit("ALL")), replicates=5)


def curve_rows(spark, n=60):
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 32)
    base = np.stack([np.sin(2 * np.pi * t), np.cos(2 * np.pi * t), np.sin(4 * np.pi * t)])
    x = rng.normal(size=(n, 3)) @ base + 0.05 * rng.normal(size=(n, 32))
    y = rng.integers(0, 2, n)
    x += np.outer(y, np.exp(-((t - 0.5) ** 2) / 0.005))
    rows = [(f"e{i}", "B1", "qkt_grassmannian", bool(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id string, bin_id string, edge_type string, is_fail boolean, curve array<double>")
    return df.repartition(3), x, y


def test_fpca_equals_svd(spark):
    df, x, _ = curve_rows(spark)
    fit = functional.fit_fpca(df, ["bin_id"])
    r = fit.first()
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    shares = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(shares), 0.95) + 1)
    assert r["n_fpcs"] == k and np.allclose(r["shares"], shares[:k]) and np.allclose(r["mean"], x.mean(axis=0))
    v = np.array(r["components"])
    assert np.allclose(np.abs((v * vt[:k]).sum(axis=1)), 1)
    scores = {q["event_id"]: q["scores"] for q in functional.fpca_scores(df, fit, ["bin_id"]).collect()}
    assert np.allclose([scores[f"e{i}"] for i in range(len(x))], c @ v.T)
    flat = spark.createDataFrame([("B1", [0.3, 0.1]), ("B1", [0.3, 0.1]), ("B1", [0.3, 0.1])], "bin_id string, curve array<double>")
    assert functional.fit_fpca(flat, ["bin_id"]).first()["n_fpcs"] == 0


def direct_beta(x, y, w):
    """Replicate by copying rows: components, regression on scores, back-projection."""
    x, y = np.repeat(x, w, axis=0), np.repeat(y, w)
    if len(set(y)) < 2:
        return None
    c = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    shares = s**2 / (s**2).sum()
    k = min(int((np.cumsum(shares) < 0.95).sum()) + 1, 32)
    return newton(c @ vt[:k].T, y, 1.0)[1:] @ vt[:k]


def test_functional_logistic_equals_direct_bootstrap(spark):
    df, x, y = curve_rows(spark)
    b = 25
    fits, beta = functional.fit_functional_logistic(df, replicates=b, min_rows=10)
    rows = sorted(beta.collect(), key=lambda r: r["layer"])
    point = direct_beta(x, y, np.ones(len(x), int))
    assert np.allclose([r["beta"] for r in rows], point, atol=1e-6)
    keys = ["bin_id", "edge_type"]
    indexed, draws = statistics.bootstrap_weights(
        df.withColumn("_id", F.col("event_id")), keys, id_col="_id", replicates=b, seed="functional"
    )
    place = {r["_i"]: int(r["event_id"][1:]) for r in indexed.collect()}
    weights = np.zeros((b, len(x)), int)
    for r in draws.collect():
        weights[r["replicate"], place[r["_i"]]] = r["weight"]
    assert (weights.sum(axis=1) == len(x)).all()
    samples = np.stack([direct_beta(x, y, w) for w in weights])
    assert np.allclose([r["beta_ci_lower"] for r in rows], np.percentile(samples, 2.5, axis=0), atol=1e-6)
    assert np.allclose([r["beta_ci_upper"] for r in rows], np.percentile(samples, 97.5, axis=0), atol=1e-6)
    fit = fits.first()
    significant = [r["beta_ci_lower"] > 0 or r["beta_ci_upper"] < 0 for r in rows]
    covered = {l for iv in fit["discriminative_depth_intervals"] for l in range(iv["lo"], iv["hi"] + 1)}
    assert covered == {i for i, s in enumerate(significant) if s}
    assert len(fit["beta_function"]) == 32


def test_bootstrap_interval_picks_order_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(40)] + [("b", 1.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in statistics.percentile_pick(df, ["k"], "v", "x").collect()}
    assert got == {"a": (40, 1.0, 38.0), "b": (1, 1.0, 1.0)}


def test_long_lines(spark):
    rng = np.random.default_rng(2)
    step = np.r_[np.zeros(20), np.ones(44)]
    rows = [
        (e, 0, h, t, float(rng.normal() * 0.01 + (e * step[t] if h == 0 else 0.0)))
        for e in range(6) for h in range(2) for t in range(64)
    ]
    rows += [(0, 1, 0, t, 1.0) for t in range(64)]  # a single series
    rows += [(e, 2, 0, t, 1.0) for e in range(3) for t in range(64)]  # no variation
    df = spark.createDataFrame(rows, "event_id int, layer int, head int, rel_pos int, grassmannian_qkt double")
    got = {(r["layer"], r["head"]): r["first_alarm_idx"] for r in functional.long_lines(df, threshold=1.0).collect()}
    assert set(got) == {(0, 0), (0, 1)}
    assert 20 <= got[(0, 0)] <= 30


def test_sweep_winner_rules(spark):
    rows = [(k, f"B{i}", g) for k, gs in {8: [0.01, 0.02], 16: [0.03, 0.04], 32: [0.0, None]}.items() for i, g in enumerate(gs)]
    gains = spark.createDataFrame(rows, "k int, bin_id string, gain double")
    assert compare.pick_winner(gains).first()["winner_k_attn"] == 16
    none = gains.withColumn("gain", F.lit(None).cast("double"))
    assert compare.pick_winner(none).first()["winner_k_attn"] == 16
    tie = gains.withColumn("gain", F.lit(0.5))
    assert compare.pick_winner(tie).first()["winner_k_attn"] == 8
    low = gains.withColumn("gain", F.when(F.col("k") == 8, 0.9).otherwise(F.lit(None).cast("double")))
    assert compare.pick_winner(low).first()["winner_k_attn"] == 8


def test_marginal_gain(spark):
    schema = "bin_id string, auroc double, auroc_ci_lower double, auroc_ci_upper double"
    base = spark.createDataFrame([(f"B{i}", 0.7, 0.6, 0.8) for i in range(1, 6)], schema)
    aug = spark.createDataFrame([(f"B{i}", 0.7 + 0.01 * i, 0.65, 0.85) for i in range(2, 7)], schema)
    gains = compare.marginal_gain(base, aug)
    assert {r["bin_id"] for r in gains.collect()} == {"B2", "B3", "B4", "B5"}
    s = compare.marginal_gain_summary(gains).first()
    assert s["median_delta_auroc"] == pytest.approx(0.04)  # upper median of .02 .03 .04 .05
    assert math.isnan(compare.marginal_gain_summary(gains.filter("false")).first()["median_delta_auroc"])


def test_interval_overlap_is_inclusive(spark):
    a = spark.createDataFrame([("x", 0, 3), ("y", 0, 3), ("z", 5, 6)], "bin_id string, lo int, hi int")
    b = spark.createDataFrame([("x", 3, 5), ("y", 4, 5), ("w", 1, 2)], "bin_id string, lo int, hi int")
    got = {r["bin_id"]: r["overlap"] for r in compare.interval_overlap(a, b).collect()}
    assert got == {"x": True, "y": False, "z": False, "w": False}
