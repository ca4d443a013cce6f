"""Operators on hand-checkable frames and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions.freq import Freq, by_gap, comparison
from tidemill.functions.scalars import corrected_skew, rounded
from tidemill.operators import crossvar, decompose, features, forecast, hierarchy, intermittency, kernels, missing, models, outliers, reconcile, resample, schema, stats, windows


def series(spark, values, start="2024-01-03", freq="D", key=None):
    ts = pd.date_range(start, periods=len(values), freq=freq)
    rows = [((key,) if key else ()) + (t.to_pydatetime(), None if v is None else float(v)) for t, v in zip(ts, values)]
    return spark.createDataFrame(rows, ("k string, " if key else "") + "ts timestamp_ntz, v double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_week_conventions(spark):
    df = series(spark, range(1, 16))
    left = resample.resample(df, Freq("W", "left"), {"v": "sum"})
    assert [(str(r.bucket), r.v) for r in left.orderBy("bucket").collect()] == [("2023-12-31", 10.0), ("2024-01-07", 56.0), ("2024-01-14", 54.0)]
    right = resample.resample(df, Freq("W", "right"), {"v": "sum"})
    assert [(str(r.bucket), r.v) for r in right.orderBy("bucket").collect()] == [("2024-01-07", 15.0), ("2024-01-14", 63.0), ("2024-01-21", 42.0)]


@pytest.mark.parametrize("freq, closed, alias", [("W", "right", "W"), ("2W", "right", "2W"), ("MS", "left", "MS"), ("QS", "left", "QS"), ("YS", "left", "YS"), ("D", "left", "D")])
def test_buckets_agree_with_pandas(spark, freq, closed, alias):
    rng = np.random.default_rng(7)
    for start in ("2023-02-03", "2022-12-31", "2024-02-25"):
        days = pd.date_range(start, periods=200, freq="D")
        days = days[rng.random(200) < 0.6]
        frame = pd.Series(rng.integers(0, 50, len(days)).astype(float), index=days)
        expect = frame.resample(alias).sum()
        df = spark.createDataFrame([(t.to_pydatetime(), v) for t, v in frame.items()], "ts timestamp_ntz, v double")
        got = resample.resample(df, Freq(freq, closed), {"v": "sum"}).orderBy("bucket").collect()
        assert [(str(r.bucket), r.v) for r in got] == [(str(t)[:10], v) for t, v in expect.items()]


def test_empty_months(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-04-05", 2.0)], "d string, v double").select(F.col("d").cast("timestamp_ntz").alias("ts"), "v")
    assert column(resample.resample(df, "MS", {"v": "sum"}), "v", "bucket") == [1.0, 0.0, 0.0, 2.0]
    assert column(resample.resample(df, "MS", {"v": "mean"}), "v", "bucket") == [1.0, None, None, 2.0]
    assert resample.resample(df.filter("false"), "MS", {"v": "sum"}).count() == 0


def test_resample_conserves_totals_and_keys(spark):
    a, b = series(spark, range(50), key="a"), series(spark, range(30), "2024-02-10", key="b")
    for freq in ("W", "MS", "QS", "2W", "6MS"):
        got = resample.resample(a.unionByName(b), freq, {"v": "sum"}, ["k"]).groupBy("k").agg(F.sum("v").alias("s"))
        assert {r.k: r.s for r in got.collect()} == {"a": sum(range(50)), "b": sum(range(30))}


def test_future_grid(spark):
    df = series(spark, [1], "2024-01-01")
    got = forecast.future_index(df.select(F.col("ts").cast("date").alias("ts"), "v"), [], 2, "MS").orderBy("step").collect()
    assert [str(r.ts) for r in got] == ["2024-02-01", "2024-03-01"]


def test_frequency_names():
    assert Freq.of("W-SUN") == Freq("W") and Freq.of("QS-OCT").unit == "QS" and Freq.of("YS-JAN").period == 1
    assert by_gap(None) == "D" and by_gap(30.4) == "MS" and comparison("W") == ["D", "MS", "QS"]
    with pytest.raises(ValueError):
        Freq.of("fortnight")


def test_downsample_keeps_ends(spark):
    got = column(resample.downsample(series(spark, range(1000)), 11), "v")
    assert len(got) == 11 and got[0] == 0 and got[-1] == 999
    assert resample.downsample(series(spark, range(5)), 11).count() == 5


def test_linear_impute_edges(spark):
    got = missing.impute(series(spark, [None, 1, None, None, 4, None]), [], "linear")
    assert column(got, "imputed") == [1, 1, 2, 3, 4, 4]
    assert column(got, "was_missing") == [True, False, True, True, False, True]


@pytest.mark.parametrize("method", [*missing.NATIVE, "spline", "auto"])
def test_imputation_leaves_observed_values(spark, method):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.3 else float(v) for v in rng.normal(10, 3, 60)]
    df = series(spark, values, key="a").unionByName(series(spark, range(20), key="b")).unionByName(series(spark, [None] * 20 + list(range(40)), key="c"))
    got = missing.impute(df, ["k"], method)
    assert got.count() == 140
    assert got.filter("not was_missing and imputed <> v").count() == 0
    if method not in ("forward_fill", "backward_fill", "auto"):
        assert got.filter("imputed is null or isnan(imputed)").count() == 0


def test_spline_is_natural_and_exact_on_lines():
    x = np.array([0.0, 1, 4, 6])
    assert np.allclose(missing.natural_spline(x, 2 * x + 1, np.array([0.5, 2, 5])), [2, 5, 11])
    assert np.allclose(missing.natural_spline(x, np.sin(x), x), np.sin(x))


def test_gap_summary(spark):
    got = missing.gap_summary(series(spark, [1, None, None, 2, None, 3], key="a"), ["k"]).first()
    assert (got.n, got.n_missing, got.n_gaps, got.max_gap, got.mean_gap, got.gap_lengths) == (6, 3, 2, 2, 1.5, [2, 1])
    whole = missing.gap_summary(series(spark, [1, 2], key="a"), ["k"]).first()
    assert (whole.n_gaps, whole.max_gap, whole.gap_lengths) == (0, 0, [])


def test_missing_patterns(spark):
    late = series(spark, [1, 2, 3, 4, None, 5, None, None], key="late")
    high = series(spark, [1, 9, None, 1, 9, None, 2, 9, None, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], key="high")
    full = series(spark, [1, 2, 3], key="full")
    got = {r.k: r.pattern for r in missing.missing_pattern(late.unionByName(high).unionByName(full), ["k"]).collect()}
    assert got == {"late": missing.MAR, "high": missing.MNAR, "full": missing.COMPLETE}


def test_centred_mean(spark):
    df = series(spark, range(1, 7))
    got = df.withColumn("m", windows.centred_mean("v", 4, windows.ordered([], "ts")))
    assert column(got, "m") == [1.5, 2, 2.5, 3.5, 4.5, 5]


def test_rolling_agrees_with_pandas(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=40)
    frame = pd.Series(values)
    got = series(spark, values).select("ts", *[c.alias(n) for n, c in windows.rolling("v", 5, windows.ordered([], "ts")).items()])
    for name in ("mean", "std", "min", "max"):
        expect = getattr(frame.shift(1).rolling(5), name)().to_numpy()
        made = np.array([np.nan if v is None else v for v in column(got, f"roll_{name}_5")], float)
        assert np.allclose(made, expect, equal_nan=True)


def test_quartiles_skew_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    got = df.agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.75).alias("b"), corrected_skew(F.col("v")).alias("s")).first()
    assert (got.a, got.b) == (1.75, 4.75) and got.s == pytest.approx(1.763632614803888)
    assert spark.range(1).select(rounded(F.lit(1.00005)).alias("x")).first().x == 1.0001


def test_splits_partition_rows(spark):
    got = windows.split(series(spark, range(20), key="a"), ["k"], "ts").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 14, "validation": 3, "test": 3}
    held = windows.holdout(series(spark, range(20)), [], "ts", 12)
    assert held.filter("is_holdout").count() == 6


def test_croston(spark):
    df = series(spark, [0, 4, 0, 0, 6], key="a").unionByName(series(spark, [0, 0, 5], key="b"))
    got = {r.k: r.forecast for r in intermittency.croston_forecast(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(3.5) and got["b"] is None
    for variant in ("croston", "sba", "tsb"):
        native = {r.k: r.forecast for r in intermittency.family_forecast(df, ["k"], variant, 1).collect()}
        for key, values in (("a", [0, 4, 0, 0, 6]), ("b", [0, 0, 5])):
            assert native[key] == pytest.approx(models.croston(np.array(values, float), 1, variant)[0])


def test_demand_classes(spark):
    rng = np.random.default_rng(0)
    df = series(spark, [5] * 20, key="smooth").unionByName(series(spark, [5, 0, 0, 0] * 10, key="intermittent")).unionByName(series(spark, (rng.exponential(50, 40) * (rng.random(40) < 0.3)).tolist(), key="lumpy"))
    got = {r.k: r["class"] for r in intermittency.classify(df, ["k"]).collect()}
    assert got == {"smooth": "Smooth", "intermittent": "Intermittent", "lumpy": "Lumpy"}
    assert intermittency.classify(series(spark, [0, 0], key="none"), ["k"]).count() == 0


def test_outliers_and_treatment(spark):
    df = series(spark, [10, 11, 9, 10, 12, 10, 9, 11, 10, 100], key="a").unionByName(series(spark, [3] * 6, key="flat"))
    got = outliers.detect(df, ["k"], ["iqr", "zscore", "isof", "lof"], z=2.5)
    hit = got.filter("is_outlier and v = 100").first()
    assert hit.severity == "HIGH" and set(hit.flagged_by) >= {"iqr", "zscore"}
    assert got.filter("k = 'flat' and (iqr or zscore)").count() == 0
    capped = outliers.treat(got, ["k"], "cap")
    fence = outliers.fences(df, ["k"]).filter("k = 'a'").first()
    assert capped.filter("v = 100").first().treated == pytest.approx(fence.upper)
    assert outliers.treat(got, ["k"], "remove").filter("v = 100 and treated is null").count() == 1
    assert outliers.treat(got, ["k"], "keep").filter("treated <> v").count() == 0
    for bad in (lambda: outliers.treat(got, ["k"], "x"), lambda: outliers.detect(df, ["k"], ["x"])):
        with pytest.raises(ValueError):
            bad()


def test_isolation_finds_the_far_point():
    x = np.concatenate((np.linspace(0, 1, 30), [9.0]))
    assert np.argmax(outliers.isolation_scores(x)) == 30


def test_decomposition_finds_the_period(spark):
    t = np.arange(120)
    y = 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 7)
    got = decompose.stl(series(spark, y - 0.5 * t, key="a").unionByName(series(spark, y[:5], key="short")), ["k"])
    assert got.count() == 120 and got.filter("period <> 7 or abs(value - trend - seasonal - residual) > 1e-9").count() == 0
    strength = stats.strengths(decompose.stl(series(spark, y, key="a"), ["k"], 7), ["k"]).first()
    assert strength.trend_label == strength.seasonal_label == "Strong"


def test_numeric_kernels():
    rng = np.random.default_rng(0)
    w, p = kernels.shapiro(rng.normal(size=200))
    assert w > 0.97 and p > 0.01 and kernels.shapiro(rng.exponential(size=200))[1] < 1e-6
    assert kernels.boxcox_lambda(np.exp(rng.normal(size=2000))) == pytest.approx(0, abs=0.1)


def test_autocorrelations_and_tests_of_them(spark):
    rng = np.random.default_rng(5)
    y = np.sin(np.arange(100) / 3) + rng.normal(size=100) * 0.1
    d = y - y.mean()
    r = np.array([1.0] + [d[k:] @ d[:-k] / (d @ d) for k in range(1, 21)])
    got = stats.acf(series(spark, y, key="a"), ["k"], 20)
    assert np.allclose(column(got, "acf", "lag"), r)
    assert stats.significant_lags(got, ["k"]).first().lags[0] == 1
    walk = np.cumsum(d)
    assert stats.kpss(series(spark, y, key="a"), ["k"]).first().statistic == pytest.approx((walk @ walk) / 100**2 / (d @ d / 100))
    assert stats.theil_sen(series(spark, [1, 3, 5, 100], key="a"), ["k"]).first().theil_sen == pytest.approx(18.5, abs=16.6)
    q = 100 * 102 * sum(r[k] ** 2 / (100 - k) for k in range(1, 11))
    assert stats.ljung_box(stats.acf(series(spark, y, key="a"), ["k"], 10), ["k"]).first().statistic == pytest.approx(q)
    partial = column(stats.pacf(got, ["k"]), "pacf", "lag")
    solve = lambda k: np.linalg.solve(r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))], r[1 : k + 1])[-1]
    assert np.allclose(partial[1:], [solve(k) for k in range(1, 21)], atol=1e-6) and partial[0] == 1.0


def test_ccf_finds_the_lead(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=120)
    y = np.concatenate((np.zeros(3), x[:-3])) + rng.normal(size=120) * 0.05
    ts = pd.date_range("2024-01-01", periods=120)
    df = spark.createDataFrame([(t.to_pydatetime(), float(a), float(b), int(a > 1)) for t, a, b in zip(ts, x, y)], "ts timestamp_ntz, x double, y double, e int")
    at = crossvar.ccf(df, "x", "y")
    best = crossvar.best_lag(at, 120).first()
    assert best.best_lag == 3 and best.significant
    gains = {r.lag: r.useful for r in crossvar.lagged_gain(df, "y", "x").collect()}
    assert gains[3]
    impact = crossvar.event_impact(df.withColumn("y", F.col("y") + F.col("e") * 5), "y", "e").first()
    assert impact.effect == "large" and impact.n_on + impact.n_off == 120


def test_hierarchy_rollup_coherence_and_nodes(spark):
    rows = [(f"r{i % 2}", f"s{i % 4}", float(i), "2024-01-01" if i < 40 else "2024-02-01") for i in range(80)] + [(None, "s0", 5.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "r string, s string, v double, d string").withColumn("d", F.col("d").cast("date"))
    rolled = hierarchy.rollup(df, ["r", "s"], "d", {"v": F.sum("v")})
    assert rolled.filter("r = '*'").agg(F.sum("v").alias("v")).first().v == sum(range(80))
    assert {r.depth: r.coherent for r in hierarchy.coherence(rolled, ["r", "s"], "d", "v").collect()} == {0: True, 1: True}
    nodes = {r.node_id: r.parent_id for r in hierarchy.nodes(rolled, ["r", "s"]).collect()}
    assert nodes["total"] is None and nodes["d1__r0"] == "total" and nodes["d2__r0__s2"] == "d1__r0"
    assert hierarchy.leaf_count(df, ["r", "s"]).first().n_leaves == 4
    assert [r.value for r in hierarchy.children(df, ["r", "s"], {"r": "r1"}).collect()] == ["s1", "s3"]
    assert len(hierarchy.tree(df, ["r", "s"]).collect()) == 2


def history(spark):
    rows = [(a, b, "2024-01-01", v) for (a, b), v in {("x", "p"): 10.0, ("x", "q"): 30.0, ("y", "p"): 60.0}.items()]
    leaves = spark.createDataFrame(rows, "a string, b string, d string, v double")
    return hierarchy.rollup(leaves, ["a", "b"], "d", {"v": F.sum("v")})


def test_reconciliation_sums_and_weights(spark):
    past = history(spark)
    weights = reconcile.child_weights(past, ["a", "b"])
    assert all(r.s == pytest.approx(1) for r in weights.groupBy("depth", "p_a", "p_b").agg(F.sum("weight").alias("s")).collect())
    base = past.select("a", "b", F.lit(1).alias("step"), (F.col("v") * 1.5).alias("forecast"))
    for strategy, middle in (("bottom_up", None), ("top_down", None), ("middle_out", 1)):
        got = {(r.a, r.b): r.forecast for r in reconcile.reconcile(base, past, ["a", "b"], strategy, middle).collect()}
        assert got[("*", "*")] == pytest.approx(150) and got[("x", "*")] == pytest.approx(60) and got[("x", "q")] == pytest.approx(45) and len(got) == 6
    with pytest.raises(ValueError):
        reconcile.reconcile(base, past, ["a", "b"], "sideways")


def test_locked_overrides(spark):
    past = history(spark)
    base = past.select("a", "b", F.lit(1).alias("step"), F.col("v").alias("forecast"))
    asked = spark.createDataFrame([("x", "*", 1, 70.0, None, None), ("x", "p", 1, None, 50.0, None)], "a string, b string, step int, value double, pct_of_base double, pct_of_reconciled double")
    marked = reconcile.override(base, asked, base, ["a", "b"])
    got = {(r.a, r.b): r.forecast for r in reconcile.reallocate(marked, reconcile.child_weights(past, ["a", "b"]), ["a", "b"]).collect()}
    assert got == pytest.approx({("*", "*"): 100, ("x", "*"): 70, ("y", "*"): 30, ("x", "p"): 5, ("x", "q"): 65, ("y", "p"): 30})


def test_models_follow_simple_patterns():
    t = np.arange(60.0)
    season = 100 + 2 * t + 10 * np.sin(2 * np.pi * t / 12)
    for name, (test, ahead) in models.run_models(season, 12, 12, 12, 1, ["ETS", "FLANN", "RecurrentFLANN", "RVFL", "ARIMA"], family="polynomial", order=1).items():
        assert len(test) == 12 == len(ahead) and np.isfinite(ahead).all(), name
    ets = models.holt_winters(season, 12, 12)
    truth = 100 + 2 * (60 + np.arange(12)) + 10 * np.sin(2 * np.pi * (60 + np.arange(12)) / 12)
    assert np.abs(ets - truth).mean() < 4
    assert np.allclose(models.arima(2 * t, 3), [120, 122, 124], atol=1.5)
    x = np.linspace(-1, 1, 7)[:, None]
    assert np.allclose(models.basis(x, 3, "legendre")[:, 1:], np.hstack((x, (3 * x**2 - 1) / 2, (5 * x**3 - 3 * x) / 2)))
    assert np.allclose(models.basis(x, 3, "chebyshev")[:, 1:], np.hstack((x, 2 * x**2 - 1, 4 * x**3 - 3 * x)))


@pytest.mark.parametrize("ranges", [None, 9])
def test_linear_forecast_against_numpy(spark, ranges):
    from tidemill.operators.ranges import cut

    rng = np.random.default_rng(6)
    y = 50 + np.cumsum(rng.normal(size=70)) + 5 * np.sin(np.arange(70))
    e = rng.normal(size=70)
    ts = pd.date_range("2024-01-03", periods=70)
    df = spark.createDataFrame([("a", t.to_pydatetime(), float(v), float(x)) for t, v, x in zip(ts, y, e)] + [("short", ts[i].to_pydatetime(), 1.0, 0.0) for i in range(8)], "k string, ts timestamp_ntz, v double, e double")
    got = forecast.linear_forecast(df, ["k"], 5, 12, 7, exog=["e"], at=cut(df, "ts", ranges, 9) if ranges else None).collect()
    assert {r.k for r in got} == {"a"}
    x = np.column_stack((np.ones(63), y[6:-1], y[5:-2], y[:-7], e[7:]))
    beta = np.linalg.lstsq(x[:-12], y[7:-12], rcond=None)[0]
    test = {r.step: (r.y, r.yhat) for r in got if r.part == "holdout"}
    assert [test[i + 1][1] for i in range(12)] == pytest.approx((x[-12:] @ beta).tolist()) and [test[i + 1][0] for i in range(12)] == pytest.approx(y[-12:].tolist())
    past = y.tolist()
    for _ in range(5):
        past.append(beta @ [1, past[-1], past[-2], past[-7], 0])
    assert [r.yhat for r in sorted((r for r in got if r.part == "future"), key=lambda r: r.step)] == pytest.approx(past[-5:])


def test_automatic_forecasts(spark):
    df = series(spark, [7], key="one").unionByName(series(spark, [5, 0, 0, 0] * 6, key="gappy")).unionByName(series(spark, range(10), key="line"))
    got = forecast.automatic(df, ["k"], 3, "MS").orderBy("step").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.model, r.forecast))
    assert [f for _, f in by["one"]] == [7, 7, 7] and by["gappy"][0][0] == "sba" and [f for _, f in by["line"]] == pytest.approx([10, 11, 12])


def test_metrics_best_and_combination(spark):
    rows = [("a", m, rank, "holdout", s, 10.0, p) for m, rank, p in (("good", 0, 11.0), ("same", 1, 9.0), ("bad", 2, 20.0)) for s in (1, 2)]
    at = spark.createDataFrame(rows, "k string, model string, rank int, part string, step int, y double, yhat double")
    scored = forecast.metrics(at, ["k", "model", "rank"])
    assert forecast.best_model(scored, ["k"]).first().model == "same"
    mixed = {r.model: r.yhat for r in forecast.combine(at, scored, ["k"]).filter("step = 1").collect()}
    assert mixed["Combo:Median"] == 11 and mixed["Combo:SimpleAvg"] == pytest.approx(40 / 3) and mixed["Combo:WeightedAvg"] < 12


def test_features_and_scaling(spark):
    df = series(spark, range(1, 41), key="a")
    got = features.prepare(df, ["k"], "ts", "v", "none", "standard", lags=(1, 2), rolling=(3,), with_calendar=True)
    train = got.filter("split = 'train'").agg(F.avg("lag_1").alias("m"), F.stddev_pop("lag_1").alias("s")).first()
    assert train.m == pytest.approx(0) and train.s == pytest.approx(1)
    assert features.select_lags([9, 3, 1, 40], 30) == [1, 3, 9] and features.select_lags(None, 25) == [1, 2, 3, 7]
    for wrong in (lambda: features.transformed(df, ["k"], "ts", "v", "sqrt"), lambda: features.scale(df, ["v"], "x", F.lit(True))):
        with pytest.raises(ValueError):
            wrong()
    box = features.transformed(df, ["k"], "ts", "v", "boxcox")
    assert box.filter("y is null").count() == 0


def test_schema_roles_and_dates(spark):
    rows = [(f"{d:02d}/03/2024", "n" if d % 2 else "s", float(d), int(d % 5 == 0), "bad" if d == 3 else str(d)) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "sale_date string, region string, qty double, promo int, units string")
    roles = schema.infer_roles(df)
    assert roles.timestamp == "sale_date" and roles.hierarchy == ["region"] and roles.event == ["promo"] and roles.dependent == ["qty"]
    assert schema.parse_dates(df, "sale_date", "t").filter("t is null or month(t) <> 3").count() == 0
    fixed, bad = schema.coerce(df, ["units"])
    assert fixed.filter("units = 0").count() == 1 and bad.first().n_bad == 1
    assert not schema.is_time_name("units") and schema.is_time_name("order_ts")
    assert math.isclose(df.agg(F.sum("qty")).first()[0], sum(range(1, 29)))


def test_star_and_underscores_are_values_like_any_other(spark):
    df = spark.createDataFrame([("2024-01-01", "*", "a_", 1.0), ("2024-01-01", "*", "_b", 2.0), ("2024-01-01", "x", "y__z", 4.0), ("2024-01-01", "x__y", "z", 8.0), ("2024-01-01", "\\*", "q", 16.0)], "ts string, r string, s string, v double")
    rolled = hierarchy.rollup(df, ["r", "s"], "ts", {"v": F.sum("v")})
    totals = [r for r in rolled.collect() if r.r == "*"]
    assert len(totals) == 1 and totals[0].v == 31.0
    named = hierarchy.nodes(rolled, ["r", "s"]).collect()
    ids = [r.node_id for r in named]
    assert len(ids) == len(set(ids)) == 1 + 4 + 5
    assert {r.depth for r in named if r.label in ("a_", "_b")} == {2}
    assert set(r.parent_id for r in named if r.depth) <= set(ids)


def test_path_filters_compare_text_without_casting_columns(spark):
    df = spark.createDataFrame([(1, "a"), (10, "b")], "k int, s string")
    assert [r.s for r in hierarchy.path_filter(df, {"k": 1}).collect()] == ["a"]
    assert hierarchy.path_filter(df, {"k": "01"}).count() == 0 and hierarchy.path_filter(df, {"k": "one"}).count() == 0
    assert hierarchy.path_filter(df, {"s": "b", "absent": 3}).count() == 1


def test_gaps_across_days_without_one_window_over_all_times(spark):
    times = ["2024-01-01 00:00", "2024-01-01 06:00", "2024-01-01 06:00", "2024-01-03 06:00", "2024-01-03 12:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.to_timestamp("t").alias("ts"))
    r = resample.median_gap_days(df).first()
    assert (r.n_timestamps, r.n_gaps, r.gap_days, r.regular) == (4, 3, 0.25, False)
    r = resample.median_gap_days(df.filter("false")).first()
    assert (r.n_timestamps, r.n_gaps, r.gap_days) == (0, 0, None)
    two = df.withColumn("k", F.when(F.col("ts") < "2024-01-02", "a").otherwise("b"))
    assert {r.k: (r.n_timestamps, r.regular) for r in resample.median_gap_days(two.filter("ts is not null"), keys=["k"]).collect()} == {"a": (2, True), "b": (2, True)}


def test_series_at_their_frequency_pass_as_they_are(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-02-01", 2.0), ("b", "2024-01-01", 3.0)]
    df = spark.createDataFrame(rows, "k string, d string, v double").select("k", F.to_date("d").alias("ts"), "v")
    assert resample.at_frequency(df, "MS", ["k"]) and not resample.at_frequency(df, "QS", ["k"]) and not resample.at_frequency(df, "MS")
    assert resample.resample_if_needed(df, "MS", {"v": "sum"}, ["k"]).count() == 3
    assert resample.resample_if_needed(df, "YS", {"v": "sum"}, ["k"]).count() == 2


def test_median_slope_of_short_and_long_series():
    from tidemill.operators.kernels import median_slope

    rng = np.random.default_rng(3)
    for n in (2, 3, 60, 301):
        y = np.round(rng.normal(size=n).cumsum(), 2)
        slopes = [(y[j] - y[i]) / (j - i) for i in range(n) for j in range(i + 1, n)]
        assert median_slope(y) == pytest.approx(np.median(slopes), abs=1e-9) and median_slope(y, most=1) == pytest.approx(np.median(slopes), abs=1e-9)
    assert median_slope(np.array([1.0])) is None


def test_profile_counts_kinds_column_by_column(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, None, 1), (4, "b", 0), (4, "a", 0), (5, "b", 0), (6, "b", 1)], "k int, t string, e int")
    got = {r["column"]: r for r in schema.profile(df).collect()}
    assert {c: r.n_distinct for c, r in got.items()} == {"k": 6, "t": 2, "e": 2}
    assert got["t"].is_hierarchy and not got["k"].is_hierarchy and got["e"].is_event and got["t"].n_missing == 1
    assert schema.is_time_name("orderdate") and schema.is_time_name("ts") and not schema.is_time_name("discounts")
