"""Decomposition, filters, tests and spectra over ranges and blocks, against numpy on whole series."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import decompose, spectrum, stats
from tidemill.operators.ranges import cut


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    wave = lambda n, p: 100 + np.arange(n) + 10 * np.sin(2 * np.pi * np.arange(n) / p) + rng.normal(size=n)
    return {"a": wave(84, 12), "b": wave(15, 5), "c": wave(13, 4), "d": wave(210, 7), None: wave(31, 9), "p": wave(101, 13)}


@pytest.fixture(scope="module")
def frame(spark, series):
    start = datetime.datetime(2020, 1, 1)
    rows = [(k, start + datetime.timedelta(days=i), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    rows += [("a", start - datetime.timedelta(days=1), None)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(5).cache()


def by_key(df, *names):
    out = {}
    for r in df.orderBy("k", "ts" if "ts" in df.columns else "k").collect():
        out.setdefault(r.k, []).append([r[n] for n in names])
    return {k: np.array(v, float).T for k, v in out.items()}


def plain_stl(y, period):
    n = len(y)
    p = max(2, min(period, n // 2))
    half = min(max(2 * p + 1, 7), n if n % 2 else n - 1) // 2
    x = np.arange(-half, half + 1)
    trend = np.empty(n)
    for i in range(n):
        centre = min(max(i, half), n - 1 - half)
        trend[i] = np.polyval(np.polyfit(x, y[centre - half : centre + half + 1], 2), i - centre)
    phase = np.arange(n) % p
    seasonal = np.array([np.median((y - trend)[phase == q]) for q in range(p)])[phase]
    seasonal -= seasonal.mean()
    return trend, seasonal, y - trend - seasonal


@pytest.mark.parametrize("period, ranges", [(12, None), (7, 20), (40, 6)])
def test_components_over_blocks(frame, series, period, ranges):
    at = cut(frame, "ts", ranges, 9) if ranges else None
    got = by_key(decompose.stl(frame, ["k"], period, at=at), "trend", "seasonal", "residual")
    assert set(got) == set(series) - {"c"}
    for k, parts in got.items():
        assert np.allclose(parts, plain_stl(series[k], period), atol=1e-8)


@pytest.mark.parametrize("penalty, block, ranges", [(1600.0, 1 << 14, None), (1600.0, 20, 15), (10.0, 7, 4)])
def test_hp_filter_over_blocks(frame, series, penalty, block, ranges):
    at = cut(frame, "ts", ranges) if ranges else None
    got = by_key(decompose.hp(frame, ["k"], penalty, at=at, block=block), "hp_trend", "cycle")
    assert set(got) == set(series) - {"c"}
    for k, (trend, cycle) in got.items():
        n = len(series[k])
        d = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(trend, np.linalg.solve(np.eye(n) + penalty * d.T @ d, series[k]), rtol=1e-9)
        assert np.allclose(trend + cycle, series[k])


@pytest.mark.parametrize("chirp", [0.0, 0.35, 2.0])
def test_spectrum_against_a_fast_transform(frame, series, chirp):
    rows = {}
    power = spectrum.spectrum(frame.withColumnRenamed("k", "key"), ["key"], chirp=chirp)
    for r in power.collect():
        rows.setdefault(r.key, {})[r.frequency] = r.power
    for k, y in series.items():
        expect = np.abs(np.fft.rfft(y - y.mean())) ** 2
        assert sorted(rows[k]) == list(range(1, len(y) // 2 + 1))
        assert np.allclose([rows[k][i] for i in sorted(rows[k])], expect[1:], rtol=1e-7, atol=1e-6)


def test_periods_are_found(frame, series):
    power = spectrum.spectrum(frame.withColumnRenamed("k", "key"), ["key"], at=cut(frame, "ts", 9))
    one = {r.key: r.period for r in spectrum.dominant_period(power, ["key"]).collect()}
    best = {r.key: r.periods for r in spectrum.strongest_periods(power, ["key"]).collect()}
    for k, y in series.items():
        strength = np.abs(np.fft.rfft(y - y.mean()))
        strength[0] = 0
        assert one[k] == int(np.clip(round(len(y) / np.argmax(strength)), 2, max(2, len(y) // 3)))
        inside = [i for i in np.argsort(strength)[::-1] if 2 < len(y) / max(i, 1e-9) < len(y) / 2][:3]
        assert best[k] == [pytest.approx(len(y) / i, abs=0.0501) for i in inside]


def test_series_tests_against_numpy(frame, series):
    from .test_regress import tails

    got = {}
    for r in stats.series_tests(frame, ["k"], 12, at=cut(frame, "ts", 12, 10)).collect():
        got.setdefault(r.k, {})[r.test] = r
    assert set(got) == set(series) - {"c"}
    for k, told in got.items():
        y = series[k]
        step = np.diff(y)
        x = np.column_stack((np.ones(len(step) - 1), y[1:-1], step[:-1]))
        beta = np.linalg.lstsq(x, step[1:], rcond=None)[0]
        left = step[1:] - x @ beta
        error = np.sqrt(left @ left / (len(x) - 3) * np.linalg.inv(x.T @ x)[1, 1])
        assert told["adf"].statistic == pytest.approx(beta[1] / error, rel=1e-5)
        s = plain_stl(y, 12)[2] ** 2
        x = np.column_stack([s[i : len(s) - 5 + i] for i in range(5)] + [np.ones(len(s) - 5)])
        left = s[5:] - x @ np.linalg.lstsq(x, s[5:], rcond=None)[0]
        stat = len(s) * (1 - left @ left / ((s[5:] - s[5:].mean()) ** 2).sum())
        assert told["arch_lm"].statistic == pytest.approx(stat, rel=1e-5, abs=1e-6)
        assert told["arch_lm"].p_value == pytest.approx(tails(told["arch_lm"].statistic, 5), abs=1e-6)
        assert told["trend"].statistic == pytest.approx(np.polyfit(np.arange(len(y)), y, 1)[0], rel=1e-8)
        assert (told["trend"].verdict == "significant") == (told["trend"].p_value < 0.05)
        assert told["differencing"].statistic == float(not (told["adf"].verdict == told["kpss"].verdict == "stationary"))
