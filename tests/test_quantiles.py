"""Exact quantiles, local outlier factors, as-of alignment and one-pass profiles against plain computations."""

import bisect
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import align, outliers, resample, schema
from tidemill.operators.quantiles import exact_quantiles
from tidemill.operators.ranges import cut


def values():
    rng = np.random.default_rng(2)
    made = {"hot": np.round(rng.lognormal(3, 2, 9000), 1), "ties": rng.integers(0, 3, 500).astype(float), "far": np.append(rng.normal(size=700), [1e300, -1e300]), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=50)}
    return made


@pytest.mark.parametrize("accuracy", [50, 5000])
def test_exact_quantiles(spark, accuracy):
    made = values()
    rows = [(k, float(v)) for k, vs in made.items() for v in vs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.003, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", shares, accuracy).collect()}
    assert set(got) == set(made)
    for k, v in made.items():
        assert got[k].n == len(v) and got[k].q == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12)
    whole = exact_quantiles(df, [], "v", [0.5], accuracy).first().q[0]
    assert whole == pytest.approx(np.median(np.concatenate(list(made.values()))))


def test_medians_of_buckets(spark):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [(start + datetime.timedelta(hours=h), float(rng.randrange(99))) for h in range(2000) for _ in range(1 + 5 * (h < 300))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    got = {r.bucket.month: (r.v, r.w) for r in resample.resample(df.withColumn("w", F.col("v")), "MS", {"v": "median", "w": "sum"}).collect()}
    for month in (1, 2, 3):
        mine = [v for t, v in rows if t.month == month]
        assert got[month] == (pytest.approx(np.median(mine)), pytest.approx(sum(mine)))


def plain_lof(x, k):
    order = np.argsort(x, kind="stable")
    s, n = x[order], len(x)
    near = []
    for i in range(n):
        span = [j for j in range(max(0, i - k), min(n, i + k + 1)) if j != i]
        near.append(sorted(span, key=lambda j: (abs(s[j] - s[i]), j))[:k])
    reach = [abs(s[m[-1]] - s[i]) for i, m in enumerate(near)]
    density = [1 / (np.mean([max(abs(s[j] - s[i]), reach[j]) for j in m]) + 1e-10) for i, m in enumerate(near)]
    out = np.empty(n)
    out[order] = [np.mean([density[j] for j in m]) / density[i] for i, m in enumerate(near)]
    return out


@pytest.mark.parametrize("ranges, block", [(None, 1 << 17), (12, 9)])
def test_local_outlier_factor_over_ranges(spark, ranges, block):
    rng = np.random.default_rng(5)
    made = {"a": np.append(rng.normal(size=90), 40.0), "b": np.array([1.0, 1.0, 1.0, 2.0, 9.0, 9.5]), "few": np.array([1.0, 2.0, 3.0]), None: rng.integers(0, 9, 40).astype(float)}
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + datetime.timedelta(days=i), float(v)) for k, vs in made.items() for i, v in enumerate(vs)] + [("a", start, None)], "k string, ts timestamp_ntz, v double")
    at = cut(df, "v", ranges) if ranges else None
    got = {}
    for r in outliers.local_outlier_factor(df, ["k"], k=8, at=at, block=block).collect():
        got.setdefault(r.k, {})[r.ts] = r.lof
    assert set(got) == {"a", "b", None}
    for k, found in got.items():
        assert [found[t] for t in sorted(found)] == pytest.approx(plain_lof(made[k], min(8, len(made[k]) - 1)).tolist())
    flagged = outliers.detect(df.filter("v is not null"), ["k"], ["lof", "iqr"]).filter("k = 'a' and lof").collect()
    assert 40.0 in {r.v for r in flagged} and len(flagged) == 5


@pytest.mark.parametrize("ranges", [1, 40])
def test_asof_alignment(spark, ranges):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    when = lambda: start + datetime.timedelta(minutes=rng.randrange(3000))
    a = [(rng.choice(["x", "x", "y", None]), when(), i) for i in range(400)] + [("x", None, 999), ("alone", when(), 1000)]
    b = list({(k, t): (k, t, rng.random()) for k, t in ((rng.choice(["x", "y", None]), when()) for _ in range(120))}.values()) + [("x", None, 5.0)]
    left, right = spark.createDataFrame(a, "k string, ts timestamp_ntz, id int"), spark.createDataFrame(b, "k string, ts timestamp_ntz, w double")
    for tolerance in (None, 3600.0):
        got = {r.id: (r.k, r.ts, r.w) for r in align.asof(left, right, ["w"], ["k"], tolerance=tolerance, at=cut(left, "ts", ranges)).collect()}
        assert len(got) == len(a)
        for k, t, i in a:
            known = sorted((s, w) for q, s, w in b if q == k and s is not None)
            place = bisect.bisect_right([s for s, _ in known], t) if t else 0
            expect = known[place - 1] if place else (None, None)
            if tolerance and place and (t - expect[0]).total_seconds() > tolerance:
                expect = (None, None)
            assert got[i] == (k, t, expect[1])


def test_profiles_in_two_passes_and_by_sketch(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}", i % 2, f"u{i}", None if i % 4 else float(i)) for i in range(40)], "a int, b string, c int, d string, e double")
    exact, near = ({r["column"]: r for r in schema.profile(df, e).collect()} for e in (True, False))
    assert {c: r.n_distinct for c, r in exact.items()} == {"a": 40, "b": 3, "c": 2, "d": 40, "e": 10}
    for c, r in exact.items():
        assert (r.is_event, r.is_hierarchy, r.n_missing) == (near[c].is_event, near[c].is_hierarchy, near[c].n_missing)
    assert exact["b"].is_hierarchy and not exact["d"].is_hierarchy and near["b"].n_distinct == 3
    assert {r["column"]: r.n_distinct for r in schema.profile(df.filter("false")).collect()} == dict.fromkeys("abcde", 0)
