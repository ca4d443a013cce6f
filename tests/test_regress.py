"""Tails of distributions and least squares in columns, against numpy and plain sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import special
from tidemill.operators.regress import least_squares


def tails(x, df):
    """Upper tail of chi-squared by summing its density."""
    s = np.linspace(max(x, 1e-12), max(x, 1e-12) + 40 * df + 400, 2_000_001)
    density = np.exp((df / 2 - 1) * np.log(s) - s / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
    return float(((density[1:] + density[:-1]) / 2 * np.diff(s)).sum())


def test_log_gamma_and_tails(spark):
    rng = random.Random(1)
    rows = [(float(df), x) for df in (1, 2, 3, 5, 10, 37, 200, 5000) for x in (0.0, 1e-9, 0.3, 1.0, 4.0, df * 0.7, df * 1.0, df * 1.3, df + 60.0)]
    rows += [(float(rng.randrange(1, 400)), rng.expovariate(0.01)) for _ in range(60)]
    df = spark.createDataFrame(rows, "df double, x double")
    for r in df.select("*", special.lgamma(F.col("df") / 2).alias("g"), special.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect():
        assert r.g == pytest.approx(math.lgamma(r.df / 2), abs=1e-10, rel=1e-12)
        assert r.df < 3 or r.p == pytest.approx(tails(r.x, r.df), abs=1e-6)
        assert r.df != 2 or r.p == pytest.approx(math.exp(-r.x / 2), abs=1e-14)
    even = df.select("x", special.chi2_tail(F.col("x"), 10).alias("p")).collect()
    assert all(r.p == pytest.approx(math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(5)), abs=1e-13) for r in even)


def test_t_tails_against_a_sum(spark):
    rows = [(t, v) for v in (1.0, 2.0, 5.0, 30.0, 1000.0, 200000.0) for t in (-40.0, -2.5, -0.01, 0.0, 0.2, 1.96, 9.0)]
    df = spark.createDataFrame(rows, "t double, v double")
    for r in df.select("*", special.t_tails(F.col("t"), F.col("v")).alias("p"), special.t_below(F.col("t"), F.col("v")).alias("c")).collect():
        s = np.linspace(0, abs(r.t), 400_001)
        density = np.exp(math.lgamma((r.v + 1) / 2) - math.lgamma(r.v / 2)) / math.sqrt(r.v * math.pi) * (1 + s * s / r.v) ** (-(r.v + 1) / 2)
        inside = float(((density[1:] + density[:-1]) / 2 * np.diff(s)).sum())
        assert r.p == pytest.approx(1 - 2 * inside, abs=1e-7)
        assert r.c == pytest.approx(0.5 + math.copysign(inside, r.t), abs=1e-7)
    one = spark.range(1).select(special.beta_below(2.0, 3.0, F.lit(0.4)).alias("b"), special.t_tails(F.lit(None).cast("double"), 3).alias("n")).first()
    assert one.b == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5))) and one.n is None


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, n, size in (("a", 60, 1.0), ("b", 300, 1e7), ("c", 7, 1e-3)):
        x = rng.normal(size=(n, 3)) * [1, 1e6, 1e-4] + [5, 1e7, 0]
        y = size * (x @ [2, 3e-6, 1e3] + 1 + rng.normal(size=n))
        rows += [(key, *map(float, row), float(v)) for row, v in zip(x, y)]
    rows += [("a", None, 1.0, 2.0, 3.0), ("d", 1.0, 1.0, 1.0, 2.0), ("d", 1.0, 2.0, 1.0, 4.0), ("d", 1.0, 3.0, 1.0, 6.0), ("e", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, p double, q double, r double, y double").repartition(4)
    got = {r.k: r for r in least_squares(df, ["k"], "y", ["p", "q", "r"]).collect()}
    assert set(got) == set("abcd")
    for k in "abc":
        part = np.array([r[1:] for r in rows if r[0] == k and None not in r], float)
        x = np.column_stack((np.ones(len(part)), part[:, :3]))
        scale = np.sqrt((x * x).sum(axis=0))
        beta = np.linalg.lstsq(x / scale, part[:, 3], rcond=None)[0] / scale
        left, centre = part[:, 3] - x @ beta, x[:, 1:] - x[:, 1:].mean(axis=0)
        error = np.sqrt(left @ left / (len(x) - 4) * np.diag(np.linalg.inv(centre.T @ centre)))
        r2 = 1 - left @ left / ((part[:, 3] - part[:, 3].mean()) ** 2).sum()
        assert got[k].n == len(part) and got[k].r2 == pytest.approx(r2, rel=1e-6)
        assert [got[k].intercept, *got[k].coef] == pytest.approx(beta.tolist(), rel=1e-5)
        assert got[k].error == pytest.approx(error.tolist(), rel=1e-4)
    assert got["d"].coef == pytest.approx([0, 2, 0]) and got["d"].r2 == pytest.approx(1)
    twice = least_squares(df.filter("k = 'a'").withColumn("p2", F.col("p") * 3), [], "y", ["p", "p2", "q"]).first()
    assert twice.coef[1] == 0.0 and twice.coef[0] != 0.0
