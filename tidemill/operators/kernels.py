"""Numerical kernels over one series: pure numpy, applied by key as grouped pandas functions.

Every kernel takes the ordered values of one series. ``by_series`` is the only bridge to Spark: it ships the key, time
and value columns alone, so column pruning and key filters before it reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_series(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame | dict | list[dict]], fields: str, ts: str = "ts", value: str = "v", more: Sequence[str] = (), keep_ts: bool = False) -> DataFrame:
    """Apply ``fn`` to each series' rows without nulls, in time order; its rows are prefixed with the key columns."""
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *([f"{ts} {types[ts]}"] if keep_ts else []), fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.dropna(subset=[value]).sort_values(ts).reset_index(drop=True)
        made = fn(at)
        out = made if isinstance(made, pd.DataFrame) else pd.DataFrame(made if isinstance(made, list) else [made])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return per_series(df.select(*keys, ts, value, *more), keys, run, schema)


def per_series(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Grouped pandas function by key; a table without keys is one series."""
    if keys:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    return df.withColumn("_k", F.lit(1)).groupBy("_k").applyInPandas(lambda pdf: fn(pdf.drop(columns="_k")), schema)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro(y: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's approximations (8 to 5,000 values)."""
    from statistics import NormalDist

    x = np.sort(y)
    n = len(x)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = m @ m
    u = 1 / math.sqrt(n)
    # Royston's polynomial coefficients for the two outer weights.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    w = float((a @ x) ** 2 / (((x - x.mean()) ** 2).sum() + 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        z = -math.log(max(1e-12, gamma - math.log1p(-min(w, 1 - 1e-12))))
        mean, deviation = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        k = math.log(n)
        z = math.log1p(-min(w, 1 - 1e-12))
        mean, deviation = 0.0038915 * k**3 - 0.083751 * k**2 - 0.31082 * k - 1.5861, math.exp(0.0030302 * k**2 - 0.082676 * k - 0.4803)
    return w, 1 - NormalDist().cdf((z - mean) / deviation)


def _below(z: np.ndarray) -> int:
    """Pairs i < j with z[j] < z[i], by merging sorted runs of growing length, all runs of a length at once."""
    n, total, run = len(z), 0, 1
    at, place = np.argsort(z, kind="stable"), np.arange(n)  # equal values keep their order and don't count
    rank = np.empty(n, np.int64)
    rank[at] = place
    while run < n:
        order = np.lexsort((rank, place // (2 * run)))
        right = (place[order] // run) % 2
        seen = np.cumsum(1 - right)
        block = place[order] // (2 * run)
        first = np.searchsorted(block, block)
        before = seen - np.where(first > 0, seen[first - 1], 0)
        left = np.minimum(run, n - block * 2 * run)
        total += int(((left - before) * right).sum())
        run *= 2
    return total


def median_slope(y: np.ndarray, most: int = 2000) -> float | None:
    """Median of (y[j] - y[i]) / (j - i) over i < j.

    Up to ``most`` points all slopes are taken; beyond, the middle ones are found by bisection: slopes under s are the
    pairs that y - s x puts out of order, counted in n log n steps.
    """
    n = len(y)
    if n < 2:
        return None
    if n <= most:
        i, j = np.triu_indices(n, 1)
        return float(np.median((y[j] - y[i]) / (j - i)))
    x, pairs, out = np.arange(n, dtype=float), n * (n - 1) // 2, []
    for k in {(pairs - 1) // 2, pairs // 2}:
        step = np.abs(np.diff(y)).max()
        low, high = -step - 1e-9, step + 1e-9  # no slope is beyond the steepest step
        for _ in range(100):
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (low, middle) if _below(y - middle * x) > k else (middle, high)
        out.append((low + high) / 2)
    return float(np.mean(out))


def boxcox_lambda(y: np.ndarray) -> float:
    """Power of the largest profile likelihood between -2 and 2, by golden section."""
    logs = np.log(y)

    def likelihood(k: float) -> float:
        z = logs if abs(k) < 1e-8 else (np.power(y, k) - 1) / k
        return (k - 1) * logs.sum() - len(y) / 2 * math.log(max(z.var(), 1e-300))

    a, b, golden = -2.0, 2.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - golden * (b - a), a + golden * (b - a)
        a, b = (a, d) if likelihood(c) > likelihood(d) else (c, b)
    return (a + b) / 2


def boxcox_transform(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str) -> DataFrame:
    """Adds the Box-Cox transform of each series (log1p where a value is not positive)."""
    schema = df.withColumn(name, df[value].cast("double")).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[value].to_numpy(float) + 1e-6
        held = ~np.isnan(y)
        made = np.full(len(y), np.nan)
        if held.sum() > 2 and (y[held] > 0).all() and y[held].std() > 0:
            k = boxcox_lambda(y[held])
            made[held] = np.log(y[held]) if abs(k) < 1e-8 else (np.power(y[held], k) - 1) / k
        else:
            made[held] = np.log1p(np.maximum(y[held], -1 + 1e-9))
        return pdf.assign(**{name: made})

    return per_series(df, keys, one, schema)
