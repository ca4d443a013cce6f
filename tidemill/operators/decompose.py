"""Decomposition of series: local quadratic trend, centred medians of the phases, the rest; Hodrick-Prescott trend.

A series is cut in blocks of positions with a halo (``ranges``), so its length is not bounded by a task. All but the
filter, which solves each block in numpy, are windows and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ranges import BLOCK, Cut, beside, over_blocks, positions, settled
from .spectrum import dominant_period, spectrum

#: Series under so many values are left out.
LEAST_ROWS = 14


def quadratic_smooth(placed: DataFrame, keys: Sequence[str], value: str, half: Column, most: int, name: str = "trend", block: int = BLOCK) -> DataFrame:
    """Adds the value at each row of the least-squares parabola through the ``half`` rows on each side of it.

    placed: rows with their position ``_i`` and their series' length ``_n``. most: the largest half width. Inner rows are a
    weighted sum over a window; the first and last rows are read off the parabolas through the first and last whole
    window, which six sums a series give.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    near = lambda order: {"_near": F.collect_list(F.struct(F.col("_i").alias("i"), v.alias("v"))).over(order.rowsBetween(-most, most))}
    at = over_blocks(placed.withColumn("_h", half), keys, near, most, most, block)
    h, i, n = F.col("_h").cast("double"), F.col("_i"), F.col("_n")
    weight = lambda d: 3 * (3 * h * h + 3 * h - 1 - 5 * d * d) / ((2 * h - 1) * (2 * h + 1) * (2 * h + 3))
    inner = F.aggregate("_near", F.lit(0.0), lambda s, x: s + F.when(F.abs(x["i"] - i) <= h, weight(x["i"] - i) * x["v"]).otherwise(0.0))
    width = 2 * F.col("_h") + 1
    squares = h * (h + 1) / 3  # mean of the squared distances
    spread = h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15 - (2 * h + 1) * squares * squares
    sums, ends = {}, {}
    for side, inside, d in (("a", i < width, i - F.col("_h")), ("z", i >= n - width, i - n + 1 + F.col("_h"))):
        part = lambda x, inside=inside: F.sum(F.when(inside, x))
        sums |= {f"_m{side}": part(v) / F.max(2 * h + 1), f"_b{side}": part(d * v) / F.max(h * (h + 1) * (2 * h + 1) / 3), f"_c{side}": part((d * d - squares) * v) / F.max(spread)}
        ends[side] = F.col(f"_m{side}") + F.col(f"_b{side}") * d + F.col(f"_c{side}") * (d * d - squares)
    curves = placed.withColumn("_h", half).groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    told = beside(at, curves, keys)
    smooth = F.when(i < F.col("_h"), ends["a"]).when(i >= n - F.col("_h"), ends["z"]).otherwise(inner)
    return told.withColumn(name, smooth).drop("_near", "_h", *sums)


def phase_medians(placed: DataFrame, keys: Sequence[str], value: str, period: Column, name: str = "seasonal") -> DataFrame:
    """Adds the median of a row's phase, less the mean of these over the series; phases are positions modulo the period."""
    keys = list(keys)
    at = placed.withColumn("_phase", F.pmod(F.col("_i"), period))
    medians = at.groupBy(*keys, "_phase").agg(F.percentile(value, 0.5).alias("_m"), F.count("*").alias("_k"))
    centre = medians.groupBy(*keys).agg((F.sum(F.col("_m") * F.col("_k")) / F.sum("_k")).alias("_c"))
    told = beside(at, beside(medians.drop("_k"), centre, keys), [*keys, "_phase"])
    return told.withColumn(name, F.col("_m") - F.col("_c")).drop("_phase", "_m", "_c")


def stl(df: DataFrame, keys: Sequence[str], period: int | None = None, ts: str = "ts", value: str = "v", at: Cut | None = None) -> DataFrame:
    """keys, ts, value, trend, seasonal, residual, period of each known value: a trend over two periods, at least seven
    values, the centred median of each phase of what it leaves, and the rest.

    period: without one, each series takes that of its strongest frequency. It is at most half of a series; series under
    14 values are left out. Times of a series differ.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("value"))
    known, at = settled(known, ts, at)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_ROWS)
    wanted = F.lit(period)
    if period is None:
        found = kept(dominant_period(spectrum(known, keys, ts, "value", at), keys).drop("n").withColumnRenamed("period", "_period"), "periods")
        sizes, wanted = beside(sizes, found, keys), F.col("_period")
        period = found.agg(F.max("_period")).first()[0] or 2  # the windows' width
    placed = beside(positions(known, keys, ts, at), sizes, keys)
    p = F.greatest(F.lit(2), F.least(wanted, F.floor(F.col("_n") / 2))).cast("int")
    half = F.least(F.greatest(p, F.lit(3)), F.floor((F.col("_n") - 1) / 2)).cast("int")
    smooth = quadratic_smooth(placed.withColumn("period", p), keys, "value", half, max(3, period), "trend", at.block)
    left = phase_medians(smooth.withColumn("_left", F.col("value") - F.col("trend")), keys, "_left", F.col("period"))
    return left.select(*keys, ts, "value", "trend", "seasonal", (F.col("_left") - F.col("seasonal")).alias("residual"), "period")


def _pentadiagonal(y: np.ndarray, penalty: float) -> np.ndarray:
    """The trend of consecutive values: (I + penalty D'D) z = y for second differences D, by elimination along the band."""
    n = len(y)
    if n < 3:
        return y
    d = np.zeros((3, n + 2))  # the diagonal and the two beside it
    for diagonal, weights in enumerate(((1, 4, 1), (-2, -2), (1,))):
        for shift, w in enumerate(weights):
            d[diagonal, shift : shift + n - 2] += penalty * w
    d[0] += 1
    one, two, pivot, z = [0.0] * n, [0.0] * n, [0.0] * n, y.tolist()
    p1 = p2 = l1 = l2 = k2 = z1 = z2 = 0.0  # pivots, multipliers and values of the last two rows
    for i, (a, b, c) in enumerate(d[:, :n].T.tolist()):
        pivot[i] = a - l1 * l1 * p1 - k2 * k2 * p2
        one[i] = (b - l2 * l1 * p1) / pivot[i]
        two[i] = c / pivot[i]
        z[i] -= l1 * z1 + k2 * z2
        p2, p1, k2, l1, l2, z2, z1 = p1, pivot[i], l2, one[i], two[i], z1, z[i]
    after = later = 0.0
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / pivot[i] - one[i] * after - two[i] * later
        later, after = after, z[i]
    return np.array(z)


def hp(df: DataFrame, keys: Sequence[str], penalty: float = 1600.0, ts: str = "ts", value: str = "v", at: Cut | None = None, block: int = 1 << 14) -> DataFrame:
    """keys, ts, value, hp_trend, cycle of each known value: the Hodrick-Prescott filter. Times of a series differ.

    A value's influence on the trend falls by e in 1.4 penalty^(1/4) rows, so blocks of positions are solved apart, each
    with so many rows on both sides that what lies beyond is less than rounding. Series under 14 values are left out.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("value"))
    known, at = settled(known, ts, at)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_ROWS)
    placed = beside(positions(known, keys, ts, at), sizes, keys).drop("_n")
    halo = math.ceil(60 * max(1.0, penalty) ** 0.25)
    of = lambda x: F.floor(x / F.lit(block))
    dealt = placed.withColumn("_block", F.explode(F.sequence(F.greatest(F.lit(0), of(F.col("_i") - halo)), of(F.col("_i") + halo))))
    kinds = dict(known.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, ts)), "value double, hp_trend double, cycle double"])

    def one(at: pd.DataFrame) -> pd.DataFrame:
        at = at.sort_values("_i").reset_index(drop=True)
        own = at["_i"] // block == at["_block"].iloc[0]
        if not own.any():  # a block of copies alone, behind the end
            return pd.DataFrame(columns=[*keys, ts, "value", "hp_trend", "cycle"])
        y = at["value"].to_numpy()
        trend = _pentadiagonal(y, penalty)
        return at.assign(hp_trend=trend, cycle=y - trend)[own][[*keys, ts, "value", "hp_trend", "cycle"]]

    return dealt.groupBy(*keys, "_block").applyInPandas(one, schema)
