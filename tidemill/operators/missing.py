"""Gaps and imputation. Series are keyed; positions are row numbers in time order, so grids should be dense."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kernels import per_series

NATIVE = ("forward_fill", "backward_fill", "mean", "median", "zero", "linear", "seasonal", "knn")


def joined_by(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per series; without keys both sides are of one series, and the right one has a single row."""
    if keys:
        return a.join(b, list(keys), how)
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k", how).drop("_k")


def zero_as_missing(value: str) -> Column:
    return F.nullif(F.col(value), F.lit(0.0))


def gap_runs(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "v") -> DataFrame:
    """Runs of consecutive missing values: keys, start, end, length."""
    w = W.partitionBy(*keys).orderBy(ts)
    at = df.withColumn("_i", F.row_number().over(w)).filter(F.col(value).isNull())
    island = F.col("_i") - F.row_number().over(w)
    return at.withColumn("_g", island).groupBy(*keys, "_g").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).drop("_g")


def gap_summary(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Per series: n, n_missing, completeness, gap count, longest and mean gap, gap lengths in time order."""
    total = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"))
    runs = gap_runs(df, keys, ts, value).groupBy(*keys).agg(
        F.count("*").alias("n_gaps"), F.max("length").alias("max_gap"), F.avg("length").alias("mean_gap"),
        F.transform(F.sort_array(F.collect_list(F.struct("start", "length"))), lambda x: x["length"]).alias("gap_lengths"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined_by(total, runs, keys, "left").select(*keys, "n", "n_missing", (1 - F.col("n_missing") / F.col("n")).alias("completeness"), zero("n_gaps"), zero("max_gap"), F.coalesce("mean_gap", F.lit(0.0)).alias("mean_gap"), F.coalesce("gap_lengths", F.expr("cast(array() as array<bigint>)")).alias("gap_lengths"))


COMPLETE, MAR, MNAR, MCAR = "COMPLETE", "MAR (end-of-series)", "MNAR", "MCAR"


def missing_pattern(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Per series: pattern and the shares it rests on.

    MAR when over 70 % of gaps lie in the second half; MNAR when over 40 % of the values before gaps exceed the 0.9
    quantile (with more than five values); else MCAR.
    """
    w = W.partitionBy(*keys)
    v = F.col(value)
    at = df.withColumn("_i", F.row_number().over(w.orderBy(ts)) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_q", F.percentile(v, 0.9).over(w)).withColumn("_obs", F.count(v).over(w)).withColumn("_before", F.lag(v).over(w.orderBy(ts)))
    gap = v.isNull()
    late = F.count_if(gap & (F.col("_i") >= F.floor(F.col("_n") / 2))) / F.count_if(gap)
    known = gap & F.col("_before").isNotNull()
    high = F.when(F.max("_obs") > 5, F.count_if(known & (F.col("_before") > F.col("_q"))) / F.count_if(known))
    made = at.groupBy(*keys).agg(F.count_if(gap).alias("n_missing"), F.when(F.count_if(gap) > 0, late).alias("late_share"), F.when(F.count_if(known) > 0, high).alias("high_share"))
    pattern = F.when(F.col("n_missing") == 0, COMPLETE).when(F.col("late_share") > 0.7, MAR).when(F.col("high_share") > 0.4, MNAR).otherwise(MCAR)
    return made.withColumn("pattern", pattern)


def choose_method(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Imputation method of each series by its gaps and pattern."""
    both = joined_by(gap_summary(df, keys, ts, value), missing_pattern(df, keys, ts, value).drop("n_missing"), keys)
    share = F.col("n_missing") / (F.col("n_missing") + 1)  # as published: never under a half, so knn is not reached
    method = F.when(F.col("n_missing") == 0, "none").when(F.col("max_gap") <= 2, "linear").when(F.col("max_gap") <= 7, "spline").when(F.col("pattern") == MAR, "forward_fill").when(share < 0.3, "knn").otherwise("seasonal")
    return both.withColumn("method", method)


def report(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v", filled: DataFrame | None = None) -> DataFrame:
    """A row a series: n, n_missing, pct_missing, pattern, method advised, n_gaps, max_gap, mean_gap, and n_missing_after,
    what is still missing in ``filled`` (keys, imputed), null without it."""
    told = choose_method(df, keys, ts, value)
    share = (100 * F.col("n_missing") / F.col("n")).alias("pct_missing")
    told = told.select(*keys, "n", "n_missing", share, "pattern", "method", "n_gaps", "max_gap", "mean_gap")
    if filled is None:
        return told.withColumn("n_missing_after", F.lit(None).cast("long"))
    return joined_by(told, filled.groupBy(*keys).agg(F.count_if(F.col("imputed").isNull()).alias("n_missing_after")), list(keys), "left")


def imputed(value: str, method: str, w, order, period: int = 7) -> Column:
    """Imputed column for a method; ``w`` partitions the series, ``order`` is the same window in time order."""
    v = F.col(value)
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    if method == "forward_fill":
        made = F.last(v, True).over(before)
    elif method == "backward_fill":
        made = F.first(v, True).over(after)
    elif method in ("mean", "knn"):  # one column has no other feature: nearest neighbours come down to the mean
        made = F.avg(v).over(w)
    elif method == "median":
        made = F.percentile(v, 0.5).over(w)
    elif method == "zero":
        made = F.lit(0.0)
    elif method == "seasonal":
        raise ValueError("seasonal imputation needs positions: use impute()")
    elif method == "linear":
        at = F.struct(F.col("_i").alias("i"), v.alias("v"))
        known = F.when(v.isNotNull(), at)
        a, b = F.last(known, True).over(before), F.first(known, True).over(after)
        line = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"])
        made = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)
    else:
        raise ValueError(f"unknown imputation method {method!r}")
    return F.coalesce(v, made)


def impute(df: DataFrame, keys: Sequence[str], method: str = "auto", period: int = 7, ts: str = "ts", value: str = "v", treat_zero: bool = False) -> DataFrame:
    """``df`` with imputed and was_missing. ``auto`` lets every series have its own method (column method)."""
    keys = list(keys)
    if treat_zero:
        df = df.withColumn(value, zero_as_missing(value))
    if method == "auto":
        chosen = choose_method(df, keys, ts, value).select(*keys, "method")
        at = joined_by(df, chosen, keys)
        # All that windows can say is worked out in one pass over the series; splines need one of their own.
        lines, made = at.filter("method <> 'spline'"), F.col(value)
        for m in ("linear", "forward_fill", "seasonal"):
            lines = impute(lines, keys, m, period, ts, value).withColumnRenamed("imputed", f"_{m}").drop("was_missing")
            made = F.when(F.col("method") == m, F.col(f"_{m}")).otherwise(made)
        lines = lines.withColumn("imputed", made).withColumn("was_missing", F.col(value).isNull()).drop("_linear", "_forward_fill", "_seasonal")
        return lines.unionByName(impute(at.filter("method = 'spline'"), keys, "spline", period, ts, value))
    if method == "spline":
        return spline_impute(df, keys, ts, value)
    w = W.partitionBy(*keys)
    order = w.orderBy(ts)
    at = df.withColumn("_i", F.row_number().over(order) - 1)
    if method == "seasonal":
        phase = F.avg(value).over(W.partitionBy(*keys, F.pmod(F.col("_i"), F.lit(period))))
        made = F.coalesce(F.col(value), phase, F.avg(value).over(w))
    else:
        made = imputed(value, method, w, order, period)
    return at.withColumn("imputed", made).withColumn("was_missing", F.col(value).isNull()).drop("_i")


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y) at ``at``; the nearest value beyond the ends; linear under three points."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y) if n else np.full(len(at), np.nan)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    upper, diag, right = np.zeros(n), np.ones(n), np.zeros(n)
    for i in range(1, n - 1):  # forward sweep of the tridiagonal system for the second derivatives
        low = h[i - 1]
        diag[i] = 2 * (h[i - 1] + h[i]) - low * upper[i - 1]
        upper[i] = h[i] / diag[i]
        right[i] = (6 * (slope[i] - slope[i - 1]) - low * right[i - 1]) / diag[i]
    m = np.zeros(n)
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def spline_impute(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Cubic-spline imputation over positions; one series a group."""
    at = df.select(*df.columns)
    schema = at.withColumn("imputed", F.lit(0.0)).withColumn("was_missing", F.lit(True)).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts).reset_index(drop=True)
        y, x = pdf[value].to_numpy(float), np.arange(len(pdf), dtype=float)
        held = ~np.isnan(y)
        made = y.copy()
        made[~held] = natural_spline(x[held], y[held], x[~held])
        return pdf.assign(imputed=made, was_missing=~held)

    return per_series(at, keys, one, schema)


def impute_wide(df: DataFrame, columns: Sequence[str], ts: str = "ts", method: str = "linear", period: int = 7) -> DataFrame:
    """Impute every value column of one series: unpivoted, imputed by variable in one pass, pivoted back."""
    long = df.unpivot([ts], list(columns), "variable", "v")
    done = impute(long, ["variable"], method, period, ts)
    return done.groupBy(ts).pivot("variable", list(columns)).agg(F.first("imputed"))
