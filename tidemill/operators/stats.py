"""Statistics of series in window and aggregate expressions: autocorrelation, KPSS, trends, component strength."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import chi2_tail, t_below, t_tails
from ..sources.shared import kept
from .decompose import stl
from .kernels import by_series, median_slope, shapiro
from .ranges import Cut, beside, settled, with_windows
from .regress import least_squares
from .windows import ordered


def acf(df: DataFrame, keys: Sequence[str], lags: int = 40, ts: str = "ts", value: str = "v") -> DataFrame:
    """Biased autocorrelations: keys, lag (0 to lags), acf; one window and one aggregate for all lags."""
    keys = list(keys)
    w, order = W.partitionBy(*keys), ordered(keys, ts)
    at = df.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(w))
    moved = at.select(*keys, "_d", *[F.lag("_d", k).over(order).alias(f"_{k}") for k in range(1, lags + 1)])
    bottom = F.sum(F.col("_d") * F.col("_d")) + 1e-12
    one = moved.groupBy(*keys).agg(F.count("*").alias("_n"), *[(F.sum(F.col("_d") * F.col(f"_{k}")) / bottom).alias(f"_{k}") for k in range(1, lags + 1)])
    rows = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), F.coalesce(f"_{k}", F.lit(0.0)).alias("acf")) for k in range(1, lags + 1)])
    return one.select(*keys, F.col("_n").alias("n"), F.inline(rows))


def significant_lags(correlations: DataFrame, keys: Sequence[str], most: int = 10) -> DataFrame:
    """The first lags beyond 1.96 / sqrt(n), with lags up to n / 2 - 1, as an array a series."""
    hit = (F.col("lag") > 0) & (F.col("lag") <= F.floor(F.col("n") / 2) - 1) & (F.abs("acf") > 1.96 / F.sqrt("n"))
    return correlations.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.when(hit, F.col("lag")))), 1, most).alias("lags"))


def ljung_box(correlations: DataFrame, keys: Sequence[str], lags: int = 10) -> DataFrame:
    """Q statistic over the first lags (of residuals): keys, statistic, lags, p_value (the tail of chi-squared)."""
    n = F.col("n")
    part = F.when((F.col("lag") > 0) & (F.col("lag") <= lags), F.pow("acf", 2) / (n - F.col("lag")))
    made = correlations.groupBy(*keys).agg((F.max(n * (n + 2)) * F.sum(part)).alias("statistic"), F.lit(lags).alias("lags"))
    return made.withColumn("p_value", chi2_tail(F.col("statistic"), lags))


def kpss(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Level KPSS statistic without long-run correction, bucketed p value, stationary under 0.463."""
    keys = list(keys)
    w = W.partitionBy(*keys)
    at = df.filter(F.col(value).isNotNull()).withColumn("_e", F.col(value) - F.avg(value).over(w))
    at = at.withColumn("_s", F.sum("_e").over(w.orderBy(ts).rowsBetween(W.unboundedPreceding, 0)))
    n = F.count("*")
    stat = F.sum(F.col("_s") * F.col("_s")) / (n * n) / (F.sum(F.col("_e") * F.col("_e")) / n + 1e-12)
    made = at.groupBy(*keys).agg(stat.alias("statistic"))
    s = F.col("statistic")
    p = F.when(s < 0.347, 0.20).when(s < 0.463, 0.10).when(s < 0.574, 0.05).when(s < 0.739, 0.025).otherwise(0.01)
    return made.withColumn("p_value", p).withColumn("stationary", s < 0.463)


def ols_trend(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Least-squares trend over positions: slope, intercept, r2, t statistic, p value of both its tails, direction."""
    at = df.filter(F.col(value).isNotNull()).withColumn("_x", (F.row_number().over(ordered(keys, ts)) - 1).cast("double"))
    y, x = F.col(value), F.col("_x")
    r2, n = F.regr_r2(y, x), F.count("*")
    made = at.groupBy(*keys).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"))
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2") + 1e-12))
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat")
    made = made.withColumn("t_statistic", t).withColumn("direction", direction)
    return made.withColumn("p_value", t_tails(F.col("t_statistic"), F.greatest(F.col("n") - 2, F.lit(1))))


def adf(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v", at: Cut | None = None) -> DataFrame:
    """Dickey-Fuller with a constant and one lagged difference: keys, statistic, p_value (the lower tail of t, 0.001 to 1),
    stationary under -2.86. A series with fewer than six steps has statistic 0 and p value 1."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"))
    before = lambda order: {"_a": F.lag("_v").over(order), "_b": F.lag("_v").over(order) - F.lag("_v", 2).over(order)}
    known, at = settled(known, ts, at)
    moved = with_windows(known, keys, ts, before, back=2, at=at).withColumn("_y", F.col("_v") - F.col("_a"))
    fit = least_squares(moved, keys, "_y", ["_a", "_b"])
    few = F.col("n") < 5
    made = fit.withColumn("statistic", F.when(few, 0.0).otherwise(F.get("coef", F.lit(0)) / (F.get("error", F.lit(0)) + 1e-12)))
    tail = t_below(F.col("statistic"), F.greatest(F.lit(1), F.col("n") - 3))
    return made.select(*keys, "statistic", F.when(few, 1.0).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(1.0), tail))).alias("p_value"), (~few & (F.col("statistic") < -2.86)).alias("stationary"))


def arch_lm(df: DataFrame, keys: Sequence[str], lags: int = 5, ts: str = "ts", value: str = "residual", at: Cut | None = None) -> DataFrame:
    """Squares regressed on their last ``lags``: keys, n, statistic (n times R2), p_value (the tail of chi-squared)."""
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, (F.col(value) * F.col(value)).cast("double").alias("_s"))
    xs = [f"_s{k}" for k in range(1, lags + 1)]
    known, at = settled(known, ts, at)
    moved = with_windows(known, keys, ts, lambda order: {x: F.lag("_s", k + 1).over(order) for k, x in enumerate(xs)}, back=lags, at=at)
    fit = least_squares(moved, keys, "_s", xs).withColumn("n", F.col("n") + lags).withColumn("statistic", F.col("n") * F.col("r2"))
    return fit.select(*keys, "n", "statistic", chi2_tail(F.col("statistic"), lags).alias("p_value"))


def pacf(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lag, pacf from the rows of ``acf``, up to half of a series: Durbin and Levinson's recursion over its lags."""
    inside = correlations.filter(F.col("lag") <= F.greatest(F.lit(0), F.floor(F.col("n") / 2) - 1))
    r = inside.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("_r")).filter(F.size("_r") > 1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(s: Column, k: Column) -> Column:
        seen = F.slice("_r", 2, k - 1)
        last = (F.get("_r", k) - dot(s["phi"], F.reverse(seen))) / (1 - dot(s["phi"], seen) + 1e-12)
        grown = lambda one: F.struct(F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - one * b), F.array(one)).alias("phi"), F.concat(s["out"], F.array(one)).alias("out"))
        return F.get(F.transform(F.array(last), grown), F.lit(0))

    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    folded = F.aggregate(F.sequence(F.lit(1), F.size("_r") - 1), start, step, lambda s: s["out"])
    return r.select(*keys, F.posexplode(folded).alias("lag", "pacf"))


def normality(residuals: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "residual") -> DataFrame:
    """Shapiro-Wilk rows of series of 8 to 5,000 values, in numpy: keys, test, statistic, p_value, verdict."""

    def one(at: pd.DataFrame) -> pd.DataFrame:
        y = at[value].to_numpy(float)
        made = [("shapiro", *shapiro(y))] if 8 <= len(y) <= 5000 else []
        return pd.DataFrame([(*m, "normal" if m[2] > 0.05 else "not normal") for m in made], columns=["test", "statistic", "p_value", "verdict"])

    sizes = residuals.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n").between(8, 5000))
    return by_series(beside(residuals, sizes, keys), keys, one, "test string, statistic double, p_value double, verdict string", ts, value)


def series_tests(df: DataFrame, keys: Sequence[str], period: int | None = None, ts: str = "ts", value: str = "v", at: Cut | None = None, shapiro_too: bool = False) -> DataFrame:
    """Rows (keys, test, statistic, p_value, verdict) of series of 14 values or more: adf, kpss and the differencing they
    call for, ljung_box and arch_lm of the residual of ``decompose.stl``, trend. All in windows and aggregates, but for
    the normality of residuals that ``shapiro_too`` adds."""
    keys = list(keys)
    df, at = settled(df.select(*keys, ts, value), ts, at)
    parts = kept(stl(df, keys, period, ts, value, at), "components")  # six tests read it
    series = parts.select(*keys, ts, F.col("value").alias(value))
    a, k = adf(series, keys, ts, value, at), kpss(series, keys, ts, value)
    row = lambda df, test, verdict, stat="statistic", p="p_value": df.select(*keys, F.lit(test).alias("test"), F.col(stat).alias("statistic"), F.col(p).cast("double").alias("p_value"), verdict.alias("verdict"))
    either = lambda rule, yes, no: F.when(rule, yes).otherwise(no)
    both = beside(a.select(*keys, "stationary"), k.select(*keys, F.col("stationary").alias("_k")), keys)
    differencing = both.select(*keys, F.when(F.col("stationary") & F.col("_k"), 0.0).otherwise(1.0).alias("statistic"), F.lit(None).cast("double").alias("p_value"))
    portmanteau = ljung_box(acf(parts, keys, 10, ts, "residual"), keys)
    squares, trend = arch_lm(parts, keys, 5, ts, "residual", at), ols_trend(series, keys, ts, value)
    frames = [
        row(a, "adf", either(F.col("stationary"), "stationary", "unit root")),
        row(k, "kpss", either(F.col("stationary"), "stationary", "not stationary")),
        row(differencing, "differencing", F.lit(None).cast("string")),
        row(portmanteau, "ljung_box", either(F.col("p_value") > 0.05, "white", "autocorrelated")),
        row(squares, "arch_lm", either(F.col("p_value") > 0.05, "constant variance", "changing variance")),
        row(trend, "trend", either(F.col("p_value") < 0.05, "significant", "not significant"), "slope"),
    ]
    if shapiro_too:
        frames.append(normality(parts, keys, ts))
    return reduce(DataFrame.unionByName, frames)


def theil_sen(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Median slope of all pairs of points of each series; one series a group, no pair of a long one is written out."""

    def one(at: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"theil_sen": [median_slope(at[value].to_numpy(float))]})

    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias(value))
    return by_series(known, keys, one, "theil_sen double", ts, value)


def strengths(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trend and seasonal strength from trend, seasonal and residual columns."""
    share = lambda c: F.greatest(F.lit(0.0), 1 - F.var_pop("residual") / (F.var_pop(F.col(c) + F.col("residual")) + 1e-12))
    made = components.groupBy(*keys).agg(share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength"))
    word = lambda c: F.when(F.col(c) > 0.6, "Strong").when(F.col(c) > 0.3, "Moderate").otherwise("Weak")
    return made.withColumn("trend_label", word("trend_strength")).withColumn("seasonal_label", word("seasonal_strength"))


def seasonal_component(df: DataFrame, keys: Sequence[str], period: int, ts: str = "ts", detrended: str = "detrended") -> DataFrame:
    """Adds seasonal: the median of each phase of a detrended series, centred by their mean over the series."""
    w = W.partitionBy(*keys)
    phase = F.pmod(F.row_number().over(ordered(keys, ts)) - 1, F.lit(period))
    at = df.withColumn("_p", phase).withColumn("_m", F.percentile(detrended, 0.5).over(W.partitionBy(*keys, "_p")))
    return at.withColumn("seasonal", F.col("_m") - F.avg("_m").over(w)).drop("_p", "_m")
