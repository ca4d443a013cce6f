"""Forecasts as long tables: models by series, metrics, best model, combinations, intervals, automatic choice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.freq import Freq
from . import intermittency
from .kernels import by_series
from .missing import joined_by
from .models import run_models
from .ranges import Cut, beside, cut, over_blocks, positions, settled
from .regress import least_squares
from .windows import ordered

MODELS = ("ETS", "ARIMA", "LinearRegression", "FLANN", "RecurrentFLANN", "RVFL")
#: Place of each model in the order of registration.
RANKS = {m: i for i, m in enumerate(("Croston", "SBA", "TSB", "ETS", "ARIMA", "ARIMAX", "LinearRegression", "FLANN", "RecurrentFLANN", "RVFL"))}


def compare_models(df: DataFrame, keys: Sequence[str], horizon: int, holdout: int = 12, period: int = 12, d: int = 1, wanted: Sequence[str] = MODELS, ts: str = "ts", value: str = "v", exog: Sequence[str] = (), allow_negative: bool = False, **options) -> DataFrame:
    """Rows (keys, model, rank, part, step, y, yhat): holdout steps with their actuals, then future steps.

    rank is the order of registration. Values under zero are clipped unless allowed or seen in the history.
    """
    wanted, exog = list(wanted), list(exog)
    unknown = set(wanted) - set(RANKS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    frames = []
    if "LinearRegression" in wanted:
        wanted.remove("LinearRegression")
        frames.append(linear_forecast(df, keys, horizon, holdout, period, ts, value, exog, allow_negative))

    def one(at: pd.DataFrame) -> pd.DataFrame:
        y = at[value].to_numpy(float)
        h = min(holdout, len(y) // 3)
        x = at[exog].fillna(0.0).to_numpy(float) if exog else None
        rows = []
        if len(y) > h + 6 and h > 0:
            for name, (test, ahead) in run_models(y, h, horizon, period, d, wanted, x, **options).items():
                rank = RANKS[name]
                low = 0.0 if not allow_negative and y.min() >= 0 else -np.inf
                rows += [(name, rank, "holdout", i + 1, float(a), float(max(low, p))) for i, (a, p) in enumerate(zip(y[-h:], test))]
                rows += [(name, rank, "future", i + 1, None, float(max(low, p))) for i, p in enumerate(ahead)]
        return pd.DataFrame(rows, columns=["model", "rank", "part", "step", "y", "yhat"])

    if wanted:
        frames.insert(0, by_series(df, keys, one, "model string, rank int, part string, step int, y double, yhat double", ts, value, exog))
    return reduce(DataFrame.unionByName, frames)


def linear_forecast(df: DataFrame, keys: Sequence[str], horizon: int, holdout: int = 12, period: int = 12, ts: str = "ts", value: str = "v", exog: Sequence[str] = (), allow_negative: bool = False, at: Cut | None = None) -> DataFrame:
    """Least squares on lags 1, 2 and the period and on exogenous columns (0 where null, and ahead): rows as those of
    ``compare_models``. Fitted before the holdout, whose steps see real lags; the future goes on from its own values.

    Lags are windows over ranges, the fit is one aggregate, and what the future needs of a series is its last period.
    Series of fewer than ``holdout`` + 7 values (the holdout a third at most), or five whole rows, are left out.
    """
    keys, exog = list(keys), list(exog)
    lags = [1, 2] + ([period] if period > 2 else [])
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_e{i}") for i, c in enumerate(exog)])
    known, at = settled(known, ts, at)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("y").alias("_low"))
    sizes = sizes.withColumn("_h", F.least(F.lit(holdout), F.floor(F.col("_n") / 3))).filter((F.col("_h") > 0) & (F.col("_n") > F.col("_h") + 6))
    placed = beside(positions(known, keys, ts, at), sizes, keys)
    rows = over_blocks(placed, keys, lambda order: {f"_x{k}": F.lag("y", k).over(order) for k in lags}, back=max(lags), ahead=0, block=at.block)
    columns = [*(f"_x{k}" for k in lags), *(f"_e{i}" for i in range(len(exog)))]
    test = F.col("_i") >= F.col("_n") - F.col("_h")
    fit = least_squares(rows.filter(~test), keys, "y", columns).filter("n >= 5").select(*keys, "intercept", "coef")
    clip = lambda v: F.greatest(v, F.lit(0.0)) if allow_negative is False else v
    low = lambda v: F.when(F.col("_low") >= 0, clip(v)).otherwise(v)
    about = lambda part: [*keys, F.lit("LinearRegression").alias("model"), F.lit(RANKS["LinearRegression"]).alias("rank"), F.lit(part).alias("part")]
    line = F.col("intercept") + sum((F.get("coef", F.lit(j)) * F.col(c) for j, c in enumerate(columns)), F.lit(0.0))
    whole = [F.col(f"_x{k}").isNotNull() for k in lags]
    seen = beside(rows.filter(test), fit, keys).select(*about("holdout"), (F.col("_i") - F.col("_n") + F.col("_h") + 1).cast("int").alias("step"), "y", F.when(reduce(lambda a, b: a & b, whole), low(line)).alias("yhat"))

    def step(s: Column, _: Column) -> Column:
        made = F.col("intercept") + sum((F.get("coef", F.lit(j)) * F.get(s, F.size(s) - k) for j, k in enumerate(lags)), F.lit(0.0))
        return F.concat(s, F.array(made))

    last = placed.filter(F.col("_i") >= F.col("_n") - max(lags)).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "y"))), lambda x: x["y"]).alias("_past"), F.first("_low").alias("_low"))
    ahead = beside(last, fit, keys).withColumn("_all", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_past"), step))
    future = ahead.select("*", F.posexplode(F.slice("_all", F.size("_past") + 1, F.lit(horizon))).alias("_p", "_f"))
    return seen.unionByName(future.select(*about("future"), (F.col("_p") + 1).alias("step"), F.lit(None).cast("double").alias("y"), low(F.col("_f")).alias("yhat")))


def metrics(predictions: DataFrame, keys: Sequence[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE and MAPE (over actuals that aren't 0) of rows where both are finite."""
    y, p = F.col(actual), F.col(predicted)
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    at = predictions.filter(good(y) & good(p))
    miss = F.abs(y - p)
    return at.groupBy(*keys).agg(F.avg(miss).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), (F.avg(F.when(F.abs(y) > 1e-8, miss / F.abs(y))) * 100).alias("mape"), F.count("*").alias("n"))


def best_model(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The model of the least MAPE (model, rank, mape in ``scored``); of equals, the one registered last."""
    order = F.struct(F.col("mape"), -F.col("rank"))
    known = scored.filter(F.col("mape").isNotNull())
    return known.groupBy(*keys).agg(F.min_by("model", order).alias("model"), F.min("mape").alias("mape"))


def combine(predictions: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combination forecasts of each step: mean, mean weighted by 1 / MAPE, median, mean of the best three."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("mape", "rank")
    ranked = scored.filter(F.col("mape").isNotNull()).select(*keys, "model", F.row_number().over(order).alias("place"), (1 / F.when(F.col("mape") > 0, F.col("mape")).otherwise(1e-9)).alias("w"))
    at = predictions.join(ranked, [*keys, "model"])
    p = F.col("yhat")
    made = at.groupBy(*keys, "part", "step").agg(
        F.count("*").alias("n"), F.max("y").alias("y"), F.avg(p).alias("Combo:SimpleAvg"), (F.sum(p * F.col("w")) / F.sum("w")).alias("Combo:WeightedAvg"),
        F.percentile(p, 0.5).alias("Combo:Median"), F.avg(F.when(F.col("place") <= 3, p)).alias("Combo:Top3Avg"),
    )
    names = ["Combo:SimpleAvg", "Combo:WeightedAvg", "Combo:Median", "Combo:Top3Avg"]
    return made.filter("n >= 2").unpivot([*keys, "part", "step", "y"], names, "model", "yhat")


def intervals(future: DataFrame, sigma: DataFrame, keys: Sequence[str], non_negative: bool = True) -> DataFrame:
    """Adds lower_95 and upper_95: 1.96 sigma sqrt(step) about a forecast; sigma has (keys, sigma)."""
    keys = list(keys)
    at = joined_by(future, sigma, keys)
    band = F.lit(1.96) * F.col("sigma") * F.sqrt(F.col("step"))
    low = F.col("forecast") - band
    return at.withColumn("lower_95", F.greatest(low, F.lit(0.0)) if non_negative else low).withColumn("upper_95", F.col("forecast") + band)


def error_sigma(holdout: DataFrame, history: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """Spread of holdout errors (y - yhat), else of the first differences of the history."""
    keys = list(keys)
    errors = holdout.groupBy(*keys).agg(F.stddev_samp(F.col("y") - F.col("yhat")).alias("_e"))
    steps = history.select(*keys, (F.col(value) - F.lag(value).over(ordered(keys, ts))).alias("_d")).groupBy(*keys).agg(F.stddev_samp("_d").alias("_s"))
    return joined_by(steps, errors, keys, "left").select(*keys, F.coalesce(F.when(F.col("_e") > 0, F.col("_e")), "_s", F.lit(1.0)).alias("sigma"))


def seasonal_naive(df: DataFrame, keys: Sequence[str], horizon: int, period: int, ts: str = "ts", value: str = "v") -> DataFrame:
    """The last season repeated: keys, step, forecast; series shorter than a season are left out."""
    w = W.partitionBy(*keys)
    at = df.withColumn("_b", F.row_number().over(w.orderBy(F.desc(ts)))).withColumn("_n", F.count("*").over(w)).filter((F.col("_b") <= period) & (F.col("_n") >= period))
    place = period - F.col("_b") + 1
    steps = F.filter(F.sequence(F.lit(1), F.lit(horizon)), lambda s: (s - 1) % period + 1 == place)
    return at.select(*keys, F.explode(steps).alias("step"), F.col(value).alias("forecast"))


def drift(df: DataFrame, keys: Sequence[str], horizon: int, ts: str = "ts", value: str = "v") -> DataFrame:
    """The line through the first and last value, continued: keys, step, forecast."""
    ends = df.groupBy(*keys).agg(F.min_by(value, ts).alias("_a"), F.max_by(value, ts).alias("_z"), F.count("*").alias("_n"))
    slope = (F.col("_z") - F.col("_a")) / F.greatest(F.col("_n") - 1, F.lit(1))
    return ends.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), F.col("_z").alias("_z"), slope.alias("_s")).select(*keys, "step", (F.col("_z") + F.col("_s") * F.col("step")).alias("forecast"))


def baseline(df: DataFrame, keys: Sequence[str], horizon: int, period: int, trend_strength: float, seasonal_strength: float, ts: str = "ts", value: str = "v") -> DataFrame:
    """Last value, drift where the trend is strong, centred last season where the season is; not under 0 if history isn't."""
    keys = list(keys)
    w = W.partitionBy(*keys)
    base = drift(df, keys, horizon, ts, value) if trend_strength > 0.5 else df.groupBy(*keys).agg(F.max_by(value, ts).alias("forecast")).select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")
    if seasonal_strength > 0.5 and period > 1:
        season = seasonal_naive(df, keys, horizon, period, ts, value)
        last = df.withColumn("_b", F.row_number().over(w.orderBy(F.desc(ts)))).filter(F.col("_b") <= period).groupBy(*keys).agg(F.avg(value).alias("_m"))
        shift = joined_by(season, last, keys).select(*keys, "step", (F.col("forecast") - F.col("_m")).alias("_s"))
        base = base.join(shift, [*keys, "step"], "left").withColumn("forecast", F.col("forecast") + F.coalesce("_s", F.lit(0.0))).drop("_s")
    low = df.groupBy(*keys).agg((F.min(value) >= 0).alias("_p"))
    return joined_by(base, low, keys).withColumn("forecast", F.when(F.col("_p"), F.greatest("forecast", F.lit(0.0))).otherwise(F.col("forecast"))).drop("_p")


def automatic(df: DataFrame, keys: Sequence[str], horizon: int, freq: str | Freq, ts: str = "ts", value: str = "v", allow_negative: bool = False) -> DataFrame:
    """Per series, in expressions alone: repeat a single value; SBA or TSB by demand class; seasonal naive; drift."""
    keys = list(keys)
    period = Freq.of(freq).period
    known = df.filter(F.col(value).isNotNull())
    size = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    kind = intermittency.classify(known, keys, value).select(*keys, "class")
    how = joined_by(size, kind, keys, "left").select(
        *keys,
        F.when(F.col("_n") == 1, "repeat").when(F.col("class") == "Intermittent", "sba").when(F.col("class") == "Lumpy", "tsb").when((F.col("_n") >= period) & F.lit(period > 1), "seasonal_naive").otherwise("drift").alias("model"),
    )
    at = joined_by(known, how, keys)
    part = lambda m: at.filter(F.col("model") == m)
    made = drift(at.filter(F.col("model").isin("drift", "repeat")), keys, horizon, ts, value)
    made = made.unionByName(seasonal_naive(part("seasonal_naive"), keys, horizon, period, ts, value))
    ranges = cut(df, ts)
    for m in ("sba", "tsb"):
        made = made.unionByName(intermittency.family_forecast(part(m), keys, m, horizon, ts, value, at=ranges).drop("model"))
    out = joined_by(made, how, keys)
    return out if allow_negative else out.withColumn("forecast", F.greatest("forecast", F.lit(0.0)))


def future_index(df: DataFrame, keys: Sequence[str], horizon: int, freq: str | Freq, ts: str = "ts") -> DataFrame:
    """(keys, step, ts) of the periods after each series' last bucket."""
    freq = Freq.of(freq)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_l"))
    return last.select(*keys, F.posexplode(freq.future(F.col("_l"), horizon)).alias("_p", ts)).select(*keys, (F.col("_p") + 1).alias("step"), ts)


def recommend(kind: Column, trend: Column, seasonal: Column, differencing: Column) -> Column:
    """Model family by demand class, then by trend and seasonal strength and differencing order."""
    return (
        F.when(kind == "Lumpy", "TSB").when(kind == "Intermittent", "SBA").when(kind == "Erratic", "LightGBM")
        .when((seasonal > 0.6) & (trend > 0.3), "ETS").when(seasonal > 0.6, "SARIMA").when((trend > 0.6) | (differencing > 0), "ARIMA").otherwise("ETS")
    )


def with_exogenous(model: str, has_exog: bool) -> str:
    """The model's form that takes exogenous columns."""
    return {"ARIMA": "ARIMAX", "SARIMA": "ARIMAX", "ETS": "LinearRegression"}.get(model, model) if has_exog else model


def timeline(observed: DataFrame, split: str, forecasts: DataFrame, ts: str = "ts", value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """One row per series and timestamp with observed, train, validation, test, holdout and forecast columns."""
    parts = {c: F.when(F.col(split) == c, F.col(value)) for c in ("train", "validation", "test", "holdout")}
    past = observed.select(*keys, ts, F.col(value).alias("observed"), *[c.alias(n) for n, c in parts.items()], F.lit(None).cast("double").alias("forecast"))
    ahead = forecasts.select(*keys, ts, "forecast")
    return past.unionByName(ahead, allowMissingColumns=True).groupBy(*keys, ts).agg(*[F.max(c).alias(c) for c in ("observed", *parts, "forecast")])
