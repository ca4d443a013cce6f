"""Feature matrices for forecasting: transforms, lags, rolling statistics, calendar, exogenous columns, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.freq import Freq
from ..functions.scalars import calendar, corrected_skew, log_shifted
from . import windows
from .ranges import beside

DEFAULT_LAGS = (1, 2, 3, 7, 14, 28, 30)
TRANSFORMS = ("none", "log", "diff", "log_diff", "boxcox", "auto")


def auto_transform(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Per series: diff when a value is not positive, log when skewed beyond 1, else none."""
    made = df.groupBy(*keys).agg(F.min(value).alias("least"), corrected_skew(F.col(value)).alias("skew"))
    return made.withColumn("transform", F.when(F.col("least") <= 0, "diff").when(F.abs("skew") > 1, "log").otherwise("none"))


def transformed(df: DataFrame, keys: Sequence[str], ts: str, value: str, transform: str, times: int = 0, name: str = "y") -> DataFrame:
    """Adds the transformed target. diff takes at least one difference; unknown transforms are errors. auto takes for each
    series what ``auto_transform`` advises for it."""
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform!r}")
    if transform == "boxcox":
        from .kernels import boxcox_transform

        return boxcox_transform(df, keys, ts, value, name)
    if transform == "auto":
        step = F.col(value) - F.lag(value).over(windows.ordered(keys, ts))
        told = beside(df, auto_transform(df, keys, value).select(*keys, F.col("transform").alias("_t"), F.col("least").alias("_least")), keys)
        made = F.when(F.col("_t") == "log", log_shifted(F.col(value), F.col("_least"))).when(F.col("_t") == "diff", step).otherwise(F.col(value))
        return told.withColumn(name, made).drop("_t", "_least")
    out = df
    if transform in ("log", "log_diff"):
        least = F.min(value).over(W.partitionBy(*keys))
        out = out.withColumn(name, log_shifted(F.col(value), least))
    else:
        out = out.withColumn(name, F.col(value))
    if transform in ("diff", "log_diff"):
        out = windows.difference(out, name, keys, ts, max(1, times), "_d").drop(name).withColumnRenamed("_d", name)
    return out


def select_lags(significant: Sequence[int] | None, n: int) -> list[int]:
    """The first eight significant lags, or the usual ones, that a series of ``n`` rows can hold."""
    chosen = sorted(significant)[:8] if significant else list(DEFAULT_LAGS)
    return [k for k in chosen if k < n // 3]


def chosen_lags(significant: Column, n: Column) -> Column:
    """``select_lags`` of a series as an array: from its significant lags and its length."""
    usual = F.array(*[F.lit(k) for k in DEFAULT_LAGS])
    chosen = F.when(F.size(significant) > 0, F.slice(F.sort_array(significant), 1, 8)).otherwise(usual)
    return F.filter(chosen, lambda k: k < F.floor(n / 3))


def series_profile(components: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v") -> DataFrame:
    """One row a series: series_id, a hier_ column for each key, n, first, last, mean, cv, pct_zero, strengths with their
    labels, demand class and the family of models these suggest.

    components: the series with trend, seasonal and residual.
    """
    from . import forecast, intermittency, stats

    keys = list(keys)
    v = F.col(value)
    extent = components.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.avg(v).alias("mean"), (F.stddev_samp(v) / (F.abs(F.avg(v)) + 1e-12)).alias("cv"),
        (F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))) * 100).alias("pct_zero"),
    )
    demand = intermittency.classify(components, keys, value).select(*keys, "class")
    made = beside(beside(extent, demand, keys, "left"), stats.strengths(components, keys), keys)
    model = forecast.recommend(F.col("class"), F.col("trend_strength"), F.col("seasonal_strength"), F.lit(0))
    return made.select((F.concat_ws("|", *keys) if keys else F.lit(value)).alias("series_id"), *[F.col(k).alias(f"hier_{k}") for k in keys], *[c for c in made.columns if c not in keys], model.alias("model"))


def feature_matrix(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    target: str = "v",
    lags: Sequence[int] = DEFAULT_LAGS,
    rolling: Sequence[int] = (7, 14, 28),
    independent: Sequence[str] = (),
    events: Sequence[str] = (),
    with_calendar: bool = True,
) -> DataFrame:
    """Target, lags, trailing rolling statistics, calendar and exogenous columns, all from one window of each series."""
    order = windows.ordered(keys, ts)
    made = windows.lags(target, lags, order)
    for width in rolling:
        made |= windows.rolling(target, width, order)
    if with_calendar:
        made |= calendar(F.col(ts))
    for c in independent:
        made |= {f"indep__{c}": F.col(c), f"indep_lag1__{c}": F.lag(c).over(order)}
    for c in events:
        made |= {f"event__{c}": F.col(c), f"event_roll7__{c}": windows.running_sum(c, 7, order)}
    return df.select(*keys, ts, F.col(target).alias("target"), *[c.alias(n) for n, c in made.items()])


def with_labels(matrix: DataFrame, components: DataFrame, keys: Sequence[str], value: str = "v", exogenous: bool = False) -> DataFrame:
    """The matrix with what is known of each series: series_id and hier_ columns, model_type_recommendation,
    intermittency_class, trend_strength_Ft, seasonal_strength_Fs, has_exogenous. Null for series too short to decompose."""
    from .forecast import with_exogenous

    told = series_profile(components, keys, value=value)
    names = {"class": "intermittency_class", "trend_strength": "trend_strength_Ft", "seasonal_strength": "seasonal_strength_Fs"}
    told = told.select(*[F.col(f"hier_{k}").alias(k) for k in keys], "series_id", *[f"hier_{k}" for k in keys], F.col("model").alias("model_type_recommendation"), *[F.col(a).alias(b) for a, b in names.items()])
    if exogenous:
        swaps = F.create_map(*[F.lit(x) for m in ("ETS", "SARIMA", "ARIMA") for x in (m, with_exogenous(m, True))])
        told = told.withColumn("model_type_recommendation", F.coalesce(F.try_element_at(swaps, F.col("model_type_recommendation")), F.col("model_type_recommendation")))
    return beside(matrix, told, keys, "left").withColumn("has_exogenous", F.lit(exogenous))


SCALERS = {
    "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
    "robust": lambda c: (F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)),
}


def scale(df: DataFrame, columns: Sequence[str], method: str, fit_on: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Scale columns with statistics of the rows where ``fit_on`` holds; a spread of zero divides by one."""
    if method == "none":
        return df
    if method not in SCALERS:
        raise ValueError(f"unknown scaling {method!r}")
    keys = list(keys)
    stats = []
    for c in columns:
        centre, spread = SCALERS[method](F.col(c))
        stats += [centre.alias(f"_c_{c}"), F.when(spread == 0, 1.0).otherwise(spread).alias(f"_s_{c}")]
    fitted = df.filter(fit_on).groupBy(*(keys or [F.lit(1).alias("_k")])).agg(*stats)
    out = (df if keys else df.withColumn("_k", F.lit(1))).join(fitted, keys or ["_k"], "left")
    return out.select(*[((F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def future_frame(df: DataFrame, keys: Sequence[str], freq: str | Freq, horizon: int, ts: str = "ts", target: str = "v", **features) -> DataFrame:
    """Feature rows of the ``horizon`` periods after each series; what history cannot know is null.

    History and future are unioned before the windows, so lags and rolling statistics line up with the matrix.
    """
    freq, keys = Freq.of(freq), list(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last")) if keys else df.agg(F.max(ts).alias("_last"))
    ahead = last.select(*keys, F.explode(freq.future(F.col("_last"), horizon)).alias(ts))
    both = df.withColumn("_future", F.lit(False)).unionByName(ahead.withColumn("_future", F.lit(True)), allowMissingColumns=True)
    made = feature_matrix(both, keys, ts, target, **features)
    step = both.select(*keys, ts, "_future", F.row_number().over(W.partitionBy(*keys, "_future").orderBy(ts)).alias("step")).filter("_future").drop("_future")
    return made.join(step, [*keys, ts]).drop("target")


def prepare(df: DataFrame, keys: Sequence[str], ts: str = "ts", target: str = "v", transform: str = "none", scaling: str = "none", train: float = 0.7, validation: float = 0.15, **features) -> DataFrame:
    """Transform, features, complete rows only, temporal split, scaling fitted on the training rows."""
    at = transformed(df, keys, ts, target, transform).drop(target).withColumnRenamed("y", target)
    matrix = feature_matrix(at, keys, ts, target, **features)
    matrix = windows.split(matrix.na.drop(), keys, ts, train, validation)
    numeric = [c for c in matrix.columns if c.startswith(("lag_", "roll_", "indep"))]
    return scale(matrix, numeric, scaling, F.col("split") == "train", keys)
