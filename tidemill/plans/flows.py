"""Whole analyses composed of operators: one series, one node, a level, features, forecasts, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.freq import Freq, comparison
from ..operators import crossvar, decompose, features, forecast, hierarchy, interval, intermittency, missing, outliers, reconcile, resample, stats
from ..sources.shared import kept
from .results import flow
from .session import Panel, Session


def _series(panel: Panel, freq: str, value: str, keys: Sequence[str] = (), method: str = "sum") -> DataFrame:
    return resample.resample(panel.df, freq, {value: method}, keys, ts=panel.ts).select(*keys, F.col("bucket").alias("ts"), F.col(value).alias("v"))


@flow
def analyze_series(panel: Panel, freq: str, value: str | None = None, period: int | None = None, keys: Sequence[str] = (), method: str = "sum", methods: Sequence[str] = ("iqr", "zscore"), chart_points: int = 1500):
    """Accumulate, impute, decompose, flag outliers, classify demand, test: a dict of DataFrames keyed by series.

    Keys make every series of a level run in parallel. The imputed series and their components are stored once.
    """
    keys, value = list(keys), value or panel.target
    at = _series(panel, freq, value, keys, method)
    full = missing.impute(at, keys, "linear").select(*keys, "ts", F.col("imputed").alias("v"))
    full = kept(full, "imputed")
    parts = kept(decompose.stl(full, keys, period), "components")
    smooth = decompose.hp(full, keys).drop("value")
    flagged = outliers.detect(parts.select(*keys, "ts", F.col("value").alias("v"), "residual"), keys, [*methods, "residual"], residual="residual")
    summary = resample.series_summary(F.col("v"))
    return {
        "series": at,
        "imputed": full,
        "gaps": missing.gap_summary(at, keys),
        "gap_report": missing.report(at, keys, filled=full.withColumnRenamed("v", "imputed")),
        "components": parts.join(smooth, [*keys, "ts"]),
        "strength": stats.strengths(parts, keys),
        "outliers": flagged,
        "outlier_report": outliers.report(flagged, keys),
        "demand": intermittency.recommendations(intermittency.classify(full, keys)),
        "tests": stats.series_tests(full, keys, period, shapiro_too=True),
        "summary": full.groupBy(*keys).agg(*[c.alias(n) for n, c in summary.items()]),
        "chart": resample.downsample(full, chart_points, keys=keys),
    }, {"freq": freq, "value": value}


@flow
def analyze_node(panel: Panel, path: dict[str, object], freq: str, value: str | None = None, method: str = "sum", period: int | None = None):
    """The same for one node; its path is filtered before anything is read into an aggregate."""
    node = Panel(hierarchy.path_filter(panel.df, path), panel.roles, panel.freq, panel.ts)
    made = analyze_series.__wrapped__(node, freq, value, period, method=method)
    made[0]["leaves"] = hierarchy.leaf_count(node.df, panel.keys) if panel.keys else None
    return made


@flow
def level_stability(panel: Panel, level: str, path: dict[str, object] | None = None, freq: str = "MS", season: str = "M", value: str | None = None, method: str = "sum", most: int | None = 30):
    """Envelope, seasonal profiles, stability, yearly totals and half-span change of a level's series.

    most: series shown (the view's cap); None takes all.
    """
    value = value or panel.target
    below = hierarchy.path_filter(panel.df, path or {}).filter(F.col(level).isNotNull())
    at = resample.resample(below, freq, {value: method}, [level], ts=panel.ts).withColumnRenamed("bucket", "ts")
    at = at if most is None else hierarchy.first_series(at, level, most)
    profile = hierarchy.seasonal_profile(at, [level], "ts", value, season)
    yearly = at.groupBy(level, F.year("ts").alias("year")).agg(F.sum(value).alias(value))
    return {
        "series": at,
        "envelope": hierarchy.envelope(at, "ts", value),
        "profile": profile,
        "combined": hierarchy.combined_profile(profile),
        "stability": hierarchy.stability(at, [level], value),
        "yearly": yearly,
        "yearly_stability": hierarchy.yoy_stability(yearly, [level], value),
        "change": hierarchy.half_span_change(at, [level], "ts", value),
    }


@flow
def rollup_hierarchy(panel: Panel, freq: str = "MS", method: str = "sum", value: str | None = None):
    """All nodes per bucket with their dimension, coherence, effects and sizes."""
    value, levels = value or panel.target, panel.keys
    leaves = resample.resample(panel.df, freq, {value: method}, levels, ts=panel.ts, dense=False)
    rolled = hierarchy.rollup(leaves, levels, "bucket", {value: hierarchy.METHODS[method](F.col(value))})
    return {
        "nodes": hierarchy.nodes(rolled, levels),
        "values": rolled,
        "coherence": hierarchy.coherence(rolled, levels, "bucket", value) if method == "sum" else None,
        "effects": hierarchy.level_effects(rolled, levels, value),
        "sizes": hierarchy.level_sizes(rolled, levels),
    }


@flow
def prepare_features(panel: Panel, freq: str, horizon: int = 1, transform: str = "none", scaling: str = "none", keys: Sequence[str] = (), value: str | None = None, **options):
    """Feature matrix with splits and the labels of each series, future frame and transform advice (auto: each its own)."""
    value, keys = value or panel.target, list(keys)
    at = kept(resample.resample(panel.df, freq, panel.methods(), keys, ts=panel.ts).withColumnRenamed("bucket", "ts"), "prepared")
    exog = {"independent": panel.roles.independent, "events": panel.roles.event}
    matrix = features.prepare(at, keys, "ts", value, transform, scaling, **exog, **options)
    full = missing.impute(at.select(*keys, "ts", F.col(value).alias("v")), keys, "linear").select(*keys, "ts", F.col("imputed").alias("v"))
    parts = decompose.stl(full, keys).withColumnRenamed("value", "v")
    return {
        "matrix": features.with_labels(matrix, kept(parts, "components"), keys, exogenous=bool(panel.roles.independent or panel.roles.event)),
        "future": features.future_frame(at, keys, freq, horizon, "ts", value, **exog),
        "advice": features.auto_transform(at, keys, value),
    }, {"transform": transform}


@flow
def relate(panel: Panel, freq: str | None = None, dependent: str | None = None, max_lag: int = 20, after: int = 5, gain_lags: int = 8):
    """Statistics, correlations, lags, event impact, predictive gain and recommended features of one dependent column
    against the panel's independent and event columns; other dependent columns count as independent."""
    chosen = dependent or panel.target
    others = [c for c in panel.roles.dependent if c != chosen] + [c for c in panel.roles.independent if c != chosen]
    at = panel.df if freq is None else resample.resample(panel.df, freq, panel.methods(), ts=panel.ts, dense=False).withColumnRenamed("bucket", panel.ts)
    return crossvar.relations(at, chosen, others, panel.roles.event, panel.ts, max_lag, after, gain_lags), {"dependent": chosen, "independent": others, "events": panel.roles.event}


@flow
def prepare_forecast(panel: Panel, freq: str, horizon: int = 12, holdout: int = 12, keys: Sequence[str] = (), path: dict[str, object] | None = None, value: str | None = None, treatment: str = "cap", detectors: Sequence[str] = ("iqr", "zscore"), models: Sequence[str] = forecast.MODELS, combinations: bool = True, allow_negative: bool = False):
    """The full chain: filter, accumulate, impute, treat outliers, fit models, score, combine, choose, give intervals."""
    keys, value = list(keys), value or panel.target
    node = Panel(hierarchy.path_filter(panel.df, path or {}), panel.roles, panel.freq, panel.ts)
    full = missing.impute(_series(node, freq, value, keys), keys, "linear").select(*keys, "ts", F.col("imputed").alias("v"))
    flagged = outliers.detect(full, keys, detectors)
    clean = outliers.treat(flagged, keys, treatment).select(*keys, "ts", F.col("treated").alias("v"))
    if treatment == "remove":
        clean = missing.impute(clean, keys, "linear").select(*keys, "ts", F.col("imputed").alias("v"))
    clean = kept(clean, "clean")  # read by each model family, by scores and by intervals
    made = forecast.compare_models(clean, keys, horizon, holdout, Freq.of(freq).period, wanted=models, allow_negative=allow_negative)
    made = kept(made, "models")
    if combinations:
        scored = forecast.metrics(made.filter("part = 'holdout'"), [*keys, "model", "rank"])
        both = forecast.combine(made, scored, keys).withColumn("rank", F.lit(100))
        made = made.unionByName(both.select(*made.columns))
    scored = forecast.metrics(made.filter("part = 'holdout'"), [*keys, "model", "rank"])
    best = forecast.best_model(scored, keys)
    chosen = made.join(best.drop("mape"), [*keys, "model"])
    sigma = forecast.error_sigma(chosen.filter("part = 'holdout'"), clean, keys)
    ahead = chosen.filter("part = 'future'").select(*keys, "model", "step", F.col("yhat").alias("forecast"))
    dated = ahead.join(forecast.future_index(clean, keys, horizon, freq), [*keys, "step"])
    parts = kept(decompose.stl(clean, keys).withColumnRenamed("value", "v"), "components")
    return {
        "components": parts,
        "profile": features.series_profile(parts, keys),
        "features": features.with_labels(features.prepare(clean, keys), parts, keys),
        "future": features.future_frame(clean, keys, freq, horizon),
        "clean": clean,
        "outliers": flagged,
        "models": made,
        "metrics": scored,
        "best": best,
        "forecast": forecast.intervals(dated, sigma, keys, not allow_negative),
    }, {"horizon": horizon, "freq": freq}


@flow
def reconciled_forecast(panel: Panel, freq: str, horizon: int = 13, strategy: str = "bottom_up", middle: int | None = None, value: str | None = None, overrides: DataFrame | None = None, allow_negative: bool = False):
    """Automatic base forecasts of every node on the common grid, reconciled, with overrides if any."""
    value, levels = value or panel.target, panel.keys
    if not levels:
        raise ValueError("reconciliation needs hierarchy columns")
    leaves = resample.resample(panel.df, freq, {value: "sum"}, levels, ts=panel.ts, dense=False)
    history = kept(hierarchy.rollup(leaves, levels, "bucket", {"v": F.sum(value)}), "history")  # base, weights, nodes and summary read it
    dense = resample.densify(history, freq, levels, {"v": 0.0})
    base = kept(forecast.automatic(dense, levels, horizon, freq, "bucket", "v", allow_negative).drop("model"), "base")
    made = reconcile.reconcile(base, history, levels, strategy, middle)
    out = {"history": history, "base": base, "nodes": hierarchy.nodes(history, levels), "weights": reconcile.child_weights(history, levels)}
    if overrides is not None:
        made = reconcile.reallocate(reconcile.override(made, overrides, base, levels), out["weights"], levels)
    out |= {"reconciled": made, "summary": reconcile.node_summary(history, made, levels)}
    return out, {"strategy": strategy, "levels": levels, "freq": freq, "middle": middle}


@flow
def advise_interval(panel: Panel, value: str | None = None, most: int = 3):
    value = value or panel.target
    at = panel.df.groupBy(panel.ts).agg(F.sum(value).alias("v"))
    return interval.advise(at, panel.ts, "v", most)


@flow
def run_pipeline(session: Session, source: object, roles: dict[str, str] | None = None, freq: str | None = None, quantity: str = "flow"):
    """Ingest, advise a frequency, roll up, accumulate and compare, analyse every dependent column."""
    session.load(source)
    panel = session.confirm(roles)
    advice = advise_interval(panel)
    target = freq or (advice.get().first()["freq"] if advice else panel.freq)
    rolled = rollup_hierarchy(panel, target) if panel.keys else None
    session.accumulate(target, quantity=quantity)
    compared = resample.compare_frequencies(panel.df.groupBy("ts").agg(F.sum(panel.target).alias("v")), [target, *comparison(target)], resample.method_for(quantity))
    analyses = {c: analyze_series(panel, target, c) for c in panel.roles.dependent}
    return {"panel": panel, "advice": advice, "hierarchy": rolled, "accumulated": session.current, "compared": compared, "series": analyses}, {"freq": target, "report": report(panel, target, analyses)}


def report(panel: Panel, freq: str, analyses: dict) -> str:
    """Short text on what was analysed."""
    lines = [f"Frequency: {freq} (native {panel.freq})", f"Values: {', '.join(panel.values)}", f"Hierarchy: {' > '.join(panel.keys) or 'none'}"]
    lines += [f"{name}: {'analysed' if made else made.failure}" for name, made in analyses.items()]
    return "\n".join(lines)
