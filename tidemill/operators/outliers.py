"""Outlier detectors, consensus severity and treatment, per series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .kernels import per_series
from .missing import joined_by
from .quantiles import exact_quantiles
from .ranges import BLOCK, Cut, beside, over_blocks, positions, settled

KERNELS = ("isof", "lof")


def fences(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Quartiles and the 1.5 and 3 IQR fences of each series; no series is gathered for them."""
    q = exact_quantiles(df, keys, value, [0.25, 0.75])
    lo, hi = F.col("q")[0], F.col("q")[1]
    side = lambda m: [(lo - m * (hi - lo)), (hi + m * (hi - lo))]
    inner, outer = side(1.5), side(3.0)
    return q.select(*keys, lo.alias("q1"), hi.alias("q3"), (hi - lo).alias("iqr"), inner[0].alias("lower"), inner[1].alias("upper"), outer[0].alias("far_lower"), outer[1].alias("far_upper"))


def local_outlier_factor(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v", k: int = 20, at: Cut | None = None, block: int = BLOCK) -> DataFrame:
    """keys, ts, lof of each known value of series of five values or more: how thin a value lies beside its neighbours.

    Values are sorted in ranges, so neighbours stand side by side; distances, reach and densities are three windows of
    ``k`` rows, in blocks with a halo of three times as many. k is at most the length of a series less one.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"))
    known, at = settled(known, "_v", at)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n >= 5").select(*keys, F.least(F.lit(k), F.col("_n") - 1).cast("int").alias("_k"))
    placed = beside(positions(known, keys, "_v", at, ties=[ts]), sizes, keys)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.col("_k")
    around = lambda name, what: lambda order: {name: F.collect_list(F.struct("_i", what)).over(order.rowsBetween(-k, k))}
    others = F.filter("_around", lambda x: x["_i"] != F.col("_i"))
    nearest = F.array_sort(F.transform(others, lambda x: F.struct(F.abs(x["_v"] - F.col("_v")).alias("d"), x["_i"].alias("i"))))
    at_place = lambda name, x, what: F.get(F.col(name), (x["i"] - F.col(name)[0]["_i"]).cast("int"))[what]
    stages = [
        around("_around", "_v"),
        lambda order: {"_near": F.slice(nearest, F.lit(1), F.col("_k"))},
        lambda order: {"_reach": F.get("_near", F.col("_k") - 1)["d"]},
        around("_reaches", "_reach"),
        lambda order: {"_density": 1 / (mean(F.transform("_near", lambda x: F.greatest(x["d"], at_place("_reaches", x, "_reach")))) + 1e-10)},
        around("_thick", "_density"),
        lambda order: {"lof": mean(F.transform("_near", lambda x: at_place("_thick", x, "_density"))) / F.col("_density")},
    ]
    return over_blocks(placed, keys, stages, 3 * k, 3 * k, block).select(*keys, ts, "lof")


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Isolation-forest scores of one-dimensional points: a tree is a nested set of random cuts of the line."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(2, size))))
    mean_depth = lambda n: 0.0 if n < 2 else (1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
    total = np.zeros(len(x))
    for _ in range(trees):
        picked = np.sort(rng.choice(x, size, replace=False))
        stack = [(picked, np.arange(len(x)), 0)]
        while stack:
            part, rows, depth = stack.pop()
            if depth >= limit or len(part) < 2 or part[0] == part[-1] or not len(rows):
                total[rows] += depth + mean_depth(len(part))
                continue
            cut = rng.uniform(part[0], part[-1])
            at, left = np.searchsorted(part, cut), x[rows] < cut
            stack += [(part[:at], rows[left], depth + 1), (part[at:], rows[~left], depth + 1)]
    return 2.0 ** (-total / trees / max(mean_depth(size), 1e-12))


def flag_share(score: np.ndarray, share: float = 0.05) -> np.ndarray:
    """The highest scores: those above the (1 - share) quantile."""
    return score > np.quantile(score, 1 - share)


def _isolated(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """keys, ts, isof: an isolation forest a series, one series a group (the numbers it draws follow one another)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        held, flag = ~np.isnan(x), np.zeros(len(x), bool)
        if held.sum() >= 10:
            flag[held] = flag_share(isolation_scores(x[held]))
        return pdf[[*keys, ts]].assign(isof=flag)

    types = dict(df.dtypes)
    return per_series(df.select(*keys, ts, value), keys, one, ", ".join([*(f"{c} {types[c]}" for c in (*keys, ts)), "isof boolean"]))


def _thin(df: DataFrame, keys: Sequence[str], ts: str, value: str, share: float = 0.05) -> DataFrame:
    """keys, ts, lof: whether a value's local outlier factor is above the (1 - share) quantile of its series."""
    scores = kept(local_outlier_factor(df, keys, ts, value), "factors")
    limits = exact_quantiles(scores, keys, "lof", [1 - share]).select(*keys, F.get("q", F.lit(0)).alias("_limit"))
    return beside(scores, limits, keys).select(*keys, ts, (F.col("lof") > F.col("_limit")).alias("lof"))


def detect(df: DataFrame, keys: Sequence[str], methods: Sequence[str] = ("iqr", "zscore"), ts: str = "ts", value: str = "v", residual: str | None = None, iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """``df`` with one flag a detector, score (share of detectors), severity, is_outlier, flagged_by.

    ``residual`` needs a residual column and is left out without one. Quartiles, moments and local densities come from
    aggregates and windows over ranges; only isof runs on one series a group.
    """
    keys, methods = list(keys), [m for m in methods if m != "residual" or residual]
    unknown = set(methods) - {"iqr", "zscore", "residual", *KERNELS}
    if unknown or not methods:
        raise ValueError(f"unknown or no outlier methods: {sorted(unknown)}")
    out, extra = df, []
    for name, made in (("isof", _isolated), ("lof", _thin)):
        if name in methods:
            told = made(df, keys, ts, value)
            on = [F.col(f"`{c}`").eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate([*keys, ts])]
            out = out.join(told.select(*[F.col(f"`{c}`").alias(f"_on{i}") for i, c in enumerate([*keys, ts])], name), on, "left").drop(*[f"_on{i}" for i in range(len(on))])
    moments = {c: name for name, c in (("zscore", value), ("residual", residual)) if name in methods}
    if moments:
        told = df.groupBy(*keys).agg(*[f(c).alias(f"_{kind}{name}") for c, name in moments.items() for kind, f in (("m", F.avg), ("s", F.stddev_pop))])
        out, extra = beside(out, told, keys), extra + [c for c in told.columns if c not in keys]
    if "iqr" in methods:
        told = exact_quantiles(df, keys, value, [0.25, 0.75]).select(*keys, F.col("q").alias("_q"))
        out, extra = beside(out, told, keys, "left"), [*extra, "_q"]
    far = lambda c, name: F.when(F.col(f"_s{name}") > 0, F.abs(F.col(c) - F.col(f"_m{name}")) / F.col(f"_s{name}") > z)
    made = {name: far(c, name) for c, name in moments.items()}
    wide = iqr * (F.col("_q")[1] - F.col("_q")[0])
    made["iqr"] = (F.col(value) < F.col("_q")[0] - wide) | (F.col(value) > F.col("_q")[1] + wide)
    out = out.withColumns({m: F.coalesce(made[m] if m in made else F.col(m), F.lit(False)) for m in methods}).drop(*extra)
    flags = [F.col(m).cast("int") for m in methods]
    score = sum(flags[1:], flags[0]) / len(methods)
    out = out.withColumn("score", score)
    hit = F.col("score") > 0
    return (
        out.withColumn("severity", F.when(~hit, F.lit(None)).when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.4, "MEDIUM").otherwise("LOW"))
        .withColumn("is_outlier", hit)
        .withColumn("flagged_by", F.filter(F.array(*[F.when(F.col(m), F.lit(m)) for m in methods]), lambda x: x.isNotNull()))
    )


def advice(detected: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Adds a treatment text: cap to the fences for low and medium severity, look into high severity."""
    limits = fences(detected, keys, value).select(*keys, "lower", "upper")
    cap = F.format_string("cap to [%.4f, %.4f]", "lower", "upper")
    return joined_by(detected, limits, keys).withColumn("treatment", F.when(F.col("severity") == "HIGH", "investigate / impute").when(F.col("is_outlier"), cap)).drop("lower", "upper")


def treat(detected: DataFrame, keys: Sequence[str], treatment: str = "cap", value: str = "v") -> DataFrame:
    """Adds treated: outliers capped to the 1.5 IQR fences, removed (null), or kept."""
    v = F.col(value)
    if treatment == "keep":
        return detected.withColumn("treated", v)
    if treatment == "remove":
        return detected.withColumn("treated", F.when(~F.col("is_outlier"), v))
    if treatment != "cap":
        raise ValueError(f"unknown treatment {treatment!r}")
    limits = fences(detected, keys, value).select(*keys, "lower", "upper")
    capped = F.least(F.greatest(v, F.col("lower")), F.col("upper"))
    joined = joined_by(detected, limits, keys)
    return joined.withColumn("treated", F.when(F.col("is_outlier"), capped).otherwise(v)).drop("lower", "upper")


def worst(detected: DataFrame, ts: str = "ts", most: int = 10) -> DataFrame:
    """The report's list: the highest scores, earliest first among equals."""
    return detected.filter("is_outlier").orderBy(F.desc("score"), ts).limit(most)


def report(detected: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """A row a series: n, n_outliers, pct_outliers, high, medium and low, mean and spread with and without the outliers,
    and the fences."""
    v, hit = F.col(value), F.col("is_outlier")
    of = lambda level: F.count_if(F.col("severity") == level).alias(level.lower())
    told = detected.groupBy(*keys).agg(
        F.count(v).alias("n"), F.count_if(hit).alias("n_outliers"), (100 * F.avg(hit.cast("int"))).alias("pct_outliers"), of("HIGH"), of("MEDIUM"), of("LOW"),
        F.avg(v).alias("mean"), F.avg(F.when(~hit, v)).alias("mean_without"), F.stddev_samp(v).alias("std"), F.stddev_samp(F.when(~hit, v)).alias("std_without"),
    )
    return beside(told, fences(detected, keys, value), list(keys), "left")
