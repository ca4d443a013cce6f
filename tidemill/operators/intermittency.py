"""Intermittent demand: classification, Croston parts and the Croston family of forecasts as folds of ranges of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import Cut, settled

#: Class: models that suit it, best first.
RECOMMENDED = {
    "Smooth": ["ETS", "ARIMA", "Theta"],
    "Erratic": ["ETS", "Gradient boosting", "Quantile regression"],
    "Intermittent": ["Croston", "SBA", "TSB"],
    "Lumpy": ["SBA", "TSB", "Bootstrap"],
}


def demand_class(adi: Column, cv2: Column, adi_cut: float = 1.32, cv2_cut: float = 0.49) -> Column:
    return (
        F.when((adi < adi_cut) & (cv2 < cv2_cut), "Smooth")
        .when(adi < adi_cut, "Erratic")
        .when(cv2 < cv2_cut, "Intermittent")
        .otherwise("Lumpy")
    )


def classify(df: DataFrame, keys: Sequence[str], value: str = "v", threshold: float = 0.0) -> DataFrame:
    """ADI, CV2, class and demand distribution of each series that has demand above the threshold."""
    v = F.col(value)
    size = F.when(v > threshold, v)
    mean, cv2 = F.avg(size), F.pow(F.coalesce(F.stddev_samp(size), F.lit(0.0)) / (F.avg(size) + 1e-12), 2)
    made = df.groupBy(*keys).agg(F.count(v).alias("n"), F.count(size).alias("n_nonzero"), mean.alias("mean_size"), F.var_samp(size).alias("var_size"), cv2.alias("cv2")).filter("n_nonzero > 0")
    adi = F.col("n") / F.col("n_nonzero")
    ratio = F.col("var_size") / (F.col("mean_size") + 1e-12)
    shape = F.when(F.col("n_nonzero") < 4, F.lit(None)).when(ratio < 0.8, "Binomial").when(ratio < 1.2, "Poisson").otherwise("NegBin")
    return made.withColumn("adi", adi).withColumn("class", demand_class(F.col("adi"), F.col("cv2"))).withColumn("distribution", shape)


def recommendations(classified: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in RECOMMENDED.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    return classified.withColumn("models", table[F.col("class")])


def croston_parts(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v", threshold: float = 0.0) -> DataFrame:
    """Demand sizes and the intervals between them in positions; the first interval is 0."""
    w = W.partitionBy(*keys).orderBy(ts)
    at = df.withColumn("_i", F.row_number().over(w)).filter(F.col(value) > threshold)
    return at.select(*keys, ts, F.col(value).alias("size"), (F.col("_i") - F.coalesce(F.lag("_i").over(w), F.col("_i"))).alias("interval"))


def demand_folds(df: DataFrame, keys: Sequence[str], ts: str, value: str, alpha: float, beta: float, at: Cut) -> DataFrame:
    """One row a series: what is left of its rows after smoothing by ``alpha`` and ``beta`` in time order.

    A demand maps the smoothed size to (1 - alpha) size + alpha demand, the interval likewise, and each row the
    probability; such maps compose to one factor and one sum. Ranges of time are folded apart, a row a range; what stands
    behind a range (demands, rows) then weighs its sums, so no series is ever one task or one array.

    n, hits: rows and demands; first, first_gap: the first demand and its place from 1; size, size_weight: the fold of
    the later demands and the factor of the start; gap: the fold of the intervals behind the first; prob, prob_weight.
    """
    keys = list(keys)
    ranged = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"), at.range_of(F.col(ts)).alias("_range"))
    forward = W.partitionBy(*keys, "_range").orderBy(ts)
    behind = W.partitionBy(*keys, "_range").orderBy(F.desc(ts)).rowsBetween(W.unboundedPreceding, -1)
    hit = F.col("_v") > 0
    rows = ranged.withColumns({
        "_i": F.row_number().over(forward).cast("double"),
        "_hits_behind": F.coalesce(F.count_if(hit).over(behind), F.lit(0)),
        "_rows_behind": F.coalesce(F.count("*").over(behind), F.lit(0)),
    })
    hits = rows.withColumn("_last", F.max(F.when(hit, F.col("_i"))).over(forward.rowsBetween(W.unboundedPreceding, -1)))
    weight = F.pow(F.lit(1.0 - alpha), F.col("_hits_behind"))
    later = hit & F.col("_last").isNotNull()
    opening = hit & F.col("_last").isNull()  # a range's first demand: its interval reaches back over ranges
    total = lambda rule, x: F.coalesce(F.sum(F.when(rule, x)), F.lit(0.0))
    folded = hits.groupBy(*keys, "_range").agg(
        F.count("*").alias("rows"), F.count_if(hit).alias("hits"), F.max(F.when(opening, F.col("_v"))).alias("v1"), F.max(F.when(opening, F.col("_i"))).alias("at1"),
        F.max(F.when(hit, F.col("_i"))).alias("at2"), total(later, alpha * weight * F.col("_v")).alias("size"), total(later, alpha * weight * (F.col("_i") - F.col("_last"))).alias("gap"),
        total(hit, beta * F.pow(F.lit(1.0 - beta), F.col("_rows_behind"))).alias("prob"),
    )
    folded = folded.withColumn("_one", F.lit(0) * F.col("hits"))
    before = W.partitionBy(*keys, "_one").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys, "_one").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    none = lambda x: F.coalesce(x, F.lit(0))
    placed = folded.withColumns({
        "start": none(F.sum("rows").over(before)), "hits_before": none(F.sum("hits").over(before)),
        "hits_after": none(F.sum("hits").over(after)), "rows_after": none(F.sum("rows").over(after)),
    })
    placed = placed.withColumn("last", F.max(F.col("start") + F.col("at2")).over(before))
    rest, own = F.pow(F.lit(1.0 - alpha), F.col("hits_after")), F.pow(F.lit(1.0 - alpha), F.col("hits") - 1)
    first = (F.col("hits_before") == 0) & (F.col("hits") > 0)
    more = (F.col("hits_before") > 0) & (F.col("hits") > 0)
    return placed.groupBy(*keys).agg(
        F.sum("rows").alias("n"), F.sum("hits").alias("hits"), F.max(F.when(first, F.col("v1"))).alias("first"), F.max(F.when(first, F.col("start") + F.col("at1"))).alias("first_gap"),
        F.sum(rest * (F.col("size") + F.when(more, alpha * own * F.col("v1")).otherwise(0.0))).alias("size"),
        F.sum(rest * (F.col("gap") + F.when(more, alpha * own * (F.col("start") + F.col("at1") - F.col("last"))).otherwise(0.0))).alias("gap"),
        F.sum(F.pow(F.lit(1.0 - beta), F.col("rows_after")) * F.col("prob")).alias("prob"),
    ).withColumn("size_weight", F.pow(F.lit(1.0 - alpha), F.greatest(F.col("hits") - 1, F.lit(0)))).withColumn("prob_weight", F.pow(F.lit(1.0 - beta), F.col("n")))


def croston_forecast(df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "v", alpha: float = 0.1, at: Cut | None = None) -> DataFrame:
    """One-step Croston: size from the first demand, interval from 1; null under two demands."""
    df, at = settled(df.select(*keys, ts, value), ts, at)
    s = demand_folds(df, keys, ts, value, alpha, 0.0, at)
    size, gap = F.col("first") * F.col("size_weight") + F.col("size"), F.col("size_weight") + F.col("gap")
    return s.select(*keys, F.when(F.col("hits") >= 2, size / gap).alias("forecast"))


def family_forecast(df: DataFrame, keys: Sequence[str], method: str, horizon: int, ts: str = "ts", value: str = "v", alpha: float = 0.1, beta: float = 0.1, at: Cut | None = None) -> DataFrame:
    """croston, sba or tsb over a horizon (flat, never negative): keys, model, step, forecast; 0 without demand."""
    if method not in ("croston", "sba", "tsb"):
        raise ValueError(f"unknown method {method!r}")
    df, at = settled(df.select(*keys, ts, value), ts, at)
    s = demand_folds(df, keys, ts, value, alpha, beta, at)
    if method == "tsb":  # the first demand also updates a size that starts at it, which changes nothing
        level = (F.col("first") * F.col("size_weight") + F.col("size")) * (F.col("prob_weight") * F.col("hits") / F.col("n") + F.col("prob"))
    else:
        gap = F.greatest(F.lit(1.0), F.col("first_gap")) * F.col("size_weight") + F.col("gap")
        level = (F.col("first") * F.col("size_weight") + F.col("size")) / gap * (1 - alpha / 2 if method == "sba" else 1.0)
    flat = s.select(*keys, F.greatest(F.coalesce(level, F.lit(0.0)), F.lit(0.0)).alias("forecast"))
    return flat.select(*keys, F.lit(method).alias("model"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")
