"""Resampling: aggregate a panel to a frequency on a dense grid, compare frequencies, measure what is kept."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.freq import Freq
from .quantiles import exact_quantiles
from .ranges import beside

#: Method of a quantity type: a flow adds up, a stock has a last level, a rate is averaged.
AUTO = {"flow": "sum", "stock": "last", "rate": "mean"}


def method_for(quantity: str) -> str:
    return AUTO[quantity]


def aggregate(method: str, value: Column, ts: Column, tie: Column | None = None) -> Column:
    """One aggregate of a bucket. first and last skip nulls and break ties of time by ``tie``."""
    order = F.struct(ts, tie) if tie is not None else ts
    present = F.when(value.isNotNull(), order)
    made = {
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value),
        "median": lambda: F.percentile(value, 0.5),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "first": lambda: F.min_by(value, present),
        "last": lambda: F.max_by(value, present),
        "count": lambda: F.count(value),
    }
    if method not in made:
        raise ValueError(f"unknown aggregation {method!r}")
    return made[method]()


def _bucketed(df: DataFrame, keys: Sequence[str], ts: str, freq: Freq) -> DataFrame:
    if not freq.needs_origin:
        return df.withColumn("bucket", freq.bucket(F.col(ts)))
    first = df.groupBy(*keys).agg(F.min(ts).alias("_first")) if keys else None
    if first is None:
        return df.withColumn("bucket", freq.bucket(F.col(ts), F.lit(df.agg(F.min(ts)).first()[0])))
    return df.join(first, list(keys)).withColumn("bucket", freq.bucket(F.col(ts), F.col("_first"))).drop("_first")


def resample(
    df: DataFrame,
    freq: str | Freq,
    values: dict[str, str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    tie: str | None = None,
    dense: bool = True,
    exact: bool = False,
) -> DataFrame:
    """Aggregate ``values`` (column to method) per key and bucket; columns: keys, bucket, values.

    dense: emit every bucket between a series' first and last one; empty ones hold 0 for sums and counts, null
    otherwise. exact: add up decimals with two places, so sums don't depend on row order.
    """
    freq, keys = Freq.of(freq), list(keys)
    cols = {}
    for name, method in values.items():
        value = F.col(name).cast("decimal(18,2)") if exact and method == "sum" else F.col(name)
        made = aggregate(method, value, F.col(ts), F.col(tie) if tie else None)
        cols[name] = made.cast("double") if exact and method == "sum" else made
    medians = [n for n, m in values.items() if m == "median"]
    at = _bucketed(df, keys, ts, freq)
    got = at.groupBy(*keys, "bucket").agg(*[c.alias(n) for n, c in cols.items() if n not in medians] or [F.lit(0).alias("_")])
    for name in medians:  # a bucket may hold a third of all rows
        middle = exact_quantiles(at, [*keys, "bucket"], name, [0.5])
        got = beside(got, middle.select(*keys, "bucket", F.get("q", F.lit(0)).alias(name)), [*keys, "bucket"], "left")
    got = got.select(*keys, "bucket", *values)
    if not dense:
        return got
    return densify(got, freq, keys, {n: 0.0 for n, m in values.items() if m in ("sum", "count")})


def densify(df: DataFrame, freq: str | Freq, keys: Sequence[str] = (), fill: dict[str, float] | None = None, bucket: str = "bucket") -> DataFrame:
    """Insert the missing buckets of each series; ``fill`` gives values for them, others are null."""
    freq, keys = Freq.of(freq), list(keys)
    grid = df.groupBy(*keys).agg(freq.sequence(F.min(bucket), F.max(bucket)).alias("_grid")).select(*keys, F.explode("_grid").alias(bucket))
    out = grid.join(df, [*keys, bucket], "left")
    for name, value in (fill or {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.select(*keys, bucket, *[c for c in df.columns if c not in keys and c != bucket])


def at_frequency(df: DataFrame, freq: str | Freq, keys: Sequence[str] = (), ts: str = "ts") -> bool:
    """Whether every time is the start of a bucket and no series has one twice: nothing is left to aggregate."""
    freq = Freq.of(freq)
    if freq.needs_origin:
        return False
    held = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"), F.bool_and(freq.bucket(F.col(ts)).cast("timestamp_ntz") == F.col(ts).cast("timestamp_ntz")).alias("_start"))
    return bool(held.agg(F.coalesce(F.bool_and((F.col("_n") == 1) & F.col("_start")), F.lit(False)).alias("ok")).first()["ok"])


def resample_if_needed(df: DataFrame, freq: str | Freq, values: dict[str, str], keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """``resample`` without gaps filled, or the rows as they are where the series already have the frequency."""
    if at_frequency(df, freq, keys, ts):
        return df.select(*keys, F.col(ts).alias("bucket"), *values)
    return resample(df, freq, values, keys, ts, dense=False)


def ohlc(df: DataFrame, freq: str | Freq, value: str = "v", keys: Sequence[str] = (), ts: str = "ts", tie: str | None = None) -> DataFrame:
    freq, keys = Freq.of(freq), list(keys)
    order = F.col(tie) if tie else None
    at = lambda m: aggregate(m, F.col(value), F.col(ts), order)
    return _bucketed(df, keys, ts, freq).groupBy(*keys, "bucket").agg(at("first").alias("open"), at("max").alias("high"), at("min").alias("low"), at("last").alias("close"))


def series_summary(value: Column) -> dict[str, Column]:
    """n, n_missing, mean, std (n - 1), min, max and share of zeros of a column."""
    return {
        "n": F.count(value),
        "n_missing": F.count_if(value.isNull()),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        "pct_zero": F.avg(F.when(value.isNotNull(), (value == 0).cast("double"))) * 100,
    }


def compare_frequencies(df: DataFrame, freqs: Sequence[str], method: str = "sum", value: str = "v", ts: str = "ts", exact: bool = False) -> DataFrame:
    """Statistics of a series at several frequencies: freq, n, mean, std, cv, total (sums only), min, max, pct_zero."""
    frames = []
    if method in ("sum", "min", "max") and not any(Freq.of(f).days < 1 for f in freqs):  # days once, all else from them
        df = resample(df, "D", {value: method}, ts=ts, dense=False, exact=exact).withColumnRenamed("bucket", ts)
    for name in freqs:
        at = resample(df, name, {value: method}, ts=ts, exact=exact)
        stats = series_summary(F.col(value))
        cv = F.stddev_samp(value) / (F.avg(value) + F.lit(1e-12))
        total = F.sum(value) if method == "sum" else F.lit(None).cast("double")
        frames.append(at.agg(F.lit(name).alias("freq"), *[stats[k].alias(k) for k in ("n", "mean", "std", "min", "max", "pct_zero")], cv.alias("cv"), total.alias("total")))
    return reduce(DataFrame.unionByName, frames)


def retention(original: DataFrame, accumulated: DataFrame, value: str = "v") -> DataFrame:
    """One row: retention = min(1, variance kept), 1 for a constant original; compression = rows in per row out."""
    a = original.agg(F.var_samp(value).alias("var_in"), F.count(value).alias("n_in")).withColumn("_k", F.lit(1))
    b = accumulated.agg(F.var_samp(value).alias("var_out"), F.count(value).alias("n_out")).withColumn("_k", F.lit(1))
    kept = F.when(F.coalesce("var_in", F.lit(0.0)) <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("var_out") / (F.col("var_in") + 1e-12)))
    return a.join(b, "_k").select("n_in", "n_out", kept.alias("retention"), (F.col("n_in") / F.col("n_out")).alias("compression"))


def median_gap_days(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Per series: distinct timestamps, gaps seen, median gap in days, whether all gaps are equal."""
    # Gaps inside a day are found day by day; one row a day tells those between days. Equal gaps are counted first.
    times = df.filter(F.col(ts).isNotNull()).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).distinct().withColumn("_day", F.floor(F.col("_t") / 86_400_000_000))
    inside = times.select(*keys, (F.col("_t") - F.lag("_t").over(W.partitionBy(*keys, "_day").orderBy("_t"))).alias("_gap"))
    days = times.groupBy(*keys, "_day").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    between = days.select(*keys, (F.col("_a") - F.lag("_b").over(W.partitionBy(*keys).orderBy("_day"))).alias("_gap"))
    counted = inside.unionByName(between).filter("_gap is not null").groupBy(*keys, "_gap").agg(F.count("*").alias("_n"))
    gaps = counted.groupBy(*keys).agg(F.sum("_n").alias("n_gaps"), (F.percentile("_gap", 0.5, F.col("_n")) / F.lit(86_400e6)).alias("gap_days"), (F.count("*") <= 1).alias("regular"))
    seen = days.groupBy(*keys).agg(F.min("_a").alias("_a"))
    made = seen.join(gaps, list(keys), "left") if keys else seen.join(gaps, how="cross")  # a row each
    n = F.coalesce("n_gaps", F.lit(0))
    return made.select(*keys, (n + F.when(F.col("_a").isNotNull(), 1).otherwise(0)).cast("long").alias("n_timestamps"), n.cast("long").alias("n_gaps"), "gap_days", F.coalesce("regular", F.lit(True)).alias("regular"))


def detect_frequency(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Median-gap frequency of each series; daily when there are fewer than two timestamps."""
    days = F.col("gap_days")
    unit = F.when(days.isNull() | (days <= 1), "D").when(days <= 7, "W").when(days <= 31, "MS").when(days <= 92, "QS").otherwise("YS")
    return median_gap_days(df, ts, keys).withColumn("freq", unit)


def downsample(df: DataFrame, points: int, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """At most ``points`` rows of each series, evenly spread from the first to the last."""
    order = W.partitionBy(*keys).orderBy(ts)
    ranked = df.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    step = (F.col("_n") - 1) / F.lit(max(1, points - 1))
    near = F.ceil(F.col("_i") / step)
    chosen = F.floor(near * step) == F.col("_i")
    return ranked.filter((F.col("_n") <= points) | chosen).drop("_i", "_n")
