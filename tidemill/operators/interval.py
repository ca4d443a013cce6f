"""Interval advice: scores of candidate frequencies for a series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.freq import Freq
from ..sources.shared import kept
from .resample import median_gap_days, resample
from .spectrum import spectrum, strongest_periods
from .windows import centred_mean

#: Fixed values. Candidate: periods a year, days.
CANDIDATES = {"H": (8760, 1 / 24), "D": (365, 1.0), "W": (52, 7.0), "2W": (26, 14.0), "MS": (12, 30.44), "QS": (4, 91.3), "YS": (1, 365.25)}


def signal_noise(at: DataFrame, keys: Sequence[str], bucket: str, value: str, width: int) -> DataFrame:
    """Per series: variance of the centred trend over variance of what it leaves, and the lag-1 autocorrelation."""
    w = W.partitionBy(*keys)
    order = w.orderBy(bucket)
    x = at.withColumn("_t", centred_mean(value, width, order)).withColumn("_d", F.col(value) - F.avg(value).over(w))
    x = x.withColumn("_l", F.lag("_d").over(order))
    snr = F.var_pop("_t") / (F.var_pop(F.col(value) - F.col("_t")) + 1e-12)
    return x.groupBy(*keys).agg(F.count(value).alias("n"), snr.alias("snr"), (F.sum(F.col("_d") * F.col("_l")) / (F.sum(F.col("_d") * F.col("_d")) + 1e-12)).alias("acf1"))


def advise(df: DataFrame, ts: str = "ts", value: str = "v", most: int = 3, every: bool = False) -> DataFrame:
    """Scores of the candidate frequencies of one series, best first: freq, n, snr, acf1, score, info_loss.

    Values of one time are added up and stored first. The series' step, its strongest periods and the candidates' rows are
    small scalars read before; the spectrum is grouped sums, each candidate is one aggregate.
    """
    known = df.filter(F.col(value).isNotNull()).groupBy(ts).agg(F.sum(F.col(value).cast("double")).alias(value))
    known = kept(known, "advice")
    native = float(median_gap_days(known, ts).first()["gap_days"] or 1.0)
    found = strongest_periods(spectrum(known, ts=ts, value=value)).first()
    if found is None or found["n"] < 10:
        raise ValueError("interval advice needs ten observations or more")
    grids = {name: resample(known, Freq.of(name, "right"), {value: "sum"}, ts=ts) for name, (_, days) in CANDIDATES.items() if days >= 0.9 * native}
    sizes = dict(reduce(DataFrame.unionByName, [at.agg(F.lit(name).alias("freq"), F.count("*").alias("n")) for name, at in grids.items()]).collect())
    frames = []
    for name, at in grids.items():
        (per_year, days), n = CANDIDATES[name], sizes[name]
        stats = signal_noise(at, [], "bucket", value, max(2, n // 5))
        cycles, ratio = n / per_year, days / max(native, 1e-9)
        fixed = (25 if cycles >= 2 else 10 if cycles >= 1 else -10) + sum(15 / (1 + abs(ratio - p) / (p + 1e-6)) for p in found["periods"])
        loss = max(0.0, min(100.0, (1 - native / days) * 100)) if days > native else 0.0
        score = F.when(F.col("n") < 8, 0.0).otherwise(F.lit(float(fixed)) + F.least(F.lit(30.0), 3 * F.col("snr")) + 20 * F.abs("acf1"))
        frames.append(stats.select(F.lit(name).alias("freq"), "n", "snr", "acf1", score.alias("score"), F.when(F.col("n") < 8, 100.0).otherwise(loss).alias("info_loss")))
    ranked = reduce(DataFrame.unionByName, frames).orderBy(F.desc("score"), "freq")
    return ranked if every else ranked.limit(most)
