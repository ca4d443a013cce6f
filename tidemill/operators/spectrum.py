"""Power spectra of series as grouped sums: no series is gathered in one task.

A transform of L = R M points is two aggregates: sums by residue class modulo R at M frequencies, then sums over the
classes at all frequencies, about n (M + R) rows that are added up before they are shuffled. Where the length has no
divisor near its root (a prime, say), the transform is written as a convolution of chirps over a length that has one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import Cut, beside, positions, settled


def _turned(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def transform(points: DataFrame, keys: Sequence[str], most: Column | None = None) -> DataFrame:
    """Discrete Fourier transform of (keys, _r, _m, _i, _re, _im), where _r times _m is the length: (keys, _r, _m, _k, _re,
    _im). Points that are not there are 0. most: the largest frequency that is wanted."""
    about = [*keys, "_r", "_m"]
    turn = lambda steps, of: -2 * math.pi * (steps % of) / of
    rows = points.select(*about, (F.col("_i") % F.col("_r")).alias("_class"), F.floor(F.col("_i") / F.col("_r")).alias("_at"), "_re", "_im", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_q"))
    re, im = _turned(F.col("_re"), F.col("_im"), turn(F.col("_q") * F.col("_at"), F.col("_m")))
    classes = rows.groupBy(*about, "_class", "_q").agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    wide = classes.select("*", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("_s")).withColumn("_k", F.col("_q") + F.col("_m") * F.col("_s"))
    wide = wide if most is None else wide.filter(F.col("_k") <= most)
    re, im = _turned(F.col("_re"), F.col("_im"), turn(F.col("_class") * F.col("_k"), F.col("_r") * F.col("_m")))
    return wide.groupBy(*about, "_k").agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))


def _direct(points: DataFrame, keys: list[str]) -> DataFrame:
    rows = points.withColumn("_m", F.col("n") / F.col("_r")).withColumn("_m", F.col("_m").cast("long")).withColumn("_im", F.lit(0.0))
    half = F.floor(F.col("_r") * F.col("_m") / 2)
    made = transform(rows, keys, half).filter((F.col("_k") > 0) & (F.col("_k") <= half))
    return made.select(*keys, (F.col("_r") * F.col("_m")).alias("n"), F.col("_k").alias("frequency"), (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("power"))


def _chirped(points: DataFrame, keys: list[str]) -> DataFrame:
    """The same by Bluestein's convolution, for any length n, over (R times R) points, R squared at least twice n."""
    root = F.ceil(F.sqrt(2.0 * F.col("n"))).cast("long")
    keyed = [*keys, "n"]
    angle = lambda j: math.pi * (j * j % (2 * F.col("n"))) / F.col("n")
    sized = points.withColumn("_r", root).withColumn("_m", root)
    a = sized.select(*keyed, "_r", "_m", "_i", (F.col("_re") * F.cos(angle(F.col("_i")))).alias("_re"), (-F.col("_re") * F.sin(angle(F.col("_i")))).alias("_im"))
    series = sized.select(*keyed, "_r", "_m").distinct().withColumn("_j", F.explode(F.sequence(1 - F.col("n"), F.col("n") - 1)))
    b = series.select(*keyed, "_r", "_m", F.pmod(F.col("_j"), F.col("_r") * F.col("_m")).alias("_i"), F.cos(angle(F.col("_j"))).alias("_re"), F.sin(angle(F.col("_j"))).alias("_im"))
    one, two = (transform(x, keyed) for x in (a, b))
    both = beside(one, two.select(*keyed, "_k", F.col("_re").alias("_re2"), F.col("_im").alias("_im2")), [*keyed, "_k"])
    # The conjugate of the product, transformed, is the conjugate of the convolution times its length.
    product = both.select(*keyed, "_r", "_m", F.col("_k").alias("_i"), (F.col("_re") * F.col("_re2") - F.col("_im") * F.col("_im2")).alias("_re"), (-F.col("_re") * F.col("_im2") - F.col("_im") * F.col("_re2")).alias("_im"))
    half = F.floor(F.col("n") / 2)
    made = transform(product, keyed, half).filter((F.col("_k") > 0) & (F.col("_k") <= half))
    size = (F.col("_r") * F.col("_m")).cast("double")
    return made.select(*keyed, F.col("_k").alias("frequency"), ((F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / (size * size)).alias("power"))


def spectrum(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", value: str = "v", at: Cut | None = None, chirp: float = 0.35) -> DataFrame:
    """keys, n, frequency, power: squared size of each frequency from 1 to n / 2 of the series' known values, less their mean.

    chirp: lengths n without a divisor between n^chirp and their root take the convolution.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_v"))
    known, at = settled(known, ts, at)
    sizes = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("_mean"))
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(F.col("n")))), lambda d: F.col("n") % d == 0)
    sizes = sizes.filter("n > 1").withColumn("_r", F.array_max(divisors))
    points = beside(positions(known, keys, ts, at), sizes, keys).select(*keys, "n", "_r", "_i", (F.col("_v") - F.col("_mean")).alias("_re"))
    good = F.col("_r") >= F.pow(F.col("n"), F.lit(chirp))
    return _direct(points.filter(good), keys).unionByName(_chirped(points.filter(~good), keys))


def strongest_periods(power: DataFrame, keys: Sequence[str] = (), most: int = 3) -> DataFrame:
    """keys, n, periods: the periods above 2 and below half the length, to one digit, strongest first, ``most`` of them."""
    period = F.round(F.col("n") / F.col("frequency"), 1)
    inside = (F.col("n") / F.col("frequency") > 2) & (F.col("frequency") > 2)
    best = F.slice(F.sort_array(F.collect_list(F.when(inside, F.struct("power", "frequency", period.alias("p")))), asc=False), 1, most)
    # Each (series, chunk of frequencies) keeps its best before they meet.
    parts = power.groupBy(*keys, "n", F.floor(F.col("frequency") / 4096).alias("_chunk")).agg(best.alias("_b"))
    return parts.groupBy(*keys, "n").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_b")), asc=False), 1, most).alias("_b")).select(*keys, "n", F.transform("_b", lambda x: x["p"]).alias("periods"))


def dominant_period(power: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, period: that of the strongest frequency, from 2 to a third of the length."""
    best = power.groupBy(*keys, "n").agg(F.max_by("frequency", F.struct("power", -F.col("frequency"))).alias("frequency"))
    top = F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    return best.select(*keys, "n", F.greatest(F.lit(2), F.least(top, F.bround(F.col("n") / F.col("frequency")))).cast("int").alias("period"))
