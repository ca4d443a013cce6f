"""Window features over series in time order: lags, trailing and centred rolling statistics, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def ordered(keys: Sequence[str], ts: str):
    return W.partitionBy(*keys).orderBy(ts)


def lags(value: str, numbers: Sequence[int], order, prefix: str = "lag_") -> dict[str, Column]:
    return {f"{prefix}{k}": F.lag(value, k).over(order) for k in numbers}


def rolling(value: str, width: int, order, names: Sequence[str] = ("mean", "std", "min", "max")) -> dict[str, Column]:
    """Statistics of the ``width`` values before a row; null until there are as many."""
    w = order.rowsBetween(-width, -1)
    full = F.count(value).over(w) == width
    return {f"roll_{n}_{width}": F.when(full, ROLLING[n](F.col(value)).over(w)) for n in names}


def running_sum(value: str, width: int, order) -> Column:
    """Sum of a row and the ``width - 1`` before it, however few there are."""
    return F.sum(value).over(order.rowsBetween(-(width - 1), 0))


def centred_mean(value: str, width: int, order) -> Column:
    """Mean of a centred window; an even one reaches one row further back than ahead."""
    return F.avg(value).over(order.rowsBetween(-(width - 1 - (width - 1) // 2), (width - 1) // 2))


def difference(df: DataFrame, value: str, keys: Sequence[str], ts: str, times: int = 1, name: str = "diff") -> DataFrame:
    out = df.withColumn(name, F.col(value))
    for _ in range(times):
        out = out.withColumn(name, F.col(name) - F.lag(name).over(ordered(keys, ts)))
    return out


def split(df: DataFrame, keys: Sequence[str], ts: str, train: float = 0.7, validation: float = 0.15, name: str = "split") -> DataFrame:
    """train, validation or test by position in time, at the floors of the shares."""
    w = W.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(ts)), F.count("*").over(w)
    cut = F.floor(n * F.lit(train))
    part = F.when(i <= cut, "train").when(i <= cut + F.floor(n * F.lit(validation)), "validation").otherwise("test")
    return df.withColumn(name, part)


def holdout(df: DataFrame, keys: Sequence[str], ts: str, rows: int, name: str = "is_holdout") -> DataFrame:
    """Marks the last rows of a series, a third of it at most."""
    w = W.partitionBy(*keys)
    back = F.row_number().over(w.orderBy(F.desc(ts)))
    return df.withColumn(name, back <= F.least(F.lit(rows), F.floor(F.count("*").over(w) / 3)))
