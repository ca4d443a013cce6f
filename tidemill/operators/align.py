"""Aligning columns on a time axis: left joins with fills, inner and semi alignment, unions of dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import Cut, beside, cut

FILLS = ("none", "zero", "carry")


def onto(target: DataFrame, other: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", fill: str = "none") -> DataFrame:
    """``target`` with ``columns`` of ``other`` at the same time: gaps stay null, become zero, or carry the last value
    (before the first one, the next; zero where there is none)."""
    if fill not in FILLS:
        raise ValueError(f"unknown fill {fill!r}")
    keys = list(keys)
    out = target.join(other.select(*keys, ts, *columns), [*keys, ts], "left")
    if fill == "none":
        return out
    order = W.partitionBy(*keys).orderBy(ts)
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    made = {c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.lit(0)) if fill == "carry" else F.coalesce(c, F.lit(0)) for c in columns}
    return out.withColumns(made)


def asof(target: DataFrame, other: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), ts: str = "ts", tolerance: float | None = None, at: Cut | None = None) -> DataFrame:
    """``target`` with ``columns`` of the last row of ``other`` at or before its time, null where there is none, or none
    within ``tolerance`` seconds. Of rows of one time, the one with the greatest columns is taken.

    Both sides are put on one time axis and cut in ranges; the last row of each range is handed to those behind it, so a
    key with most of the rows is spread and no pair of rows is ever made.
    """
    keys, columns = list(keys), list(columns)
    kinds = dict(target.dtypes)
    at = at or cut(target, ts)
    mine = target.select(*keys, F.col(ts).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.struct(*target.columns).alias("_row"))
    theirs = other.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(ts).cast("timestamp").alias("_t"), *columns).alias("_seen"))
    both_sides = mine.unionByName(theirs, allowMissingColumns=True).withColumn("_range", Cut(at.bounds, "timestamp", at.block).range_of(F.col("_t")))
    here = F.max("_seen").over(W.partitionBy(*keys, "_range").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    ends = both_sides.groupBy(*keys, "_range").agg(F.max("_seen").alias("_end"), F.min(F.lit(0)).alias("_one"))
    before = F.max("_end").over(W.partitionBy(*keys, "_one").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select(*keys, "_range", before.alias("_carried"))
    found = beside(both_sides.withColumn("_here", here).filter("_side = 1"), carried, [*keys, "_range"])
    seen = F.coalesce("_here", "_carried")
    late = F.lit(False) if tolerance is None else F.unix_micros("_t") - F.unix_micros(seen["_t"]) > round(tolerance * 1_000_000)
    told = F.when(F.col("_t").isNotNull() & ~F.coalesce(late, F.lit(False)), seen)
    return found.select(*[F.col("_row")[c].cast(kinds[c]).alias(c) for c in target.columns if c not in columns], *[told[c].alias(c) for c in columns])


def together(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows whose time both sides have, without nulls."""
    return a.join(b, [*keys, ts]).na.drop()


def both(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Full outer alignment."""
    return a.join(b, [*keys, ts], "full")


def within(a: DataFrame, times: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows of ``a`` whose time stands in ``times``."""
    return a.join(times.select(*keys, ts), [*keys, ts], "left_semi")


def union_times(frames: Sequence[DataFrame], ts: str = "ts") -> DataFrame:
    """Distinct times of several tables."""
    out = frames[0].select(ts)
    for f in frames[1:]:
        out = out.unionByName(f.select(ts))
    return out.distinct()
