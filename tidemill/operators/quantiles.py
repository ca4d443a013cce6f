"""Exact quantiles of series of any length: a mergeable sketch brackets the ranks, counting decides inside the bracket.

The sketch of ``percentile_approx`` is never off by more than one in its accuracy of the ranks, so two of its values bracket
each wanted rank. A second pass counts what lies below the bracket and the distinct values inside it, some thousandths
of a series (all of one with fewer than 10,000 values), whose running counts hold the rank. A key with a third of all
rows is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranges import beside


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], accuracy: int = 5000) -> DataFrame:
    """keys, n, q: the quantiles ``shares`` of the known values, between two values by interpolation, as an array. A key
    without known values has no row."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    edges = [min(1.0, max(0.0, p + side * 2 / accuracy)) for p in shares for side in (-1, 1)]
    told = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    told = told.filter("_n > 0")
    share = lambda j: F.get(F.array(*[F.lit(float(p)) for p in shares]), j)
    at = beside(known, told, keys).withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(len(shares))])))
    # At the ends of the ranks, and of series where two steps of the sketch are a few ranks, the least and the greatest value are the bracket.
    few = F.col("_n") < 2 * accuracy
    low = F.when(few | (share(F.col("_j")) <= 2 / accuracy), F.col("_least")).otherwise(F.get("_e", 2 * F.col("_j")))
    high = F.when(few | (share(F.col("_j")) >= 1 - 2 / accuracy), F.col("_most")).otherwise(F.get("_e", 2 * F.col("_j") + 1))
    near = at.filter(F.col("_v") <= high).select(*keys, "_j", "_n", F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))
    counts = near.groupBy(*keys, "_j", "_n", "_v").agg(F.count("*").alias("_k"))
    order = W.partitionBy(*keys, "_j").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_k").over(order))
    place = share(F.col("_j")) * (F.col("_n") - 1)
    at_rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    picked = ranked.groupBy(*keys, "_j", "_n").agg(at_rank(F.floor(place)).alias("_a"), at_rank(F.ceil(place)).alias("_b"))
    made = picked.withColumn("_q", F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place)))
    return made.groupBy(*keys).agg(F.max("_n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("_j", "_q"))), lambda x: x["_q"]).alias("q"))
