"""Relations between the columns of a panel: correlation, cross-correlation, event impact, lagged predictive gain."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import kept
from .ranges import Cut, beside, cut, settled, with_windows


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two columns that are null in the same rows, as an aggregate: NaN where one of them never changes, null
    without rows. Spark's ``corr`` divides by zero there, which is an error in ANSI mode."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it, NaN or infinite where b is 0; ``/`` is an error there in ANSI mode."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations as rows (a, b, corr), all in one aggregate; each pair is worked out once.

    A pair of which one column never changes has NaN, a pair without rows null.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: pearson(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    one = df.agg(*[both(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    both_ways = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for a, b, i in both_ways])
    return one.select(F.inline(rows))


def variable_stats(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Per column: role, n, n_missing, mean, std, min, max, pct_zero, pct_one, is_binary."""
    aggs = []
    for c in roles:
        v = F.col(c).cast("double")
        known = v.isNotNull()
        aggs += [
            F.struct(
                F.lit(c).alias("variable"), F.lit(roles[c]).alias("role"), F.count(v).alias("n"), F.count_if(~known).alias("n_missing"), F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.avg(F.when(known, (v == 0).cast("double"))) * 100).alias("pct_zero"),
                (F.avg(F.when(known, (v == 1).cast("double"))) * 100).alias("pct_one"), F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False)).alias("is_binary"),
            ).alias(f"_{c}")
        ]
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"_{c}") for c in roles])))


def ccf(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), ts: str = "ts", max_lag: int = 20, rows: int | None = None, at: Cut | None = None) -> DataFrame:
    """Cross-correlation of z-normed series at lags -L to L: keys, lag, ccf; a positive lag has x leading y.

    Lags go up to ``max_lag`` and to a third of the shortest series; pass ``rows`` (its length) and ``at`` to save a pass.
    Series are cut in ranges of time with a halo of the largest lag. A column that never changes gives null.
    """
    keys = list(keys)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    known = known.select(*keys, ts, x, y)
    if at is None:
        known = kept(known, "pair")
    moments = {f"_{f}{c}": fn(c) for c in (x, y) for f, fn in (("m", F.avg), ("s", F.stddev_pop))}
    if keys:
        told = known.groupBy(*keys).agg(F.count("*").alias("_n"), *[m.alias(name) for name, m in moments.items()])
        at = at or cut(known, ts)
        rows = (told.agg(F.min("_n")).first()[0] or 0) if rows is None else rows
        known = beside(known, told, keys)
        fact = F.col
    else:
        seen = cut(known, ts, **moments)
        at, rows = at or seen, seen.facts["n"] if rows is None else rows
        fact = lambda name: F.lit(seen.facts[name]).cast("double")
    top = min(max_lag, rows // 3)
    z = lambda c: F.when(fact(f"_s{c}") != 0, (F.col(c) - fact(f"_m{c}")) / fact(f"_s{c}"))
    normed = known.select(*keys, ts, z(x).alias("_x"), z(y).alias("_y"))
    product = lambda order: {f"_{k + top}": F.col("_y") * (F.lag("_x", k) if k >= 0 else F.lead("_x", -k)).over(order) for k in range(-top, top + 1)}
    moved = with_windows(normed, keys, ts, product, top, top, at)
    one = moved.groupBy(*keys).agg(*[F.avg(f"_{i}").alias(f"_{i}") for i in range(2 * top + 1)])
    rows_of = F.array(*[F.struct(F.lit(i - top).alias("lag"), F.col(f"_{i}").alias("ccf")) for i in range(2 * top + 1)])
    return one.select(*keys, F.inline(rows_of))


def best_lag(correlations: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The lag of the largest absolute value, the first one among equals, against 1.96 / sqrt(n)."""
    limit = 1.96 / math.sqrt(n)
    first = F.struct(F.abs("ccf"), -F.col("lag"))
    made = correlations.groupBy(*keys).agg(F.max_by("lag", first).alias("best_lag"), F.max_by("ccf", first).alias("max_ccf"))
    return made.withColumn("sig_threshold", F.lit(limit)).withColumn("significant", F.abs("max_ccf") > limit)


def event_impact(df: DataFrame, dependent: str, event: str, ts: str = "ts", after: int = 5, at: Cut | None = None) -> DataFrame:
    """Means on and off the event, lift, Cohen's d and the mean of the ``after`` rows behind events."""
    d, on = F.col(dependent), F.col(event) == 1
    known, at = settled(df.filter(d.isNotNull() & F.col(event).isNotNull()).select(ts, dependent, event), ts, at)
    behind = with_windows(known, [], ts, lambda order: {"_after": F.avg(dependent).over(order.rowsBetween(1, after))}, ahead=after, at=at)
    made = behind.agg(
        F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"), F.avg(F.when(on, d)).alias("mean_on"), F.avg(F.when(~on, d)).alias("mean_off"),
        F.var_samp(F.when(on, d)).alias("_v1"), F.var_samp(F.when(~on, d)).alias("_v0"), F.avg(F.when(on, F.col("_after"))).alias("mean_after"),
    )
    more = F.col("mean_on") - F.col("mean_off")
    effect = quotient(more, F.sqrt((F.col("_v1") + F.col("_v0")) / 2))
    size = F.abs(F.col("cohens_d"))
    return (
        made.withColumn("lift_pct", quotient(more, F.abs("mean_off")) * 100)
        .withColumn("cohens_d", effect)
        .withColumn("effect", F.when(size > 0.8, "large").when(size > 0.5, "medium").otherwise("small"))
        .drop("_v1", "_v0")
    )


def _r2_two(y: Column, a: Column, x: Column) -> Column:
    """R2 of y on a and x from their three correlations, 0 at least; NaN where one of them never changes."""
    ya, yx, ax = pearson(y, a), pearson(y, x), pearson(a, x)
    return F.greatest(F.lit(0.0), quotient(ya * ya + yx * yx - 2 * ya * yx * ax, 1 - ax * ax))


def lagged_gain(df: DataFrame, dependent: str, driver: str, ts: str = "ts", max_lag: int = 8, rows: int | None = None, at: Cut | None = None) -> DataFrame:
    """Per lag: R2 of y on its last value, R2 with the lagged driver added, the gain, and whether it is useful. Gains of a
    column that never changes are NaN and not useful."""
    known = df.filter(F.col(dependent).isNotNull() & F.col(driver).isNotNull()).select(ts, F.col(dependent).alias("y"), F.col(driver).alias("_x"))
    if at is None:
        known, at = settled(known, ts)
        rows = at.facts["n"] if rows is None else rows
    rows = known.count() if rows is None else rows
    top = max(1, min(max_lag, rows // 4))
    lagged = lambda order: {"a": F.lag("y").over(order)} | {f"x{k}": F.lag("_x", k).over(order) for k in range(1, top + 1)}
    moved = with_windows(known, [], ts, lagged, back=top, at=at)
    base = pearson(F.when(F.col("a").isNotNull(), F.col("y")), F.col("a"))
    aggs = [F.pow(base, 2).alias("_base")]
    for k in range(1, top + 1):
        whole = F.col("a").isNotNull() & F.col(f"x{k}").isNotNull()
        keep = lambda c, w=whole: F.when(w, F.col(c))
        aggs += [_r2_two(keep("y"), keep("a"), keep(f"x{k}")).alias(f"_r{k}"), F.count_if(whole).alias(f"_n{k}")]
    one = moved.agg(*aggs)
    rows_of = F.array(*[F.struct(F.lit(k).alias("lag"), F.col("_base").alias("base_r2"), F.col(f"_r{k}").alias("r2"), (F.col(f"_r{k}") - F.col("_base")).alias("gain"), F.col(f"_n{k}").alias("n")) for k in range(1, top + 1)])
    return one.select(F.inline(rows_of)).filter("n >= 10").withColumn("useful", (F.col("gain") > 0.01) & ~F.isnan("gain"))


def recommend(correlated: DataFrame, gains: DataFrame, impacts: DataFrame) -> DataFrame:
    """Features to include: drivers that correlate or predict (variable, max_ccf, significant; variable, useful) and
    events of at least medium effect (variable, cohens_d, lift_pct); significant first, then by strength."""
    useful = gains.groupBy("variable").agg(F.bool_or("useful").alias("useful"))
    drivers = correlated.join(useful, "variable", "left").select("variable", F.lit("driver").alias("kind"), (F.col("significant") | F.coalesce("useful", F.lit(False))).alias("include"), F.abs("max_ccf").alias("strength"), F.col("significant"))
    events = impacts.select("variable", F.lit("event").alias("kind"), (F.abs("cohens_d") > 0.3).alias("include"), F.abs("lift_pct").alias("strength"), (F.abs("cohens_d") > 0.5).alias("significant"))
    return drivers.unionByName(events).orderBy(F.desc("significant"), F.desc("strength"), "variable")


def relations(df: DataFrame, dependent: str, independent: Sequence[str] = (), events: Sequence[str] = (), ts: str = "ts", max_lag: int = 20, after: int = 5, gain_lags: int = 8) -> dict[str, DataFrame]:
    """All relations of a series to its drivers and events: tables by name, with the driver or event as ``variable``.

    Rows without the dependent value are left out and the rest is stored once. Missing drivers and events count as 0,
    in predictive gain as the last value. The series is cut in the same ranges for all.
    """
    independent, events = list(independent), list(events)
    numbers = [F.col(c).cast("double").alias(c) for c in (dependent, *independent, *events)]
    known = kept(df.filter(F.col(dependent).isNotNull()).select(ts, *numbers), "relations")
    at = cut(known, ts)
    n = at.facts["n"]
    filled = known.fillna(0.0, [*independent, *events])
    tagged = lambda made, name: made.select(F.lit(name).alias("variable"), "*")
    joined = lambda frames, schema: reduce(DataFrame.unionByName, frames) if frames else df.sparkSession.createDataFrame([], schema)
    lagged = kept(joined([tagged(ccf(filled, c, dependent, ts=ts, max_lag=max_lag, rows=n, at=at), c) for c in (*independent, *events)], "variable string, lag int, ccf double"), "ccf")
    best = best_lag(lagged, max(1, n), ["variable"])
    impacts = joined([tagged(event_impact(filled, dependent, c, ts, after, at), c) for c in events], IMPACTS)
    carried = with_carried(known, independent, ts, at)
    gains = joined([tagged(lagged_gain(carried, dependent, c, ts, gain_lags, n, at), c) for c in independent], "variable string, lag int, base_r2 double, r2 double, gain double, n long, useful boolean")
    roles = {dependent: "dependent"} | dict.fromkeys(independent, "independent") | dict.fromkeys(events, "event")
    return {
        "variables": variable_stats(df, roles),
        "correlations": correlation_matrix(df, list(roles)),
        "ccf": lagged,
        "best": best,
        "impacts": impacts,
        "gains": gains,
        "recommendations": recommend(best.filter(F.col("variable").isin(independent)), gains, impacts),
    }


IMPACTS = "variable string, n_on long, n_off long, mean_on double, mean_off double, mean_after double, lift_pct double, cohens_d double, effect string"


def with_carried(df: DataFrame, columns: Sequence[str], ts: str = "ts", at: Cut = Cut()) -> DataFrame:
    """``columns`` with gaps filled by the last value before them, 0 before the first: inside ranges of time by a window,
    across them by the last value of each range."""
    if not columns:
        return df
    ranged = df.withColumn("_range", at.range_of(F.col(ts)))
    here = W.partitionBy("_range").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    ends = ranged.groupBy("_range").agg(F.min(F.lit(0)).alias("_one"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_e_{c}") for c in columns])
    before = W.partitionBy("_one").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_range", *[F.last(f"_e_{c}", True).over(before).alias(f"_b_{c}") for c in columns])
    found = beside(ranged.withColumns({c: F.last(c, True).over(here) for c in columns}), carried, ["_range"])
    return found.select(*[F.coalesce(F.col(c), F.col(f"_b_{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])
