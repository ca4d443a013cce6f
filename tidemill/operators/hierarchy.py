"""Hierarchies: roll-up by grouping sets, coherence, level effects, trees, envelopes, stability of a level."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import season

ALL = "*"
METHODS = {"sum": F.sum, "mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "max": F.max, "min": F.min}


def path_filter(df: DataFrame, path: dict[str, object]) -> DataFrame:
    """Rows of a node: equality on the text of each path column; columns the table lacks are ignored.

    The literal is cast, not the column, so that the filter reaches the files; a text that the column's type would write
    in another way (01 for a number) matches nothing.
    """
    kinds = dict(df.dtypes)

    def equal(c: str, v: object) -> Column:
        told = F.lit(str(v))
        if kinds[c] == "string":
            return F.col(c) == told
        cast = told.try_cast(kinds[c])
        return (F.col(c) == cast) & (cast.cast("string") == told)

    held = [equal(c, v) for c, v in path.items() if c in df.columns]
    return reduce(lambda a, b: a.filter(b), held, df)


def by_time(df: DataFrame, roles: dict[str, str], ts: str = "ts") -> DataFrame:
    """One row a timestamp with each column aggregated by its method (sum, mean, median, max, min)."""
    return df.groupBy(ts).agg(*[METHODS[m](F.col(c)).alias(c) for c, m in roles.items()])


def weighted_mean(df: DataFrame, value: str, weight: str, ts: str = "ts") -> DataFrame:
    """Per timestamp: sum(w v) / sum(w) over rows that have both."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return df.filter(both).groupBy(ts).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def rollup(df: DataFrame, levels: Sequence[str], bucket: str, aggregates: dict[str, Column]) -> DataFrame:
    """Every node of the hierarchy per bucket in one shuffle: grouping sets of all prefixes, '*' for what is rolled up.

    Rows with a null in a level are left out, as they belong to no node. A level value that is itself '*' (behind any
    number of backslashes) gets a backslash more, so '*' alone always means rolled up.
    """
    levels = list(levels)
    sets = [[F.col(bucket), *[F.col(c) for c in levels[:k]]] for k in range(len(levels), -1, -1)]
    made = df.na.drop(subset=levels).groupingSets(sets, F.col(bucket), *[F.col(c) for c in levels]).agg(*[a.alias(n) for n, a in aggregates.items()])
    keys = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"^(\\*)\*$", r"\\$1*"), F.lit(ALL)).alias(c) for c in levels]
    return made.select(bucket, *keys, *aggregates)


def depth(levels: Sequence[str]) -> Column:
    return sum((F.when(F.col(c) != ALL, 1).otherwise(0) for c in levels), F.lit(0))


def _joined_path(labels: Sequence[Column]) -> Column:
    """Labels down to a node, parted by '__'; backslashes in labels are escaped, and underscores that stand beside another
    one or at an end, so a double one only parts labels."""
    held = F.filter(F.array(*labels), lambda x: x != ALL)
    return F.array_join(F.transform(held, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), "(?<=_)_|_(?=_)|^_|_$", r"\\_")), "__")


def node_id(levels: Sequence[str]) -> Column:
    d = depth(levels)
    path = _joined_path([F.col(c) for c in levels])
    return F.when(d == 0, F.lit("total")).otherwise(F.concat(F.lit("d"), d.cast("string"), F.lit("__"), path))


def nodes(rolled: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Node dimension: node_id, parent_id, depth, level_name, label, display_path and the path columns."""
    levels = list(levels)
    dim = rolled.select(*levels).distinct()
    d = depth(levels)
    up = [F.when(d == k + 1, F.lit(ALL)).otherwise(F.col(c)).alias(c) for k, c in enumerate(levels)]
    named = dim.select(*levels, node_id(levels).alias("node_id"), d.alias("depth"), F.struct(*up).alias("_up"))
    parent = [F.col(f"_up.{c}") for c in levels]
    pd = sum((F.when(p != ALL, 1).otherwise(0) for p in parent), F.lit(0))
    path = _joined_path(parent)
    parent_id = F.when(F.col("depth") > 0, F.when(pd == 0, F.lit("total")).otherwise(F.concat(F.lit("d"), pd.cast("string"), F.lit("__"), path)))
    own = F.filter(F.array(*[F.col(c) for c in levels]), lambda x: x != ALL)
    return named.select(
        *levels,
        "node_id",
        parent_id.alias("parent_id"),
        "depth",
        F.when(F.col("depth") == 0, "total").otherwise(F.get(F.array(*[F.lit(c) for c in levels]), F.col("depth") - 1)).alias("level_name"),
        F.when(F.col("depth") == 0, "total").otherwise(F.get(own, F.size(own) - 1)).alias("label"),
        F.when(F.col("depth") == 0, "total").otherwise(F.array_join(own, " / ")).alias("display_path"),
    )


def node_preview(named: DataFrame, most: int = 200) -> DataFrame:
    """The first nodes by depth and label (and id, as labels repeat under different parents)."""
    return named.orderBy("depth", "label", "node_id").limit(most)


def level_sizes(rolled: DataFrame, levels: Sequence[str]) -> DataFrame:
    return rolled.select(*levels).distinct().groupBy(depth(levels).alias("depth")).agg(F.count("*").alias("n_series"))


def coherence(rolled: DataFrame, levels: Sequence[str], bucket: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Per level but the last: parents compared with the sums of their children; largest gap and verdict."""
    levels = list(levels)
    at = rolled.withColumn("depth", depth(levels))
    up = [F.when(F.col("depth") == k + 1, F.lit(ALL)).otherwise(F.col(c)).alias(c) for k, c in enumerate(levels)]
    children = at.filter("depth > 0").select(bucket, *up, (F.col("depth") - 1).alias("depth"), value).groupBy(bucket, *levels, "depth").agg(F.sum(value).alias("_below"))
    both = at.join(children, [bucket, *levels, "depth"])
    gap = F.max(F.abs(F.col(value) - F.col("_below")))
    return both.groupBy("depth").agg(F.count("*").alias("n_checked"), gap.alias("largest_gap"), (gap < tolerance).alias("coherent"))


def level_effects(rolled: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Per level: mean coefficient of variation and mean variance of series with more than one value."""
    by_node = rolled.groupBy(*levels).agg(F.stddev_samp(value).alias("s"), F.avg(value).alias("m"), F.var_samp(value).alias("var"), F.count(value).alias("n")).filter("n > 1")
    return by_node.groupBy(depth(levels).alias("depth")).agg(F.avg(F.col("s") / (F.col("m") + 1e-12)).alias("mean_cv"), F.avg("var").alias("mean_variance"), F.count("*").alias("n_series"))


def level_values(df: DataFrame, level: str, most: int | None = None) -> DataFrame:
    out = df.filter(F.col(level).isNotNull()).select(F.col(level).cast("string").alias("value")).distinct().orderBy("value")
    return out if most is None else out.limit(most)


def children(df: DataFrame, levels: Sequence[str], path: dict[str, object], most: int | None = None) -> DataFrame:
    """Values of the first level below a path."""
    nxt = next(c for c in levels if c not in path)
    return level_values(path_filter(df, path), nxt, most)


def leaf_count(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(levels)).select(*levels).distinct().agg(F.count("*").alias("n_leaves"))


def tree(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per first-level value with its nested children as sorted arrays of structs."""
    levels = list(levels)
    at = df.na.drop(subset=levels).select(*levels).distinct()
    item = F.col(levels[-1])
    for k in range(len(levels) - 1, 0, -1):
        at = at.groupBy(*levels[:k]).agg(F.sort_array(F.collect_set(item)).alias("children"))
        item = F.struct(F.col(levels[k - 1]).alias("value"), F.col("children"))
    return at


def envelope(series: DataFrame, bucket: str, value: str) -> DataFrame:
    """Across series per bucket: mean, population std, min, max, cv (null where the mean rounds to 0)."""
    mean, std = F.avg(value), F.stddev_pop(value)
    cv = F.when(F.abs(mean) >= 5e-5, std / (F.abs(mean) + 1e-12))
    return series.groupBy(bucket).agg(mean.alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), cv.alias("cv"), F.count(value).alias("n"))


def seasonal_profile(series: DataFrame, keys: Sequence[str], bucket: str, value: str, interval: str) -> DataFrame:
    label, order = season(F.col(bucket), interval)
    mean, n = F.avg(value), F.count(value)
    return series.groupBy(*keys, label.alias("season"), order.alias("season_order")).agg(mean.alias("mean"), F.when(n > 1, F.stddev_pop(value) / (F.abs(mean) + 1e-12)).alias("cv"), n.alias("n"))


def combined_profile(profile: DataFrame) -> DataFrame:
    """Mean and population cv of the series' seasonal means."""
    mean = F.avg("mean")
    return profile.groupBy("season", "season_order").agg(mean.alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("mean") / (F.abs(mean) + 1e-12)).alias("cv"))


def stability(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per series with two values or more: mean, population std, cv, range and a label by cv."""
    mean, std = F.avg(value), F.stddev_pop(value)
    cv = std / (F.abs(mean) + 1e-12)
    label = F.when(cv < 0.2, "stable").when(cv < 0.5, "moderate").otherwise("volatile")
    made = series.groupBy(*keys).agg(mean.alias("mean"), std.alias("std"), cv.alias("cv"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n"), label.alias("label"))
    return made.filter("n >= 2")


def year_matrix(series: DataFrame, keys: Sequence[str], bucket: str, value: str, years: Sequence[int] | None = None, method: str = "sum") -> DataFrame:
    """Yearly totals (or means) of each series, a column a year."""
    at = series.withColumn("_year", F.year(bucket))
    return at.groupBy(*keys).pivot("_year", list(years) if years else None).agg(METHODS[method](F.col(value)))


def yoy_stability(yearly: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Over the yearly values of each series: population cv; stable under 0.1, moderate under 0.3."""
    cv = F.stddev_pop(value) / (F.abs(F.avg(value)) + 1e-12)
    return yearly.groupBy(*keys).agg(cv.alias("cv"), F.when(cv < 0.1, "stable").when(cv < 0.3, "moderate").otherwise("volatile").alias("label"))


def half_span_change(series: DataFrame, keys: Sequence[str], bucket: str, value: str) -> DataFrame:
    """Mean percent change over half a series' length; positions are joined, as the offset differs by series."""
    w = W.partitionBy(*keys)
    at = series.withColumn("_i", F.row_number().over(w.orderBy(bucket))).withColumn("_h", F.floor(F.count("*").over(w) / 2))
    back = at.select(*keys, (F.col("_i") + F.col("_h")).alias("_i"), F.col(value).alias("_old"))
    change = at.join(back, [*keys, "_i"]).filter("_h > 0")
    return change.groupBy(*keys).agg((F.avg(F.col(value) / F.col("_old") - 1) * 100).alias("half_span_change"))


def first_series(series: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of the alphabetically first ``most`` series: a display limit."""
    names = series.select(key).distinct().orderBy(key).limit(most)
    return series.join(names, key, "left_semi")
