"""Hierarchical reconciliation: weights, bottom-up, top-down, middle-out, overrides with locks.

Nodes are rows of rolled-up level columns ('*' for what is rolled up). Work goes level by level, never node by node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .hierarchy import ALL, depth

STRATEGIES = ("bottom_up", "top_down", "middle_out")


def _parent(levels: Sequence[str], d: int) -> list:
    """Path columns of the parent of nodes at depth ``d``, prefixed with p_."""
    return [(F.lit(ALL) if k >= d - 1 else F.col(c)).alias(f"p_{c}") for k, c in enumerate(levels)]


def child_weights(history: DataFrame, levels: Sequence[str], value: str = "v") -> DataFrame:
    """Share of each node in its parent: |sum|, else mean |value|, else 1, normalised over siblings."""
    levels = list(levels)
    total = F.abs(F.sum(value))
    size = F.when(total > 0, total).otherwise(F.when(F.avg(F.abs(value)) > 0, F.avg(F.abs(value))).otherwise(1.0))
    nodes = history.groupBy(*levels).agg(size.alias("w")).withColumn("depth", depth(levels)).filter("depth > 0")
    up = [F.when(F.col("depth") == k + 1, F.lit(ALL)).otherwise(F.col(c)) for k, c in enumerate(levels)]
    siblings = W.partitionBy("depth", *[f"p_{c}" for c in levels])
    at = nodes.select(*levels, "depth", "w", *[u.alias(f"p_{c}") for u, c in zip(up, levels)])
    return at.withColumn("weight", F.col("w") / F.sum("w").over(siblings)).drop("w")


def bottom_up(leaves: DataFrame, levels: Sequence[str], step: str = "step", value: str = "forecast") -> DataFrame:
    """Every node as the sum of its leaves: one set of grouping sets over (step, path)."""
    from .hierarchy import rollup

    return rollup(leaves, levels, step, {value: F.sum(value)})


def allocate(parents: DataFrame, weights: DataFrame, levels: Sequence[str], start: int, value: str = "forecast", step: str = "step") -> DataFrame:
    """Parents at depth ``start`` and all below them, each child its weight's share of its parent."""
    levels = list(levels)
    out = at = parents.select(*levels, step, value)
    for d in range(start + 1, len(levels) + 1):
        below = weights.filter(F.col("depth") == d).select(*levels, *[f"p_{c}" for c in levels], "weight")
        up = at.select(*[F.col(c).alias(f"p_{c}") for c in levels], step, F.col(value).alias("_v"))
        at = below.join(up, [f"p_{c}" for c in levels]).select(*levels, step, (F.col("_v") * F.col("weight")).alias(value))
        out = out.unionByName(at)
    return out


def reconcile(base: DataFrame, history: DataFrame, levels: Sequence[str], strategy: str, middle: int | None = None, value: str = "v", step: str = "step") -> DataFrame:
    """Reconciled forecasts of all nodes from base forecasts (levels, step, forecast) of all nodes."""
    levels = list(levels)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    at = base.withColumn("_d", depth(levels))
    if strategy == "bottom_up":
        return bottom_up(at.filter(F.col("_d") == len(levels)).drop("_d"), levels, step)
    weights = child_weights(history, levels, value)
    if strategy == "top_down":
        return allocate(at.filter("_d = 0"), weights, levels, 0, step=step)
    if middle is None or not 0 < middle <= len(levels):
        raise ValueError("middle_out needs a level depth between 1 and the number of levels")
    held = at.filter(F.col("_d") == middle).drop("_d")
    down = allocate(held, weights, levels, middle, step=step)
    up = bottom_up(held.select(*levels[:middle], step, "forecast"), levels[:middle], step)
    missing = [F.lit(ALL).alias(c) for c in levels[middle:]]
    above = up.select(step, *levels[:middle], *missing, "forecast").withColumn("_d", depth(levels)).filter(F.col("_d") < middle).drop("_d")
    return down.unionByName(above.select(*levels, step, "forecast"))


def override(reconciled: DataFrame, overrides: DataFrame, base: DataFrame, levels: Sequence[str], step: str = "step") -> DataFrame:
    """Merge overrides (levels, step, and value, pct_of_base or pct_of_reconciled, the first that is given) into
    reconciled forecasts; unknown nodes and steps are ignored; adds locked. Values under 0 become 0."""
    levels = list(levels)
    key = [*levels, step]
    at = reconciled.join(base.select(*key, F.col("forecast").alias("_base")), key, "left").join(overrides.withColumn("_o", F.lit(True)), key, "left")
    asked = F.coalesce(F.col("value"), F.col("_base") * F.col("pct_of_base") / 100, F.col("forecast") * F.col("pct_of_reconciled") / 100)
    locked = F.col("_o").isNotNull() & asked.isNotNull()
    return at.select(*key, F.when(locked, F.greatest(asked, F.lit(0.0))).otherwise(F.col("forecast")).alias("forecast"), locked.alias("locked"))


def reallocate(overridden: DataFrame, weights: DataFrame, levels: Sequence[str], step: str = "step") -> DataFrame:
    """Spread what parents hold beyond their locked children over the unlocked ones, level by level, then sum up.

    A remainder may be negative. Parents whose children are all locked become the sum of them.
    """
    levels = list(levels)
    p = [f"p_{c}" for c in levels]
    known = overridden.withColumn("_d", depth(levels))
    at = known.filter("_d = 0").select(*levels, step, "forecast")
    for d in range(1, len(levels) + 1):
        w = weights.filter(F.col("depth") == d).select(*levels, *p, "weight")
        kids = known.filter(F.col("_d") == d).join(w, levels)
        kin = W.partitionBy(*p, step)
        up = at.select(*[F.col(c).alias(f"p_{c}") for c in levels], step, F.col("forecast").alias("_v"))
        fixed = F.sum(F.when(F.col("locked"), F.col("forecast")).otherwise(0.0)).over(kin)
        free = F.sum(F.when(~F.col("locked"), F.col("weight")).otherwise(0.0)).over(kin)
        spare = F.count_if(~F.col("locked")).over(kin)
        share = F.when(free > 0, F.col("weight") / free).otherwise(1 / spare)
        made = kids.withColumn("_fixed", fixed).withColumn("_share", share).join(up, [*p, step])
        at = made.select(*levels, step, F.when(F.col("locked"), F.col("forecast")).otherwise((F.col("_v") - F.col("_fixed")) * F.col("_share")).alias("forecast"))
    return bottom_up(at, levels, step)


def node_summary(history: DataFrame, reconciled: DataFrame, levels: Sequence[str], value: str = "v") -> DataFrame:
    """Points and total of history, and total of the forecast, per node."""
    past = history.groupBy(*levels).agg(F.count(value).alias("history_points"), F.sum(value).alias("history_total"))
    return past.join(reconciled.groupBy(*levels).agg(F.sum("forecast").alias("future_total")), list(levels), "left")


def compatible(snapshot: dict, request: dict) -> bool:
    """Whether overrides made on a snapshot still fit a request: same frequency, levels, strategy, middle, dates, nodes."""
    return all(snapshot.get(k) == request.get(k) for k in ("freq", "levels", "strategy", "middle", "dates", "nodes"))
