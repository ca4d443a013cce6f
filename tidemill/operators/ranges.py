"""Long series cut into ranges of time: exact positions and windows with a halo, without one task for a whole series.

``cut`` reads the bounds of the ranges off the data, as quantiles of the time column in one aggregate. ``positions`` ranks
rows inside their ranges and adds the rows of the ranges before. ``with_windows`` deals rows to blocks of equal length by
position, copies the rows near an edge to the neighbouring blocks, runs the windows there and drops the copies: values are
those of one window over the whole series, whatever the number of ranges and blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..sources.shared import kept

#: Rows of a block, and about the rows of a range; there are ``MOST`` ranges at most.
BLOCK, MOST = 1 << 17, 256


@dataclass(frozen=True)
class Cut:
    """Where series are cut: lower bounds of the ranges but the first (as text, and their type), and rows of a block.

    facts: what else the pass over the data told, ``n`` (rows) among it.
    """

    bounds: tuple[str, ...] = ()
    kind: str = "timestamp"
    block: int = BLOCK
    facts: dict[str, Any] = field(default_factory=dict, compare=False)

    def range_of(self, ts: Column) -> Column:
        """The range of a time, from 0: the number of bounds up to it, by a tree of comparisons."""

        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(ts < F.lit(self.bounds[middle]).cast(self.kind), among(low, middle)).otherwise(among(middle + 1, high))

        return F.when(ts.isNull(), 0).otherwise(among(0, len(self.bounds))) if self.bounds else F.lit(0)


def cut(df: DataFrame, ts: str = "ts", ranges: int | None = None, block: int = BLOCK, **facts: Column) -> Cut:
    """Ranges of about ``block`` rows of ``df``, or so many ``ranges``; times that repeat stay together. One aggregate,
    which also works out ``facts``."""
    kind = dict(df.dtypes)[ts]
    most = ranges or MOST
    shares = [i / most for i in range(1, most)]
    quantiles = F.percentile_approx(ts, shares, 100 * most).cast("array<string>") if shares else F.array().cast("array<string>")
    told = df.agg(F.count("*").alias("n"), quantiles.alias("q"), *[c.alias(name) for name, c in facts.items()]).first()
    seen = {name: told[name] for name in ("n", *facts)}
    wanted = ranges or min(MOST, -(-told["n"] // block))
    if wanted < 2 or not told["q"]:
        return Cut((), kind, block, seen)
    picked = [told["q"][-(-most * i // wanted) - 1] for i in range(1, wanted)]
    return Cut(tuple(dict.fromkeys(picked)), kind, block, seen)


def settled(df: DataFrame, ts: str = "ts", at: Cut | None = None) -> tuple[DataFrame, Cut]:
    """A table that several branches are about to read, and its cut: without ``at`` it is stored and cut here; who passes
    a cut has read the table before and looks after that."""
    if at is not None:
        return df, at
    stored = kept(df, "series")
    return stored, cut(stored, ts)


def _runs(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, _before): rows of a series in the ranges before each; one small row a range."""
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"), F.min(F.lit(0)).alias("_one"))
    order = W.partitionBy(*keys, "_one").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_before"))


def beside(df: DataFrame, told: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``told``, which has one row for each value of ``keys`` (one row, without keys);
    null is a value."""
    if not keys:
        return df.join(F.broadcast(told), F.lit(True), how)
    more = [c for c in told.columns if c not in keys]
    other = told.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], *more)
    joined = df.join(other, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], how)
    return joined.drop(*[f"_key{i}" for i in range(len(keys))])


def positions(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", at: Cut = Cut(), name: str = "_i", ties: Sequence[str] = ()) -> DataFrame:
    """Adds each row's place in its series, from 0, in order of time and ``ties``."""
    keys = list(keys)
    ranged = df.withColumn("_range", at.range_of(F.col(ts)))
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(ts, *ties)).cast("long") - 1
    if not at.bounds:
        return ranged.withColumn(name, local).drop("_range")
    joined = beside(ranged.withColumn("_local", local), _runs(ranged, keys), [*keys, "_range"])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("_local") + F.col("_before")).alias(name))


def with_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    make: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    at: Cut = Cut(),
    ties: Sequence[str] = (),
) -> DataFrame:
    """``df`` with the columns of ``make(order)``: windows over series in time order that reach at most ``back`` rows
    back and ``ahead`` rows ahead. A block holds ``at.block`` rows and its halo."""
    keys = list(keys)
    if not at.bounds:
        order = W.partitionBy(*keys, "_block").orderBy(ts, *ties)
        return df.withColumn("_block", F.lit(0)).withColumns(make(order)).drop("_block")
    placed = positions(df, keys, ts, at, "_i", ties)
    made = over_blocks(placed, keys, make, back, ahead, at.block)
    return made.drop("_i")


def over_blocks(placed: DataFrame, keys: Sequence[str], make: Callable[[WindowSpec], dict[str, Column]] | Sequence, back: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Windows over rows that carry their position ``_i``, in blocks of positions with a halo. Several ``make`` follow one
    another, each over what the last ones made; the halo is what they reach together."""
    of = lambda x: F.floor(x / F.lit(block))
    dealt = placed.withColumn("_block", F.explode(F.sequence(F.greatest(F.lit(0), of(F.col("_i") - ahead)), of(F.col("_i") + back))))
    order, out, new = W.partitionBy(*keys, "_block").orderBy("_i"), dealt, {}
    for one in [make] if callable(make) else make:
        made = one(order)
        out, new = out.withColumns(made), new | made
    out = out.filter(of(F.col("_i")) == F.col("_block"))
    return out.select(*[F.col(f"`{c}`") for c in placed.columns if c not in new], *new)
