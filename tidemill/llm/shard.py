"""Sharding by a hypergeometric communication matrix, in DataFrame functions alone.

Rows are dealt to P source partitions by a hash of their content. For each source partition the number of rows it
sends to each shard is drawn from the multivariate hypergeometric law that a uniform shuffle with exact shard sizes
implies; rows are permuted inside the source partition, exchanged by those counts, and permuted again in the shard.
Counts of shards differ by one at most, whatever repeats: rows are stored with a number first, which their hashes take
in, so equal rows, equal keys, equal texts and hot sources are dealt like any other row.

Defined results: a null text counts as empty (size 1); a null id is a value like any other; rows that are equal in
every hashed column are interchangeable; an empty table gives an empty result with the same columns. Columns that
the operator adds replace input columns of the same name.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored, without


def hypergeometric(good: int, bad: int, drawn: int, u: float) -> int:
    """Successes among ``drawn`` of ``good + bad`` items, by inverting the distribution at ``u``.

    Log ratios of neighbouring probabilities are summed outward from the mode over 14 standard deviations, so
    counts of any size take a short array.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    deviation = math.sqrt(max(1.0, drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))))
    reach = int(14 * deviation) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logp = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(logp - logp.max()))
    return low + int(np.searchsorted(mass, u * mass[-1], side="right").clip(0, high - low))


def communication_matrix(counts: Sequence[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each source partition sends to each shard: row sums ``counts``, column sums equal to within one."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        row, pool = [], sum(left)
        for s in range(shards):
            x = hypergeometric(left[s], pool - left[s], n, float(rng.random()))
            row.append(x)
            pool -= left[s]
            n -= x
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _literal(rows: list[list[int]]) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")


def shard(
    docs: DataFrame,
    keys: list[str],
    shards: int = 16,
    seed: int = 17,
    partitions: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (its place in the shard, gapless from 0).

    keys: columns whose hash, with the row's number, places a row.
    partitions, buckets: source partitions, and pieces in which a shard is ordered; by default one for about
    500,000 rows, 256 and 32 at least, 65,536 at most. Only their counts reach the driver.
    """
    seeded = lambda k: F.xxhash64(F.lit(seed * 1000 + k), *[F.col(f"`{c}`") for c in keys], F.col("_row"))
    df = without(docs, ["shard", "slot", "_row", "_part", "_rank", "_order", "_bucket"])
    df = stored(df.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    if partitions is None or buckets is None:
        rows = df.count()
        partitions = partitions or min(1 << 16, max(256, rows // 500_000))
        buckets = buckets or min(1 << 16, max(32, rows // (500_000 * shards)))
    df = df.withColumn("_part", F.pmod(seeded(1), F.lit(partitions)).cast("int"))
    counted = {r["_part"]: r["n"] for r in df.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    counts = [counted.get(p, 0) for p in range(partitions)]
    matrix = communication_matrix(counts, shards, seed)
    cuts = [np.cumsum(row).tolist() for row in matrix]
    local = W.partitionBy("_part").orderBy(seeded(2), "_row")
    df = df.withColumn("_rank", F.row_number().over(local) - 1)
    cut = F.element_at(_literal(cuts), F.col("_part") + 1)
    df = df.withColumn("shard", F.size(F.filter(cut, lambda c: c <= F.col("_rank"))).cast("int"))
    # Second permutation: a fresh hash orders the shard; its top bits cut it into buckets that are ranked apart.
    df = df.withColumn("_order", seeded(3)).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_order", 33), F.lit(buckets)).cast("int"))
    sizes = {(r["shard"], r["_bucket"]): r["n"] for r in df.groupBy("shard", "_bucket").agg(F.count("*").alias("n")).collect()}
    base = []
    for s in range(shards):
        at, row = 0, []
        for b in range(buckets):
            row.append(at)
            at += sizes.get((s, b), 0)
        base.append(row)
    inside = W.partitionBy("shard", "_bucket").orderBy("_order", "_row")
    start = F.element_at(F.element_at(_literal(base), F.col("shard") + 1), F.col("_bucket") + 1)
    return df.withColumn("slot", start + F.row_number().over(inside) - 1).drop("_row", "_part", "_rank", "_order", "_bucket")
