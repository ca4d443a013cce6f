"""Least squares of many series at once: moments in one grouped aggregate, the normal equations solved over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its column's variance is none: the column hangs on those before it and gets 0.
LEAST = 1e-11


def solved(matrix: Column, size: int) -> Column:
    """Rows of [R | ...] after elimination by the columns of R, an array of arrays: R is symmetric and not negative."""

    def step(rows: Column, p: Column) -> Column:
        pivot = F.get(rows, p)
        factor = F.when(F.abs(F.get(pivot, p)) > LEAST, 1 / F.get(pivot, p)).otherwise(0.0)
        own = F.transform(pivot, lambda v: v * factor)
        return F.transform(rows, lambda row, i: F.when(i == p, own).otherwise(F.zip_with(row, pivot, lambda v, q: v - F.get(row, p) * factor * q)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)


def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """y on xs and a constant over the rows without nulls, a row for each key: n, intercept, coef and error (arrays in the
    order of xs), r2.

    Means and covariances of all columns are one aggregate, so a series is never gathered; columns are scaled before the
    solution, so their sizes may differ. A column that hangs on those before it, or never changes, gets 0.
    """
    keys, xs = list(keys), list(xs)
    names = [*xs, y]
    k = len(xs)
    whole = df
    for c in names:
        whole = whole.filter(F.col(c).isNotNull())
    pairs = {f"_c{i}_{j}": F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")) for i in range(k + 1) for j in range(i, k + 1)}
    means = {f"_m{i}": F.avg(F.col(c).cast("double")) for i, c in enumerate(names)}
    told = whole.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in (pairs | means).items()])
    told = told.filter("n > 0").withColumns({f"_s{i}": F.sqrt(F.greatest(F.col(f"_c{i}_{i}"), F.lit(0.0))) for i in range(k + 1)})

    def corr(i: int, j: int) -> Column:
        bottom = F.col(f"_s{i}") * F.col(f"_s{j}")
        return F.when(bottom > 0, F.col(f"_c{min(i, j)}_{max(i, j)}") / bottom).otherwise(0.0)

    matrix = F.array(*[F.array(*[corr(i, j) for j in range(k + 1)], *[F.lit(float(i == j)) for j in range(k)]) for i in range(k)])
    told = told.withColumn("_a", solved(matrix, k))
    entry = lambda i, j: F.get(F.get("_a", F.lit(i)), F.lit(j))
    r2 = sum((entry(i, k) * corr(i, k) for i in range(k)), F.lit(0.0))
    told = told.withColumn("r2", r2)
    spread = F.col("n") * F.col(f"_c{k}_{k}") * F.greatest(F.lit(0.0), 1 - F.col("r2")) / F.greatest(F.lit(1), F.col("n") - k - 1)
    scale = lambda i: F.when(F.col(f"_s{i}") > 0, 1 / F.col(f"_s{i}")).otherwise(0.0)
    coef = F.array(*[entry(i, k) * F.col(f"_s{k}") * scale(i) for i in range(k)])
    error = F.array(*[F.sqrt(F.greatest(F.lit(0.0), spread * entry(i, k + 1 + i) / F.col("n"))) * scale(i) for i in range(k)])
    made = told.withColumns({"coef": coef, "error": error})
    intercept = F.col(f"_m{k}") - sum((F.get("coef", F.lit(i)) * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    return made.select(*keys, "n", intercept.alias("intercept"), "coef", "error", "r2")
