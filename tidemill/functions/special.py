"""Special functions as column expressions: gamma and beta tails by folds whose length is known before the data."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _of(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _bound(body: Callable[[Column], Column], **arguments: Column) -> Column:
    """``body`` of a struct of arguments that are worked out once a row, however often it names them."""
    return F.get(F.transform(F.array(F.struct(*[c.cast("double").alias(n) for n, c in arguments.items()])), body), F.lit(0))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series eight places on."""
    y = x + 8
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def gamma_tail(a: Column | float, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x): a power series below a + 1, a continued fraction beyond."""
    return _bound(lambda s: _gamma_tail(s["a"], s["x"], s["log_a"]), a=_of(a), x=x, log_a=lgamma(a) if isinstance(a, Column) else F.lit(math.lgamma(a)))


def _gamma_tail(a: Column, x: Column, log_a: Column) -> Column:
    front = F.exp(a * F.log(x) - x - log_a)
    steps = (60 + 12 * F.ceil(F.sqrt(a))).cast("int")
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    low = 1 - front * F.aggregate(F.sequence(F.lit(1), steps), start, add, lambda s: s["total"])
    fold = F.aggregate(F.sequence(steps * 4, F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n * (n - a) / (2 * n + 1 + x - a - f))
    high = front / (x + 1 - a - fold)
    return F.when(x.isNull() | a.isNull(), None).when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), low)).otherwise(F.least(F.lit(1.0), high))


def _beta_fraction(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The part of the beta distribution below x where x lies under its mean; y is 1 - x. The fraction is folded from its end."""
    steps = (40 + 4 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int")

    def add(f: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + even / (1 + odd / f)

    fold = F.aggregate(F.sequence(steps, F.lit(1), F.lit(-1)), F.lit(1.0), add)
    front = F.exp(a * F.log(x) + b * F.log(y) - lgamma(a) - lgamma(b) + lgamma(a + b)) / a
    return front / (1 - (a + b) * x / (a + 1) / fold)


def beta_below(a: Column | float, b: Column | float, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta function I(x; a, b); y is 1 - x where that is known without rounding."""
    return _bound(lambda s: _beta_below(s["a"], s["b"], s["x"], s["y"]), a=_of(a), b=_of(b), x=x, y=1 - x if y is None else y)


def _beta_below(a: Column, b: Column, x: Column, y: Column) -> Column:
    low = x < (a + 1) / (a + b + 2)
    return F.when(x.isNull() | a.isNull() | b.isNull(), None).when(x <= 0, 0.0).when(y <= 0, 1.0).when(low, _beta_fraction(a, b, x, y)).otherwise(1 - _beta_fraction(b, a, y, x))


def chi2_tail(x: Column, df: Column | float) -> Column:
    """Upper tail of chi-squared."""
    return gamma_tail(df / 2, x / 2)


def t_tails(t: Column, df: Column | float) -> Column:
    """Both tails of Student's t beyond |t|."""
    df = _of(df)
    square = t * t
    return beta_below(df / 2, 0.5, df / (df + square), square / (df + square))


def t_below(t: Column, df: Column | float) -> Column:
    """Distribution function of Student's t."""
    half = t_tails(t, df) / 2
    return F.when(t > 0, 1 - half).otherwise(half)
