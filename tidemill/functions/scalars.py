"""Scalar expressions: calendar fields, season labels, rounding, shape statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on the scaled double, with a nudge of 1e-5 of the last place.

    Unlike ``round`` this agrees between engines at decimal ties, and when sums were added in another order.
    """
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)


def money(x: Column) -> Column:
    """Exact, order-independent sum of amounts with two decimals."""
    return F.sum(x.cast("decimal(18,2)")).cast("double")


def finite(x: Column) -> Column:
    """Null for null, NaN and infinite values."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def corrected_skew(x: Column) -> Column:
    """Bias-corrected sample skewness (null under three values)."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


CALENDAR = ("day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend", "is_month_start", "is_month_end")


def calendar(ts: Column) -> dict[str, Column]:
    """Calendar features; day_of_week counts from Monday as 0, weeks are ISO weeks."""
    d = ts.cast("date")
    angle = lambda x, period: x * F.lit(2 * math.pi / period)
    return {
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "month_sin": F.sin(angle(F.month(d), 12)),
        "month_cos": F.cos(angle(F.month(d), 12)),
        "dow_sin": F.sin(angle(F.weekday(d), 7)),
        "dow_cos": F.cos(angle(F.weekday(d), 7)),
    }


def season(ts: Column, interval: str) -> tuple[Column, Column]:
    """(label, calendar order) of a date's season at an interval: D, W, M, Q, 6M or Y; others give year-month."""
    d = ts.cast("date")
    if interval == "D":
        return F.date_format(d, "EEE"), F.weekday(d)
    if interval == "W":
        return F.concat(F.lit("W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")), F.weekofyear(d)
    if interval == "M":
        return F.date_format(d, "MMM"), F.month(d)
    if interval == "Q":
        return F.concat(F.lit("Q"), F.quarter(d).cast("string")), F.quarter(d)
    if interval == "6M":
        return F.when(F.month(d) <= 6, F.lit("H1")).otherwise(F.lit("H2")), F.when(F.month(d) <= 6, 1).otherwise(2)
    if interval == "Y":
        return F.year(d).cast("string"), F.year(d)
    return F.date_format(d, "yyyy-MM"), F.year(d) * 12 + F.month(d)


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def log_shifted(x: Column, least: Column) -> Column:
    """log(1 + x), after moving a series whose least value is not positive above zero."""
    return F.log1p(x + F.when(least <= 0, F.abs(least) + 1).otherwise(0.0))


def name_tokens(name: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^0-9a-z]+", name.lower()) if t]
