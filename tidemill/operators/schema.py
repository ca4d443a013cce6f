"""Schema inference: roles of columns, date parsing, frequency, coercion, one-pass profiles.

Column names are judged by their tokens, values by one aggregation over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import name_tokens
from ..sources.shared import kept
from .ranges import cut, with_windows
from .resample import detect_frequency

#: Name tokens that mark a time column, in order of preference.
TIME_TOKENS = ("date", "datetime", "time", "timestamp", "ts", "period", "week", "month", "year", "day", "hour", "dt")
#: Date patterns tried in order; day-first forms only where the data may be ambiguous.
PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyyMMdd", "yyyy-MM")
DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd-MM-yy")
AMBIGUOUS = r"^\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s*$"
ROLES = ("dependent", "independent", "event", "hierarchy", "timestamp", "ignore")


def is_time_name(name: str) -> bool:
    return time_rank(name) is not None


def time_rank(name: str) -> int | None:
    """Place of the name's first time token; longer tokens also count inside a word (``orderdate``), short ones don't."""
    tokens = name_tokens(name)
    ranks = [i for i, t in enumerate(TIME_TOKENS) if t in tokens or (len(t) > 3 and any(t in x for x in tokens))]
    return min(ranks, default=None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def parsed(column: Column, patterns: Sequence[str] = PATTERNS) -> Column:
    """Timestamp of a text under the first pattern that fits; null if none does. Texts with other characters than the
    patterns have are not tried: each failure costs an exception."""
    tried = F.coalesce(*[F.try_to_timestamp(column, F.lit(p)) for p in patterns])
    return F.when(column.rlike(r"^[-+0-9/: ]+$"), tried).cast("timestamp_ntz")


def parse_scores(df: DataFrame, column: str, choices: dict[str, Sequence[str]], ranges: int | None = None) -> DataFrame:
    """Per choice of patterns: values parsed, month starts, first days, share of the commonest gap.

    Every choice is tried on one pass; gaps between the different times are taken in ranges of time.
    """
    tried = F.explode(F.array(*[F.struct(F.lit(name).alias("choice"), parsed(F.col(column), patterns).alias("t")) for name, patterns in choices.items()]))
    counts = df.select(tried.alias("s")).select("s.*").groupBy("choice", "t").agg(F.count("*").alias("n"))
    counts = counts.withColumn("micros", F.unix_micros(F.col("t").cast("timestamp")))
    times = counts.filter("t is not null")
    gaps = with_windows(times, ["choice"], "micros", lambda order: {"g": F.col("micros") - F.lag("micros").over(order)}, back=1, at=cut(times, "micros", ranges))
    share = gaps.filter("g is not null").groupBy("choice", "g").agg(F.count("*").alias("n")).groupBy("choice").agg((F.max("n") / F.sum("n")).alias("gap_share"))
    valid, firsts = F.when(F.col("t").isNotNull(), F.col("n")), F.when(F.dayofmonth("t") == 1, F.col("n"))
    stats = counts.groupBy("choice").agg(F.coalesce(F.sum(valid), F.lit(0)).alias("n_valid"), F.coalesce(F.sum(firsts), F.lit(0)).alias("n_first_days"))
    return stats.join(share, "choice", "left")


def parse_dates(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Adds the parsed timestamp; where 80 % of the values look like d/m/y, month-first and day-first compete by score."""
    name = name or column
    if dict(df.dtypes)[column] != "string":
        return df.withColumn(name, F.col(column).cast("timestamp_ntz"))
    odd = df.agg(F.avg(F.col(column).rlike(AMBIGUOUS).cast("int")).alias("a")).first()["a"] or 0.0
    patterns = PATTERNS
    if odd >= 0.8:
        scores = parse_scores(df, column, {"month_first": PATTERNS, "day_first": DAY_FIRST}).collect()
        best = max(scores, key=lambda r: (r["n_valid"], r["n_first_days"], r["gap_share"] or 0.0, r["choice"] == "month_first"))
        patterns = DAY_FIRST if best["choice"] == "day_first" else PATTERNS
    return df.withColumn(name, parsed(F.col(column), patterns))


def to_number(column: Column, fill: float | None = 0.0) -> Column:
    """Number of a value; unparseable, missing and NaN values become ``fill`` (null where that is None)."""
    x = column.try_cast("double")
    clean = F.when(~F.isnan(x), x)
    return clean if fill is None else F.coalesce(clean, F.lit(fill))


def coerce(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> tuple[DataFrame, DataFrame]:
    """(coerced table, one row per column with the values that weren't numbers): bad values are counted before the fill."""
    bad = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & to_number(F.col(c), None).isNull()).alias("n_bad"), F.count_if(F.col(c).isNull()).alias("n_missing")).alias(f"_{i}") for i, c in enumerate(columns)]
    report = df.agg(*bad).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))
    return df.select(*[(to_number(F.col(c), fill).alias(c) if c in columns else F.col(c)) for c in df.columns]), report


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of all ``columns`` in one scan and one exchange: values are told by 128 bits of hash, made
    distinct before they are shuffled, so a column of few values sends few rows."""
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).cast("short").alias("i"), F.xxhash64(F.col(f"`{c}`")).alias("a"), F.xxhash64(F.lit(7), F.col(f"`{c}`")).alias("b"))) for i, c in enumerate(columns)]
    values = df.select(F.explode(F.array(*cells)).alias("x")).filter("x is not null").select("x.*").distinct()
    counts = values.groupBy("i").agg(F.count("*").alias("n"))
    names = df.sparkSession.range(0, len(columns), 1, 1).select(F.col("id").cast("short").alias("i"), F.get(F.array(*[F.lit(c) for c in columns]), F.col("id").cast("int")).alias("column"))
    return names.join(counts, "i", "left").select("column", F.coalesce("n", F.lit(0)).cast("long").alias("n_distinct"))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: column, dtype, n, n_missing, n_distinct, min, max, is_event, is_hierarchy, parse_rate.

    One pass over the table gives all but the distinct counts, a second one those of all columns together. Without
    ``exact`` they are a sketch's in the first pass, and only text columns that may be hierarchies are counted.

    An event column holds 0 and 1 (or true and false) with at least one 1. A hierarchy column is text whose distinct
    values are few: at most 30 % of the rows (two at least) and fewer than the rows.
    """
    parts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        n = F.count(c)
        number = isinstance(f.dataType, (T.NumericType, T.BooleanType))
        text = isinstance(f.dataType, T.StringType)
        x = F.round(c.cast("double"), 6) if number else F.lit(None).cast("double")
        event = F.coalesce(F.bool_and(x.isin(0.0, 1.0)) & (F.max(x) == 1), F.lit(False)) if number else F.lit(False)
        rate = F.avg(F.when(c.isNotNull(), parsed(c).isNotNull().cast("int"))) if text else F.lit(None).cast("double")
        flat = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        edge = lambda fn, c=c, flat=flat: F.lit(None).cast("string") if flat else fn(c).cast("string")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), n.alias("n"), F.count_if(c.isNull()).alias("n_missing"), F.lit(text).alias("_text"), F.lit(None).cast("long").alias("_about") if exact or flat else F.approx_count_distinct(c, 0.02).alias("_about"),
                edge(F.min).alias("min"), edge(F.max).alias("max"), event.alias("is_event"), rate.alias("parse_rate"),
            ).alias(f"_{i}")
        )
    told = df.agg(*parts).select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(parts))])))
    wanted = df.columns
    if not exact:
        told = kept(told, "profile")  # a row a column
        wanted = [r["column"] for r in told.filter(F.col("_text") & (F.col("_about") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.35)))).collect()]
    made = told.join(F.broadcast(distinct_counts(df, wanted)), "column", "left") if wanted else told.withColumn("n_distinct", F.lit(None).cast("long"))
    made = made.withColumn("n_distinct", F.coalesce("n_distinct", "_about"))
    tier = F.col("_text") & (F.col("n_distinct") <= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.3))) & (F.col("n_distinct") < F.col("n"))
    return made.select("column", "dtype", "n", "n_missing", "n_distinct", "min", "max", "is_event", tier.alias("is_hierarchy"), "parse_rate")


@dataclass
class Roles:
    """Roles of a table's columns."""

    timestamp: str | None = None
    dependent: list[str] = field(default_factory=list)
    independent: list[str] = field(default_factory=list)
    event: list[str] = field(default_factory=list)
    hierarchy: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)

    @property
    def values(self) -> list[str]:
        return [*self.dependent, *self.independent, *self.event]

    @classmethod
    def of(cls, roles: dict[str, str]) -> Roles:
        made = cls()
        for column, role in roles.items():
            if role not in ROLES:
                raise ValueError(f"unknown role {role!r}")
            if role == "timestamp":
                made.timestamp = column
            else:
                getattr(made, role).append(column)
        return made

    def as_dict(self) -> dict[str, str]:
        out = {self.timestamp: "timestamp"} if self.timestamp else {}
        return out | {c: r for r in ROLES if r != "timestamp" for c in getattr(self, r)}


def guess_timestamp(df: DataFrame) -> str:
    """A column of a time type, else one named like time, else the first text that parses as dates at least at 80 %."""
    typed = time_columns(df)
    named = sorted((c for c in typed or df.columns if is_time_name(c)), key=time_rank)
    if named:
        return named[0]
    if typed:
        return typed[0]
    texts = string_columns(df)
    if texts:
        rates = df.agg(*[F.avg(parsed(F.col(c)).isNotNull().cast("int")).alias(c) for c in texts]).first()
        for c in texts:
            if (rates[c] or 0) >= 0.8:
                return c
    raise ValueError("no column looks like time")


def infer_roles(df: DataFrame) -> Roles:
    """Suggested roles: time, hierarchy (coarsest first), events, first other number dependent, the rest independent."""
    rows = {r["column"]: r for r in profile(df, exact=False).collect()}
    time = guess_timestamp(df)
    tiers = sorted((c for c, r in rows.items() if r["is_hierarchy"] and c != time), key=lambda c: (rows[c]["n_distinct"], c))
    events = [c for c, r in rows.items() if r["is_event"] and c != time]
    numbers = [c for c in numeric_columns(df) if c not in events and c != time]
    rest = [c for c in df.columns if c not in {time, *tiers, *events, *numbers}]
    if not numbers and not events:
        raise ValueError("no numeric column")
    return Roles(time, numbers[:1], numbers[1:], events, tiers, rest)


def report(df: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row: rows, series (value columns times key combinations), first and last time, frequency of the distinct times."""
    agg = df.agg(F.count("*").alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), *[F.count_distinct(k).alias(f"_{i}") for i, k in enumerate(keys)])
    combos = reduce(lambda a, b: a * b, [F.col(f"_{i}") for i in range(len(keys))], F.lit(len(values)))
    freq = detect_frequency(df, ts).select("freq", "n_timestamps", F.lit(1).alias("_k"))
    return agg.withColumn("_k", F.lit(1)).join(freq, "_k").select("n_rows", combos.cast("long").alias("n_series"), "first", "last", "n_timestamps", "freq")
