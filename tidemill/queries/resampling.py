"""Resampling, frequency detection and frequency comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.freq import Freq
from ..functions.scalars import rounded
from ..operators import hierarchy, resample
from ..sources.panels import HIERARCHY, orders_daily, orders_panel, table
from .common import DAILY, PANEL, r4

QUERIES, ORACLES = {}, {}


def hier_monthly_rollup(spark, sf_dir):
    """Monthly revenue and orders of every node; leaves are aggregated before the grouping sets expand them."""
    amount = F.col("v").cast("decimal(18,2)")
    leaves = orders_panel(spark, sf_dir).groupBy(*HIERARCHY, F.trunc("ts", "MM").alias("month")).agg(F.sum(amount).alias("v"), F.count("*").alias("n"))
    return hierarchy.rollup(leaves, HIERARCHY, "month", {"revenue": F.sum("v").cast("double"), "n_orders": F.sum("n")})


QUERIES["hier_monthly_rollup"] = hier_monthly_rollup
ORACLES["hier_monthly_rollup"] = f"""
WITH {PANEL}
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name,
       coalesce(c_mktsegment, '*') AS c_mktsegment, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(count(*) AS BIGINT) AS n_orders
FROM panel
GROUP BY GROUPING SETS ((date_trunc('month', ts), r_name, n_name, c_mktsegment), (date_trunc('month', ts), r_name, n_name),
                        (date_trunc('month', ts), r_name), (date_trunc('month', ts)))"""

BUCKETS = {
    "day": (Freq("D"), "CAST(o_orderdate AS DATE)", "1 DAY"),
    "week_left": (Freq("W", "left"), "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INT)", "7 DAY"),
    "week_right": (Freq("W", "right"), "CAST(o_orderdate AS DATE) + CAST((7 - dayofweek(o_orderdate)) % 7 AS INT)", "7 DAY"),
    "month": (Freq("MS"), "CAST(date_trunc('month', o_orderdate) AS DATE)", "1 MONTH"),
    "quarter": (Freq("QS"), "CAST(date_trunc('quarter', o_orderdate) AS DATE)", "3 MONTH"),
    "year": (Freq("YS"), "CAST(date_trunc('year', o_orderdate) AS DATE)", "1 YEAR"),
    "2w_left": (
        Freq("2W", "left"),
        "(SELECT CAST(min(o_orderdate) AS DATE) - CAST(dayofweek(min(o_orderdate)) AS INT) FROM orders) + CAST(14 * floor((CAST(o_orderdate AS DATE) - (SELECT CAST(min(o_orderdate) AS DATE) - CAST(dayofweek(min(o_orderdate)) AS INT) FROM orders)) / 14.0) AS INT)",
        "14 DAY",
    ),
    "2w_right": (
        Freq("2W", "right"),
        "(SELECT CAST(min(o_orderdate) AS DATE) + CAST((7 - dayofweek(min(o_orderdate))) % 7 AS INT) FROM orders) + CAST(14 * ceil((CAST(o_orderdate AS DATE) - (SELECT CAST(min(o_orderdate) AS DATE) + CAST((7 - dayofweek(min(o_orderdate))) % 7 AS INT) FROM orders)) / 14.0) AS INT)",
        "14 DAY",
    ),
    "half_year": (
        Freq("6MS"),
        "CAST((SELECT date_trunc('month', min(o_orderdate)) FROM orders) + to_months(CAST(6 * floor(date_diff('month', (SELECT date_trunc('month', min(o_orderdate)) FROM orders), date_trunc('month', o_orderdate)) / 6.0) AS INT)) AS DATE)",
        "6 MONTH",
    ),
}


def _order_resample(freq, method, **how):
    def query(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"), "o_orderkey")
        got = resample.resample(orders, freq, {"v": method}, tie="o_orderkey", exact=True, **how)
        return got.select("bucket", (F.col("v") if method == "sum" else rounded(F.col("v"))).alias("v"))

    return query


def _dense_sql(bucket, step, value, empty):
    return f"""
WITH b AS (SELECT {bucket} AS bucket, o_totalprice AS v, o_orderdate AS ts, o_orderkey AS k FROM orders),
a AS (SELECT bucket, {value} AS v FROM b GROUP BY bucket),
g AS (SELECT CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL {step})) AS DATE) AS bucket FROM a)
SELECT bucket, {empty} AS v FROM g LEFT JOIN a USING (bucket)"""


for _name, (_freq, _sql, _step) in BUCKETS.items():
    QUERIES[f"resample_{_name}_sum"] = _order_resample(_freq, "sum")
    ORACLES[f"resample_{_name}_sum"] = _dense_sql(_sql, _step, "CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE)", "coalesce(v, 0.0)")

for _method, _value in {
    "mean": "avg(v)",
    "median": "quantile_cont(v, 0.5)",
    "first": "arg_min(v, (ts, k))",
    "last": "arg_max(v, (ts, k))",
    "min": "min(v)",
    "max": "max(v)",
}.items():
    QUERIES[f"resample_month_{_method}"] = _order_resample(Freq("MS"), _method)
    ORACLES[f"resample_month_{_method}"] = _dense_sql(BUCKETS["month"][1], "1 MONTH", _value, r4("v"))


def resample_segment_week(spark, sf_dir):
    """Weekly order value of each market segment on its dense grid: a panel resampled by key in one shuffle."""
    got = resample.resample(orders_panel(spark, sf_dir), "W", {"v": "sum"}, ["c_mktsegment"], exact=True)
    return got.select("c_mktsegment", "bucket", "v")


QUERIES["resample_segment_week"] = resample_segment_week
ORACLES["resample_segment_week"] = f"""
WITH {PANEL},
a AS (SELECT c_mktsegment, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS bucket, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2),
g AS (SELECT c_mktsegment, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS DATE) AS bucket FROM a GROUP BY 1)
SELECT c_mktsegment, bucket, coalesce(v, 0.0) AS v FROM g LEFT JOIN a USING (c_mktsegment, bucket)"""


def resample_mixed(spark, sf_dir):
    """Several columns at once, each by its role: price summed, discount averaged, returned flag by maximum."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    got = resample.resample(lines, "MS", {"price": "sum", "discount": "mean", "returned": "max"}, exact=True, dense=False)
    return got.select("bucket", "price", rounded(F.col("discount")).alias("discount"), "returned")


QUERIES["resample_mixed"] = resample_mixed
ORACLES["resample_mixed"] = f"""
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
       {r4("avg(l_discount)")} AS discount, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
FROM lineitem GROUP BY 1"""


def ohlc_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return resample.ohlc(orders, "MS", tie="o_orderkey")


QUERIES["ohlc_month"] = ohlc_month
ORACLES["ohlc_month"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,
       max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close
FROM orders GROUP BY 1"""

COMPARED = ("W", "MS", "QS")


def accumulate_compare(spark, sf_dir):
    got = resample.compare_frequencies(orders_daily(spark, sf_dir), COMPARED, exact=True)
    return got.select("freq", F.col("n").cast("long").alias("n"), *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "cv", "total", "min", "max", "pct_zero")])


QUERIES["accumulate_compare"] = accumulate_compare
ORACLES["accumulate_compare"] = "WITH " + DAILY.replace("daily AS", "d0 AS") + ",\n" + ",\n".join(
    f"""a{i} AS (SELECT {sql.replace("o_orderdate", "ts")} AS bucket, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM d0 GROUP BY 1),
g{i} AS (SELECT '{f}' AS freq, coalesce(v, 0.0) AS v FROM (SELECT CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL {step})) AS DATE) AS bucket FROM a{i}) LEFT JOIN a{i} USING (bucket))"""
    for i, (f, (_, sql, step)) in enumerate((("W", BUCKETS["week_left"]), ("MS", BUCKETS["month"]), ("QS", BUCKETS["quarter"])))
) + f"""
SELECT freq, CAST(count(v) AS BIGINT) AS n, {r4("avg(v)")} AS mean, {r4("stddev_samp(v)")} AS std,
       {r4("stddev_samp(v) / (avg(v) + 1e-12)")} AS cv, {r4("sum(v)")} AS total, {r4("min(v)")} AS min, {r4("max(v)")} AS max,
       {r4("100 * avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)")} AS pct_zero
FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY freq"""


def info_retention(spark, sf_dir):
    daily = orders_daily(spark, sf_dir)
    kept = resample.retention(daily, resample.resample(daily, "MS", {"v": "mean"}))
    return kept.select("n_in", "n_out", rounded(F.col("retention")).alias("retention"), rounded(F.col("compression")).alias("compression"))


QUERIES["info_retention"] = info_retention
ORACLES["info_retention"] = f"""
WITH {DAILY}, m AS (SELECT date_trunc('month', ts) AS b, avg(v) AS v FROM daily GROUP BY 1),
x AS (SELECT var_samp(v) AS v0, CAST(count(v) AS BIGINT) AS n_in FROM daily), y AS (SELECT var_samp(v) AS v1, CAST(count(v) AS BIGINT) AS n_out FROM m)
SELECT n_in, n_out, {r4("least(1.0, v1 / (v0 + 1e-12))")} AS retention, {r4("n_in / n_out")} AS compression FROM x, y"""

_GAPS = """
g AS (SELECT {k} AS k, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY {k} ORDER BY t) AS gap FROM (SELECT DISTINCT {k}, t FROM s)),
m AS (SELECT k, CAST(count(*) AS BIGINT) AS n_timestamps, CAST(count(gap) AS BIGINT) AS n_gaps, quantile_cont(gap, 0.5) / 86400e6 AS days, count(DISTINCT gap) <= 1 AS regular FROM g GROUP BY k)
SELECT k AS series, n_timestamps, n_gaps, regular, floor(days * 1e6 + 0.50001) / 1e6 AS gap_days,
       CASE WHEN days IS NULL OR days <= 1 THEN 'D' WHEN days <= 7 THEN 'W' WHEN days <= 31 THEN 'MS' WHEN days <= 92 THEN 'QS' ELSE 'YS' END AS freq
FROM m"""


def _freq_columns(df, key):
    return df.select(F.col(key).alias("series"), "n_timestamps", "n_gaps", "regular", rounded(F.col("gap_days"), 6).alias("gap_days"), "freq")


def freq_detect_events(spark, sf_dir):
    return _freq_columns(resample.detect_frequency(table(spark, sf_dir, "events"), "ts", ["event_type"]), "event_type")


def freq_detect_nations(spark, sf_dir):
    return _freq_columns(resample.detect_frequency(orders_panel(spark, sf_dir), "ts", ["n_name"]), "n_name")


def freq_detect_monthly(spark, sf_dir):
    monthly = orders_panel(spark, sf_dir).select("r_name", F.trunc("ts", "MM").alias("ts"))
    return _freq_columns(resample.detect_frequency(monthly, "ts", ["r_name"]), "r_name")


QUERIES |= {"freq_detect_events": freq_detect_events, "native_step_nations": freq_detect_nations, "freq_detect_monthly": freq_detect_monthly}
ORACLES["freq_detect_events"] = "WITH s AS (SELECT event_type, ts AS t FROM events)," + _GAPS.format(k="event_type")
ORACLES["native_step_nations"] = f"WITH {PANEL}, s AS (SELECT n_name, ts AS t FROM panel)," + _GAPS.format(k="n_name")
ORACLES["freq_detect_monthly"] = f"WITH {PANEL}, s AS (SELECT r_name, CAST(date_trunc('month', ts) AS TIMESTAMP) AS t FROM panel)," + _GAPS.format(k="r_name")


def daily_money(spark, sf_dir):
    """Order value a day: the plain single series other queries start from."""
    return orders_daily(spark, sf_dir)


QUERIES["node_series_total"] = daily_money
ORACLES["node_series_total"] = f"WITH {DAILY} SELECT ts, v FROM daily"


def downsample_chart(spark, sf_dir):
    """The chart feed: 400 evenly spaced days of the daily series (the feature is the cap)."""
    return resample.downsample(orders_daily(spark, sf_dir), 400)


QUERIES["chart_downsample"] = downsample_chart
ORACLES["chart_downsample"] = f"""
WITH {DAILY}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM daily)
SELECT ts, v FROM n WHERE n <= 400 OR floor(ceil(i / ((n - 1) / 399.0)) * ((n - 1) / 399.0)) = i"""

