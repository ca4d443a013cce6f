"""Lag, rolling, calendar, split, scaling and future-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import CALENDAR, rounded
from ..operators import decompose
from ..operators import features as X
from ..operators import windows as N
from ..sources.panels import orders_daily, orders_panel, region_monthly, shipments_daily
from .common import DAILY, PANEL, REGION, SHIPMENTS, long_count, r4
from .decompositions import STL

QUERIES, ORACLES = {}, {}
SEGMENT = f"{PANEL}, seg AS (SELECT c_mktsegment, CAST(ts AS DATE) AS ts, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2)"


def segments(spark, sf_dir):
    from ..functions.scalars import money

    return orders_panel(spark, sf_dir).groupBy("c_mktsegment", F.col("ts").cast("date").alias("ts")).agg(money(F.col("v")).alias("v"))


def lag_features(spark, sf_dir):
    order = N.ordered(["c_mktsegment"], "ts")
    return segments(spark, sf_dir).select("c_mktsegment", "ts", "v", *[c.alias(n) for n, c in N.lags("v", (1, 7, 28), order).items()])


QUERIES["lag_features"] = lag_features
ORACLES["lag_features"] = f"WITH {SEGMENT} SELECT c_mktsegment, ts, v, lag(v, 1) OVER w AS lag_1, lag(v, 7) OVER w AS lag_7, lag(v, 28) OVER w AS lag_28 FROM seg WINDOW w AS (PARTITION BY c_mktsegment ORDER BY ts)"


def rolling_features(spark, sf_dir):
    made = N.rolling("v", 7, N.ordered(["c_mktsegment"], "ts"))
    return segments(spark, sf_dir).select("c_mktsegment", "ts", *[rounded(c, 2).alias(n) for n, c in made.items()])


QUERIES["rolling_features"] = rolling_features
ORACLES["rolling_features"] = f"WITH {SEGMENT} SELECT c_mktsegment, ts, " + ", ".join(f"{r4(f'CASE WHEN count(v) OVER w = 7 THEN {f}(v) OVER w END', 2)} AS roll_{n}_7" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM seg WINDOW w AS (PARTITION BY c_mktsegment ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


def centred_rolling(spark, sf_dir):
    order = N.ordered(["r_name"], "ts")
    return region_monthly(spark, sf_dir).select("r_name", "ts", rounded(N.centred_mean("v", 4, order)).alias("even"), rounded(N.centred_mean("v", 5, order)).alias("odd"))


QUERIES["centred_rolling"] = centred_rolling
ORACLES["centred_rolling"] = f"WITH {REGION} SELECT r_name, ts, {r4('avg(v) OVER (PARTITION BY r_name ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS even, {r4('avg(v) OVER (PARTITION BY r_name ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS odd FROM region_monthly"


def calendar_features(spark, sf_dir):
    from ..functions.scalars import calendar

    cols = calendar(F.col("ts"))
    return orders_daily(spark, sf_dir).select("ts", *[(c if n in CALENDAR else rounded(c)).alias(n) for n, c in cols.items()])


QUERIES["calendar_features"] = calendar_features
ORACLES["calendar_features"] = f"""
WITH {DAILY}
SELECT ts, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(week(ts) AS INT) AS week_of_year, CAST(month(ts) AS INT) AS month,
  CAST(quarter(ts) AS INT) AS quarter, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(day(ts) = 1 AS INT) AS is_month_start, CAST(ts = last_day(ts) AS INT) AS is_month_end,
  {r4("sin(2 * pi() * month(ts) / 12)")} AS month_sin, {r4("cos(2 * pi() * month(ts) / 12)")} AS month_cos,
  {r4("sin(2 * pi() * (isodow(ts) - 1) / 7)")} AS dow_sin, {r4("cos(2 * pi() * (isodow(ts) - 1) / 7)")} AS dow_cos FROM daily"""


def exog_features(spark, sf_dir):
    got = X.feature_matrix(shipments_daily(spark, sf_dir), [], "ts", "price", (1,), (), ["discount"], ["event"], False)
    return got.select("ts", "target", "lag_1", rounded(F.col("indep__discount")).alias("indep__discount"), rounded(F.col("indep_lag1__discount")).alias("indep_lag1__discount"), "event__event", "event_roll7__event")


QUERIES["event_roll7"] = exog_features
ORACLES["event_roll7"] = f"""
WITH {SHIPMENTS} SELECT ts, price AS target, lag(price) OVER (ORDER BY ts) AS lag_1, {r4("discount")} AS indep__discount, {r4("lag(discount) OVER (ORDER BY ts)")} AS indep_lag1__discount,
  event AS event__event, CAST(sum(event) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS event_roll7__event FROM shipments"""


def diff_log(spark, sf_dir):
    at = region_monthly(spark, sf_dir)
    one = X.transformed(at, ["r_name"], "ts", "v", "diff", name="diff_1")
    two = X.transformed(one, ["r_name"], "ts", "v", "diff", 2, name="diff_2")
    log = X.transformed(two, ["r_name"], "ts", "v", "log", name="log")
    both = X.transformed(log, ["r_name"], "ts", "v", "log_diff", name="log_diff")
    shifted = both.withColumn("w", F.col("v") - 5_000_000)
    out = X.transformed(shifted, ["r_name"], "ts", "w", "log", name="log_shifted")
    return out.select("r_name", "ts", *[rounded(F.col(c)).alias(c) for c in ("diff_1", "diff_2", "log", "log_diff", "log_shifted")])


QUERIES["diff_log"] = diff_log
ORACLES["diff_log"] = f"""
WITH {REGION}, a AS (SELECT *, v - lag(v) OVER w AS d1, ln(1 + v) AS lg, v - 5000000 AS s FROM region_monthly WINDOW w AS (PARTITION BY r_name ORDER BY ts)),
b AS (SELECT *, min(s) OVER (PARTITION BY r_name) AS lo FROM a)
SELECT r_name, ts, {r4("d1")} AS diff_1, {r4("d1 - lag(d1) OVER w")} AS diff_2, {r4("lg")} AS log, {r4("lg - lag(lg) OVER w")} AS log_diff,
  {r4("ln(1 + s + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0.0 END)")} AS log_shifted FROM b WINDOW w AS (PARTITION BY r_name ORDER BY ts)"""


def auto_transform(spark, sf_dir):
    return X.auto_transform(segments(spark, sf_dir), ["c_mktsegment"]).select("c_mktsegment", rounded(F.col("least")).alias("least"), rounded(F.col("skew")).alias("skew"), "transform")


QUERIES["auto_transform"] = auto_transform
ORACLES["auto_transform"] = f"""
WITH {SEGMENT}, s AS (SELECT c_mktsegment, min(v) AS least, skewness(v) AS skew FROM seg GROUP BY 1)
SELECT c_mktsegment, {r4("least")} AS least, {r4("skew")} AS skew, CASE WHEN least <= 0 THEN 'diff' WHEN abs(skew) > 1 THEN 'log' ELSE 'none' END AS transform FROM s"""

SPLIT = """sp AS (SELECT *, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM region_monthly))"""


def temporal_split(spark, sf_dir):
    return N.split(region_monthly(spark, sf_dir), ["r_name"], "ts").select("r_name", "ts", "split")


def split_counts(spark, sf_dir):
    return N.split(region_monthly(spark, sf_dir), ["r_name"], "ts").groupBy("split").agg(F.count("*").alias("n"))


def holdout(spark, sf_dir):
    return N.holdout(region_monthly(spark, sf_dir), ["r_name"], "ts", 12)


QUERIES |= {"temporal_split": temporal_split, "split_counts": split_counts, "holdout": holdout}
ORACLES |= {
    "temporal_split": f"WITH {REGION}, {SPLIT} SELECT r_name, ts, split FROM sp",
    "split_counts": f"WITH {REGION}, {SPLIT} SELECT split, {long_count()} AS n FROM sp GROUP BY 1",
    "holdout": f"WITH {REGION} SELECT r_name, ts, v, row_number() OVER (PARTITION BY r_name ORDER BY ts DESC) <= least(12, count(*) OVER (PARTITION BY r_name) // 3) AS is_holdout FROM region_monthly",
}

SCALE_SQL = {"minmax": ("min(v)", "max(v) - min(v)"), "standard": ("avg(v)", "stddev_pop(v)"), "robust": ("quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")}
for _method, (_c, _s) in SCALE_SQL.items():

    def _scale(spark, sf_dir, method=_method):
        at = N.split(region_monthly(spark, sf_dir), ["r_name"], "ts")
        return X.scale(at, ["v"], method, F.col("split") == "train", ["r_name"]).select("r_name", "ts", "split", rounded(F.col("v")).alias("v"))

    QUERIES[f"scale_{_method}"] = _scale
    ORACLES[f"scale_{_method}"] = f"WITH {REGION}, {SPLIT}, f AS (SELECT r_name, {_c} AS c, CASE WHEN {_s} = 0 THEN 1.0 ELSE {_s} END AS s FROM sp WHERE split = 'train' GROUP BY 1) SELECT r_name, ts, split, {r4('(v - c) / s')} AS v FROM sp JOIN f USING (r_name)"


def future_frame(spark, sf_dir):
    got = X.future_frame(region_monthly(spark, sf_dir), ["r_name"], "MS", 6, lags=(1, 2, 12), rolling=(3,), with_calendar=False)
    return got.select("r_name", "ts", "step", "lag_1", "lag_2", "lag_12", rounded(F.col("roll_mean_3")).alias("roll_mean_3"))


QUERIES["future_frame"] = future_frame
ORACLES["future_frame"] = f"""
WITH {REGION}, l AS (SELECT r_name, max(ts) AS last FROM region_monthly GROUP BY 1),
f AS (SELECT r_name, CAST(last + to_months(CAST(s AS INT)) AS DATE) AS ts, CAST(s AS INT) AS step, NULL::DOUBLE AS v FROM l, generate_series(1, 6) AS t(s)),
u AS (SELECT r_name, ts, NULL AS step, v FROM region_monthly UNION ALL SELECT r_name, ts, step, v FROM f),
w AS (SELECT r_name, ts, step, lag(v, 1) OVER o AS lag_1, lag(v, 2) OVER o AS lag_2, lag(v, 12) OVER o AS lag_12,
             CASE WHEN count(v) OVER r = 3 THEN avg(v) OVER r END AS m
      FROM u WINDOW o AS (PARTITION BY r_name ORDER BY ts), r AS (PARTITION BY r_name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT r_name, ts, step, lag_1, lag_2, lag_12, {r4("m")} AS roll_mean_3 FROM w WHERE step IS NOT NULL"""


def prepare_features(spark, sf_dir):
    got = X.prepare(region_monthly(spark, sf_dir), ["r_name"], transform="log_diff", scaling="standard", lags=(1, 12), rolling=(3,), with_calendar=False)
    return got.select("r_name", "ts", "split", *[rounded(F.col(c)).alias(c) for c in ("target", "lag_1", "lag_12", "roll_mean_3", "roll_std_3", "roll_min_3", "roll_max_3")])


_COLS = ("lag_1", "lag_12", "roll_mean_3", "roll_std_3", "roll_min_3", "roll_max_3")
QUERIES["prepare_features"] = prepare_features
ORACLES["prepare_features"] = f"""
WITH {REGION}, a AS (SELECT r_name, ts, ln(1 + v) - lag(ln(1 + v)) OVER (PARTITION BY r_name ORDER BY ts) AS y FROM region_monthly),
m AS (SELECT r_name, ts, y AS target, lag(y, 1) OVER o AS lag_1, lag(y, 12) OVER o AS lag_12, CASE WHEN count(y) OVER r = 3 THEN avg(y) OVER r END AS roll_mean_3,
             CASE WHEN count(y) OVER r = 3 THEN stddev_samp(y) OVER r END AS roll_std_3, CASE WHEN count(y) OVER r = 3 THEN min(y) OVER r END AS roll_min_3, CASE WHEN count(y) OVER r = 3 THEN max(y) OVER r END AS roll_max_3
      FROM a WINDOW o AS (PARTITION BY r_name ORDER BY ts), r AS (PARTITION BY r_name ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM m WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ("target", *_COLS))}),
s AS (SELECT *, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM n),
f AS (SELECT r_name, {", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in _COLS)} FROM s WHERE split = 'train' GROUP BY 1)
SELECT r_name, ts, split, {r4("target")} AS target, {", ".join(f"{r4(f'({c} - c_{c}) / s_{c}')} AS {c}" for c in _COLS)} FROM s JOIN f USING (r_name)"""


def auto_transformed(spark, sf_dir):
    """Every region's series under the transform advised for it: one shifted below zero, one made skew, others as they are."""
    v = F.col("v")
    at = region_monthly(spark, sf_dir).withColumn("v", F.when(F.col("r_name") == "ASIA", v - 1e7).when(F.col("r_name") == "EUROPE", F.exp(v / 2e6)).otherwise(v))
    return X.transformed(at, ["r_name"], "ts", "v", "auto").select("r_name", "ts", rounded(F.col("y")).alias("y"))


QUERIES["auto_transformed"] = auto_transformed
ORACLES["auto_transformed"] = f"""
WITH {REGION}, x AS (SELECT r_name, ts, CASE r_name WHEN 'ASIA' THEN v - 1e7 WHEN 'EUROPE' THEN exp(v / 2e6) ELSE v END AS v FROM region_monthly),
s AS (SELECT r_name, min(v) AS least, skewness(v) AS skew FROM x GROUP BY 1)
SELECT r_name, ts, {r4("CASE WHEN least <= 0 THEN v - lag(v) OVER (PARTITION BY r_name ORDER BY ts) WHEN abs(skew) > 1 THEN ln(1 + v) ELSE v END")} AS y FROM x JOIN s USING (r_name)"""


def prepared_labels(spark, sf_dir):
    """The feature matrix with the identity, class, strengths and model of each series in every row."""
    at = region_monthly(spark, sf_dir)
    matrix = X.prepare(at, ["r_name"], lags=(1, 12), rolling=(), with_calendar=False)
    parts = decompose.stl(at, ["r_name"], 12).withColumnRenamed("value", "v")
    got = X.with_labels(matrix, parts, ["r_name"], exogenous=True)
    strength = [rounded(F.col(c)).alias(c) for c in ("trend_strength_Ft", "seasonal_strength_Fs")]
    return got.select("r_name", "ts", "target", "lag_12", "split", "series_id", "hier_r_name", "model_type_recommendation", "intermittency_class", *strength, "has_exogenous")


QUERIES["prepared_labels"] = prepared_labels
ORACLES["prepared_labels"] = f"""
WITH {STL},
m AS (SELECT r_name, ts, v AS target, lag(v) OVER o AS a, lag(v, 12) OVER o AS lag_12 FROM region_monthly WINDOW o AS (PARTITION BY r_name ORDER BY ts)),
w AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS k, count(*) OVER (PARTITION BY r_name) AS rows FROM m WHERE lag_12 IS NOT NULL),
s AS (SELECT r_name, greatest(0.0, 1 - var_pop(residual) / (var_pop(trend + residual) + 1e-12)) AS ft, greatest(0.0, 1 - var_pop(residual) / (var_pop(seasonal + residual) + 1e-12)) AS fs,
  count(*) / count(*) FILTER (v > 0) AS adi, power(coalesce(stddev_samp(v) FILTER (v > 0), 0.0) / (avg(v) FILTER (v > 0) + 1e-12), 2) AS cv2 FROM parts GROUP BY 1),
c AS (SELECT *, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi < 1.32 THEN 'Erratic' WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END AS class FROM s)
SELECT r_name, ts, target, lag_12, CASE WHEN k <= floor(rows * 0.7) THEN 'train' WHEN k <= floor(rows * 0.7) + floor(rows * 0.15) THEN 'validation' ELSE 'test' END AS split,
  r_name AS series_id, r_name AS hier_r_name, CASE class WHEN 'Lumpy' THEN 'TSB' WHEN 'Intermittent' THEN 'SBA' WHEN 'Erratic' THEN 'LightGBM' ELSE CASE WHEN fs > 0.6 AND ft > 0.3 THEN 'LinearRegression' WHEN fs > 0.6 OR ft > 0.6 THEN 'ARIMAX' ELSE 'LinearRegression' END END AS model_type_recommendation,
  class AS intermittency_class, {r4("ft")} AS trend_strength_Ft, {r4("fs")} AS seasonal_strength_Fs, true AS has_exogenous FROM w JOIN c USING (r_name)"""
