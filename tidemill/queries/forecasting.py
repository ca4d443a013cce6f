"""Forecast and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import forecast as P
from ..operators import hierarchy as H
from ..operators import reconcile as C
from ..operators.windows import split
from ..sources.panels import brand_demand, region_monthly, table
from ..sources.shared import kept
from .common import BRANDS, REGION, long_count, r4
from .hierarchies import ROLLED, rolled

QUERIES, ORACLES = {}, {}
KEY = ["r_name"]
LEVELS = ["r_name", "n_name", "c_mktsegment"]
HORIZON = 6

NAIVE = """b AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts DESC) AS b, count(*) OVER (PARTITION BY r_name) AS n FROM region_monthly),
sn AS (SELECT r_name, CAST(s AS INT) AS step, v AS forecast FROM b, generate_series(1, 18) AS g(s) WHERE b <= 12 AND n >= 12 AND (s - 1) % 12 = 12 - b)"""
DRIFT = """e AS (SELECT r_name, arg_min(v, ts) AS a, arg_max(v, ts) AS z, count(*) AS n FROM region_monthly GROUP BY 1),
dr AS (SELECT r_name, CAST(s AS INT) AS step, z + (z - a) / greatest(n - 1, 1) * s AS forecast FROM e, generate_series(1, 18) AS g(s))"""


def seasonal_naive(spark, sf_dir):
    return P.seasonal_naive(region_monthly(spark, sf_dir), KEY, 18, 12)


def drift(spark, sf_dir):
    return P.drift(region_monthly(spark, sf_dir), KEY, 18).select("r_name", "step", rounded(F.col("forecast")).alias("forecast"))


def baseline(spark, sf_dir):
    got = P.baseline(region_monthly(spark, sf_dir), KEY, 18, 12, 0.7, 0.7)
    return got.select("r_name", "step", rounded(F.col("forecast")).alias("forecast"))


QUERIES |= {"seasonal_naive": seasonal_naive, "drift_fc": drift, "baseline_fc": baseline}
ORACLES["seasonal_naive"] = f"WITH {REGION}, {NAIVE} SELECT r_name, step, forecast FROM sn"
ORACLES["drift_fc"] = f"WITH {REGION}, {DRIFT} SELECT r_name, step, {r4('forecast')} AS forecast FROM dr"
ORACLES["baseline_fc"] = f"""
WITH {REGION}, {NAIVE}, {DRIFT}, m AS (SELECT r_name, avg(v) AS m FROM b WHERE b <= 12 GROUP BY 1), p AS (SELECT r_name, min(v) >= 0 AS p FROM region_monthly GROUP BY 1)
SELECT r_name, step, {r4("CASE WHEN p THEN greatest(0.0, dr.forecast + sn.forecast - m) ELSE dr.forecast + sn.forecast - m END")} AS forecast FROM dr JOIN sn USING (r_name, step) JOIN m USING (r_name) JOIN p USING (r_name)"""


def future_index(spark, sf_dir):
    return P.future_index(region_monthly(spark, sf_dir), KEY, HORIZON, "MS")


QUERIES["future_index"] = future_index
ORACLES["future_index"] = f"WITH {REGION} SELECT r_name, CAST(s AS INT) AS step, CAST(max(ts) + to_months(CAST(s AS INT)) AS DATE) AS ts FROM region_monthly, generate_series(1, {HORIZON}) AS g(s) GROUP BY r_name, s"


def _scored(spark, sf_dir):
    """Holdout of twelve months against naive, seasonal naive and mean forecasts, as a long table."""
    at = region_monthly(spark, sf_dir)
    from ..operators.windows import holdout

    marked = holdout(at, KEY, "ts", 12)
    past = marked.filter("not is_holdout").drop("is_holdout")
    from pyspark.sql import Window as W

    actual = marked.filter("is_holdout").select(*KEY, F.row_number().over(W.partitionBy(*KEY).orderBy("ts")).alias("step"), F.col("v").alias("y"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("step")
    last = past.groupBy(*KEY).agg(F.max_by("v", "ts").alias("yhat")).select(*KEY, steps, "yhat")
    mean = past.groupBy(*KEY).agg(F.avg("v").alias("yhat")).select(*KEY, steps, "yhat")
    season = P.seasonal_naive(past, KEY, 12, 12).withColumnRenamed("forecast", "yhat")
    whole = None
    for rank, (name, df) in enumerate((("Naive", last), ("SeasonalNaive", season), ("Mean", mean))):
        part = df.join(actual, [*KEY, "step"]).withColumn("model", F.lit(name)).withColumn("rank", F.lit(rank)).withColumn("part", F.lit("holdout"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


SCORED = f"""{REGION}, h AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts DESC) <= least(12, count(*) OVER (PARTITION BY r_name) // 3) AS hold FROM region_monthly),
ac AS (SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS step, v AS y FROM h WHERE hold),
pa AS (SELECT r_name, ts, v, row_number() OVER (PARTITION BY r_name ORDER BY ts DESC) AS b FROM h WHERE NOT hold),
pr AS (SELECT r_name, s AS step, arg_max(v, ts) AS yhat, 'Naive' AS model, 0 AS rank FROM pa, generate_series(1, 12) AS g(s) GROUP BY r_name, s
  UNION ALL SELECT r_name, s, v, 'SeasonalNaive', 1 FROM pa, generate_series(1, 12) AS g(s) WHERE b = 13 - s
  UNION ALL SELECT r_name, s, avg(v), 'Mean', 2 FROM pa, generate_series(1, 12) AS g(s) GROUP BY r_name, s),
sc AS (SELECT r_name, step, model, rank, y, yhat FROM pr JOIN ac USING (r_name, step)),
me AS (SELECT r_name, model, rank, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 100 * avg(CASE WHEN abs(y) > 1e-8 THEN abs(y - yhat) / abs(y) END) AS mape, CAST(count(*) AS BIGINT) AS n FROM sc GROUP BY 1, 2, 3)"""


def fc_metrics(spark, sf_dir):
    got = P.metrics(_scored(spark, sf_dir), [*KEY, "model", "rank"])
    return got.select("r_name", "model", "n", *[rounded(F.col(c)).alias(c) for c in ("mae", "rmse", "mape")])


def best_model(spark, sf_dir):
    got = P.best_model(P.metrics(_scored(spark, sf_dir), [*KEY, "model", "rank"]), KEY)
    return got.select("r_name", "model", rounded(F.col("mape")).alias("mape"))


def fc_combo(spark, sf_dir):
    at = _scored(spark, sf_dir)
    got = P.combine(at, P.metrics(at, [*KEY, "model", "rank"]), KEY)
    return got.select("r_name", "step", "model", rounded(F.col("yhat")).alias("yhat"))


QUERIES |= {"fc_metrics": fc_metrics, "best_model": best_model, "fc_combo": fc_combo}
ORACLES["fc_metrics"] = f"WITH {SCORED} SELECT r_name, model, n, {r4('mae')} AS mae, {r4('rmse')} AS rmse, {r4('mape')} AS mape FROM me"
ORACLES["best_model"] = f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY mape, rank DESC) AS k FROM me) SELECT r_name, model, {r4('mape')} AS mape FROM k WHERE k = 1"
ORACLES["fc_combo"] = f"""
WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY mape, rank) AS place, 1 / CASE WHEN mape > 0 THEN mape ELSE 1e-9 END AS w FROM me),
j AS (SELECT s.r_name, s.step, s.yhat, k.place, k.w FROM sc s JOIN k USING (r_name, model)),
c AS (SELECT r_name, CAST(step AS INT) AS step, avg(yhat) AS a, sum(yhat * w) / sum(w) AS b, quantile_cont(yhat, 0.5) AS m, avg(yhat) FILTER (place <= 3) AS t FROM j GROUP BY 1, 2)
SELECT r_name, step, 'Combo:SimpleAvg' AS model, {r4("a")} AS yhat FROM c UNION ALL SELECT r_name, step, 'Combo:WeightedAvg', {r4("b")} FROM c
UNION ALL SELECT r_name, step, 'Combo:Median', {r4("m")} FROM c UNION ALL SELECT r_name, step, 'Combo:Top3Avg', {r4("t")} FROM c"""


def fc_interval(spark, sf_dir):
    at = region_monthly(spark, sf_dir)
    held = _scored(spark, sf_dir).filter("model = 'SeasonalNaive'")
    got = P.intervals(P.seasonal_naive(at, KEY, HORIZON, 12), P.error_sigma(held, at, KEY), KEY)
    return got.select("r_name", "step", *[rounded(F.col(c), 3).alias(c) for c in ("forecast", "lower_95", "upper_95")])


QUERIES["fc_interval"] = fc_interval
ORACLES["fc_interval"] = f"""
WITH {SCORED}, {NAIVE}, s AS (SELECT r_name, stddev_samp(y - yhat) AS sigma FROM sc WHERE model = 'SeasonalNaive' GROUP BY 1)
SELECT r_name, step, {r4("forecast", 3)} AS forecast, {r4("greatest(0.0, forecast - 1.96 * sigma * sqrt(step))", 3)} AS lower_95, {r4("forecast + 1.96 * sigma * sqrt(step)", 3)} AS upper_95 FROM sn JOIN s USING (r_name) WHERE step <= {HORIZON}"""


def timeline(spark, sf_dir):
    """Observed, split and forecast columns of each region over time."""
    at = split(region_monthly(spark, sf_dir), KEY, "ts")
    ahead = P.future_index(at, KEY, HORIZON, "MS").join(P.seasonal_naive(at, KEY, HORIZON, 12), [*KEY, "step"])
    return P.timeline(at, "split", ahead, keys=KEY).drop("holdout")


QUERIES["forecast_timeline"] = timeline
ORACLES["forecast_timeline"] = f"""
WITH {REGION}, {NAIVE}, o AS (SELECT r_name, ts, v, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM region_monthly),
e AS (SELECT r_name, max(ts) AS last FROM o GROUP BY 1),
s AS (SELECT *, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM o)
SELECT r_name, ts, v AS observed, CASE WHEN split = 'train' THEN v END AS train, CASE WHEN split = 'validation' THEN v END AS validation, CASE WHEN split = 'test' THEN v END AS test, NULL::DOUBLE AS forecast FROM s
UNION ALL SELECT r_name, CAST(last + to_months(step) AS DATE), NULL, NULL, NULL, NULL, forecast FROM sn JOIN e USING (r_name) WHERE step <= {HORIZON}"""


def auto_forecast(spark, sf_dir):
    """Weekly demand over 20 units of each brand: SBA, TSB, seasonal naive or drift by its class."""
    weekly = brand_demand(spark, sf_dir).groupBy("p_brand", F.date_trunc("week", "ts").cast("date").alias("ts")).agg(F.sum("v").alias("v"))
    sparse = weekly.withColumn("v", F.when(F.col("v") > 600, F.col("v")).otherwise(0.0))
    got = P.automatic(sparse, ["p_brand"], 4, "W")
    return got.select("p_brand", "step", "model", rounded(F.col("forecast")).alias("forecast"))


QUERIES["auto_forecast"] = auto_forecast


def automatic_sql(horizon: int, period: int) -> str:
    """CTEs after ``demand`` (k, ts, v): the automatic forecasts ``auto`` (k, step, model, forecast)."""
    return f"""d AS MATERIALIZED (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) AS i, count(*) OVER (PARTITION BY k) AS n FROM demand WHERE v IS NOT NULL),
kind AS (SELECT k, max(n) AS n, count(*) / nullif(count(*) FILTER (v > 0), 0) AS adi, power(coalesce(stddev_samp(v) FILTER (v > 0), 0.0) / (avg(v) FILTER (v > 0) + 1e-12), 2) AS cv2 FROM d GROUP BY 1),
how AS MATERIALIZED (SELECT k, n, CASE WHEN n = 1 THEN 'repeat' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'sba' WHEN adi >= 1.32 THEN 'tsb' WHEN n >= {period} THEN 'seasonal_naive' ELSE 'drift' END AS model FROM kind),
ds AS MATERIALIZED (SELECT d.* FROM d JOIN how USING (k) WHERE model = 'sba'),
dt AS MATERIALIZED (SELECT d.* FROM d JOIN how USING (k) WHERE model = 'tsb'),
fs AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS z, 0.0::DOUBLE AS p, 0.0::DOUBLE AS gap, 0 AS c FROM (SELECT DISTINCT k FROM ds)
  UNION ALL
  SELECT fs.k, ds.i, CASE WHEN ds.v <= 0 THEN fs.z WHEN fs.c = 0 THEN ds.v ELSE fs.z + 0.1 * (ds.v - fs.z) END,
    CASE WHEN ds.v <= 0 THEN fs.p WHEN fs.c = 0 THEN greatest(1.0, fs.gap + 1) ELSE fs.p + 0.1 * (fs.gap + 1 - fs.p) END,
    CASE WHEN ds.v > 0 THEN 0.0 ELSE fs.gap + 1 END, fs.c + (ds.v > 0)::INT FROM fs JOIN ds ON ds.k = fs.k AND ds.i = fs.i + 1),
ft AS (
  SELECT k, CAST(0 AS BIGINT) AS i, coalesce(arg_min(v, i) FILTER (v > 0), 0.0)::DOUBLE AS z, (count(*) FILTER (v > 0) / count(*))::DOUBLE AS p FROM dt GROUP BY k
  UNION ALL
  SELECT ft.k, dt.i, CASE WHEN dt.v > 0 THEN ft.z + 0.1 * (dt.v - ft.z) ELSE ft.z END, ft.p + 0.1 * ((dt.v > 0)::INT - ft.p) FROM ft JOIN dt ON dt.k = ft.k AND dt.i = ft.i + 1),
ends AS (SELECT k, arg_min(v, i) AS a, arg_max(v, i) AS z, count(*) AS n FROM d GROUP BY 1),
steps AS (SELECT CAST(s AS INT) AS step FROM generate_series(1, {horizon}) AS g(s)),
auto AS (
  SELECT k, step, model, z + (z - a) / greatest(ends.n - 1, 1) * step AS forecast FROM how JOIN ends USING (k), steps WHERE model IN ('drift', 'repeat') UNION ALL
  SELECT k, step, model, v FROM how JOIN d USING (k), steps WHERE model = 'seasonal_naive' AND d.n - i < {period} AND (step - 1) % {period} = {period} - 1 - (d.n - i) UNION ALL
  SELECT k, step, model, CASE WHEN c > 0 THEN z / p ELSE 0.0 END * 0.95 FROM how JOIN fs USING (k), steps WHERE fs.i = how.n UNION ALL
  SELECT k, step, model, z * p FROM how JOIN ft USING (k), steps WHERE ft.i = how.n)"""


ORACLES["auto_forecast"] = f"""
WITH RECURSIVE {BRANDS.replace("demand AS", "brand_days AS")},
weekly AS (SELECT p_brand, CAST(date_trunc('week', ts) AS DATE) AS ts, sum(v) AS v FROM brand_days GROUP BY 1, 2),
demand AS (SELECT p_brand AS k, ts, CASE WHEN v > 600 THEN v ELSE 0.0 END AS v FROM weekly), {automatic_sql(4, 52)}
SELECT k AS p_brand, step, model, {r4("greatest(forecast, 0.0)")} AS forecast FROM auto"""


def recommend(spark, sf_dir):
    """Model family of every brand from its demand class (no trend or season known)."""
    from ..operators.intermittency import classify

    at = classify(brand_demand(spark, sf_dir), ["p_brand"], threshold=20.0)
    zero = F.lit(0.0)
    return at.select("p_brand", P.recommend(F.col("class"), zero, zero, zero).alias("model"))


QUERIES["recommend_model"] = recommend
ORACLES["recommend_model"] = f"""
WITH {BRANDS}, a AS (SELECT p_brand, count(*) / count(*) FILTER (v > 20) AS adi, power(coalesce(stddev_samp(v) FILTER (v > 20), 0.0) / (avg(v) FILTER (v > 20) + 1e-12), 2) AS cv2 FROM demand GROUP BY 1 HAVING count(*) FILTER (v > 20) > 0)
SELECT p_brand, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'ETS' WHEN adi < 1.32 THEN 'LightGBM' WHEN cv2 < 0.49 THEN 'SBA' ELSE 'TSB' END AS model FROM a"""


def model_forecasts(spark, sf_dir):
    """All numerical models of each region with holdout and future values."""
    return P.compare_models(region_monthly(spark, sf_dir), KEY, HORIZON)


def model_comparison(spark, sf_dir):
    at = P.compare_models(region_monthly(spark, sf_dir), KEY, HORIZON).filter("part = 'holdout'")
    return P.metrics(at, [*KEY, "model", "rank"])


QUERIES |= {"model_forecasts": model_forecasts, "model_comparison": model_comparison}
for _name, _model in (("hw_fc", "ETS"), ("arima_fc", "ARIMA"), ("flann_fc", "FLANN"), ("recurrent_flann_fc", "RecurrentFLANN"), ("rvfl_fc", "RVFL")):

    def _one(spark, sf_dir, model=_model):
        return P.compare_models(region_monthly(spark, sf_dir), KEY, HORIZON, wanted=[model])

    QUERIES[_name] = _one


def hw_fixed(spark, sf_dir):
    """Additive smoothing of each region with given weights: level, trend and a season of twelve months."""
    import pandas as pd

    from ..operators.kernels import by_series
    from ..operators.models import holt_winters

    def one(at: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"step": range(1, HORIZON + 1), "forecast": holt_winters(at["v"].to_numpy(float), HORIZON, 12, 0.3, 0.05, 0.2)})

    got = by_series(region_monthly(spark, sf_dir), KEY, one, "step int, forecast double", "ts", "v")
    return got.select("r_name", "step", rounded(F.col("forecast"), 1).alias("forecast"))


QUERIES["hw_fixed"] = hw_fixed
ORACLES["hw_fixed"] = f"""
WITH RECURSIVE {REGION},
x AS MATERIALIZED (SELECT r_name, v, CAST(row_number() OVER (PARTITION BY r_name ORDER BY ts) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY r_name) AS INT) AS n FROM region_monthly),
s AS (SELECT r_name, avg(v) FILTER (i < 12) AS a, avg(v) FILTER (i >= 12 AND i < 24) AS b, list(v ORDER BY i) FILTER (i < 12) AS first, max(n) AS n FROM x GROUP BY 1),
f AS (
  SELECT r_name, n, 0 AS i, a::DOUBLE AS l, ((b - a) / 12)::DOUBLE AS t, list_transform(first, lambda q: q - a) AS season FROM s
  UNION ALL
  SELECT r_name, n, i + 1, nl, 0.05 * (nl - l) + 0.95 * t, list_concat(season[2:], [0.2 * (v - nl) + 0.8 * season[1]])
  FROM (SELECT f.*, x.v, 0.3 * (x.v - season[1]) + 0.7 * (l + t) AS nl FROM f JOIN x ON x.r_name = f.r_name AND x.i = f.i))
SELECT r_name, CAST(h AS INT) AS step, {r4(f"l + t * h + season[h]", 1)} AS forecast FROM f, generate_series(1, {HORIZON}) AS g(h) WHERE i = n"""


def linear_fc(spark, sf_dir):
    """Least squares on lags 1, 2 and 12 of each region: holdout and recursive future values."""
    got = P.linear_forecast(region_monthly(spark, sf_dir), KEY, HORIZON)
    return got.select("r_name", "part", "step", rounded(F.col("yhat"), 1).alias("yhat"))


QUERIES["linear_fc"] = linear_fc
ORACLES["linear_fc"] = f"""
WITH RECURSIVE {REGION},
x AS MATERIALIZED (SELECT r_name, v AS y, lag(v) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 12) OVER w AS c, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n FROM region_monthly WINDOW w AS (PARTITION BY r_name ORDER BY ts)),
m AS (SELECT r_name, avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc,
  covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, covar_pop(c, y) AS cy FROM x WHERE c IS NOT NULL AND i < n - 12 GROUP BY 1),
k0 AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
k1 AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / det AS p, (aa * (byy * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / det AS q,
  (aa * (bb * cy - bc * byy) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / det AS r FROM k0),
k AS MATERIALIZED (SELECT r_name, y - p * a - q * b - r * c AS o, p, q, r FROM k1),
h AS (SELECT r_name, list(y ORDER BY i) AS past FROM x WHERE i >= n - 12 GROUP BY 1),
f AS (
  SELECT r_name, 0 AS step, past, 0.0::DOUBLE AS yhat FROM h
  UNION ALL
  SELECT r_name, step + 1, list_append(past[2:], made), made FROM (SELECT f.*, o + p * past[12] + q * past[11] + r * past[1] AS made FROM f JOIN k USING (r_name) WHERE step < {HORIZON}))
SELECT r_name, 'holdout' AS part, CAST(i - (n - 12) + 1 AS INT) AS step, {r4("greatest(0.0, o + p * a + q * b + r * c)", 1)} AS yhat FROM x JOIN k USING (r_name) WHERE i >= n - 12
UNION ALL SELECT r_name, 'future', CAST(step AS INT), {r4("greatest(0.0, yhat)", 1)} FROM f WHERE step > 0"""


def linear_exog_fc(spark, sf_dir):
    """The same with the share of returned lines of each month beside the lags."""
    monthly = region_monthly(spark, sf_dir)
    at = monthly.join(returned_share(spark, sf_dir), "ts", "left")
    got = P.linear_forecast(at, KEY, HORIZON, exog=["returned"])
    return got.select("r_name", "part", "step", rounded(F.col("yhat"), 1).alias("yhat"))


def returned_share(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ts")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returned"))


QUERIES["linear_exog_fc"] = linear_exog_fc
#: Normal equations of four columns by projecting each column off those before it, then back substitution.
ORACLES["linear_exog_fc"] = f"""
WITH RECURSIVE {REGION},
share AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, count(*) FILTER (l_returnflag = 'R') / count(*) AS e FROM lineitem GROUP BY 1),
x AS MATERIALIZED (SELECT r_name, v AS y, lag(v) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 12) OVER w AS c, coalesce(e, 0.0) AS e, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY r_name) AS n FROM region_monthly LEFT JOIN share USING (ts) WINDOW w AS (PARTITION BY r_name ORDER BY ts)),
m AS (SELECT r_name, avg(y) AS y, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(e) AS e FROM x WHERE c IS NOT NULL AND i < n - 12 GROUP BY 1),
t AS (SELECT x.r_name, x.y - m.y AS y, x.a - m.a AS a, x.b - m.b AS b, x.c - m.c AS c, x.e - m.e AS e FROM x JOIN m USING (r_name) WHERE x.c IS NOT NULL AND i < n - 12),
g1 AS (SELECT r_name, sum(a * b) / sum(a * a) AS ab, sum(a * c) / sum(a * a) AS ac, sum(a * e) / sum(a * a) AS ae, sum(a * y) / sum(a * a) AS ay FROM t GROUP BY 1),
t1 AS (SELECT r_name, b - ab * a AS b, c - ac * a AS c, e - ae * a AS e, y - ay * a AS y FROM t JOIN g1 USING (r_name)),
g2 AS (SELECT r_name, sum(b * c) / sum(b * b) AS bc, sum(b * e) / sum(b * b) AS be, sum(b * y) / sum(b * b) AS byy FROM t1 GROUP BY 1),
t2 AS (SELECT r_name, c - bc * b AS c, e - be * b AS e, y - byy * b AS y FROM t1 JOIN g2 USING (r_name)),
g3 AS (SELECT r_name, sum(c * e) / sum(c * c) AS ce, sum(c * y) / sum(c * c) AS cy FROM t2 GROUP BY 1),
t3 AS (SELECT r_name, e - ce * c AS e, y - cy * c AS y FROM t2 JOIN g3 USING (r_name)),
g4 AS (SELECT r_name, sum(e * y) / sum(e * e) AS s FROM t3 GROUP BY 1),
k1 AS (SELECT *, cy - ce * s AS r FROM g1 JOIN g2 USING (r_name) JOIN g3 USING (r_name) JOIN g4 USING (r_name)),
k2 AS (SELECT *, byy - bc * r - be * s AS q FROM k1),
k3 AS (SELECT *, ay - ab * q - ac * r - ae * s AS p FROM k2),
k AS MATERIALIZED (SELECT r_name, m.y - p * m.a - q * m.b - r * m.c - s * m.e AS o, p, q, r, s FROM k3 JOIN m USING (r_name)),
h AS (SELECT r_name, list(y ORDER BY i) AS past FROM x WHERE i >= n - 12 GROUP BY 1),
f AS (
  SELECT r_name, 0 AS step, past, 0.0::DOUBLE AS yhat FROM h
  UNION ALL
  SELECT r_name, step + 1, list_append(past[2:], made), made FROM (SELECT f.*, o + p * past[12] + q * past[11] + r * past[1] AS made FROM f JOIN k USING (r_name) WHERE step < {HORIZON}))
SELECT r_name, 'holdout' AS part, CAST(i - (n - 12) + 1 AS INT) AS step, {r4("greatest(0.0, o + p * a + q * b + r * c + s * e)", 1)} AS yhat FROM x JOIN k USING (r_name) WHERE i >= n - 12
UNION ALL SELECT r_name, 'future', CAST(step AS INT), {r4("greatest(0.0, yhat)", 1)} FROM f WHERE step > 0"""


def arimax_fc(spark, sf_dir):
    """ARIMA with a calendar regressor."""
    at = region_monthly(spark, sf_dir).withColumn("q4", (F.quarter("ts") == 4).cast("double"))
    return P.compare_models(at, KEY, HORIZON, wanted=["ARIMAX"], exog=["q4"])


QUERIES["arimax_fc"] = arimax_fc

# Reconciliation: base forecasts are last-value forecasts of every node on the common month grid, so SQL can repeat them.


def _history(spark, sf_dir):
    """Node history, stored: weights, base forecasts and summaries all read it."""
    return kept(rolled(spark, sf_dir), "history")


def _base(history):
    last = history.agg(F.max("month")).first()[0]
    at = history.filter(F.col("month") > F.add_months(F.lit(last), -12)).groupBy(*LEVELS).agg(F.sum("v").alias("s"))
    return at.select(*LEVELS, (F.col("s") / 12).alias("f"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")).select(*LEVELS, "step", (F.col("f") * (1 + F.col("step") / 100)).alias("forecast"))


BASE = f"""{ROLLED},
ba AS (SELECT r_name, n_name, c_mktsegment, depth, CAST(s AS INT) AS step, sum(v) / 12 * (1 + s / 100) AS forecast FROM deep, generate_series(1, 3) AS g(s)
       WHERE month > (SELECT max(month) FROM deep) - INTERVAL 12 MONTH GROUP BY 1, 2, 3, 4, s),
nw AS (SELECT r_name, n_name, c_mktsegment, depth, CASE WHEN abs(sum(v)) > 0 THEN abs(sum(v)) WHEN avg(abs(v)) > 0 THEN avg(abs(v)) ELSE 1.0 END AS w,
              CASE WHEN depth > 1 THEN r_name ELSE '*' END AS p1, CASE WHEN depth > 2 THEN n_name ELSE '*' END AS p2 FROM deep WHERE depth > 0 GROUP BY 1, 2, 3, 4),
we AS (SELECT *, w / sum(w) OVER (PARTITION BY depth, p1, p2) AS weight FROM nw)"""
OUT = "r_name, n_name, c_mktsegment, step, " + r4("forecast", 2) + " AS forecast"


def _told(df):
    return df.select(*LEVELS, "step", rounded(F.col("forecast"), 2).alias("forecast"))


def recon_weights(spark, sf_dir):
    return C.child_weights(_history(spark, sf_dir), LEVELS).select(*LEVELS, "depth", rounded(F.col("weight"), 6).alias("weight"))


QUERIES["recon_weights"] = recon_weights
ORACLES["recon_weights"] = f"WITH {BASE} SELECT r_name, n_name, c_mktsegment, depth, {r4('weight', 6)} AS weight FROM we"

for _strategy, _middle in (("bottom_up", None), ("top_down", None), ("middle_out", 1)):

    def _recon(spark, sf_dir, strategy=_strategy, middle=_middle):
        history = _history(spark, sf_dir)
        return _told(C.reconcile(_base(history), history, LEVELS, strategy, middle))

    QUERIES[f"recon_{_strategy}"] = _recon

ORACLES["recon_bottom_up"] = f"""
WITH {BASE}, l AS (SELECT * FROM ba WHERE depth = 3)
SELECT {OUT} FROM (
  SELECT coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name, coalesce(c_mktsegment, '*') AS c_mktsegment, step, sum(forecast) AS forecast
  FROM l GROUP BY GROUPING SETS ((step, r_name, n_name, c_mktsegment), (step, r_name, n_name), (step, r_name), (step)))"""
_DOWN = """d2 AS (SELECT w.r_name, w.n_name, '*' AS c_mktsegment, u.step, u.forecast * w.weight AS forecast FROM d1 u JOIN we w ON w.depth = 2 AND w.p1 = u.r_name),
d3 AS (SELECT w.r_name, w.n_name, w.c_mktsegment, u.step, u.forecast * w.weight AS forecast FROM d2 u JOIN we w ON w.depth = 3 AND w.p1 = u.r_name AND w.p2 = u.n_name)"""
ORACLES["recon_top_down"] = f"""
WITH {BASE}, d0 AS (SELECT r_name, n_name, c_mktsegment, step, forecast FROM ba WHERE depth = 0),
d1 AS (SELECT w.r_name, '*' AS n_name, '*' AS c_mktsegment, u.step, u.forecast * w.weight AS forecast FROM d0 u JOIN we w ON w.depth = 1), {_DOWN}
SELECT {OUT} FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""
ORACLES["recon_middle_out"] = f"""
WITH {BASE}, d1 AS (SELECT r_name, n_name, c_mktsegment, step, forecast FROM ba WHERE depth = 1), d0 AS (SELECT '*' AS r_name, '*' AS n_name, '*' AS c_mktsegment, step, sum(forecast) AS forecast FROM d1 GROUP BY step), {_DOWN}
SELECT {OUT} FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""


def recon_override(spark, sf_dir):
    """Asia is set to a value, Europe to 110 % of its reconciled forecast; both stay locked, the rest absorbs it."""
    history = _history(spark, sf_dir)
    base = kept(_base(history), "base")
    made = kept(C.reconcile(base, history, LEVELS, "top_down"), "reconciled")
    asked = spark.createDataFrame(
        [("ASIA", "*", "*", 1, 5_000_000.0, None, None), ("EUROPE", "*", "*", 2, None, None, 110.0), ("AFRICA", "*", "*", 3, None, 90.0, None), ("NOWHERE", "*", "*", 1, 1.0, None, None)],
        "r_name string, n_name string, c_mktsegment string, step int, value double, pct_of_base double, pct_of_reconciled double",
    )
    return _told(C.reallocate(C.override(made, asked, base, LEVELS), kept(C.child_weights(history, LEVELS), "weights"), LEVELS))


QUERIES["recon_override"] = recon_override
ORACLES["recon_override"] = f"""
WITH {BASE}, d0 AS (SELECT step, forecast FROM ba WHERE depth = 0),
t AS (SELECT w.r_name, u.step, u.forecast * w.weight AS forecast, w.weight FROM d0 u JOIN we w ON w.depth = 1),
o AS (SELECT t.r_name, t.step, t.weight, CASE WHEN t.r_name = 'ASIA' AND t.step = 1 THEN 5000000.0 WHEN t.r_name = 'EUROPE' AND t.step = 2 THEN t.forecast * 1.1
             WHEN t.r_name = 'AFRICA' AND t.step = 3 THEN b.forecast * 0.9 END AS fixed
      FROM t JOIN ba b ON b.depth = 1 AND b.r_name = t.r_name AND b.step = t.step),
d1 AS (SELECT o.r_name, '*' AS n_name, '*' AS c_mktsegment, o.step,
         coalesce(o.fixed, (d0.forecast - coalesce(sum(o.fixed) OVER (PARTITION BY o.step), 0.0)) * o.weight / sum(CASE WHEN o.fixed IS NULL THEN o.weight END) OVER (PARTITION BY o.step)) AS forecast
       FROM o JOIN d0 USING (step)), {_DOWN},
u AS (SELECT * FROM d3)
SELECT {OUT} FROM (
  SELECT coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name, coalesce(c_mktsegment, '*') AS c_mktsegment, step, sum(forecast) AS forecast
  FROM u GROUP BY GROUPING SETS ((step, r_name, n_name, c_mktsegment), (step, r_name, n_name), (step, r_name), (step)))"""


def recon_summary(spark, sf_dir):
    history = _history(spark, sf_dir)
    got = C.node_summary(history, C.reconcile(_base(history), history, LEVELS, "bottom_up"), LEVELS)
    return got.select(*LEVELS, "history_points", rounded(F.col("history_total"), 2).alias("history_total"), rounded(F.col("future_total"), 2).alias("future_total"))


QUERIES["recon_node_summary"] = recon_summary
ORACLES["recon_node_summary"] = f"""
WITH {BASE}, f AS (SELECT coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name, coalesce(c_mktsegment, '*') AS c_mktsegment, sum(forecast) AS forecast
  FROM ba WHERE depth = 3 GROUP BY GROUPING SETS ((r_name, n_name, c_mktsegment), (r_name, n_name), (r_name), ())),
h AS (SELECT r_name, n_name, c_mktsegment, {long_count("v")} AS history_points, sum(v) AS history_total FROM deep GROUP BY 1, 2, 3)
SELECT r_name, n_name, c_mktsegment, history_points, {r4("history_total", 2)} AS history_total, {r4("forecast", 2)} AS future_total FROM h LEFT JOIN f USING (r_name, n_name, c_mktsegment)"""


def base_forecasts(spark, sf_dir):
    """Automatic forecasts of every node on the dense month grid, independent of one another."""
    from ..operators.resample import densify

    dense = densify(_history(spark, sf_dir), "MS", LEVELS, {"v": 0.0}, "month")
    got = P.automatic(dense, LEVELS, HORIZON, "MS", "month", "v")
    return got.select(H.node_id(LEVELS).alias("node_id"), "step", "model", rounded(F.col("forecast")).alias("forecast"))


QUERIES["recon_base_forecasts"] = base_forecasts
ORACLES["recon_base_forecasts"] = f"""
WITH RECURSIVE {ROLLED.removeprefix("WITH ")},
named AS (SELECT *, CASE depth WHEN 0 THEN 'total' ELSE 'd' || depth || '__' || concat_ws('__', r_name, CASE WHEN depth > 1 THEN n_name END, CASE WHEN depth > 2 THEN c_mktsegment END) END AS k FROM deep),
months AS (SELECT k, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS ts FROM named GROUP BY 1),
demand AS (SELECT months.k, months.ts, coalesce(v, 0.0) AS v FROM months LEFT JOIN named ON named.k = months.k AND named.month = months.ts), {automatic_sql(HORIZON, 12)}
SELECT k AS node_id, step, model, {r4("greatest(forecast, 0.0)")} AS forecast FROM auto"""
