"""Gap, imputation and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import missing as M
from ..operators import outliers as O
from ..operators import resample as R
from ..sources.panels import event_readings, orders_daily, region_monthly
from .common import DAILY, READINGS, REGION, long_count, r4

QUERIES, ORACLES = {}, {}
KEY = ["event_type"]


def readings(spark, sf_dir):
    """Hourly readings of each event type on the dense hour grid; missing hours are null."""
    got = event_readings(spark, sf_dir).withColumnRenamed("ts", "bucket")
    return R.densify(got, "H", KEY).withColumnRenamed("bucket", "ts")


def gap_runs(spark, sf_dir):
    return M.gap_runs(readings(spark, sf_dir), KEY)


RUNS = f"""{READINGS},
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM readings),
g AS (SELECT event_type, ts, i - row_number() OVER (PARTITION BY event_type ORDER BY ts) AS g FROM i WHERE v IS NULL),
runs AS (SELECT event_type, min(ts) AS start, max(ts) AS "end", CAST(count(*) AS BIGINT) AS length FROM g GROUP BY event_type, g.g)"""
QUERIES["gap_runs"] = gap_runs
ORACLES["gap_runs"] = f'WITH {RUNS} SELECT event_type, start, "end", length FROM runs'


def gap_summary(spark, sf_dir):
    got = M.gap_summary(readings(spark, sf_dir), KEY)
    return got.select("event_type", "n", "n_missing", rounded(F.col("completeness")).alias("completeness"), "n_gaps", "max_gap", rounded(F.col("mean_gap")).alias("mean_gap"), F.array_join(F.transform("gap_lengths", lambda x: x.cast("string")), ",").alias("gap_lengths"))


QUERIES["gap_summary"] = gap_summary
ORACLES["gap_summary"] = f"""
WITH {RUNS}, t AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS n_missing FROM readings GROUP BY 1),
s AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n_gaps, max(length) AS max_gap, avg(length) AS mean_gap, string_agg(CAST(length AS VARCHAR), ',' ORDER BY start) AS gap_lengths FROM runs GROUP BY 1)
SELECT event_type, n, n_missing, {r4("1 - n_missing / n")} AS completeness, coalesce(n_gaps, 0) AS n_gaps, coalesce(max_gap, 0) AS max_gap,
       {r4("coalesce(mean_gap, 0.0)")} AS mean_gap, coalesce(gap_lengths, '') AS gap_lengths FROM t LEFT JOIN s USING (event_type)"""

PATTERN = f"""p0 AS (
  SELECT event_type, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, quantile_cont(v, 0.9) OVER (PARTITION BY event_type) AS q,
         count(v) OVER (PARTITION BY event_type) AS obs, lag(v) OVER w AS before
  FROM readings WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
p1 AS (
  SELECT event_type, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS n_missing, count(*) FILTER (v IS NULL AND i >= n // 2) / count(*) FILTER (v IS NULL) AS late_share,
         CASE WHEN max(obs) > 5 AND count(*) FILTER (v IS NULL AND before IS NOT NULL) > 0 THEN count(*) FILTER (v IS NULL AND before > q) / count(*) FILTER (v IS NULL AND before IS NOT NULL) END AS high_share
  FROM p0 GROUP BY 1),
p AS (SELECT *, CASE WHEN n_missing = 0 THEN 'COMPLETE' WHEN late_share > 0.7 THEN 'MAR (end-of-series)' WHEN high_share > 0.4 THEN 'MNAR' ELSE 'MCAR' END AS pattern FROM p1)"""


def missing_pattern(spark, sf_dir):
    got = M.missing_pattern(readings(spark, sf_dir), KEY)
    return got.select("event_type", "n_missing", rounded(F.col("late_share")).alias("late_share"), rounded(F.col("high_share")).alias("high_share"), "pattern")


QUERIES["missing_pattern"] = missing_pattern
ORACLES["missing_pattern"] = f"WITH {READINGS}, {PATTERN} SELECT event_type, n_missing, {r4('late_share')} AS late_share, {r4('high_share')} AS high_share, pattern FROM p"


def missing_method(spark, sf_dir):
    return M.choose_method(readings(spark, sf_dir), KEY).select("event_type", "max_gap", "pattern", "method")


QUERIES["missing_method"] = missing_method
ORACLES["missing_method"] = f"""
WITH {RUNS}, {PATTERN}, s AS (SELECT event_type, max(length) AS m FROM runs GROUP BY 1)
SELECT event_type, coalesce(m, 0) AS max_gap, pattern,
  CASE WHEN n_missing = 0 THEN 'none' WHEN m <= 2 THEN 'linear' WHEN m <= 7 THEN 'spline' WHEN pattern = 'MAR (end-of-series)' THEN 'forward_fill' ELSE 'seasonal' END AS method
FROM p LEFT JOIN s USING (event_type)"""

def gap_report(spark, sf_dir):
    """The gaps of each series in one row: share, pattern, advised method, runs."""
    got = M.report(readings(spark, sf_dir), KEY).drop("n_missing_after")
    return got.select("event_type", "n", "n_missing", rounded(F.col("pct_missing")).alias("pct_missing"), "pattern", "method", "n_gaps", "max_gap", rounded(F.col("mean_gap")).alias("mean_gap"))


QUERIES["gap_report"] = gap_report
ORACLES["gap_report"] = f"""
WITH {RUNS}, {PATTERN}, s AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n_gaps, max(length) AS m, avg(length) AS mean_gap FROM runs GROUP BY 1),
t AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM readings GROUP BY 1)
SELECT event_type, n, n_missing, {r4("100 * n_missing / n")} AS pct_missing, pattern,
  CASE WHEN n_missing = 0 THEN 'none' WHEN m <= 2 THEN 'linear' WHEN m <= 7 THEN 'spline' WHEN pattern = 'MAR (end-of-series)' THEN 'forward_fill' ELSE 'seasonal' END AS method,
  coalesce(n_gaps, 0) AS n_gaps, coalesce(m, 0) AS max_gap, {r4("coalesce(mean_gap, 0.0)")} AS mean_gap
FROM p JOIN t USING (event_type) LEFT JOIN s USING (event_type)"""

IMPUTE = {
    "forward_fill": "last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)",
    "backward_fill": "first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "mean": "avg(v) OVER (PARTITION BY event_type)",
    "knn": "avg(v) OVER (PARTITION BY event_type)",
    "median": "quantile_cont(v, 0.5) OVER (PARTITION BY event_type)",
    "zero": "0.0",
    "seasonal": "coalesce(avg(v) OVER (PARTITION BY event_type, i % 24), avg(v) OVER (PARTITION BY event_type))",
    "linear": """CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END""",
}
for _method, _sql in IMPUTE.items():

    def _impute(spark, sf_dir, method=_method):
        got = M.impute(readings(spark, sf_dir), KEY, method, period=24)
        return got.select("event_type", "ts", rounded(F.col("imputed")).alias("imputed"), "was_missing")

    QUERIES[f"impute_{_method}"] = _impute
    ORACLES[f"impute_{_method}"] = f"""
WITH {READINGS}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM readings),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv,
             first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(v IGNORE NULLS) OVER b AS nv
      FROM i WINDOW a AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, {r4(f"coalesce(v, {_sql})")} AS imputed, v IS NULL AS was_missing FROM n"""


def impute_auto(spark, sf_dir):
    got = M.impute(readings(spark, sf_dir), KEY, "auto", period=24)
    return got.select("event_type", "ts", "method", rounded(F.col("imputed")).alias("imputed"), "was_missing")


def spline_impute(spark, sf_dir):
    got = M.impute(readings(spark, sf_dir), KEY, "spline")
    return got.select("event_type", "ts", rounded(F.col("imputed")).alias("imputed"), "was_missing")


QUERIES |= {"impute_auto": impute_auto, "spline_impute": spline_impute}
#: A natural cubic spline: sweeps of the tridiagonal system over the known points, then its pieces at the gaps.
SPLINE = """i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM readings),
k0 AS (SELECT event_type, i AS x, v AS y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m, lead(i) OVER w - i AS h, lead(v) OVER w - v AS dy FROM i WHERE v IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
k AS MATERIALIZED (SELECT *, dy / h AS s, lag(h) OVER w AS ph, lag(dy / h) OVER w AS ps FROM k0 WINDOW w AS (PARTITION BY event_type ORDER BY k)),
fw AS (
  SELECT event_type, k, m, 0.0::DOUBLE AS u, 0.0::DOUBLE AS r FROM k WHERE k = 0
  UNION ALL
  SELECT k.event_type, k.k, k.m, k.h / (2 * (k.ph + k.h) - k.ph * fw.u), (6 * (k.s - k.ps) - k.ph * fw.r) / (2 * (k.ph + k.h) - k.ph * fw.u)
  FROM fw JOIN k ON k.event_type = fw.event_type AND k.k = fw.k + 1 WHERE k.k < k.m - 1),
fm AS MATERIALIZED (SELECT * FROM fw),
bw AS (
  SELECT event_type, m - 1 AS k, 0.0::DOUBLE AS b FROM k WHERE k = 0
  UNION ALL
  SELECT fm.event_type, fm.k, CASE WHEN fm.k = 0 THEN 0.0 ELSE fm.r - fm.u * bw.b END FROM bw JOIN fm ON fm.event_type = bw.event_type AND fm.k = bw.k - 1),
c AS MATERIALIZED (SELECT k.*, bw.b, lead(k.x) OVER w AS nx, lead(k.y) OVER w AS ny, lead(bw.b) OVER w AS nb FROM k JOIN bw USING (event_type, k) WINDOW w AS (PARTITION BY k.event_type ORDER BY k.k)),
spot AS (SELECT event_type, i.ts, i.i, i.v, least(greatest(i.i, min(CASE WHEN v IS NOT NULL THEN i.i END) OVER (PARTITION BY event_type)), max(CASE WHEN v IS NOT NULL THEN i.i END) OVER (PARTITION BY event_type)) AS p FROM i),
sp AS (
  SELECT spot.event_type, spot.ts, spot.v, (c.nx - spot.p) / c.h * c.y + (spot.p - c.x) / c.h * c.ny
    + ((power((c.nx - spot.p) / c.h, 3) - (c.nx - spot.p) / c.h) * c.b + (power((spot.p - c.x) / c.h, 3) - (spot.p - c.x) / c.h) * c.nb) * c.h * c.h / 6 AS made
  FROM spot JOIN c ON c.event_type = spot.event_type AND c.k < c.m - 1 AND spot.p >= c.x AND (spot.p < c.nx OR c.k = c.m - 2 AND spot.p = c.nx))"""
ORACLES["spline_impute"] = f"WITH RECURSIVE {READINGS}, {SPLINE} SELECT event_type, ts, {r4('coalesce(v, made)')} AS imputed, v IS NULL AS was_missing FROM sp"
ORACLES["impute_auto"] = f"""
WITH RECURSIVE {READINGS}, {SPLINE},
chosen AS (SELECT event_type, method FROM ({ORACLES["missing_method"].strip()})),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv,
             first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(v IGNORE NULLS) OVER b AS nv, {IMPUTE["seasonal"]} AS seasonal, {IMPUTE["forward_fill"]} AS fill
      FROM i WINDOW a AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, n.ts, method, {r4("coalesce(n.v, CASE method WHEN 'linear' THEN " + IMPUTE["linear"] + " WHEN 'forward_fill' THEN fill WHEN 'spline' THEN made ELSE seasonal END)")} AS imputed, n.v IS NULL AS was_missing
FROM n JOIN chosen USING (event_type) JOIN sp USING (event_type, ts)"""


def zero_as_missing(spark, sf_dir):
    """Zero readings become gaps before linear imputation."""
    whole = readings(spark, sf_dir).withColumn("v", F.floor("v"))
    got = M.impute(whole, KEY, "linear", treat_zero=True)
    return got.select("event_type", "ts", rounded(F.col("imputed")).alias("imputed"), "was_missing")


QUERIES["impute_zero_as_missing"] = zero_as_missing
ORACLES["impute_zero_as_missing"] = ORACLES["impute_linear"].replace("CASE WHEN n > 0 THEN s / n END AS v", "nullif(CASE WHEN n > 0 THEN floor(s / n) END, 0) AS v")

FENCES = """f AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, stddev_pop(v) AS s FROM daily),
d AS (SELECT ts, v, (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr, CASE WHEN s > 0 THEN abs(v - m) / s > 3.0 ELSE false END AS zscore,
             q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM daily, f),
o AS (SELECT *, (iqr::INT + zscore::INT) / 2 AS score FROM d)"""


def outlier_iqr(spark, sf_dir):
    return O.detect(orders_daily(spark, sf_dir), [], ["iqr"]).select("ts", "v", "iqr")


def outlier_zscore(spark, sf_dir):
    return O.detect(orders_daily(spark, sf_dir), [], ["zscore"]).select("ts", "v", "zscore")


def outlier_consensus(spark, sf_dir):
    got = O.detect(orders_daily(spark, sf_dir), [], ["iqr", "zscore"])
    return got.select("ts", "score", "severity", "is_outlier", F.array_join("flagged_by", ",").alias("flagged_by"))


def outlier_fences(spark, sf_dir):
    names = ("q1", "q3", "iqr", "lower", "upper", "far_lower", "far_upper")
    return O.fences(region_monthly(spark, sf_dir), ["r_name"]).select("r_name", *[rounded(F.col(c)).alias(c) for c in names])


def _treated(treatment):
    def query(spark, sf_dir):
        got = O.treat(O.detect(orders_daily(spark, sf_dir), [], ["iqr", "zscore"]), [], treatment)
        return got.select("ts", rounded(F.col("treated")).alias("treated"))

    return query


def outlier_regions(spark, sf_dir):
    """Detectors by key: every region's monthly series with its own quartiles and moments."""
    got = O.detect(region_monthly(spark, sf_dir), ["r_name"], ["iqr", "zscore"], iqr=1.0, z=1.5)
    return got.select("r_name", "ts", "iqr", "zscore", "severity")


def outlier_top(spark, sf_dir):
    """The report's top ten (the feature is the limit)."""
    return O.worst(O.detect(orders_daily(spark, sf_dir), [], ["iqr", "zscore"])).select("ts", "v", "score")


def outlier_advice(spark, sf_dir):
    got = O.advice(O.detect(region_monthly(spark, sf_dir), ["r_name"], ["iqr", "zscore"], iqr=0.8), ["r_name"])
    return got.select("r_name", "ts", F.regexp_replace("treatment", r"\[.*", "").alias("treatment"))


QUERIES |= {"outlier_iqr": outlier_iqr, "outlier_zscore": outlier_zscore, "outlier_consensus": outlier_consensus, "outlier_fences": outlier_fences, "outlier_cap": _treated("cap"), "outlier_remove": _treated("remove"), "outlier_keep": _treated("keep"), "outlier_regions": outlier_regions, "outlier_top": outlier_top, "outlier_advice": outlier_advice}
ORACLES |= {
    "outlier_iqr": f"WITH {DAILY}, {FENCES} SELECT ts, v, iqr FROM o",
    "outlier_zscore": f"WITH {DAILY}, {FENCES} SELECT ts, v, zscore FROM o",
    "outlier_consensus": f"""WITH {DAILY}, {FENCES} SELECT ts, score, CASE WHEN score = 0 THEN NULL WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       score > 0 AS is_outlier, concat_ws(',', CASE WHEN iqr THEN 'iqr' END, CASE WHEN zscore THEN 'zscore' END) AS flagged_by FROM o""",
    "outlier_fences": f"""WITH {REGION}, q AS (SELECT r_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM region_monthly GROUP BY 1)
SELECT r_name, {r4("a")} AS q1, {r4("b")} AS q3, {r4("b - a")} AS iqr, {r4("a - 1.5 * (b - a)")} AS lower, {r4("b + 1.5 * (b - a)")} AS upper, {r4("a - 3.0 * (b - a)")} AS far_lower, {r4("b + 3.0 * (b - a)")} AS far_upper FROM q""",
    "outlier_cap": f"WITH {DAILY}, {FENCES} SELECT ts, {r4('CASE WHEN score > 0 THEN least(greatest(v, lower), upper) ELSE v END')} AS treated FROM o",
    "outlier_remove": f"WITH {DAILY}, {FENCES} SELECT ts, {r4('CASE WHEN score = 0 THEN v END')} AS treated FROM o",
    "outlier_keep": f"WITH {DAILY} SELECT ts, {r4('v')} AS treated FROM daily",
    "outlier_regions": f"""WITH {REGION}, s AS (SELECT r_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev_pop(v) AS s FROM region_monthly GROUP BY 1),
x AS (SELECT r_name, ts, (v < a - (b - a) OR v > b + (b - a)) AS iqr, CASE WHEN s > 0 THEN abs(v - m) / s > 1.5 ELSE false END AS zscore FROM region_monthly JOIN s USING (r_name))
SELECT r_name, ts, iqr, zscore, CASE iqr::INT + zscore::INT WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS severity FROM x""",
    "outlier_top": f"WITH {DAILY}, {FENCES} SELECT ts, v, score FROM o WHERE score > 0 ORDER BY score DESC, ts LIMIT 10",
    "outlier_advice": f"""WITH {REGION}, s AS (SELECT r_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev_pop(v) AS s FROM region_monthly GROUP BY 1),
x AS (SELECT r_name, ts, (v < a - 0.8 * (b - a) OR v > b + 0.8 * (b - a))::INT + (CASE WHEN s > 0 THEN abs(v - m) / s > 3 ELSE false END)::INT AS k FROM region_monthly JOIN s USING (r_name))
SELECT r_name, ts, CASE k WHEN 2 THEN 'investigate / impute' WHEN 1 THEN 'cap to ' END AS treatment FROM x""",
}


def outlier_kernels(spark, sf_dir):
    """Isolation forest and local outlier factor by region, beside the fence."""
    got = O.detect(region_monthly(spark, sf_dir), ["r_name"], ["iqr", "isof", "lof"])
    return got.select("r_name", "ts", "v", "iqr", "isof", "lof", rounded(F.col("score")).alias("score"), "severity")


QUERIES["outlier_isof_lof"] = outlier_kernels


def outlier_lof(spark, sf_dir):
    """Local outlier factors of each region's months, and the five per cent that stand out."""
    at = region_monthly(spark, sf_dir)
    flagged = O.detect(at, ["r_name"], ["lof"]).select("r_name", "ts", F.col("lof").alias("flag"))
    scores = O.local_outlier_factor(at, ["r_name"])
    return scores.join(flagged, ["r_name", "ts"]).select("r_name", "ts", rounded(F.col("lof"), 5).alias("lof"), "flag")


QUERIES["outlier_lof"] = outlier_lof
ORACLES["outlier_lof"] = f"""
WITH {REGION},
s AS MATERIALIZED (SELECT r_name, ts, v, row_number() OVER (PARTITION BY r_name ORDER BY v, ts) AS i, least(20, count(*) OVER (PARTITION BY r_name) - 1) AS k FROM region_monthly),
near AS MATERIALIZED (SELECT * FROM (
  SELECT a.r_name, a.i, b.i AS j, a.k, abs(b.v - a.v) AS d, row_number() OVER (PARTITION BY a.r_name, a.i ORDER BY abs(b.v - a.v), b.i) AS place
  FROM s a JOIN s b ON a.r_name = b.r_name AND a.i <> b.i AND abs(a.i - b.i) <= 20) WHERE place <= k),
reach AS (SELECT r_name, i, max(d) AS reach FROM near GROUP BY 1, 2),
thick AS MATERIALIZED (SELECT n.r_name, n.i, 1 / (avg(greatest(n.d, r.reach)) + 1e-10) AS density FROM near n JOIN reach r ON r.r_name = n.r_name AND r.i = n.j GROUP BY 1, 2),
f AS (SELECT n.r_name, n.i, avg(t.density) / max(o.density) AS lof FROM near n JOIN thick t ON t.r_name = n.r_name AND t.i = n.j JOIN thick o ON o.r_name = n.r_name AND o.i = n.i GROUP BY 1, 2)
SELECT r_name, ts, {r4("lof", 5)} AS lof, lof > quantile_cont(lof, 0.95) OVER (PARTITION BY r_name) AS flag FROM f JOIN s USING (r_name, i)"""


def outlier_report(spark, sf_dir):
    """Each region's outliers in one row: counts by severity, moments with and without them, fences."""
    got = O.report(O.detect(region_monthly(spark, sf_dir), ["r_name"], ["iqr", "zscore"], iqr=1.0, z=1.5), ["r_name"])
    return got.select("r_name", "n", "n_outliers", "high", "medium", "low", *[rounded(F.col(c), 2).alias(c) for c in ("pct_outliers", "mean", "mean_without", "std", "std_without", "lower", "upper")])


QUERIES["outlier_report"] = outlier_report
ORACLES["outlier_report"] = f"""
WITH {REGION}, s AS (SELECT r_name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev_pop(v) AS s FROM region_monthly GROUP BY 1),
x AS (SELECT r_name, v, (v < a - (b - a) OR v > b + (b - a))::INT + (CASE WHEN s > 0 THEN abs(v - m) / s > 1.5 ELSE false END)::INT AS k, a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM region_monthly JOIN s USING (r_name))
SELECT r_name, {long_count()} AS n, CAST(count(*) FILTER (k > 0) AS BIGINT) AS n_outliers, CAST(count(*) FILTER (k = 2) AS BIGINT) AS high, CAST(count(*) FILTER (k = 1) AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low,
  {r4("100 * count(*) FILTER (k > 0) / count(*)", 2)} AS pct_outliers, {r4("avg(v)", 2)} AS mean, {r4("avg(v) FILTER (k = 0)", 2)} AS mean_without, {r4("stddev_samp(v)", 2)} AS std, {r4("stddev_samp(v) FILTER (k = 0)", 2)} AS std_without,
  {r4("max(lower)", 2)} AS lower, {r4("max(upper)", 2)} AS upper FROM x GROUP BY 1"""
