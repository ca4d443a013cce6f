"""Decomposition, filters, diagnostics and series profiles, each with its whole computation in SQL beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import decompose, features, missing, outliers, spectrum
from ..operators import stats as S
from ..sources.panels import region_monthly, shipments_daily
from .analysis import ACF, TRENDED, _LABEL, components
from .common import CHI2_TAIL, REGION, SHIPMENTS, T_TAILS, long_count, r4

QUERIES, ORACLES = {}, {}
KEY = ["r_name"]

#: The decomposition of monthly series, period 12: quadratic smoothing over 25 months (12 on each side; the ends
#: are read off the quadratics of the first and last 25), centred medians of the phases, the rest.
STL = f"""{REGION},
x AS (SELECT r_name, ts, v, CAST(row_number() OVER (PARTITION BY r_name ORDER BY ts) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY r_name) AS INT) AS n FROM region_monthly),
inner_part AS (SELECT a.r_name, a.i, sum(b.v * 3 * (467 - 5 * (b.i - a.i) * (b.i - a.i)) / 15525.0) AS trend FROM x a JOIN x b ON a.r_name = b.r_name AND b.i BETWEEN a.i - 12 AND a.i + 12 WHERE a.i >= 12 AND a.i < a.n - 12 GROUP BY 1, 2),
edge AS (SELECT r_name, s, i - CASE s WHEN 0 THEN 12 ELSE n - 13 END AS p, i, v FROM x, (VALUES (0), (1)) AS sides(s) WHERE CASE s WHEN 0 THEN i < 25 ELSE i >= n - 25 END),
curve AS (SELECT r_name, s, avg(v) AS m, sum(p * v) / 1300.0 AS b, sum((p * p - 52) * v) / 53820.0 AS c FROM edge GROUP BY 1, 2),
t AS (SELECT r_name, i, trend FROM inner_part UNION ALL SELECT e.r_name, e.i, m + b * p + c * (p * p - 52) FROM edge e JOIN curve USING (r_name, s) WHERE CASE s WHEN 0 THEN p < 0 ELSE p > 0 END),
d AS (SELECT x.*, trend, quantile_cont(v - trend, 0.5) OVER (PARTITION BY r_name, i % 12) AS m FROM x JOIN t USING (r_name, i)),
parts AS (SELECT r_name, ts, i, n, v, trend, m - avg(m) OVER (PARTITION BY r_name) AS seasonal, v - trend - (m - avg(m) OVER (PARTITION BY r_name)) AS residual FROM d)"""


def stl_components(spark, sf_dir):
    got = decompose.stl(region_monthly(spark, sf_dir), KEY, 12)
    return got.select("r_name", "ts", *[rounded(F.col(c), 1).alias(c) for c in ("trend", "seasonal", "residual")], "period")


def stl_strength(spark, sf_dir):
    got = S.strengths(decompose.stl(region_monthly(spark, sf_dir), KEY, 12), KEY)
    return got.select("r_name", rounded(F.col("trend_strength")).alias("trend_strength"), rounded(F.col("seasonal_strength")).alias("seasonal_strength"), "trend_label", "seasonal_label")


QUERIES |= {"stl_components": stl_components, "stl_strength": stl_strength}
ORACLES["stl_components"] = f"WITH {STL} SELECT r_name, ts, {r4('trend', 1)} AS trend, {r4('seasonal', 1)} AS seasonal, {r4('residual', 1)} AS residual, CAST(12 AS INT) AS period FROM parts"
ORACLES["stl_strength"] = f"""
WITH {STL}, s AS (SELECT r_name, greatest(0.0, 1 - var_pop(residual) / (var_pop(trend + residual) + 1e-12)) AS ft, greatest(0.0, 1 - var_pop(residual) / (var_pop(seasonal + residual) + 1e-12)) AS fs FROM parts GROUP BY 1)
SELECT r_name, {r4("ft")} AS trend_strength, {r4("fs")} AS seasonal_strength, {_LABEL.format("ft")} AS trend_label, {_LABEL.format("fs")} AS seasonal_label FROM s"""


def hp_filter(spark, sf_dir):
    got = decompose.hp(region_monthly(spark, sf_dir), KEY, 1600.0)
    return got.select("r_name", "ts", rounded(F.col("hp_trend"), 1).alias("hp_trend"), rounded(F.col("cycle"), 1).alias("cycle"))


QUERIES["hp_filter"] = hp_filter
ORACLES["hp_filter"] = f"""
WITH RECURSIVE {REGION},
x AS MATERIALIZED (SELECT r_name, ts, v, CAST(row_number() OVER (PARTITION BY r_name ORDER BY ts) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY r_name) AS INT) AS n FROM region_monthly),
k AS MATERIALIZED (SELECT *, 1 + 1600.0 * CASE least(i, n - 1 - i) WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 6 END AS d0,
  CASE WHEN i = n - 1 THEN 0.0 WHEN i = 0 OR i = n - 2 THEN -3200.0 ELSE -6400.0 END AS d1, CASE WHEN i <= n - 3 THEN 1600.0 ELSE 0.0 END AS d2 FROM x),
f AS (
  SELECT r_name, i, n, ts, v, d0::DOUBLE AS g, (d1 / d0)::DOUBLE AS a, (d2 / d0)::DOUBLE AS b, 0.0::DOUBLE AS pg, 0.0::DOUBLE AS pb, v::DOUBLE AS z, 0.0::DOUBLE AS pz FROM k WHERE i = 0
  UNION ALL
  SELECT k.r_name, k.i, k.n, k.ts, k.v, k.d0 - f.a * f.a * f.g - f.pb * f.pb * f.pg,
    (k.d1 - f.b * f.a * f.g) / (k.d0 - f.a * f.a * f.g - f.pb * f.pb * f.pg), k.d2 / (k.d0 - f.a * f.a * f.g - f.pb * f.pb * f.pg),
    f.g, f.b, k.v - f.a * f.z - f.pb * f.pz, f.z FROM f JOIN k ON k.r_name = f.r_name AND k.i = f.i + 1),
w AS MATERIALIZED (SELECT r_name, i, n, ts, v, z / g AS y, a, b FROM f),
s AS (
  SELECT r_name, i, ts, v, y AS trend, 0.0::DOUBLE AS after FROM w WHERE i = n - 1
  UNION ALL
  SELECT w.r_name, w.i, w.ts, w.v, w.y - w.a * s.trend - w.b * s.after, s.trend FROM s JOIN w ON w.r_name = s.r_name AND w.i = s.i - 1)
SELECT r_name, ts, {r4("trend", 1)} AS hp_trend, {r4("v - trend", 1)} AS cycle FROM s"""


def pacf(spark, sf_dir):
    got = S.pacf(S.acf(region_monthly(spark, sf_dir), KEY, 24), KEY)
    return got.select("r_name", "lag", rounded(F.col("pacf")).alias("pacf"))


QUERIES["pacf"] = pacf


def own_period(spark, sf_dir):
    """The period of each region's strongest frequency, and its three strongest periods."""
    power = spectrum.spectrum(region_monthly(spark, sf_dir), KEY)
    best = spectrum.strongest_periods(power, KEY).select("r_name", F.array_join(F.transform("periods", lambda p: p.cast("string")), ",").alias("periods"))
    return spectrum.dominant_period(power, KEY).select("r_name", "period").join(best, "r_name")


QUERIES["own_period"] = own_period
ORACLES["own_period"] = f"""
WITH {REGION},
y AS MATERIALIZED (SELECT r_name, v - avg(v) OVER w AS y, row_number() OVER (PARTITION BY r_name ORDER BY ts) - 1 AS i, count(*) OVER w AS n FROM region_monthly WINDOW w AS (PARTITION BY r_name)),
f AS (SELECT r_name, k, max(n) AS n, pow(sum(y * cos(2 * pi() * k * i / n)), 2) + pow(sum(y * sin(2 * pi() * k * i / n)), 2) AS s FROM y, generate_series(1, (SELECT max(n) // 2 FROM y)) AS g(k) WHERE k <= n // 2 GROUP BY r_name, k),
one AS (SELECT r_name, CAST(greatest(2, least(arg_max(n, s) // 3, round_even(arg_max(n / k, s), 0))) AS INT) AS period FROM f GROUP BY 1),
best AS (SELECT r_name, string_agg(CAST(p AS VARCHAR), ',' ORDER BY s DESC) AS periods FROM (SELECT r_name, s, round(n / k, 1) AS p, row_number() OVER (PARTITION BY r_name ORDER BY s DESC) AS place FROM f WHERE k > 2 AND 2 * k < n) WHERE place <= 3 GROUP BY 1)
SELECT r_name, period, periods FROM one JOIN best USING (r_name)"""
ORACLES["pacf"] = f"""
{ACF.replace("WITH ", "WITH RECURSIVE ", 1)},
r AS MATERIALIZED (SELECT r_name, list(acf::DOUBLE ORDER BY lag) AS r FROM a WHERE lag BETWEEN 1 AND 24 GROUP BY 1),
p AS (
  SELECT r_name, r, 1 AS k, [r[1] / (1 + 1e-12)] AS phi FROM r
  UNION ALL
  SELECT r_name, r, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda q: q[1] - last * q[2]), last) FROM (
    SELECT *, (r[k + 1] - list_dot_product(phi, list_reverse(r[1:k]))) / (1 - list_dot_product(phi, r[1:k]) + 1e-12) AS last FROM p WHERE k < 24))
SELECT r_name, CAST(k AS INT) AS lag, CAST({r4("phi[k]")} AS DOUBLE) AS pacf FROM p UNION ALL SELECT r_name, 0, 1.0::DOUBLE FROM r"""


def diagnostics(spark, sf_dir):
    """Stationarity tests of the series and tests of the residual: statistic, p value and verdict of each."""
    got = S.series_tests(region_monthly(spark, sf_dir), KEY, 12).filter("test <> 'trend'")
    return got.select("r_name", "test", rounded(F.col("statistic"), 3).alias("statistic"), rounded(F.coalesce("p_value", F.lit(1.0)), 5).alias("p_value"), F.coalesce("verdict", F.lit("")).alias("verdict"))


def _left(columns: list[str], by: str) -> str:
    """Each column less its projection on ``by``, within the series."""
    return ", ".join(f"{c} - {by} * sum({c} * {by}) OVER s / (sum({by} * {by}) OVER s + 1e-300) AS {c}" for c in columns)


_LAGS = [f"x{k}" for k in range(1, 6)]
_STEPS = "".join(f",\na{k} AS (SELECT r_name, n, top, {_left(['y', *_LAGS[k:]], _LAGS[k - 1])} FROM a{k - 1} WINDOW s AS (PARTITION BY r_name))" for k in range(1, 6))
QUERIES["series_diagnostics"] = diagnostics
ORACLES["series_diagnostics"] = f"""
WITH {STL},
y AS (SELECT r_name, i, v - lag(v) OVER w AS y, lag(v) OVER w AS a, lag(v) OVER w - lag(v, 2) OVER w AS b FROM x WINDOW w AS (PARTITION BY r_name ORDER BY i)),
m AS (SELECT r_name, count(*) AS n, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS byy, var_pop(y) * count(*) AS yy FROM y WHERE b IS NOT NULL GROUP BY 1),
c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS p, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS q FROM m),
adf AS (SELECT r_name, n, p / (sqrt((yy - p * ay - q * byy) / (n - 3) * bb / det) + 1e-12) AS s FROM c),
e AS (SELECT r_name, i, v - avg(v) OVER (PARTITION BY r_name) AS e FROM x),
u AS (SELECT *, sum(e) OVER (PARTITION BY r_name ORDER BY i) AS u FROM e),
kpss AS (SELECT r_name, sum(u * u) / (count(*) * count(*)) / (sum(e * e) / count(*) + 1e-12) AS s FROM u GROUP BY 1),
g AS (SELECT r_name, i, n, residual - avg(residual) OVER (PARTITION BY r_name) AS d FROM parts),
z AS (SELECT r_name, sum(d * d) + 1e-12 AS z, max(n) AS n FROM g GROUP BY 1),
h AS (SELECT p.r_name, k, sum(p.d * q.d) AS c FROM generate_series(1, 10) AS t(k), g p JOIN g q ON p.r_name = q.r_name AND q.i = p.i - k GROUP BY 1, 2),
lb AS (SELECT r_name, max(n) * (max(n) + 2.0) * sum((c / z) * (c / z) / (n - k)) AS s FROM h JOIN z USING (r_name) GROUP BY 1),
sq AS (SELECT r_name, n, i, residual * residual AS y, {", ".join(f"lag(residual * residual, {k}) OVER w AS x{k}" for k in range(1, 6))} FROM parts WINDOW w AS (PARTITION BY r_name ORDER BY i)),
a0 AS (SELECT r_name, n, var_pop(y) OVER s * count(*) OVER s AS top, y - avg(y) OVER s AS y, {", ".join(f"{c} - avg({c}) OVER s AS {c}" for c in _LAGS)} FROM sq WHERE i >= 5 WINDOW s AS (PARTITION BY r_name)){_STEPS},
arch AS (SELECT r_name, max(n) * (1 - sum(y * y) / (max(top) + 1e-12)) AS s FROM a5 GROUP BY 1),
told AS (
  SELECT r_name, 'adf' AS test, s, greatest(0.001, least(1.0, CASE WHEN s > 0 THEN 1 - {T_TAILS.format(t="s", v="(n - 3)")} / 2 ELSE {T_TAILS.format(t="s", v="(n - 3)")} / 2 END)) AS p, CASE WHEN s < -2.86 THEN 'stationary' ELSE 'unit root' END AS verdict FROM adf UNION ALL
  SELECT r_name, 'kpss', s, CASE WHEN s < 0.347 THEN 0.2 WHEN s < 0.463 THEN 0.1 WHEN s < 0.574 THEN 0.05 WHEN s < 0.739 THEN 0.025 ELSE 0.01 END, CASE WHEN s < 0.463 THEN 'stationary' ELSE 'not stationary' END FROM kpss UNION ALL
  SELECT r_name, 'differencing', CASE WHEN adf.s < -2.86 AND kpss.s < 0.463 THEN 0.0 ELSE 1.0 END, 1.0, '' FROM adf JOIN kpss USING (r_name) UNION ALL
  SELECT r_name, 'ljung_box', s, {CHI2_TAIL.format(x="s", v="10")}, CASE WHEN s < 18.307038 THEN 'white' ELSE 'autocorrelated' END FROM lb UNION ALL
  SELECT r_name, 'arch_lm', s, {CHI2_TAIL.format(x="s", v="5")}, CASE WHEN s < 11.070498 THEN 'constant variance' ELSE 'changing variance' END FROM arch)
SELECT r_name, test, {r4("s", 3)} AS statistic, CAST({r4("p", 5)} AS DOUBLE) AS p_value, verdict FROM told"""


def outlier_residual(spark, sf_dir):
    """Points whose residual lies over 1.5 deviations from its mean."""
    got = outliers.detect(components(spark, sf_dir), KEY, ["residual"], residual="residual", z=1.5)
    return got.select("r_name", "ts", "is_outlier", "severity", F.array_join("flagged_by", ",").alias("flagged_by"))


QUERIES["outlier_residual"] = outlier_residual
ORACLES["outlier_residual"] = f"""
WITH {TRENDED}, z AS (SELECT r_name, ts, abs(v - trend - seasonal - avg(v - trend - seasonal) OVER (PARTITION BY r_name)) / stddev_pop(v - trend - seasonal) OVER (PARTITION BY r_name) > 1.5 AS hit FROM c)
SELECT r_name, ts, hit AS is_outlier, CASE WHEN hit THEN 'HIGH' END AS severity, CASE WHEN hit THEN 'residual' ELSE '' END AS flagged_by FROM z"""


def lag_selection(spark, sf_dir):
    """Lags of the feature matrix: up to eight significant ones, or the usual ones, that a third of the series can hold."""
    found = S.acf(region_monthly(spark, sf_dir), KEY)
    n = found.groupBy(*KEY).agg(F.max("n").alias("n"))
    got = S.significant_lags(found, KEY).join(n, KEY)
    return got.select("r_name", F.array_join(F.transform(features.chosen_lags(F.col("lags"), F.col("n")), lambda x: x.cast("string")), ",").alias("lags"))


QUERIES["lag_selection"] = lag_selection
ORACLES["lag_selection"] = f"""
{ACF}, s AS (SELECT r_name, lag, n, row_number() OVER (PARTITION BY r_name ORDER BY lag) AS k FROM a WHERE lag > 0 AND lag <= n // 2 - 1 AND abs(acf) > 1.96 / sqrt(n)),
whole AS (SELECT DISTINCT r_name, n FROM a),
c AS (SELECT r_name, lag, n FROM s WHERE k <= 8 UNION ALL SELECT r_name, d AS lag, n FROM whole, (VALUES (1), (2), (3), (7), (14), (28), (30)) AS t(d) WHERE r_name NOT IN (SELECT r_name FROM s))
SELECT whole.r_name, coalesce(string_agg(CAST(lag AS VARCHAR), ',' ORDER BY lag) FILTER (lag < c.n // 3), '') AS lags FROM whole LEFT JOIN c USING (r_name) GROUP BY 1"""


def impute_columns(spark, sf_dir):
    """Both value columns of the daily shipments, each with its own gaps, imputed in one pass."""
    at = shipments_daily(spark, sf_dir)
    day = F.dayofmonth("ts")
    gaps = at.select("ts", F.when(day % 9 != 0, F.col("price")).alias("price"), F.when(day % 7 != 0, F.col("discount")).alias("discount"))
    done = missing.impute_wide(gaps, ["price", "discount"], method="mean")
    return done.select("ts", rounded(F.col("price"), 2).alias("price"), rounded(F.col("discount")).alias("discount"))


QUERIES["impute_columns"] = impute_columns
ORACLES["impute_columns"] = f"""
WITH {SHIPMENTS}, g AS (SELECT ts, CASE WHEN day(ts) % 9 <> 0 THEN price END AS price, CASE WHEN day(ts) % 7 <> 0 THEN discount END AS discount FROM shipments)
SELECT ts, {r4("coalesce(price, avg(price) OVER ())", 2)} AS price, {r4("coalesce(discount, avg(discount) OVER ())")} AS discount FROM g"""


def series_profile(spark, sf_dir):
    """Each region's profile: extent, level, spread, demand class, strengths, family of models, identity."""
    got = features.series_profile(components(spark, sf_dir), KEY)
    return got.select("series_id", "hier_r_name", "n", "first", "last", *[rounded(F.col(c), d).alias(c) for c, d in (("mean", 2), ("cv", 4), ("pct_zero", 4), ("trend_strength", 4), ("seasonal_strength", 4))], "class", "model")


QUERIES["series_profile"] = series_profile
ORACLES["series_profile"] = f"""
WITH {TRENDED}, p AS (
  SELECT r_name, {long_count("v")} AS n, min(ts) AS first, max(ts) AS last, avg(v) AS mean, stddev_samp(v) / (abs(avg(v)) + 1e-12) AS cv, 100 * avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS pct_zero,
    greatest(0.0, 1 - var_pop(v - trend - seasonal) / (var_pop(v - seasonal) + 1e-12)) AS ft, greatest(0.0, 1 - var_pop(v - trend - seasonal) / (var_pop(v - trend) + 1e-12)) AS fs,
    count(*) / count(*) FILTER (v > 0) AS adi, power(coalesce(stddev_samp(v) FILTER (v > 0), 0.0) / (avg(v) FILTER (v > 0) + 1e-12), 2) AS cv2 FROM c GROUP BY 1),
k AS (SELECT *, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi < 1.32 THEN 'Erratic' WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END AS class FROM p)
SELECT r_name AS series_id, r_name AS hier_r_name, n, first, last, {r4("mean", 2)} AS mean, {r4("cv")} AS cv, {r4("pct_zero")} AS pct_zero, {r4("ft")} AS trend_strength, {r4("fs")} AS seasonal_strength, class,
  CASE WHEN class = 'Lumpy' THEN 'TSB' WHEN class = 'Intermittent' THEN 'SBA' WHEN class = 'Erratic' THEN 'LightGBM' WHEN fs > 0.6 AND ft > 0.3 THEN 'ETS' WHEN fs > 0.6 THEN 'SARIMA' WHEN ft > 0.6 THEN 'ARIMA' ELSE 'ETS' END AS model FROM k"""
