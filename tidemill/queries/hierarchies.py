"""Hierarchy queries: levels, nodes, coherence, envelopes, seasonal profiles, stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import money, rounded
from ..operators import hierarchy as H
from ..operators import resample as R
from ..sources.panels import HIERARCHY, orders_panel, region_monthly, table
from .common import PANEL, REGION, long_count, r4

QUERIES, ORACLES = {}, {}

ROLLED = f"""{PANEL},
rolled AS (
  SELECT CAST(date_trunc('month', ts) AS DATE) AS month, coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name,
         coalesce(c_mktsegment, '*') AS c_mktsegment, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM panel GROUP BY GROUPING SETS ((date_trunc('month', ts), r_name, n_name, c_mktsegment), (date_trunc('month', ts), r_name, n_name), (date_trunc('month', ts), r_name), (date_trunc('month', ts)))),
deep AS (SELECT *, (r_name <> '*')::INT + (n_name <> '*')::INT + (c_mktsegment <> '*')::INT AS depth FROM rolled)"""


def rolled(spark, sf_dir):
    amount = F.col("v").cast("decimal(18,2)")
    leaves = orders_panel(spark, sf_dir).groupBy(*HIERARCHY, F.trunc("ts", "MM").alias("month")).agg(F.sum(amount).alias("v"))
    return H.rollup(leaves, HIERARCHY, "month", {"v": F.sum("v").cast("double")})


def level_sizes(spark, sf_dir):
    return H.level_sizes(rolled(spark, sf_dir), HIERARCHY)


QUERIES["level_sizes"] = level_sizes
ORACLES["level_sizes"] = f"WITH {ROLLED} SELECT depth, {long_count()} AS n_series FROM (SELECT DISTINCT depth, r_name, n_name, c_mktsegment FROM deep) GROUP BY depth"


def node_dimension(spark, sf_dir):
    return H.nodes(rolled(spark, sf_dir), HIERARCHY)


QUERIES["node_dimension"] = node_dimension
ORACLES["node_dimension"] = f"""
WITH {ROLLED}, n AS (SELECT DISTINCT r_name, n_name, c_mktsegment, depth FROM deep)
SELECT r_name, n_name, c_mktsegment, depth,
  CASE depth WHEN 0 THEN 'total' WHEN 1 THEN 'd1__' || r_name WHEN 2 THEN 'd2__' || r_name || '__' || n_name ELSE 'd3__' || r_name || '__' || n_name || '__' || c_mktsegment END AS node_id,
  CASE depth WHEN 0 THEN NULL WHEN 1 THEN 'total' WHEN 2 THEN 'd1__' || r_name ELSE 'd2__' || r_name || '__' || n_name END AS parent_id,
  CASE depth WHEN 0 THEN 'total' WHEN 1 THEN 'r_name' WHEN 2 THEN 'n_name' ELSE 'c_mktsegment' END AS level_name,
  CASE depth WHEN 0 THEN 'total' WHEN 1 THEN r_name WHEN 2 THEN n_name ELSE c_mktsegment END AS label,
  CASE depth WHEN 0 THEN 'total' WHEN 1 THEN r_name WHEN 2 THEN r_name || ' / ' || n_name ELSE r_name || ' / ' || n_name || ' / ' || c_mktsegment END AS display_path
FROM n"""


def coherence(spark, sf_dir):
    got = H.coherence(rolled(spark, sf_dir), HIERARCHY, "month", "v", 1e-3)
    return got.select("depth", "n_checked", rounded(F.col("largest_gap"), 2).alias("largest_gap"), "coherent")


QUERIES["coherence"] = coherence
ORACLES["coherence"] = f"""
WITH {ROLLED},
c AS (SELECT month, depth - 1 AS depth, CASE WHEN depth > 1 THEN r_name ELSE '*' END AS r_name, CASE WHEN depth > 2 THEN n_name ELSE '*' END AS n_name, '*' AS c_mktsegment, sum(v) AS below
      FROM deep WHERE depth > 0 GROUP BY ALL)
SELECT depth, {long_count()} AS n_checked, {r4("max(abs(v - below))", 2)} AS largest_gap, max(abs(v - below)) < 1e-3 AS coherent
FROM deep JOIN c USING (month, depth, r_name, n_name, c_mktsegment) GROUP BY depth"""


def level_effects(spark, sf_dir):
    got = H.level_effects(rolled(spark, sf_dir), HIERARCHY, "v")
    return got.select("depth", rounded(F.col("mean_cv")).alias("mean_cv"), rounded(F.col("mean_variance") / 1e6, 2).alias("mean_variance_m"), "n_series")


QUERIES["level_effects"] = level_effects
ORACLES["level_effects"] = f"""
WITH {ROLLED}, n AS (SELECT depth, stddev_samp(v) AS s, avg(v) AS m, var_samp(v) AS var FROM deep GROUP BY depth, r_name, n_name, c_mktsegment HAVING count(v) > 1)
SELECT depth, {r4("avg(s / (m + 1e-12))")} AS mean_cv, {r4("avg(var) / 1e6", 2)} AS mean_variance_m, {long_count()} AS n_series FROM n GROUP BY depth"""


def weighted_regions(spark, sf_dir):
    """Order value a month weighted by the customer's balance rank class: sum(w v) / sum(w)."""
    panel = orders_panel(spark, sf_dir).select(F.trunc("ts", "MM").alias("ts"), "v", F.length("c_mktsegment").cast("double").alias("w"))
    return H.weighted_mean(panel, "v", "w").select("ts", rounded(F.col("v")).alias("v"))


QUERIES["weighted_mean"] = weighted_regions
ORACLES["weighted_mean"] = f"WITH {PANEL} SELECT CAST(date_trunc('month', ts) AS DATE) AS ts, {r4('sum(v * length(c_mktsegment)) / sum(CAST(length(c_mktsegment) AS DOUBLE))')} AS v FROM panel GROUP BY 1"


def mixed_by_time(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ts"), F.col("l_quantity").cast("decimal(18,2)").alias("quantity"), F.col("l_discount").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("event"))
    got = H.by_time(lines, {"quantity": "sum", "discount": "mean", "event": "max"})
    return got.select("ts", F.col("quantity").cast("double").alias("quantity"), rounded(F.col("discount")).alias("discount"), "event")


QUERIES["mixed_by_time"] = mixed_by_time
ORACLES["mixed_by_time"] = f"""
SELECT CAST(l_shipdate AS DATE) AS ts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, {r4("avg(l_discount)")} AS discount,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS event FROM lineitem GROUP BY 1"""


def leaf_count(spark, sf_dir):
    return H.leaf_count(orders_panel(spark, sf_dir), HIERARCHY)


QUERIES["leaf_count"] = leaf_count
ORACLES["leaf_count"] = f"WITH {PANEL} SELECT {long_count()} AS n_leaves FROM (SELECT DISTINCT r_name, n_name, c_mktsegment FROM panel)"


def level_values(spark, sf_dir):
    return H.level_values(orders_panel(spark, sf_dir), "n_name")


QUERIES["level_values"] = level_values
ORACLES["level_values"] = f"WITH {PANEL} SELECT DISTINCT n_name AS value FROM panel WHERE n_name IS NOT NULL"


def children_of_path(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    return H.children(panel, HIERARCHY, {"r_name": "ASIA"})


QUERIES["children_of_path"] = children_of_path
ORACLES["children_of_path"] = f"WITH {PANEL} SELECT DISTINCT n_name AS value FROM panel WHERE r_name = 'ASIA'"


def hierarchy_tree(spark, sf_dir):
    got = H.tree(orders_panel(spark, sf_dir), HIERARCHY)
    return got.select("r_name", F.to_json("children").alias("children"))


QUERIES["hierarchy_tree"] = hierarchy_tree
ORACLES["hierarchy_tree"] = f"""
WITH {PANEL}, a AS (SELECT r_name, n_name, list_sort(list(DISTINCT c_mktsegment)) AS s FROM panel GROUP BY 1, 2)
SELECT r_name, '[' || string_agg('{{"value":"' || n_name || '","children":["' || array_to_string(s, '","') || '"]}}', ',' ORDER BY n_name) || ']' AS children FROM a GROUP BY 1"""


def node_series(spark, sf_dir):
    """Monthly series of one node; the path predicate is applied before anything is aggregated."""
    node = H.path_filter(orders_panel(spark, sf_dir), {"r_name": "EUROPE", "c_mktsegment": "BUILDING", "absent": 1})
    return R.resample(node, "MS", {"v": "sum"}, exact=True)


QUERIES["node_series"] = node_series
ORACLES["node_series"] = f"""
WITH {PANEL}, a AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS bucket, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel WHERE r_name = 'EUROPE' AND c_mktsegment = 'BUILDING' GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 MONTH)) AS DATE) AS bucket FROM a)
SELECT bucket, coalesce(v, 0.0) AS v FROM g LEFT JOIN a USING (bucket)"""


def series_stats(spark, sf_dir):
    monthly = region_monthly(spark, sf_dir)
    stats = R.series_summary(F.col("v"))
    return monthly.groupBy("r_name").agg(*[(c.cast("long") if n in ("n", "n_missing") else rounded(c)).alias(n) for n, c in stats.items()])


QUERIES["series_stats"] = series_stats
ORACLES["series_stats"] = f"""
WITH {REGION} SELECT r_name, {long_count("v")} AS n, {long_count()} - {long_count("v")} AS n_missing, {r4("avg(v)")} AS mean, {r4("stddev_samp(v)")} AS std,
  {r4("min(v)")} AS min, {r4("max(v)")} AS max, {r4("100 * avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)")} AS pct_zero FROM region_monthly GROUP BY 1"""


def envelope(spark, sf_dir):
    got = H.envelope(region_monthly(spark, sf_dir), "ts", "v")
    return got.select("ts", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "min", "max", "cv")])


QUERIES["envelope"] = envelope
ORACLES["envelope"] = f"""
WITH {REGION} SELECT ts, {long_count("v")} AS n, {r4("avg(v)")} AS mean, {r4("stddev_pop(v)")} AS std, {r4("min(v)")} AS min, {r4("max(v)")} AS max,
  {r4("CASE WHEN abs(avg(v)) >= 5e-5 THEN stddev_pop(v) / (abs(avg(v)) + 1e-12) END")} AS cv FROM region_monthly GROUP BY ts"""

SEASON = {
    "D": ("strftime(ts, '%a')", "isodow(ts) - 1"),
    "W": ("'W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0')", "week(ts)"),
    "M": ("strftime(ts, '%b')", "month(ts)"),
    "Q": ("'Q' || quarter(ts)", "quarter(ts)"),
    "6M": ("CASE WHEN month(ts) <= 6 THEN 'H1' ELSE 'H2' END", "CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END"),
    "Y": ("CAST(year(ts) AS VARCHAR)", "year(ts)"),
    "native": ("strftime(ts, '%Y-%m')", "year(ts) * 12 + month(ts)"),
}
PROFILE = """p AS (SELECT r_name, {label} AS season, CAST({order} AS INT) AS season_order, avg(v) AS m, CASE WHEN count(v) > 1 THEN stddev_pop(v) / (abs(avg(v)) + 1e-12) END AS cv, CAST(count(v) AS BIGINT) AS n FROM base GROUP BY 1, 2, 3)"""


def region_daily(spark, sf_dir):
    return orders_panel(spark, sf_dir).groupBy("r_name", F.col("ts").cast("date").alias("ts")).agg(money(F.col("v")).alias("v"))


_DAILY = f"{PANEL}, base AS (SELECT r_name, CAST(ts AS DATE) AS ts, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2)"

for _interval, (_label, _order) in SEASON.items():

    def _profile(spark, sf_dir, interval=_interval):
        got = H.seasonal_profile(region_daily(spark, sf_dir), ["r_name"], "ts", "v", interval)
        return got.select("r_name", "season", F.col("season_order").cast("int").alias("season_order"), rounded(F.col("mean")).alias("mean"), rounded(F.col("cv")).alias("cv"), "n")

    QUERIES[f"seasonal_profile_{_interval.lower()}"] = _profile
    ORACLES[f"seasonal_profile_{_interval.lower()}"] = f"WITH {_DAILY}, {PROFILE.format(label=_label, order=_order)} SELECT r_name, season, season_order, {r4('m')} AS mean, {r4('cv')} AS cv, n FROM p"


def combined_season(spark, sf_dir):
    got = H.combined_profile(H.seasonal_profile(region_daily(spark, sf_dir), ["r_name"], "ts", "v", "M"))
    return got.select("season", F.col("season_order").cast("int").alias("season_order"), rounded(F.col("mean")).alias("mean"), rounded(F.col("cv")).alias("cv"))


QUERIES["combined_season"] = combined_season
ORACLES["combined_season"] = f"""
WITH {_DAILY}, {PROFILE.format(label=SEASON["M"][0], order=SEASON["M"][1])}
SELECT season, season_order, {r4("avg(m)")} AS mean, {r4("CASE WHEN count(*) > 1 THEN stddev_pop(m) / (abs(avg(m)) + 1e-12) END")} AS cv FROM p GROUP BY 1, 2"""


def stability_stats(spark, sf_dir):
    got = H.stability(region_monthly(spark, sf_dir), ["r_name"], "v")
    return got.select("r_name", "n", "label", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "cv", "min", "max", "range")])


QUERIES["stability_stats"] = stability_stats
ORACLES["stability_stats"] = f"""
WITH {REGION}, s AS (SELECT r_name, count(v) AS n, avg(v) AS m, stddev_pop(v) AS s, stddev_pop(v) / (abs(avg(v)) + 1e-12) AS cv, min(v) AS lo, max(v) AS hi FROM region_monthly GROUP BY 1)
SELECT r_name, CAST(n AS BIGINT) AS n, CASE WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.5 THEN 'moderate' ELSE 'volatile' END AS label,
  {r4("m")} AS mean, {r4("s")} AS std, {r4("cv")} AS cv, {r4("lo")} AS min, {r4("hi")} AS max, {r4("hi - lo")} AS range FROM s WHERE n >= 2"""

YEARS = list(range(1995, 2002))


def yoy_matrix(spark, sf_dir):
    got = H.year_matrix(region_monthly(spark, sf_dir), ["r_name"], "ts", "v", YEARS)
    return got.select("r_name", *[rounded(F.col(str(y)), 2).alias(f"y{y}") for y in YEARS])


QUERIES["yoy_matrix"] = yoy_matrix
ORACLES["yoy_matrix"] = f"WITH {REGION} SELECT r_name, {', '.join(f'{r4(f'sum(v) FILTER (year(ts) = {y})', 2)} AS y{y}' for y in YEARS)} FROM region_monthly GROUP BY 1"


def yoy_stability(spark, sf_dir):
    yearly = orders_panel(spark, sf_dir).groupBy("n_name", F.year("ts").alias("year")).agg(money(F.col("v")).alias("v"))
    return H.yoy_stability(yearly, ["n_name"], "v").select("n_name", rounded(F.col("cv")).alias("cv"), "label")


QUERIES["yoy_stability"] = yoy_stability
ORACLES["yoy_stability"] = f"""
WITH {PANEL}, y AS (SELECT n_name, year(ts) AS y, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2),
c AS (SELECT n_name, stddev_pop(v) / (abs(avg(v)) + 1e-12) AS cv FROM y GROUP BY 1)
SELECT n_name, {r4("cv")} AS cv, CASE WHEN cv < 0.1 THEN 'stable' WHEN cv < 0.3 THEN 'moderate' ELSE 'volatile' END AS label FROM c"""


def yoy_change(spark, sf_dir):
    return H.half_span_change(region_monthly(spark, sf_dir), ["r_name"], "ts", "v").select("r_name", rounded(F.col("half_span_change"), 2).alias("half_span_change"))


QUERIES["yoy_change"] = yoy_change
ORACLES["yoy_change"] = f"""
WITH {REGION}, i AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY ts) AS i, count(*) OVER (PARTITION BY r_name) // 2 AS h FROM region_monthly)
SELECT a.r_name, {r4("100 * avg(a.v / b.v - 1)", 2)} AS half_span_change FROM i a JOIN i b ON a.r_name = b.r_name AND a.i = b.i + b.h WHERE a.h > 0 GROUP BY 1"""


def stability_shown(spark, sf_dir):
    """The display form: the alphabetically first ten nations, as the view caps its series."""
    monthly = orders_panel(spark, sf_dir).groupBy("n_name", F.trunc("ts", "MM").alias("ts")).agg(money(F.col("v")).alias("v"))
    return H.first_series(monthly, "n_name", 10).groupBy("n_name").agg(F.count("*").alias("n"), rounded(F.avg("v")).alias("mean"))


QUERIES["stability_shown"] = stability_shown
ORACLES["stability_shown"] = f"""
WITH {PANEL}, m AS (SELECT n_name, date_trunc('month', ts) AS ts, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2)
SELECT n_name, {long_count()} AS n, {r4("avg(v)")} AS mean FROM m WHERE n_name IN (SELECT DISTINCT n_name FROM m ORDER BY 1 LIMIT 10) GROUP BY 1"""
