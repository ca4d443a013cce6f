"""SQL fragments that the catalogue's DuckDB texts share."""

from __future__ import annotations

PANEL = """panel AS (
  SELECT r_name, n_name, c_mktsegment, o_orderdate AS ts, o_totalprice AS v, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1)"

REGION = f"""{PANEL},
region_monthly AS (
  SELECT r_name, CAST(date_trunc('month', ts) AS DATE) AS ts, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS v FROM panel GROUP BY 1, 2)"""

SHIPMENTS = """shipments AS (
  SELECT CAST(l_shipdate AS DATE) AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
         CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS discount,
         CASE WHEN count(*) FILTER (l_returnflag = 'R') > count(*) * 0.4 THEN 1 ELSE 0 END AS event
  FROM lineitem GROUP BY 1)"""

BRANDS = """sold AS (
  SELECT p_brand, CAST(l_shipdate AS DATE) AS ts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
days AS (SELECT p_brand, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM sold GROUP BY p_brand),
demand AS (SELECT p_brand, ts, coalesce(v, 0.0) AS v FROM days LEFT JOIN sold USING (p_brand, ts))"""

READINGS = """hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS ts,
         CAST(sum(CAST(CASE WHEN event_id % 7 = 0 OR (hour(ts) + day(ts)) % 5 = 0 THEN NULL ELSE value END AS DECIMAL(18,4))) AS DOUBLE) AS s,
         count(CASE WHEN event_id % 7 = 0 OR (hour(ts) + day(ts)) % 5 = 0 THEN NULL ELSE value END) AS n
  FROM events GROUP BY 1, 2),
hours AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY event_type),
readings AS (SELECT event_type, ts, CASE WHEN n > 0 THEN s / n END AS v FROM hours LEFT JOIN hourly USING (event_type, ts))"""


#: Both tails of Student's t and the upper tail of chi-squared, summed as power series term by term (v: degrees of freedom).
_BELOW = """(SELECT exp({a} * ln({x}) + {b} * ln({y}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * sum(exp(lgamma({a} + {b} + j) - lgamma({a} + {b}) - lgamma({a} + 1 + j) + lgamma({a} + 1) + j * ln({x}))) FROM generate_series(0, 3000) AS terms(j))"""
_X, _Y = "({v} / ({v} + ({t}) * ({t})))", "(({t}) * ({t}) / ({v} + ({t}) * ({t})))"
T_TAILS = f"(CASE WHEN {_X} < 0.9 THEN {_BELOW.format(a='({v} / 2.0)', b='0.5', x=_X, y=_Y)} ELSE 1 - {_BELOW.format(a='0.5', b='({v} / 2.0)', x=_Y, y=_X)} END)"
CHI2_TAIL = "(1 - (SELECT exp({v} / 2.0 * ln(({x}) / 2.0) - ({x}) / 2.0) * sum(exp(j * ln(({x}) / 2.0) - lgamma({v} / 2.0 + j + 1))) FROM generate_series(0, 2000) AS terms(j)))"


def r4(x: str, digits: int = 4) -> str:
    scale = f"1e{digits}"
    return f"floor(({x}) * {scale} + 0.50001) / {scale}"


def long_count(x: str = "*") -> str:
    return f"CAST(count({x}) AS BIGINT)"
