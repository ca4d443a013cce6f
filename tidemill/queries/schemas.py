"""Schema inference, coercion, streaming-form and flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import schema as S
from ..plans.flows import level_stability, prepare_forecast, reconciled_forecast, rollup_hierarchy
from ..plans.session import Session
from ..sources.files import sanitised
from ..sources.panels import orders_panel, table
from ..streaming.windows import accumulate
from .forecasting import _DOWN as DOWN
from .forecasting import BASE, automatic_sql
from .common import PANEL, long_count, r4

QUERIES, ORACLES = {}, {}


def profile_orders(spark, sf_dir):
    """Column profile of orders: one aggregation for all columns."""
    return S.profile(table(spark, sf_dir, "orders")).select("column", "n", "n_missing", "n_distinct", "is_event", "is_hierarchy")


COLUMNS = {"o_orderkey": 0, "o_custkey": 0, "o_orderstatus": 1, "o_totalprice": 0, "o_orderdate": 0, "o_orderpriority": 1}
QUERIES["profile_columns"] = profile_orders
ORACLES["profile_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column, {long_count(c)} AS n, {long_count()} - {long_count(c)} AS n_missing, {long_count(f'DISTINCT {c}')} AS n_distinct, false AS is_event, " + (f"count(DISTINCT {c}) <= greatest(2, ceil(count({c}) * 0.3)) AND count(DISTINCT {c}) < count({c})" if text else "false") + " AS is_hierarchy FROM orders"
    for c, text in COLUMNS.items()
)


def detect_events(spark, sf_dir):
    """Event columns of the labels table."""
    return S.profile(table(spark, sf_dir, "labels"), exact=False).select("column", "is_event")


QUERIES["detect_events"] = detect_events
ORACLES["detect_events"] = " UNION ALL ".join(f"SELECT '{c}' AS column, bool_and({c} IN (0, 1)) AND max({c}) = 1 AS is_event FROM labels" for c in ("doc_id", "quality", "toxic"))


def detect_hierarchy(spark, sf_dir):
    return S.profile(orders_panel(spark, sf_dir)).filter("is_hierarchy").select("column", "n_distinct")


QUERIES["detect_hierarchy"] = detect_hierarchy
ORACLES["detect_hierarchy"] = f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column, {long_count(f'DISTINCT {c}')} AS n_distinct FROM panel" for c in ("r_name", "n_name", "c_mktsegment"))


def suggested_roles(spark, sf_dir):
    """Roles inferred from the order panel's columns."""
    roles = S.infer_roles(orders_panel(spark, sf_dir).drop("o_orderkey")).as_dict()
    seen = S.profile(orders_panel(spark, sf_dir).drop("o_orderkey"))
    return seen.select("column", F.create_map(*[x for c, r in roles.items() for x in (F.lit(c), F.lit(r))])[F.col("column")].alias("role"))


QUERIES["suggested_roles"] = suggested_roles
ORACLES["suggested_roles"] = "SELECT * FROM (VALUES ('r_name', 'hierarchy'), ('n_name', 'hierarchy'), ('c_mktsegment', 'hierarchy'), ('ts', 'timestamp'), ('v', 'dependent')) AS t(\"column\", role)"


def schema_report(spark, sf_dir):
    got = S.report(orders_panel(spark, sf_dir), "ts", ["v"], ["r_name", "n_name", "c_mktsegment"])
    return got


QUERIES["schema_report"] = schema_report
ORACLES["schema_report"] = f"""
WITH {PANEL} SELECT {long_count()} AS n_rows, CAST(count(DISTINCT r_name) * count(DISTINCT n_name) * count(DISTINCT c_mktsegment) AS BIGINT) AS n_series, min(ts) AS first, max(ts) AS last,
  {long_count("DISTINCT ts")} AS n_timestamps, 'D' AS freq FROM panel"""


def parse_dates(spark, sf_dir):
    """Day-first texts made of the order dates, parsed back by the competition of patterns."""
    at = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("told"))
    return S.parse_dates(at, "told", "ts").select("o_orderkey", "ts")


QUERIES["parse_dates"] = parse_dates
ORACLES["parse_dates"] = "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders"


def coerce_values(spark, sf_dir):
    """Texts that are numbers in nine rows of ten: what isn't becomes zero."""
    told = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 10 == 5, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    at = table(spark, sf_dir, "orders").select("o_orderkey", told.alias("v"))
    return S.coerce(at, ["v"])[0]


def coerce_report(spark, sf_dir):
    told = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 7 == 5, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    return S.coerce(table(spark, sf_dir, "orders").select("o_orderkey", told.alias("v")), ["v"])[1]


def clean_values(spark, sf_dir):
    """NaN and infinite values as null."""
    x = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return sanitised(table(spark, sf_dir, "events").select("event_id", x.alias("value")))


QUERIES |= {"coerce_values": coerce_values, "coerce_report": coerce_report, "sanitise": clean_values}
ORACLES["coerce_values"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (0, 5) THEN 0.0 ELSE o_totalprice END AS v FROM orders"
ORACLES["coerce_report"] = f"SELECT 'v' AS column, {long_count()} FILTER (o_orderkey % 10 = 0) AS n_bad, {long_count()} FILTER (o_orderkey % 10 <> 0 AND o_orderkey % 7 = 5) AS n_missing FROM orders".replace("CAST(count(*) AS BIGINT) FILTER", "count(*) FILTER")
ORACLES["sanitise"] = "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value FROM events"


def event_windows(spark, sf_dir):
    """Sunday weeks of each event type in the streaming form, run over the table."""
    at = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,4)").alias("v"))
    got = accumulate(at, "W", ["event_type"])
    return got.select("event_type", F.col("bucket").cast("date").alias("bucket"), rounded(F.col("sum").cast("double"), 2).alias("sum"), "n", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


QUERIES["stream_week"] = event_windows
ORACLES["stream_week"] = f"""
SELECT event_type, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS bucket, {r4("CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE)", 2)} AS sum, {long_count("value")} AS n,
       CAST(min(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS min, CAST(max(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS max FROM events GROUP BY 1, 2"""

ROLES = {"ts": "timestamp", "r_name": "hierarchy", "n_name": "hierarchy", "c_mktsegment": "hierarchy", "v": "dependent"}


def _panel(spark, sf_dir):
    session = Session(spark, raw=orders_panel(spark, sf_dir).drop("o_orderkey"))
    return session.confirm(ROLES)


def flow_rollup(spark, sf_dir):
    """The roll-up flow on a confirmed session panel: node values a quarter."""
    made = rollup_hierarchy(_panel(spark, sf_dir), "QS")
    return made.get("values").select("bucket", "r_name", "n_name", "c_mktsegment", rounded(F.col("v"), 2).alias("v"))


QUERIES["flow_rollup"] = flow_rollup
ORACLES["flow_rollup"] = f"""
WITH {PANEL} SELECT CAST(date_trunc('quarter', ts) AS DATE) AS bucket, coalesce(r_name, '*') AS r_name, coalesce(n_name, '*') AS n_name, coalesce(c_mktsegment, '*') AS c_mktsegment, {r4("sum(v)", 2)} AS v
FROM panel GROUP BY GROUPING SETS ((date_trunc('quarter', ts), r_name, n_name, c_mktsegment), (date_trunc('quarter', ts), r_name, n_name), (date_trunc('quarter', ts), r_name), (date_trunc('quarter', ts)))"""


def flow_stability(spark, sf_dir):
    """The level-stability flow for the nations of a region."""
    made = level_stability(_panel(spark, sf_dir), "n_name", {"r_name": "EUROPE"}, most=None)
    return made.get("stability").select("n_name", "n", "label", rounded(F.col("mean"), 2).alias("mean"), rounded(F.col("cv")).alias("cv"))


QUERIES["flow_stability"] = flow_stability
ORACLES["flow_stability"] = f"""
WITH {PANEL}, a AS (SELECT n_name, CAST(date_trunc('month', ts) AS DATE) AS b, sum(v) AS v FROM panel WHERE r_name = 'EUROPE' GROUP BY 1, 2),
g AS (SELECT n_name, CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 MONTH)) AS DATE) AS b FROM a GROUP BY 1), d AS (SELECT n_name, coalesce(v, 0.0) AS v FROM g LEFT JOIN a USING (n_name, b)),
s AS (SELECT n_name, {long_count("v")} AS n, avg(v) AS m, stddev_pop(v) / (abs(avg(v)) + 1e-12) AS cv FROM d GROUP BY 1)
SELECT n_name, n, CASE WHEN cv < 0.2 THEN 'stable' WHEN cv < 0.5 THEN 'moderate' ELSE 'volatile' END AS label, {r4("m", 2)} AS mean, {r4("cv")} AS cv FROM s WHERE n >= 2"""


def flow_forecast(spark, sf_dir):
    """The forecast flow for every region: cleaned, fitted, combined, chosen, with intervals."""
    made = prepare_forecast(_panel(spark, sf_dir), "MS", 6, keys=["r_name"])
    return made.get("forecast")


def flow_reconcile(spark, sf_dir):
    """The reconciliation flow, middle out from the regions."""
    made = reconciled_forecast(_panel(spark, sf_dir), "MS", 3, "middle_out", 1)
    return made.get("reconciled").select("r_name", "n_name", "c_mktsegment", "step", rounded(F.col("forecast"), 2).alias("forecast"))


QUERIES |= {"flow_forecast": flow_forecast, "flow_reconcile": flow_reconcile}
ORACLES["flow_reconcile"] = f"""
WITH RECURSIVE {BASE},
months AS (SELECT r_name, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS ts FROM deep WHERE depth = 1 GROUP BY 1),
demand AS (SELECT months.r_name AS k, months.ts, coalesce(v, 0.0) AS v FROM months LEFT JOIN deep ON deep.depth = 1 AND deep.r_name = months.r_name AND deep.month = months.ts), {automatic_sql(3, 12)},
d1 AS (SELECT k AS r_name, '*' AS n_name, '*' AS c_mktsegment, step, greatest(forecast, 0.0) AS forecast FROM auto), d0 AS (SELECT '*' AS r_name, '*' AS n_name, '*' AS c_mktsegment, step, sum(forecast) AS forecast FROM d1 GROUP BY step), {DOWN}
SELECT r_name, n_name, c_mktsegment, step, {r4("forecast", 2)} AS forecast FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""
