"""Alignment queries: exogenous and event columns on a target's time axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import money, rounded
from ..operators import align as A
from ..sources.panels import orders_daily, shipments_daily, table
from .common import DAILY, SHIPMENTS, r4

QUERIES, ORACLES = {}, {}
BOTH = f"WITH {DAILY}, {SHIPMENTS}"


def _sparse(spark, sf_dir):
    """Daily shipments, whose days differ from the orders' by nature; values are null on two days of three."""
    told = F.dayofyear("ts") % 3 == 0
    return shipments_daily(spark, sf_dir).select("ts", *[F.when(told, F.col(c)).alias(c) for c in ("price", "discount", "event")])


SPARSE = "sparse AS (SELECT ts, " + ", ".join(f"CASE WHEN dayofyear(ts) % 3 = 0 THEN {c} END AS {c}" for c in ("price", "discount", "event")) + " FROM shipments)"


def align_null(spark, sf_dir):
    return A.onto(orders_daily(spark, sf_dir), _sparse(spark, sf_dir), ["discount"]).select("ts", "v", rounded(F.col("discount")).alias("discount"))


def align_zero(spark, sf_dir):
    return A.onto(orders_daily(spark, sf_dir), _sparse(spark, sf_dir), ["event"], fill="zero").select("ts", "v", "event")


def align_carry(spark, sf_dir):
    return A.onto(orders_daily(spark, sf_dir), _sparse(spark, sf_dir), ["discount"], fill="carry").select("ts", rounded(F.col("discount")).alias("discount"))


def align_inner(spark, sf_dir):
    return A.together(orders_daily(spark, sf_dir), _sparse(spark, sf_dir).select("ts", "price", "event"))


def align_outer(spark, sf_dir):
    return A.both(orders_daily(spark, sf_dir), _sparse(spark, sf_dir).select("ts", "price"))


def align_semi(spark, sf_dir):
    return A.within(orders_daily(spark, sf_dir), _sparse(spark, sf_dir))


def union_dates(spark, sf_dir):
    return A.union_times([orders_daily(spark, sf_dir), _sparse(spark, sf_dir)])


SHIFT, HOURS = 8217, 30


def align_asof(spark, sf_dir):
    """The last day's orders at or before each event, by group of customers and users, if not over 30 hours ago. Order
    days are shifted so that the last ones lie in the month of the events."""
    days = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).cast("long").alias("k"), F.date_add(F.col("o_orderdate").cast("date"), SHIFT).alias("ts")).agg(money(F.col("o_totalprice")).alias("spent"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("long").alias("k"), "ts", "event_id")
    return A.asof(events, days, ["spent"], ["k"], tolerance=HOURS * 3600).select("event_id", "k", "spent")


QUERIES["align_asof"] = align_asof
ORACLES["align_asof"] = f"""
WITH days AS (SELECT o_custkey % 5 AS k, CAST(o_orderdate AS DATE) + {SHIFT} AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1, 2),
seen AS (SELECT event_id, user_id % 5 AS k, e.ts, CAST(d.day AS TIMESTAMP) AS day, spent FROM events e ASOF LEFT JOIN days d ON e.user_id % 5 = d.k AND e.ts >= CAST(d.day AS TIMESTAMP))
SELECT event_id, k, CASE WHEN ts - day <= INTERVAL {HOURS} HOUR THEN spent END AS spent FROM seen"""

QUERIES |= {"align_null": align_null, "align_zero": align_zero, "align_carry": align_carry, "align_inner": align_inner, "align_outer": align_outer, "align_semi": align_semi, "union_dates": union_dates}
ORACLES |= {
    "align_null": f"{BOTH}, {SPARSE} SELECT ts, v, {r4('discount')} AS discount FROM daily LEFT JOIN sparse USING (ts)",
    "align_zero": f"{BOTH}, {SPARSE} SELECT ts, v, coalesce(event, 0) AS event FROM daily LEFT JOIN sparse USING (ts)",
    "align_carry": f"""{BOTH}, {SPARSE}, j AS (SELECT ts, discount FROM daily LEFT JOIN sparse USING (ts))
SELECT ts, {r4("coalesce(last_value(discount IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(discount IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0)")} AS discount FROM j""",
    "align_inner": f"{BOTH}, {SPARSE} SELECT ts, v, price, event FROM daily JOIN sparse USING (ts) WHERE price IS NOT NULL AND v IS NOT NULL",
    "align_outer": f"{BOTH}, {SPARSE} SELECT ts, v, price FROM daily FULL JOIN sparse USING (ts)",
    "align_semi": f"{BOTH}, {SPARSE} SELECT ts, v FROM daily WHERE ts IN (SELECT ts FROM sparse)",
    "union_dates": f"{BOTH}, {SPARSE} SELECT ts FROM daily UNION SELECT ts FROM sparse",
}
