"""Panels over the star-schema tables: explicit keys, a timestamp and value columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HIERARCHY = ["r_name", "n_name", "c_mktsegment"]


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their region, nation and segment: (r_name, n_name, c_mktsegment, ts, v, o_orderkey).

    The nation and region tables have a fixed number of rows; the join with customers is left to the optimiser.
    """
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(*HIERARCHY, F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"), "o_orderkey")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series of order value: (ts, v)."""
    from ..functions.scalars import money

    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("ts")).agg(money(F.col("o_totalprice")).alias("v"))


def region_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value of each region: (r_name, ts, v), exact to the cent."""
    from ..functions.scalars import money

    panel = orders_panel(spark, sf_dir)
    return panel.groupBy("r_name", F.trunc("ts", "MM").alias("ts")).agg(money(F.col("v")).alias("v"))


def shipments_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipments: (ts, price, discount, returned): dependent sum, independent mean, 0/1 event."""
    from ..functions.scalars import money

    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("ts")).agg(
        money(F.col("l_extendedprice")).alias("price"),
        (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("discount"),
        F.when(F.count_if(F.col("l_returnflag") == "R") > F.count("*") * 0.4, 1).otherwise(0).alias("event"),
    )


def brand_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity of each brand on the dense grid of its days: (p_brand, ts, v), zero where nothing shipped."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ts"))
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "ts").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("v"))
    span = sold.groupBy("p_brand").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("p_brand", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("ts"))
    return grid.join(sold, ["p_brand", "ts"], "left").select("p_brand", "ts", F.coalesce("v", F.lit(0.0)).alias("v"))


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean reading of each event type with gaps: every seventh event and a fifth of the hours are null."""
    events = table(spark, sf_dir, "events")
    gap = (F.col("event_id") % 7 == 0) | ((F.hour("ts") + F.dayofmonth("ts")) % 5 == 0)
    value = F.when(~gap, F.col("value"))
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    hourly = events.groupBy("event_type", hour.alias("ts")).agg(F.sum(value.cast("decimal(18,4)")).alias("s"), F.count(value).alias("n"))
    return hourly.select("event_type", "ts", F.when(F.col("n") > 0, (F.col("s").cast("double") / F.col("n"))).alias("v"))
