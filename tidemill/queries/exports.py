"""Sources and sinks as queries: tables are written in each form, read back and compared with what went out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import date_label, rounded
from ..operators import hierarchy as H
from ..operators import resample as R
from ..sources import files
from ..sources.panels import orders_daily, orders_panel, region_monthly, shipments_daily, table
from ..sources.shared import shared_path
from .common import DAILY, PANEL, REGION, SHIPMENTS, long_count, r4

QUERIES, ORACLES = {}, {}


def csv_round_trip(spark, sf_dir):
    """The customers written as CSV with a header and read with a schema."""
    path = f"{shared_path(spark, 'customers')}.csv"
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    files.write(customers, path, "csv")
    back = files.read(spark, path, ", ".join(f"{n} {t}" for n, t in customers.dtypes))
    return back.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").cast("long").alias("keys"), rounded(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


QUERIES["csv_round_trip"] = csv_round_trip
ORACLES["csv_round_trip"] = f"SELECT c_nationkey, c_mktsegment, {long_count()} AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, {r4('CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE)', 2)} AS balance FROM customer GROUP BY 1, 2"


def csv_inferred(spark, sf_dir):
    """Shipments a day written as CSV and read with inferred types."""
    path = f"{shared_path(spark, 'shipments')}.csv"
    files.write(shipments_daily(spark, sf_dir), path, "csv")
    return files.read(spark, path).select("ts", rounded(F.col("price"), 2).alias("price"), rounded(F.col("discount")).alias("discount"), F.col("event").cast("int").alias("event"))


QUERIES["csv_inferred"] = csv_inferred
ORACLES["csv_inferred"] = f"WITH {SHIPMENTS} SELECT ts, {r4('price', 2)} AS price, {r4('discount')} AS discount, CAST(event AS INT) AS event FROM shipments"


def json_round_trip(spark, sf_dir):
    """Monthly regional values written as JSON records and read back."""
    path = f"{shared_path(spark, 'regions')}.json"
    files.write(region_monthly(spark, sf_dir), path, "json")
    return files.read(spark, path, "r_name string, ts date, v double").select("r_name", "ts", rounded(F.col("v"), 2).alias("v"))


QUERIES["json_round_trip"] = json_round_trip
ORACLES["json_round_trip"] = f"WITH {REGION} SELECT r_name, ts, {r4('v', 2)} AS v FROM region_monthly"


def frame_passes(spark, sf_dir):
    """A DataFrame given as a source is taken as it is."""
    return files.read(spark, table(spark, sf_dir, "supplier")).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").cast("long").alias("last"))


QUERIES["frame_passes"] = frame_passes
ORACLES["frame_passes"] = f"SELECT s_nationkey, {long_count()} AS n, CAST(max(s_suppkey) AS BIGINT) AS last FROM supplier GROUP BY 1"


def bundle_round_trip(spark, sf_dir):
    """Two named tables and a report in one folder, one as CSV and one as JSON; rows and totals read from there."""
    path = shared_path(spark, "bundle")
    files.write_bundle({"daily": orders_daily(spark, sf_dir), "regions": region_monthly(spark, sf_dir)}, path, "order values\nby day and by region", {"regions": "json"})
    daily = spark.read.option("header", True).schema("ts date, v double").csv(f"{path}/daily")
    regions = spark.read.schema("r_name string, ts date, v double").json(f"{path}/regions")
    told = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), rounded(F.sum(F.col("v").cast("decimal(18,2)")).cast("double"), 2).alias("total"))
    lines = spark.read.text(f"{path}/report").agg(F.lit("report").alias("part"), F.count("*").alias("n"), F.lit(0.0).alias("total"))
    return told(daily, "daily").unionByName(told(regions, "regions")).unionByName(lines)


QUERIES["bundle_round_trip"] = bundle_round_trip
_TOTAL = r4("CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE)", 2)
ORACLES["bundle_round_trip"] = f"WITH {REGION}, {DAILY} SELECT 'daily' AS part, {long_count()} AS n, {_TOTAL} AS total FROM daily UNION ALL SELECT 'regions', {long_count()}, {_TOTAL} FROM region_monthly UNION ALL SELECT 'report', CAST(2 AS BIGINT), 0.0::DOUBLE"


def preview_rows(spark, sf_dir):
    """The JSON preview's records: the first 200 monthly values in order of region and time, dates as ISO text."""
    rows = files.preview(region_monthly(spark, sf_dir), 200, ["r_name", "ts"])
    return spark.createDataFrame([(i, r["r_name"], r["ts"], r["v"]) for i, r in enumerate(rows)], "place int, r_name string, ts string, v double").withColumn("v", rounded(F.col("v"), 2))


QUERIES["preview_rows"] = preview_rows
ORACLES["preview_rows"] = f"WITH {REGION}, p AS (SELECT CAST(row_number() OVER (ORDER BY r_name, ts) - 1 AS INT) AS place, * FROM region_monthly) SELECT place, r_name, strftime(ts, '%Y-%m-%d') AS ts, {r4('v', 2)} AS v FROM p WHERE place < 200"


def date_labels(spark, sf_dir):
    """Events by the label of their date."""
    return table(spark, sf_dir, "events").groupBy(date_label(F.col("ts")).alias("label")).agg(F.count("*").alias("n"))


QUERIES["date_labels"] = date_labels
ORACLES["date_labels"] = f"SELECT strftime(ts, '%Y-%m-%d') AS label, {long_count()} AS n FROM events GROUP BY 1"


def quantity_methods(spark, sf_dir):
    """Quarterly order values as a flow (sum), a stock (last) and a rate (mean) of the daily series."""
    daily = orders_daily(spark, sf_dir)
    at = daily.select("ts", *[F.col("v").alias(q) for q in R.AUTO])
    got = R.resample(at, "QS", {q: R.method_for(q) for q in R.AUTO})
    return got.select(F.col("bucket").cast("date").alias("bucket"), *[rounded(F.col(q), 2).alias(q) for q in R.AUTO])


QUERIES["quantity_methods"] = quantity_methods
ORACLES["quantity_methods"] = f"WITH {DAILY} SELECT CAST(date_trunc('quarter', ts) AS DATE) AS bucket, {r4('sum(v)', 2)} AS flow, {r4('arg_max(v, ts)', 2)} AS stock, {r4('avg(v)', 2)} AS rate FROM daily GROUP BY 1"


def resample_if_needed(spark, sf_dir):
    """Monthly values asked for by month pass as they are; by quarter they are added up."""
    at = region_monthly(spark, sf_dir)
    told = lambda freq: R.resample_if_needed(at, freq, {"v": "sum"}, ["r_name"]).select(F.lit(freq).alias("freq"), "r_name", F.col("bucket").cast("date").alias("bucket"), rounded(F.col("v"), 2).alias("v"))
    return told("MS").unionByName(told("QS"))


QUERIES["resample_if_needed"] = resample_if_needed
ORACLES["resample_if_needed"] = f"WITH {REGION} SELECT 'MS' AS freq, r_name, ts AS bucket, {r4('v', 2)} AS v FROM region_monthly UNION ALL SELECT 'QS', r_name, CAST(date_trunc('quarter', ts) AS DATE), {r4('sum(v)', 2)} FROM region_monthly GROUP BY 2, 3"


def node_preview(spark, sf_dir):
    """The first 60 nodes by depth and label, as the reconciliation view lists them."""
    levels = ["r_name", "n_name", "c_mktsegment"]
    at = R.resample(orders_panel(spark, sf_dir), "YS", {"v": "sum"}, levels, dense=False)
    return H.node_preview(H.nodes(H.rollup(at, levels, "bucket", {"v": F.sum("v")}), levels), 60).select("depth", "label", "node_id", "display_path")


QUERIES["node_preview"] = node_preview
ORACLES["node_preview"] = f"""
WITH {PANEL}, n AS (
  SELECT DISTINCT 0 AS depth, 'total' AS label, 'total' AS node_id, 'total' AS display_path FROM panel UNION ALL
  SELECT DISTINCT 1, r_name, 'd1__' || r_name, r_name FROM panel UNION ALL
  SELECT DISTINCT 2, n_name, 'd2__' || r_name || '__' || n_name, r_name || ' / ' || n_name FROM panel UNION ALL
  SELECT DISTINCT 3, c_mktsegment, 'd3__' || r_name || '__' || n_name || '__' || c_mktsegment, r_name || ' / ' || n_name || ' / ' || c_mktsegment FROM panel)
SELECT CAST(depth AS INT) AS depth, label, node_id, display_path FROM n ORDER BY depth, label, node_id LIMIT 60"""
