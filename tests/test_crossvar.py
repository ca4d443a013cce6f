"""Relations of columns that never change, against the DuckDB text of the queries."""

import datetime
import math

import pytest

from tidemill.operators import crossvar
from tidemill.queries import ORACLES, QUERIES
from tidemill.sources.panels import shipments_daily

duckdb = pytest.importorskip("duckdb")


def lines(spark, folder, days=60, flags="NA", price=lambda i: 10.0 + i * i % 17, discount=lambda i: i * 7 % 11 / 100):
    """``lineitem`` of two rows a day. Without flag R no day is an event, with no other flag all days are."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=i), float(price(i + j)), float(discount(i + j)), flags[(i + j) % len(flags)]) for i in range(days) for j in (0, 1)]
    df = spark.createDataFrame(rows, "l_shipdate timestamp_ntz, l_extendedprice double, l_discount double, l_returnflag string")
    df.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def both(spark, folder, name):
    """(Spark's rows, SQL's rows) as sorted texts: NaN and null differ. One thread, so that SQL takes up rows in order."""
    with duckdb.connect(config={"threads": 1}) as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        wanted = con.sql(ORACLES[name]).fetchall()
    return sorted(map(str, map(tuple, QUERIES[name](spark, folder).collect()))), sorted(map(str, wanted))


@pytest.mark.parametrize("days, flags", [(60, "NA"), (60, "R"), (60, "RNNA"), (1, "NA"), (0, "NA")])
def test_correlations_equal_sql(spark, tmp_path, days, flags):
    found, wanted = both(spark, lines(spark, tmp_path, days, flags), "corr_matrix")
    assert found == wanted and len(found) == 9


def test_correlations_without_a_spread_or_rows(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (2.0, 3.0, None), (4.0, None, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r["corr"] for r in crossvar.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "a"] == pytest.approx(1) and math.isnan(got["a", "b"]) and math.isnan(got["b", "b"]) and math.isnan(got["c", "a"])
    assert got["b", "c"] is None and got["c", "b"] is None


@pytest.mark.parametrize("flags", ["NA", "R", "RNNA"])
def test_relations_without_or_with_events_equal_sql(spark, tmp_path, flags):
    found, wanted = both(spark, lines(spark, tmp_path, 90, flags), "relations")
    assert found == wanted and len(found) == 2


@pytest.mark.parametrize("steady", [{"discount": lambda i: 0}, {"price": lambda i: 8}])
@pytest.mark.parametrize("name", ["relations", "granger_proxy", "event_impact", "feature_recommendations"])
def test_relations_of_a_steady_driver_or_price_equal_sql(spark, tmp_path, steady, name):
    found, wanted = both(spark, lines(spark, tmp_path, 90, "RNNAN", **steady), name)
    assert found == wanted


def test_gains_of_a_steady_driver_are_not_useful(spark, tmp_path):
    got = crossvar.lagged_gain(shipments_daily(spark, lines(spark, tmp_path, discount=lambda i: 0)), "price", "discount").collect()
    assert len(got) == 8 and all(math.isnan(r.gain) and not r.useful for r in got)
