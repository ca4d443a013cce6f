"""Sessions, flows, sources and the streaming form on small panels."""

import numpy as np
import pandas as pd
import pytest

from tidemill.plans import flows
from tidemill.plans.session import Session
from tidemill.sources import files
from tidemill.streaming.windows import accumulate


@pytest.fixture(scope="module")
def panel_rows():
    rng = np.random.default_rng(42)
    rows = []
    for week in pd.date_range("2022-01-02", periods=104, freq="W"):
        for region in ("north", "south"):
            for store in ("s1", "s2"):
                rows.append((str(week.date()), region, store, float(max(0, 100 + 30 * np.sin(week.dayofyear / 58) + rng.normal(0, 8))), int(rng.random() < 0.1)))
    return rows


@pytest.fixture(scope="module")
def session(spark, panel_rows):
    s = Session(spark)
    s.load(spark.createDataFrame(panel_rows, "date string, region string, store string, demand double, promo int"))
    s.confirm({"date": "timestamp", "region": "hierarchy", "store": "hierarchy", "demand": "dependent", "promo": "event"})
    return s


def test_confirm_and_forms(session):
    assert session.panel.freq == "W" and session.panel.keys == ["region", "store"] and session.panel.target == "demand"
    assert session.accumulate("MS").count() == 24
    done = session.impute("linear")
    assert done.count() == 24 and set(done.columns) == {"ts", "demand", "promo"}
    assert session.treat(["iqr", "zscore"]).count() == 24 and session.current is session.forms["treated"]


def test_inferred_roles(spark, panel_rows):
    s = Session(spark)
    s.load(panel := spark.createDataFrame(panel_rows, "date string, region string, store string, demand double, promo int"))
    made = s.confirm()
    assert made.roles.as_dict() == {"date": "timestamp", "demand": "dependent", "promo": "event", "region": "hierarchy", "store": "hierarchy"}
    assert panel.count() == made.df.count()


def test_series_and_node_flows(session):
    made = flows.analyze_series(session.panel, "W", keys=["region"])
    assert made, made.failure
    assert made.get()["components"].select("region").distinct().count() == 2
    assert made.get()["tests"].filter("test = 'adf'").count() == 2
    node = flows.analyze_node(session.panel, {"region": "north"}, "MS")
    assert node and node.get()["leaves"].first().n_leaves == 2


def test_rollup_stability_and_features(session):
    rolled = flows.rollup_hierarchy(session.panel)
    assert rolled and rolled.get()["nodes"].count() == 7 and rolled.get()["coherence"].filter("not coherent").count() == 0
    stable = flows.level_stability(session.panel, "store", {"region": "south"})
    assert stable and stable.get()["stability"].count() == 2
    made = flows.prepare_features(session.panel, "W", 4, lags=(1, 2), rolling=(3,))
    assert made and made.get()["future"].count() == 4 and made.get()["matrix"].count() > 90
    row = made.get()["matrix"].first()
    assert row.intermittency_class == "Smooth" and row.has_exogenous and 0 <= row.seasonal_strength_Fs <= 1 and row.model_type_recommendation not in ("ETS", "ARIMA", "SARIMA")
    by_store = flows.prepare_features(session.panel, "MS", 2, transform="auto", keys=["store"], lags=(1,), rolling=())
    assert by_store, by_store.failure
    assert {(r.series_id, r.hier_store) for r in by_store.get()["matrix"].collect()} == {("s1", "s1"), ("s2", "s2")}


def test_relations_of_a_panel(session):
    made = flows.relate(session.panel, "W")
    assert made, made.failure
    told = made.get()
    assert made.facts["events"] == ["promo"] and told["gains"].count() == 0
    assert {(r.variable, r.role) for r in told["variables"].collect()} == {("demand", "dependent"), ("promo", "event")}
    assert told["correlations"].count() == 4 and told["ccf"].groupBy("variable").count().first()["count"] == 41
    assert told["impacts"].first().n_on > 0 and told["recommendations"].first().kind == "event"


def test_forecast_and_reconciliation_flows(session):
    made = flows.prepare_forecast(session.panel, "MS", 3, holdout=6, models=["ETS", "LinearRegression"])
    assert made, made.failure
    assert {"components", "profile", "features", "future"} <= set(made.get()) and made.get()["profile"].count() == 1
    assert made.get()["forecast"].count() == 3 and made.get()["forecast"].filter("lower_95 > forecast or upper_95 < forecast").count() == 0
    both = flows.reconciled_forecast(session.panel, "MS", 2)
    assert both, both.failure
    total = {(r.region, r.store, r.step): r.forecast for r in both.get()["reconciled"].collect()}
    assert total[("*", "*", 1)] == pytest.approx(sum(v for (r, s, k), v in total.items() if s != "*" and k == 1))


def test_failures_become_results(session):
    made = flows.reconciled_forecast(session.panel, "MS", 2, "sideways")
    assert not made and "sideways" in str(made.failure) and made.planning_seconds >= 0
    with pytest.raises(ValueError):
        made.get()


def test_pipeline(spark, panel_rows):
    made = flows.run_pipeline(Session(spark), spark.createDataFrame(panel_rows, "date string, region string, store string, demand double, promo int"), freq="MS")
    assert made, made.failure
    assert made.facts["freq"] == "MS" and "demand: analysed" in made.facts["report"]


def test_sources_and_sinks(spark, tmp_path):
    text = "date,v,name\n2024-01-01,1.5,a\n2024-01-02,x,b\n"
    assert [r.name for r in files.read(spark, text).collect()] == ["a", "b"]
    assert files.read(spark, text.replace("x", "2")).schema["v"].dataType.simpleString() == "double"
    quoted = files.read(spark, '"a, b",`c`\n"x, y",2\n')
    assert quoted.columns == ["a, b", "`c`"] and quoted.first()[0] == "x, y" and quoted.first()[1] == 2.0
    assert files.read(spark, {"a": 1}).count() == 1 and files.read(spark, [{"a": 1}, {"a": 2}]).count() == 2
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k int, v double")
    for form in ("csv", "json", "parquet"):
        files.write(df, f"{tmp_path}/out.{form}", form)
        assert files.read(spark, f"{tmp_path}/out.{form}").count() == 2
    assert files.preview(df, 5, ["k"]) == [{"k": 1, "v": None}, {"k": 2, "v": 2.0}]
    files.write_bundle({"one": df, "two": df}, f"{tmp_path}/bundle", "two lines\nof text", {"two": "json"})
    assert spark.read.text(f"{tmp_path}/bundle/report").count() == 2
    with pytest.raises(ValueError):
        files.read(spark, "name.doc")


def test_stream_accumulates_weeks(spark, tmp_path):
    ts = pd.date_range("2024-01-03", periods=30, freq="D")
    df = spark.createDataFrame([(t.to_pydatetime(), float(i)) for i, t in enumerate(ts)], "ts timestamp, v double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = accumulate(stream, "W", late="1 day").writeStream.format("memory").queryName("weeks").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {r.bucket.date().isoformat(): r["sum"] for r in spark.sql("select * from weeks").collect()}
    assert got["2023-12-31"] == 0 + 1 + 2 + 3 and sum(got.values()) == sum(range(30))


def test_two_week_bins_agree_with_the_batch_form(spark):
    from datetime import date

    from tidemill.operators.resample import resample

    ts = pd.date_range("2024-01-10", periods=40, freq="D")
    df = spark.createDataFrame([(t.to_pydatetime(), float(i)) for i, t in enumerate(ts)], "ts timestamp, v double")
    with pytest.raises(ValueError):
        accumulate(df, "2W")
    streamed = {r.bucket.date(): r["sum"] for r in accumulate(df, "2W", origin=date(2024, 1, 10)).collect()}
    assert streamed == {r.bucket: r.v for r in resample(df, "2W", {"v": "sum"}).collect()}


def test_parameter_suggestions():
    from tidemill.plans.parameters import folds, suggest

    assert folds(10, 12) == 2 and folds(1000, 12) == 5 and folds(130, 12) == 3
    made = suggest(120, 12, 12, 1, 0.7, 0.8)
    assert made["arima"]["order"] == (1, 1, 1) and made["ets"]["seasonal"] == "mul" and suggest(10, 3, 12)["ets"]["seasonal"] is None
