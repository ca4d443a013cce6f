"""Windows over ranges of time equal windows over whole series, for any number of ranges and blocks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators import crossvar, schema
from tidemill.operators.ranges import Cut, cut, positions, with_windows


def frame(spark, n=1500, keys="ab"):
    rng = random.Random(n)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice([*keys, None]), start + datetime.timedelta(seconds=37 * i + 7919 * i % 31), float(rng.randrange(100)), rng.random(), int(rng.random() < 0.2)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, x double, e int")


def same(a, b):
    found, other = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()] for df in (a, b))
    assert sorted(map(str, found)) == sorted(map(str, other)) and found


def test_positions_over_ranges(spark):
    df = frame(spark)
    at = cut(df, "ts", ranges=50)
    assert len(at.bounds) == 49 and at.facts["n"] == 1500
    for keys in ([], ["k"]):
        order = W.partitionBy(*keys, F.lit(1)).orderBy("ts")
        wrong = positions(df, keys, "ts", at).withColumn("_j", F.row_number().over(order) - 1).filter("_i <> _j")
        assert wrong.count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_windows_with_a_halo_equal_whole_windows(spark, keys):
    df = frame(spark)
    make = lambda o: {"a": F.lag("v", 3).over(o), "b": F.lead("x", 40).over(o), "c": F.avg("v").over(o.rowsBetween(-25, 10)), "v": F.max("v").over(o.rowsBetween(-2, 0))}
    whole = with_windows(df, keys, "ts", make, 25, 40)
    assert whole.columns == [c for c in df.columns if c != "v"] + ["v", "a", "b", "c"] or set(whole.columns) == {*df.columns, "a", "b", "c"}
    for ranges, block in ((50, 30), (2, 1000), (7, 3)):
        same(whole.select(sorted(whole.columns)), with_windows(df, keys, "ts", make, 25, 40, cut(df, "ts", ranges, block)).select(sorted(whole.columns)))


def test_ties_nulls_and_empty_tables(spark):
    df = frame(spark, 300)
    tied = df.withColumn("ts", F.date_trunc("hour", "ts")).withColumn("id", F.xxhash64("x")).unionByName(df.withColumn("id", F.xxhash64("x")).withColumn("ts", F.lit(None).cast("timestamp_ntz")).filter("v < 20"))
    make = lambda o: {"a": F.lag("id").over(o)}
    same(with_windows(tied, [], "ts", make, 1, ties=["id"]), with_windows(tied, [], "ts", make, 1, at=cut(tied, "ts", 20, 10), ties=["id"]))
    none = df.filter("false")
    assert cut(none, "ts").bounds == () and with_windows(none, ["k"], "ts", make=lambda o: {"a": F.lag("v").over(o)}, back=1, at=cut(none, "ts", 5)).count() == 0


def test_relations_over_fifty_ranges_equal_one(spark):
    df = frame(spark, 800)
    fifty = cut(df, "ts", 50, 13)
    assert len(fifty.bounds) == 49
    for keys in ([], ["k"]):
        same(crossvar.ccf(df, "x", "v", keys, at=Cut()), crossvar.ccf(df, "x", "v", keys, at=fifty))
    same(crossvar.lagged_gain(df, "v", "x", at=Cut()), crossvar.lagged_gain(df, "v", "x", at=fifty))
    same(crossvar.event_impact(df, "v", "e", at=Cut()), crossvar.event_impact(df, "v", "e", at=fifty))
    texts = df.select(F.date_format("ts", "dd/MM/yyyy").alias("told"))
    choices = {"month_first": schema.PATTERNS, "day_first": schema.DAY_FIRST}
    same(schema.parse_scores(texts, "told", choices), schema.parse_scores(texts, "told", choices, ranges=20))


def test_carried_values_and_relations_over_ranges(spark):
    df = frame(spark, 400).withColumn("x", F.when(F.rand(3) < 0.3, F.col("x"))).cache()
    got = crossvar.with_carried(df, ["x"], "ts", cut(df, "ts", 40)).orderBy("ts").collect()
    last, expect = 0.0, []
    for r in df.orderBy("ts").collect():
        last = last if r.x is None else r.x
        expect.append(last)
    assert [r.x for r in got] == expect
    told = crossvar.relations(df, "v", ["x"], ["e"])
    assert told["ccf"].count() == 82 and told["best"].count() == 2 and told["gains"].count() == 8 and told["impacts"].count() == 1
    filled = df.fillna(0.0, ["x"])
    same(told["ccf"].filter("variable = 'x'").drop("variable"), crossvar.ccf(filled, "x", "v"))
    none = crossvar.relations(df.filter("false"), "v", ["x"], [])
    assert none["recommendations"].count() <= 1


def test_ccf_of_a_constant_is_null(spark):
    df = frame(spark, 60).withColumn("x", F.lit(3.0))
    assert {r.ccf for r in crossvar.ccf(df, "x", "v").collect()} == {None}


def plain_croston(values, start=None, alpha=0.1, beta=0.1):
    """(size, interval, demands) of Croston, (size, probability) of TSB, row by row."""
    z = p = gap = k = 0
    for v in values:
        gap += 1
        if v > 0:
            z, p = (v, start or max(1, gap)) if k == 0 else (z + alpha * (v - z), p + alpha * (gap - p))
            k, gap = k + 1, 0
    hits = [v for v in values if v > 0]
    size, share = (hits[0] if hits else 0.0), len(hits) / max(1, len(values))
    for v in values:
        size = size + alpha * (v - size) if v > 0 else size
        share += beta * ((v > 0) - share)
    return z, p, k, size, share


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_croston_family_over_ranges(spark, ranges):
    from tidemill.operators import intermittency

    rng = random.Random(3)
    series = {"a": [rng.choice([0, 0, 0, 2, 5]) for _ in range(300)], "b": [0] * 40, "c": [0, 0, 3], "d": [4], "e": [0] * 150 + [1, 0, 0, 7] + [0] * 100, None: [1.5] * 30}
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(hours=i), float(v)) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    at = cut(df, "ts", ranges)
    assert len(at.bounds) == ranges - 1
    one = {r.k: r.forecast for r in intermittency.croston_forecast(df, ["k"], at=at).collect()}
    made = {m: {r.k: r.forecast for r in intermittency.family_forecast(df, ["k"], m, 1, at=at).collect()} for m in ("croston", "sba", "tsb")}
    for k, values in series.items():
        z, p, hits, size, share = plain_croston(values)
        assert made["croston"][k] == pytest.approx(z / p if hits else 0) and made["sba"][k] == pytest.approx(0.95 * z / p if hits else 0)
        assert made["tsb"][k] == pytest.approx(size * share)
        z, p, hits, *_ = plain_croston(values, start=1.0)
        assert one[k] == (pytest.approx(z / p) if hits >= 2 else None)
