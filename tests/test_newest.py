"""Newest row per key, averages along hot series, and sets of names: results and plans."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fxspark.functions import calendar as cal
from fxspark.functions.stats import correlation
from fxspark.operators import calendar as oc
from fxspark.operators import indicators as ind
from fxspark.operators import scores as sc
from fxspark.operators import volume as vo

ROWS = [None, -(2**63), 2**63 - 1, 0, 1, -1, 5, 4]


def made():
    r = random.Random(1)
    doubles = [None, 1.0, float("nan"), -0.0, 0.0, float("-inf")]
    return [(r.choice([None, "a", "b", "c"]), r.choice(ROWS), r.choice(ROWS), r.choice(doubles), r.choice([None, True, False]), i) for i in range(400)]


def rank(v):
    return (0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v)


@pytest.mark.parametrize("order", [["a", "b", "i"], ["d", "a", "i"], ["f", "a", "i"], ["i"], ["a", "i", "b"], ["f", "i", "a"]])
def test_newest_row_by_any_order(spark, order):
    data = made()
    df = spark.createDataFrame(data, "k string, a bigint, b bigint, d double, f boolean, i int")
    place = {c: n for n, c in enumerate(df.columns)}
    want, count = {}, {}
    for row in data:
        key = tuple(rank(row[place[c]]) for c in order)
        count[row[0]] = count.get(row[0], 0) + 1
        want[row[0]] = max(want.get(row[0], key), key)
    got = sc.latest_by(df, ["k"], order, [F.count("*").alias("n")]).collect()
    assert {r.k: tuple(rank(r[c]) for c in order) for r in got} == want and {r.k: r.n for r in got} == count and len(got) == len(want)


def test_newest_row_of_times_and_equal_rows(spark):
    data = [("x", "2024-01-02 03:04:05.000006", 1), ("x", "2024-01-02 03:04:05.000007", 0), ("y", "0001-01-01 00:00:00", 5), ("y", None, 9)] + [("z", "9999-12-31 23:59:59", 3)] * 50
    df = spark.createDataFrame(data, "k string, t string, n bigint").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.k: r.n for r in sc.latest_by(df, ["k"], ["t", "n"]).collect()} == {"x": 0, "y": 5, "z": 3}
    assert sc.latest_by(df.limit(0), ["k"], ["t"]).count() == 0


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_newest_row_sorts_only_winners(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    text = plan(sc.latest_by(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]))
    assert "SortAggregate" not in text and "max(_order" in text
    narrow = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert {"o_custkey", "o_orderdate", "o_orderkey"} in narrow  # the search for winners reads the order alone
    events = spark.createDataFrame([("US", "CPI", 1.0, 1)], "country string, event_name string, actual double, row_id bigint").withColumn("event_datetime", F.current_timestamp())
    assert "SortAggregate" not in plan(oc.deduplicate(events, "row_id"))


def test_averages_move_bars_twice_and_need_no_python(spark):
    bars = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_type AS symbol", "'M1' AS timeframe", "ts", "value AS open", "value AS high", "value AS low", "value AS close", "value AS volume")
    s = ind.bar_series(bars).ema({"a": ("close", 5, False), "b": ("close", 50, True), "c": ("close", 12, True)})
    text = plan(s.result())
    assert "Python" not in text and "Arrow" not in text
    by_bucket = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "_part" in x]
    by_series = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "_part" not in x]
    assert len(by_bucket) + len(by_series) <= 4, text  # the bars twice, the table of blocks twice


def test_steep_averages_over_long_buckets(spark):
    """Weights of one bucket span far more than a double: blocks and stretches both have to cut."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    x = 100 + r.normal(size=6000)
    data = [("A", "M1", t.to_pydatetime(), *([float(v)] * 5)) for t, v in zip(pd.date_range("2024-01-01", periods=6000, freq="min"), x)]
    df = spark.createDataFrame(data, "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    out = ind.bar_series(df).ema({f"e{n}_{int(a)}": ("close", n, a) for n in (2, 5, 200) for a in (False, True)}).result().toPandas().sort_values("ts")
    for n in (2, 5, 200):
        for a in (False, True):
            np.testing.assert_allclose(out[f"e{n}_{int(a)}"], pd.Series(x).ewm(span=n, adjust=a).mean(), rtol=1e-11)


def test_names_are_matched_once_and_keep_nulls(spark):
    data = [("Non-Farm Payrolls", "US", "low"), ("Interest Rate Decision", "JP", ""), ("CPI YoY", "DE", None), (None, "US", "High"), ("GDP", None, "Low"), ("Manufacturing PMI", "US", "Low")] * 5
    df = spark.createDataFrame(data, "event_name string, country string, raw string")
    got = sorted(map(str, oc.named(df, impact="raw").select("event_name", "country", "raw", "event_type", "impact").collect()))
    plainly = df.withColumns({"event_type": cal.event_type("event_name", "country"), "impact": cal.impact_level("raw", "country", "event_name")})
    assert got == sorted(map(str, plainly.collect()))
    matching = [node for node in plan(oc.named(df, impact="raw")).split("\n\n") if "Contains(" in node]
    # the patterns stand in one node, which sees distinct names and nothing else
    assert len(matching) == 1 and re.search(r"Input \[2\]: \[event_name#\d+, country#\d+\]", matching[0])


def test_correlation_of_constants_and_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(correlation("a", "b")).first()[0] is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (None, 100.0)], "a double, b double")
    assert abs(df.agg(correlation("a", "b")).first()[0] - df.filter("a IS NOT NULL").corr("a", "b")) < 1e-12


def test_volume_operators_keep_pairs_without_name(spark):
    data = [(s, "M1", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", 5.0, 6.0 + i % 3, 4.0, 5.0 + i % 2, float(i % 7)) for s in ("A", None) for i in range(24 * 12)]
    df = spark.createDataFrame(data, "symbol string, timeframe string, t string, open double, high double, low double, close double, volume double")
    df = df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    for frame in (vo.session_statistics(vo.hourly_totals(df)), vo.atr_volume_correlation(df), vo.session_baselines(df),
                  vo.hourly_anomalies(vo.date_hour_totals(df)), vo.next_volume_forecast(vo.date_hour_totals(df)), vo.daily_anomalies(vo.daily_totals(df))):
        rest = [c for c in frame.columns if c != "pair"]
        tell = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
        rows = {name: sorted(map(tell, frame.filter(where).select(*rest).collect())) for name, where in (("A", "pair = 'A'"), (None, "pair IS NULL"))}
        assert rows["A"] and rows["A"] == rows[None]
