"""NULL keys and values, ties, short series, both paths of what depends on size, and runs that go on."""

import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fxspark.functions import stats as st
from fxspark.operators import indicators as ind
from fxspark.operators import models as md
from fxspark.operators import regime as rg
from fxspark.operators import scores as sc
from fxspark.operators import series as sr
from fxspark.operators import validation as va
from fxspark.operators import vectors as ve
from fxspark.operators.quantiles import group_quantiles
from fxspark.session import work_dir
from fxspark.sources import readers as rd
from fxspark.streaming import jobs

SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def gaps():
    r = np.random.default_rng(5)
    rows = []
    for symbol, n in (("A", 120), (None, 60), ("B", 3)):
        for i, t in enumerate(pd.date_range("2024-01-01", periods=n, freq="3h")):
            x = None if r.random() < 0.25 or i in range(40, 75) or (symbol == "A" and i < 2) else float(100 + r.normal())
            rows.append((symbol, "M1", t.to_pydatetime(), x, x, x, x, x))
    return rows


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(sr, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sr, "LIFT", 18.0)  # 16 rows at span 2
    monkeypatch.setattr(sr, "STRETCH", 40.0)


def compare(spark, gaps, frame, want):
    got = frame.toPandas().sort_values("ts")
    assert len(got) == len(gaps)
    source = pd.DataFrame(gaps, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for symbol in ("A", None, "B"):
        mine = got[got["symbol"].isna() if symbol is None else got["symbol"] == symbol]
        close = source[source["symbol"].isna() if symbol is None else source["symbol"] == symbol]["close"].astype(float)
        for name, fn in want.items():
            np.testing.assert_allclose(mine[name].to_numpy(float), fn(close).to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{symbol} {name}")


def test_averages_over_gaps_and_null_keys(spark, gaps):
    s = ind.bar_series(spark.createDataFrame(gaps, SCHEMA).repartition(3))
    spans = (2, 3, 12, 50)
    out = s.ema({f"e{n}_{int(a)}": ("close", n, a) for n in spans for a in (False, True)}).result()
    compare(spark, gaps, out, {f"e{n}_{int(a)}": (lambda x, n=n, a=a: x.ewm(span=n, adjust=a).mean()) for n in spans for a in (False, True)})


def test_rolling_windows_need_all_values(spark, gaps):
    rl = ind.bar_series(spark.createDataFrame(gaps, SCHEMA)).rolling(15)
    rl.add({"sma": ind.sma(rl, 3), "sd": ind.rolling_std(rl, 4), "part": ind.sma(rl, 5, full=False)})
    compare(spark, gaps, rl.done(), {"sma": lambda x: x.rolling(3).mean(), "sd": lambda x: x.rolling(4).std(), "part": lambda x: x.rolling(5, min_periods=1).mean()})
    rl = ind.stochastic(ind.bar_series(spark.createDataFrame(gaps, SCHEMA)).rolling(20), 4, 2)
    k = lambda x: (100 * (x - x.rolling(4).min()) / (x.rolling(4).max() - x.rolling(4).min() + 1e-12)).clip(0, 100)
    compare(spark, gaps, rl.done(), {"st_k": k, "st_d": lambda x: k(x).rolling(2).mean()})


def test_running_values_keep_rows_without_key_or_time(spark):
    rows = [(None, None, 1.0), (None, 3, 2.0), (None, 40, 4.0), ("a", None, 8.0), ("a", 5, 16.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double")
    got = {(r.k, r.id): r.s for r in sr.Series.by_id(df, ["k"], "id").scan({"s": ("sum", F.col("x"))}).result().collect()}
    assert got == {(None, None): 1.0, (None, 3): 3.0, (None, 40): 7.0, ("a", None): 8.0, ("a", 5): 24.0}


def test_states_with_a_null_key_merge(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None), ("b", None)], "k string, x double")
    parts = sc.partial_states(df.limit(1), ["k"], ["x"]).unionByName(sc.partial_states(df.exceptAll(df.limit(1)), ["k"], ["x"]))
    got = {r.k: r for r in sc.finish_states(sc.merge_states(parts, ["k"], ["x"]), ["k"], ["x"]).collect()}
    assert set(got) == {None, "a", "b"} and got[None].x_mean == 2.0 and got[None].article_count == 2 and got["b"].x_mean is None


def test_both_quantile_paths_keep_all_groups(spark):
    rows = [(None, float(i), None) for i in range(30)] + [("n", None, None)] * 30 + [("s", 1.0, 2.0), ("s", 3.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    cols = [F.count("*").alias("n")]
    take = lambda hot, more: sorted((tuple(r) for r in group_quantiles(df, ["k"], ["a", "b"], {"p50": 0.5, "p95": 0.95}, hot, more).collect()), key=str)
    for more in (cols, ()):
        assert take(10, more) == take(1000, more) == take(1, more) and len(take(10, more)) == 3


def test_tied_vectors_are_ranked_by_id_in_both_paths(spark):
    store = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(99, [0.0, 1.0])], "item_id bigint, vector array<double>").repartition(4)
    queries = spark.createDataFrame([(q, [2.0, 0.0]) for q in range(3)], "query_id bigint, vector array<double>")
    for limit in (10, 2):
        for size in (7, 1000):
            got = ve.nearest(queries, store, 3, broadcast_limit=limit, slice_rows=size).orderBy("query_id", "rank").collect()
            assert [(r.query_id, r.item_id) for r in got] == [(q, i) for q in range(3) for i in (1, 2, 3)]


def test_normal_distribution(spark):
    xs = [0.0, 1e-9, 0.3, -0.3, 1.96, -4.2, 6.9, 7.0, 7.2, -7.2, -20.0, 30.0, -38.0, None, float("nan")]
    d = statistics.NormalDist()
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", st.norm_cdf("x").alias("p")).collect()
    for r in got:
        assert r.p is None if r.x is None or r.x != r.x else r.p == pytest.approx(d.cdf(r.x), rel=1e-12, abs=1e-15)
    ps = [1e-300, 1e-12, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.9999, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, 2.0, None]], "p double").select("p", st.norm_ppf("p").alias("x")).collect()
    for r in got:
        assert r.x is None if r.p is None else r.x == pytest.approx(d.inv_cdf(r.p), rel=1e-9, abs=1e-13) if 0 < r.p < 1 else r.x != r.x


def test_short_inputs_answer(spark):
    s = sr.Series.by_id(spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(60)], "k string, id int"), ["k"], "id")
    roles = va.purged_splits(va.indexed(s), ["k"]).groupBy("k", "role").count().collect()
    assert {r.k for r in roles} == {"a", "b"}
    one = spark.range(1).select(F.lit(0.5).alias("s"), F.lit(1).alias("n"), F.lit(0).alias("t"), F.lit(0.0).alias("z"), F.lit(3.0).alias("k"))
    got = one.select(va.deflated_sharpe(F.col("s"), F.col("t"), F.lit(100), F.col("z"), F.col("k")).alias("a"), va.deflated_sharpe(F.col("s"), F.lit(10), F.col("n"), F.col("z"), F.col("k")).alias("b"),
                     va.expected_max_sharpe(F.col("t"), F.col("n")).alias("c"), va.expected_max_sharpe(F.lit(10), F.lit(0)).alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == (0.0, 0.0, 0.0, None)
    assert md.f_statistic(spark.createDataFrame([("x", 1.0), ("x", 2.0)], "y string, a double"), "y", ["a"]).first().score is None


def test_a_champion_without_the_metric_counts_as_zero(spark):
    schema = "pair string, directional_accuracy double, pbo double, deflated_sharpe double"
    c = spark.createDataFrame([("p", 0.9, 0.1, 0.04), ("q", 0.9, 0.1, 0.04), (None, 0.9, 0.1, 0.04)], schema)
    ch = spark.createDataFrame([("p", None), (None, 0.5)], "pair string, deflated_sharpe double")
    assert {r.pair: r.reason for r in va.promotion(c, ch, ["pair"]).collect()} == {"p": "improvement", "q": "promoted", None: "improvement"}


def test_relabelled_probabilities_follow(spark):
    rows = [("k", 0, 5.0, [0.7, 0.2, 0.1]), ("k", 1, -1.0, [0.1, 0.8, 0.1]), ("l", 2, 1.0, [0.1, 0.3, 0.6])]
    df = spark.createDataFrame(rows, "key string, state int, ret double, p array<double>")
    got = {(r.key, r.state): list(r.p) for r in rg.relabel(df, ["key"], probabilities="p").collect()}
    assert got == {("k", 1): [0.2, 0.7, 0.1], ("k", 0): [0.8, 0.1, 0.1], ("l", 0): [0.6, 0.1, 0.3]}


def test_result_documents_keep_any_params(spark, tmp_path):
    text = '{"run_id":"r","symbol":"s","timeframe":"H1","strategy_type":"t","timestamp":"2024-01-01","results":[{"params":{"ma_type":"ema","fast":5},"total_return":0.1,"sharpe_ratio":1.0,"max_drawdown":0.2,"win_rate":0.5,"num_trades":3,"kurtosis":4.0}]}'
    (tmp_path / "d.json").write_text(text)
    row = rd.read_results(spark, str(tmp_path)).first()
    assert (row.params, row.timestamp, row.kurtosis, row.recovery_factor, row.max_consecutive_wins) == ('{"ma_type":"ema","fast":5}', "2024-01-01", 4.0, 0.0, 0)


def test_ingest_goes_on_and_drops_late_copies(spark):
    inbox, home = work_dir(spark, "inbox"), work_dir(spark, "home")
    kinds = spark.createDataFrame([], "id bigint, v string, ts timestamp_ntz").schema
    stored = spark.createDataFrame([(3,)], "id bigint")
    want = {1: "a", 2: "b"}
    for n, rows in enumerate(([(1, "a"), (1, "z"), (2, "b"), (3, "c")], [(2, "late"), (4, "d"), (1, "later")], [])):
        if rows:
            spark.createDataFrame(rows, "id bigint, v string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(inbox)
        out = jobs.ingest_once(jobs.article_stream(spark, inbox, kinds), stored, "id", ["id", "v"], home=home)
        want |= {4: "d"} if n else {}
        assert {r.id: r.v for r in out.collect()} == want and out.count() == len(want)
