"""Block-based windows against plain pandas, with blocks small enough that every case crosses several."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fxspark.operators import indicators as ind
from fxspark.operators import performance as pf
from fxspark.operators import series as sr
from fxspark.operators import signals as sg
from fxspark.operators.quantiles import group_quantiles


def make_bars(n=300, symbols=("A", "B"), seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(symbols):
        m = n if k == 0 else n // 4  # one long series holds most rows
        close = 100 + np.cumsum(rng.normal(0, 1, m))
        t = pd.date_range("2024-01-01", periods=m, freq="97min")
        for i in range(m):
            rows.append((s, "M1", t[i], close[i] - 0.1, close[i] + abs(rng.normal()), close[i] - abs(rng.normal()), close[i], float(rng.integers(0, 50))))
    return pd.DataFrame(rows, columns=["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def bars(spark):
    pdf = make_bars()
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(7)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(sr, "BLOCK_ROWS", 16)
    monkeypatch.setattr(sr, "LIFT", 18.0)  # 16 rows at span 2
    monkeypatch.setattr(sr, "STRETCH", 40.0)
    monkeypatch.setattr(sg, "BLOCK_ROWS", 16)


def both(df, pdf, cols):
    got = df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    exp = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert len(got) == len(exp)
    for c in cols:
        np.testing.assert_allclose(got[c].to_numpy(float), exp[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


def per_symbol(pdf, fn):
    return pd.concat([fn(g.sort_values("ts").copy()) for _, g in pdf.groupby("symbol")])


def test_scan_kinds(bars):
    pdf, df = bars
    gap = F.when(F.col("volume") % 3 != 0, F.col("close"))
    s = ind.bar_series(df).scan({
        "csum": ("sum", F.col("close")), "cmax": ("max", F.col("close")), "cmin": ("min", F.col("close")),
        "cnt": ("count", gap), "ff": ("last", gap), "bf": ("next", gap)})

    def exp(g):
        x = g["close"].where(g["volume"] % 3 != 0)
        return g.assign(csum=g["close"].cumsum(), cmax=g["close"].cummax(), cmin=g["close"].cummin(), cnt=x.notna().cumsum(), ff=x.ffill(), bf=x.bfill())

    both(s.df, per_symbol(pdf, exp), ["csum", "cmax", "cmin", "cnt", "ff", "bf"])


def test_rolling_windows_cross_blocks(bars):
    pdf, df = bars
    rl = ind.bar_series(df).rolling(15, block=16)
    rl.add({"ret": ind.simple_return(rl, 1), "sma": ind.sma(rl, 10), "part": ind.sma(rl, 10, full=False)})
    rl.add({"vol": ind.rolling_std(rl, 10, "ret")})
    ind.rolling_shape(rl, "close", 12)
    ind.donchian(rl, 9)
    ind.atr(rl, 14)

    def exp(g):
        c = g["close"]
        tr = pd.concat([g["high"] - g["low"], (g["high"] - c.shift()).abs(), (g["low"] - c.shift()).abs()], axis=1).max(axis=1)
        return g.assign(ret=c.pct_change(), sma=c.rolling(10).mean(), part=c.rolling(10, min_periods=1).mean(), vol=c.pct_change().rolling(10).std(),
                        close_skew=c.rolling(12, min_periods=1).skew(), close_kurtosis=c.rolling(12, min_periods=1).kurt(),
                        dc_upper=g["high"].rolling(9).max().shift(), dc_lower=g["low"].rolling(9).min().shift(), atr=tr.rolling(14).mean())

    out = rl.done()
    assert out.count() == len(pdf)
    both(out, per_symbol(pdf, exp), ["ret", "sma", "part", "vol", "dc_upper", "dc_lower", "atr"])
    got = out.select("symbol", "ts", "close_skew", "close_kurtosis").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = per_symbol(pdf, exp).sort_values(["symbol", "ts"]).reset_index(drop=True)
    np.testing.assert_allclose(got["close_skew"], want["close_skew"], atol=1e-6)
    np.testing.assert_allclose(got["close_kurtosis"], want["close_kurtosis"], atol=1e-5)


@pytest.mark.parametrize("adjust", [False, True])
def test_ema_matches_pandas(bars, adjust):
    pdf, df = bars
    spans = [1, 2, 5, 12, 200]
    s = ind.bar_series(df).ema({f"e{n}": ("close", n, adjust) for n in spans})
    exp = per_symbol(pdf, lambda g: g.assign(**{f"e{n}": g["close"].ewm(span=n, adjust=adjust).mean() for n in spans}))
    both(s.df, exp, [f"e{n}" for n in spans])


def test_macd(bars):
    pdf, df = bars

    def exp(g):
        m = g["close"].ewm(span=12, adjust=False).mean() - g["close"].ewm(span=26, adjust=False).mean()
        return g.assign(macd=m, macd_signal=m.ewm(span=9, adjust=False).mean())

    both(ind.macd(ind.bar_series(df)).df, per_symbol(pdf, exp), ["macd", "macd_signal"])


def test_rsi_without_losses(spark):
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "M1", "ts": pd.date_range("2024-01-01", periods=40, freq="min"), "close": np.arange(40.0) + 1})
    rl = ind.bar_series(spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))).rolling(15, block=16)
    for z in ind.ZERO_LOSS:
        ind.rsi(rl, 14, z, z)
    last = rl.done().orderBy(F.desc("ts")).first()
    assert last["eps"] > 99.9 and last["tiny"] > 99.9 and last["inf"] == 0.0


def simulate(pdf, periods):
    """Long/flat simulation bar by bar."""
    out, trades = [], []
    for sym, g in pdf.groupby("symbol"):
        g = g.sort_values("ts").reset_index(drop=True)
        for pid, n in enumerate(periods):
            up, lo = g["high"].rolling(n).max().shift(), g["low"].rolling(n).min().shift()
            pos, eq, top, top_at, entry = 0, 0.0, 0.0, 0, None
            for i in range(len(g)):
                lr = np.log(g["close"][i] / g["close"][i - 1]) if i and pos else 0.0
                was = pos
                eq += lr
                if eq >= top:
                    top, top_at = eq, i + 1
                sig = 1 if g["close"][i] > up[i] else -1 if g["close"][i] < lo[i] else 0
                if sig == 1 and not pos:
                    pos, entry = 1, i
                elif sig == -1 and pos:
                    pos = 0
                    trades.append((sym, pid, entry + 1, i + 1, g["close"][i] / g["close"][entry] - 1))
                out.append((sym, g["ts"][i], pid, bool(was), eq, 1 - np.exp(eq - top), i + 1 - top_at))
    return (pd.DataFrame(out, columns=["symbol", "ts", "param_id", "was_long", "log_equity", "drawdown", "under"]),
            pd.DataFrame(trades, columns=["symbol", "param_id", "entry_bar", "exit_bar", "pnl_pct"]))


def test_positions_and_trades_against_simulation(bars):
    pdf, df = bars
    periods = [5, 9]
    pos = sg.positions(sg.signals(df, "breakout", [{"donchian_period": n, "sl_pct": 0.01, "tp_pct": 0.01} for n in periods]))
    got = pos.toPandas().sort_values(["symbol", "param_id", "ts"]).reset_index(drop=True)
    exp, tr = simulate(pdf, periods)
    exp = exp.sort_values(["symbol", "param_id", "ts"]).reset_index(drop=True)
    assert (got["was_long"] == exp["was_long"]).all()
    np.testing.assert_allclose(got["log_equity"], exp["log_equity"], atol=1e-10)
    np.testing.assert_allclose(got["drawdown"], exp["drawdown"], atol=1e-10)
    t = sg.trades(pos).toPandas().sort_values(["symbol", "param_id", "exit_bar"]).reset_index(drop=True)
    tr = tr.sort_values(["symbol", "param_id", "exit_bar"]).reset_index(drop=True)
    assert len(t) == len(tr) > 5
    assert (t["entry_bar"] == tr["entry_bar"]).all() and (t["exit_bar"] == tr["exit_bar"]).all()
    np.testing.assert_allclose(t["pnl_pct"], tr["pnl_pct"], atol=1e-10)


def test_equity_with_negative_and_zero_factors(spark):
    r = [0.1, -0.2, -1.5, 0.3, -2.5, 0.05, -1.0, 0.4]
    pdf = pd.DataFrame({"k": 1, "i": range(len(r)), "ret": r})
    s = pf.equity(sr.Series.of(spark.createDataFrame(pdf), ["k"], ["i"], {"b": F.floor(F.col("i") / 3)}))
    got = s.df.orderBy("i").toPandas()
    eq = np.cumprod(1 + np.array(r))
    peak = np.maximum.accumulate(eq)
    np.testing.assert_allclose(got["equity"], eq, atol=1e-12)
    np.testing.assert_allclose(got["drawdown"], (peak - eq) / np.where(peak > 0, peak, 1), atol=1e-12)


def test_streaks_zero_breaks_both(spark):
    pnl = [1, 1, 0, 1, 1, 1, -1, -1, 0, -1, 1]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(len(pnl)), "pnl": [float(x) for x in pnl]}))
    row = sg.streaks(df, ["k"], "i", "pnl").first()
    assert (row["max_wins"], row["max_losses"]) == (3, 2)


def test_quantiles_of_hot_groups_are_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([pd.DataFrame({"k": "hot", "a": np.round(rng.normal(size=5000), 2), "b": rng.exponential(size=5000)}),
                     pd.DataFrame({"k": "small", "a": rng.normal(size=11), "b": rng.normal(size=11)})])
    probs = {"p01": 0.01, "p50": 0.5, "p95": 0.95}
    df = spark.createDataFrame(pdf)
    got = group_quantiles(df, ["k"], ["a", "b"], probs, hot_rows=100, aggs=[F.count("*").alias("n")]).toPandas().set_index("k")
    assert got.loc["hot", "n"] == 5000
    for k, g in pdf.groupby("k"):
        for m in "ab":
            for n, p in probs.items():
                assert got.loc[k, f"{m}_{n}"] == pytest.approx(np.percentile(g[m], p * 100), abs=1e-12)


def test_indicator_plan_has_no_whole_series_window(bars):
    """Windows over rows partition by block, so one series is spread over tasks."""
    _, df = bars
    rl = ind.bar_series(df).rolling(15, block=16)
    plan = rl.add({"s": ind.sma(rl, 10)}).done()._jdf.queryExecution().optimizedPlan().toString()
    heavy = [x for x in plan.splitlines() if "Window [" in x and "avg(" in x]
    assert heavy and all("_blk" in x for x in heavy)


def falls(spark, n=60, at=(7, 40)):
    """A series that goes up by one from 100 but falls to zero at some bars."""
    t = pd.date_range("2024-01-01", periods=n, freq="97min")
    close = [0.0 if i in at else 100.0 + i for i in range(n)]
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "M1", "ts": t, "open": close, "high": close, "low": close, "close": close, "volume": 1.0})
    return close, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_a_fall_to_zero_is_a_log_return_of_minus_infinity(spark):
    close, df = falls(spark)
    rl = ind.bar_series(df).rolling(1)
    rl.add({"lr": ind.log_return(rl)})
    got = [r["lr"] for r in rl.done().orderBy("ts").collect()]
    want = [None if i == 0 or close[i - 1] == 0 else -np.inf if close[i] == 0 else np.log(close[i] / close[i - 1]) for i in range(len(close))]
    assert [x is None for x in got] == [x is None for x in want]
    np.testing.assert_allclose([x for x in got if x is not None], [x for x in want if x is not None], rtol=1e-12)


@pytest.mark.parametrize("at", [(40,), (33, 50), (48,)])  # inside a block, in two, at the begin of one
def test_a_fall_to_zero_ends_the_equity_of_a_held_position(spark, at):
    close, df = falls(spark, at=at)
    run = [{"donchian_period": 5, "sl_pct": 0.01, "tp_pct": 0.01}]
    pos = sg.positions(sg.signals(df, "breakout", run)).orderBy("ts").collect()
    lost = False
    for i, p in enumerate(pos):
        lost = lost or (p.was_long and close[i] == 0)
        if p.was_long and close[i] == 0:
            assert p.ret == -1.0
        assert (p.log_equity == -np.inf) == lost and p.drawdown == (1.0 if lost else 0.0)
    assert lost
    m = sg.grid_metrics(df, "breakout", run).first()
    assert m.total_return == -1.0 and m.max_drawdown == 1.0 and m.recovery_factor == -1.0
    assert m.max_drawdown_duration_hours == pytest.approx(max(p.bars_under_peak for p in pos) / 60)
