"""Metric rows of a grid from packed blocks, against plain loops over bars."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fxspark.operators import grid as gr
from fxspark.operators import series as sr

SCHEMA = "symbol string, timeframe string, _rn bigint, close double, log_ret double, _signals array<tinyint>"


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(gr, "BLOCK_ROWS", 16)
    monkeypatch.setattr(gr, "RUNS", 2)
    monkeypatch.setattr(sr, "BLOCK_ROWS", 16)


def made():
    """Series of different length, one without a name; runs that never trade, always trade, start with an exit, hold to the end."""
    r = np.random.default_rng(4)
    out = {}
    for symbol, n in (("A", 150), (None, 70), ("B", 1), ("C", 17)):
        close = np.round(100 * np.exp(np.cumsum(r.normal(0, 0.02, n))), 2)
        move = np.r_[0.0, np.log(close[1:] / close[:-1])]
        signals = np.stack([np.zeros(n, int), r.choice([-1, 0, 1], n), r.choice([-1, 0, 0, 0, 0, 0, 0, 0, 1], n), np.ones(n, int), -np.ones(n, int),
                            np.where(np.arange(n) % 40 == 5, 1, np.where(np.arange(n) % 40 == 37, -1, 0))], axis=1)
        out[symbol] = close, move, signals
    return out


def plain(close, move, signal):
    """One run, bar by bar."""
    long, equity, peak, peak_rn, entry = False, 0.0, 0.0, 0, None
    returns, fall, under, trades = [], 0.0, 0, []
    for i in range(len(close)):
        rn = i + 1
        if long:
            equity += move[i]
        returns.append(math.expm1(move[i]) if long else 0.0)
        if equity >= peak:
            peak, peak_rn = equity, rn
        fall, under = max(fall, 1 - math.exp(equity - peak)), max(under, rn - peak_rn)
        if long and signal[i] == -1:
            trades.append((rn - entry[0], close[i] / entry[1] - 1))
            long = False
        elif not long and signal[i] == 1:
            long, entry = True, (rn, close[i])
    x, pnl = pd.Series(returns), [t[1] for t in trades]
    wins, losses = [p for p in pnl if p > 0], [p for p in pnl if p < 0]

    def streak(ok):
        best = run = 0
        for p in pnl:
            run = run + 1 if ok(p) else 0
            best = max(best, run)
        return best

    s = dict(n_bars=len(x), n_returns=len(x), mean_ret=x.mean(), _sdp=x.std(ddof=0), ret_p05=x.quantile(0.05), ret_p95=x.quantile(0.95), total_return=math.expm1(equity),
             max_drawdown=fall, _dd_bars=under, _down=math.sqrt((x.clip(upper=0) ** 2).mean()), _up_sum=x.clip(lower=0).sum(), _down_sum=-x.clip(upper=0).sum(), num_trades=len(pnl))
    if len(x) > 1:
        s["sd_ret"] = x.std()
    if x.std(ddof=0) > 0:
        d = x - x.mean()
        s |= dict(_g1=(d**3).mean() / x.std(ddof=0) ** 3, _g2=(d**4).mean() / x.std(ddof=0) ** 4 - 3)
    if pnl:
        s |= dict(win_rate=len(wins) / len(pnl), avg_win_pct=np.mean(wins) if wins else 0, avg_loss_pct=np.mean(losses) if losses else 0, best_trade_pct=max(pnl), worst_trade_pct=min(pnl),
                  profit_factor=sum(wins) / -sum(losses) if losses else 0, expectancy=np.mean(pnl), _held=np.mean([t[0] for t in trades]),
                  max_wins=streak(lambda p: p > 0), max_losses=streak(lambda p: p < 0))
    return s


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_statistics_of_every_run(spark, hot_rows):
    data = made()
    rows = [(k, "H1", i + 1, float(c[i]), float(m[i]), [int(v) for v in s[i]]) for k, (c, m, s) in data.items() for i in range(len(c))]
    got = gr.run_statistics(spark.createDataFrame(rows, SCHEMA).repartition(5), ["symbol", "timeframe"], hot_rows).collect()
    assert len(got) == 6 * len(data)
    for r in got:
        close, move, signals = data[r.symbol]
        want = plain(close, move, signals[:, r.param_id])
        for c in gr.STATS:
            a, b = r[c], want.get(c)
            if c in ("num_trades", "max_wins", "max_losses"):
                a, b = a or 0, b or 0
            assert (a is None) == (b is None) or c in ("_sdp", "sd_ret"), (r.symbol, r.param_id, c, a, b)
            if b is not None:
                assert a == pytest.approx(b, rel=1e-9, abs=1e-11), (r.symbol, r.param_id, c)


def test_no_bars(spark):
    assert gr.run_statistics(spark.createDataFrame([], SCHEMA), ["symbol", "timeframe"]).count() == 0


def test_a_trade_without_price_has_no_result(spark):
    rows = [("A", "H1", i + 1, None if i == 2 else 10.0 + i, 0.0, [s]) for i, s in enumerate((1, 0, -1, 1, -1, 0))]
    r = gr.run_statistics(spark.createDataFrame(rows, SCHEMA), ["symbol", "timeframe"]).first()
    assert r.num_trades == 2 and r.win_rate == 1.0 and r.expectancy == pytest.approx(14 / 13 - 1)


def test_bars_and_runs_meet_as_bits(spark):
    close, move, signals = made()["A"]
    rows = [("A", "H1", i + 1, float(close[i]), float(move[i]), [int(v) for v in signals[i]]) for i in range(150)]
    blocks = gr.packed(spark.createDataFrame(rows, SCHEMA), ["symbol", "timeframe"])
    assert blocks.filter("param_id >= 0").count() == 6 * 10  # runs x blocks
    assert blocks.agg(F.max(F.length("held"))).first()[0] == 2  # a bit for each of 16 bars


def test_a_total_loss_stays_lost(spark):
    """Runs that are held from the first bar, entered later, flat when the price falls to zero, or told to enter twice."""
    close = np.r_[np.arange(10.0, 50.0), 0.0, np.full(20, 5.0)]
    move = np.r_[0.0, np.log(close[1:41].clip(1e-300) / close[:40]), np.zeros(20)]
    move[40] = -np.inf
    n = len(close)
    signals = np.stack([np.r_[1, np.zeros(n - 1, int)], np.where(np.arange(n) == 20, 1, np.where(np.arange(n) == 44, -1, 0)), np.where(np.arange(n) == 3, 1, np.where(np.arange(n) == 35, -1, 0)),
                        np.isin(np.arange(n), (0, 34)).astype(int)], axis=1)
    rows = [("A", "H1", i + 1, float(close[i]), float(move[i]), [int(v) for v in signals[i]]) for i in range(n)]
    got = {r.param_id: r for r in gr.run_statistics(spark.createDataFrame(rows, SCHEMA), ["symbol", "timeframe"]).collect()}
    for i in range(4):
        want = plain(close, move, signals[:, i])
        for c in ("total_return", "max_drawdown", "_dd_bars", "mean_ret", "_sdp", "_down", "_up_sum", "_down_sum"):
            assert got[i][c] == pytest.approx(want[c], rel=1e-9, abs=1e-11), (i, c)
    assert [got[i].total_return == -1.0 for i in range(4)] == [True, True, False, True]
