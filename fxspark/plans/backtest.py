"""Strategy signals, trades, metric rows over parameter grids, and result reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import performance as pf
from ..operators import signals as sg
from ..operators import scores as sc
from ..operators.series import Series
from .bars import TR, ema_sql, full, lag, rsi_expr, rsi_levels, step, win
from .inputs import bars, r, rnd, rounded, table, unnamed, unnamed_bars
from .normal_sql import cdf
from .registry import SQL, query


def _signal_rows(spark, sf, strategy, points):
    out = sg.signals(bars(spark, sf), strategy, points).filter(F.col("signal").isNotNull())
    return out.select("symbol", "ts", "param_id", "signal")


def _sig(up: str, down: str) -> str:
    u, d = f"coalesce({up}, false)", f"coalesce({down}, false)"
    return f"CASE WHEN {u} AND NOT {d} THEN 1 WHEN {d} AND NOT {u} THEN -1 END"


def _cross(a: str, b: str) -> tuple[str, str]:
    return f"{a} > {b} AND {lag(a)} <= {lag(b)}", f"{a} < {b} AND {lag(a)} >= {lag(b)}"


def _rows(level: int, *exprs: str) -> str:
    parts = [f"SELECT symbol, ts, {i} AS param_id, {e} AS signal FROM b{level}" for i, e in enumerate(exprs)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE signal IS NOT NULL"


TREND = [{"ma_type": t, "fast_window": 5, "slow_window": 20, "sl_pct": 0.01, "tp_pct": 0.02} for t in ("sma", "ema")]


@query("W18a_trend_signal", win(step(0, f=full("avg(close)", 5), s=full("avg(close)", 20), ef=ema_sql("close", 5, False), es=ema_sql("close", 20, False)),
                                _rows(1, _sig(*_cross("f", "s")), _sig(*_cross("ef", "es")))))
def trend_signal(spark, sf):
    return _signal_rows(spark, sf, "trend_following", TREND)


@query("W18b_scalping_signal", win(*rsi_levels(0), step(3, rsi=f"CASE WHEN rn >= 14 THEN {rsi_expr('2.220446049250313e-16')} END"),
       _rows(4, _sig(_cross("rsi", "30.0")[1].replace(lag("30.0"), "30.0"), _cross("rsi", "70.0")[0].replace(lag("70.0"), "70.0")))))
def scalping_signal(spark, sf):
    return _signal_rows(spark, sf, "scalping", [{"rsi_period": 14, "oversold": 30, "overbought": 70, "sl_pct": 0.01, "tp_pct": 0.01}])


def dc(n: int) -> dict[str, str]:
    return {f"u{n}": full("max(high)", n, -1), f"l{n}": full("min(low)", n, -1)}


@query("W18c_breakout_signal", win(step(0, **dc(20)), _rows(1, _sig("close > u20", "close < l20"))))
def breakout_signal(spark, sf):
    return _signal_rows(spark, sf, "breakout", [{"donchian_period": 20, "sl_pct": 0.01, "tp_pct": 0.02}])


@query("W18d_mean_reversion_signal", win(step(0, m=full("avg(close)", 20), s=full("stddev_samp(close)", 20)),
       _rows(1, *(_sig(f"close < m - {k} * s", f"close > m + {k} * s") for k in (1.5, 2.0)))))
def mean_reversion_signal(spark, sf):
    return _signal_rows(spark, sf, "mean_reversion", [{"bb_period": 20, "bb_std": k, "sl_pct": 0.01, "tp_pct": 0.01} for k in (1.5, 2.0)])


@query("W18e_macd_signal", win(step(0, macd=f"{ema_sql('close', 12, False)} - {ema_sql('close', 26, False)}"), step(1, sig=ema_sql("macd", 9, False)),
       _rows(2, _sig(*_cross("macd", "sig")))))
def macd_signal(spark, sf):
    return _signal_rows(spark, sf, "macd", [{"fast_window": 12, "slow_window": 26, "signal_window": 9, "sl_pct": 0.01, "tp_pct": 0.01}])


_UP, _DOWN = _cross("k", "d")


@query("W18f_stochastic_signal", win(step(0, ll=full("min(low)", 14), hh=full("max(high)", 14)),
       step(1, k="CASE WHEN rn >= 14 THEN greatest(0, least(100, 100 * (close - ll) / (hh - ll + 1e-12))) END"), step(2, d=full("avg(k)", 3, lead=13)),
       _rows(3, _sig(f"{_UP} AND {lag('k')} < 25", f"{_DOWN} AND {lag('k')} > 75"))))
def stochastic_signal(spark, sf):
    return _signal_rows(spark, sf, "stochastic", [
        {"k_period": 14, "d_period": 3, "oversold": 25, "overbought": 75, "sl_pct": 0.01, "tp_pct": 0.01}])


@query("W18g_atr_breakout_signal", win(step(0, **dc(15), tr=TR), step(1, atr=full("avg(tr)", 14)),
       step(2, signal=_sig("close > u15", "close < l15")),
       f"SELECT symbol, ts, signal, {r('greatest(0.001, least(0.1, coalesce(atr / nullif(close, 0) * 2.0, 0.015)))')} AS stop_pct FROM b3 WHERE signal IS NOT NULL"))
def atr_breakout_signal(spark, sf):
    p = {"donchian_period": 15, "atr_window": 14, "atr_multiplier": 2.0, "sl_pct": 0.015, "tp_pct": 0.02}
    rl = sg.signal_frame(bars(spark, sf), "atr_breakout", [p])
    ind.atr(rl, p["atr_window"])
    up, down = sg.STRATEGIES["atr_breakout"].signal(rl, p)
    rl.flush().add({"signal": sg.signal_value(up, down), "stop_pct": sg.atr_stop(F.col("close"), F.col("atr"), p["atr_multiplier"], p["sl_pct"])})
    return rounded(rl.done().filter(F.col("signal").isNotNull()).select("symbol", "ts", "signal", "stop_pct"), "stop_pct")


BREAKOUT_GRID = {"donchian_period": [10, 20, 30], "sl_pct": [0.01, 0.02], "tp_pct": [0.02, 0.04]}
PERIODS = BREAKOUT_GRID["donchian_period"]

# positions of the three breakout runs
P = "PARTITION BY symbol, param_id ORDER BY rn"
POS = [
    step(0, **{k: v for n in PERIODS for k, v in dc(n).items()}, lr=f"coalesce(ln(close / nullif({lag('close')}, 0)), 0)"),
    " UNION ALL ".join(f"SELECT symbol, timeframe, ts, close, rn, lr, {i} AS param_id, {_sig(f'close > u{n}', f'close < l{n}')} AS signal FROM b1" for i, n in enumerate(PERIODS)),
    f"SELECT *, coalesce(last(signal IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) = 1 AS was_long FROM b2",
    f"SELECT *, sum(CASE WHEN was_long THEN lr ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS le, CASE WHEN was_long THEN exp(lr) - 1 ELSE 0 END AS ret FROM b3",
    f"SELECT *, greatest(0, max(le) OVER ({P} ROWS UNBOUNDED PRECEDING)) AS top, max(round(le, 9)) OVER ({P} ROWS UNBOUNDED PRECEDING) AS rtop FROM b4",
    f"SELECT *, 1 - exp(le - top) AS drawdown, rn - coalesce(max(CASE WHEN rtop >= 0 AND round(le, 9) = rtop THEN rn END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS under FROM b5",
]
ENTRIES = f"""en AS (SELECT symbol, timeframe, param_id, rn, ts, close, signal FROM b6 WHERE (signal = 1 AND NOT was_long) OR (signal = -1 AND was_long)),
tr AS (SELECT symbol, timeframe, param_id, lag(rn) OVER w AS entry_bar, rn AS exit_bar, lag(ts) OVER w AS entry_ts, ts AS exit_ts, lag(close) OVER w AS entry_price,
   close AS exit_price, rn - lag(rn) OVER w AS bars_held, close / lag(close) OVER w - 1 AS pnl_pct, signal FROM en WINDOW w AS ({P}) QUALIFY signal = -1)"""


def pos_sql(*tail: str) -> str:
    """SQL over the positions (b6) with further CTE parts before the final select."""
    base = win(*POS, "")
    return f"{base.rstrip()}, {', '.join(tail[:-1])} {tail[-1]}" if len(tail) > 1 else f"{base} {tail[-1]}"


def breakout_positions(spark, sf):
    pts = sg.distinct_signals("breakout", sg.grid_points("breakout", BREAKOUT_GRID))
    return sg.positions(sg.signals(bars(spark, sf), "breakout", pts))


@query("W19_trades", pos_sql(ENTRIES, f"""SELECT symbol, param_id, entry_bar, exit_bar, entry_ts, exit_ts, 'long' AS side, entry_price, exit_price, bars_held, {r('pnl_pct')} AS pnl_pct FROM tr"""))
def trades(spark, sf):
    return rounded(sg.trades(breakout_positions(spark, sf)).drop("timeframe"), "pnl_pct")


@query("W20_equity_and_drawdown", pos_sql(f"""SELECT symbol, param_id, ts, was_long, {r('ret')} AS ret, {r('le')} AS log_equity, {r('drawdown')} AS drawdown, under AS bars_under_peak FROM b6"""))
def equity_and_drawdown(spark, sf):
    p = breakout_positions(spark, sf).select("symbol", "param_id", "ts", "was_long", "ret", "log_equity", "drawdown", "bars_under_peak")
    return rounded(p, "ret", "log_equity", "drawdown")


# trades of one account per order priority: result between -0.5 and 0.5, zero included
TRADE_TABLE = "SELECT o_orderpriority AS account, o_orderkey AS trade_no, (CAST(floor(o_totalprice) AS BIGINT) % 11 - 5) / 10.0 AS pnl FROM orders"


def trade_table(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("account"), F.col("o_orderkey").alias("trade_no"),
        ((F.floor("o_totalprice") % 11 - 5) / 10).alias("pnl"))


@query("W21_streaks", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY trade_no) AS n FROM ({TRADE_TABLE})),
g AS (SELECT *, n - row_number() OVER (PARTITION BY account, sign(pnl) ORDER BY n) AS island FROM t),
s AS (SELECT account, sign(pnl) AS side, count(*) AS len FROM g GROUP BY account, sign(pnl), island)
SELECT account, coalesce(max(len) FILTER (side = 1), 0) AS max_wins, coalesce(max(len) FILTER (side = -1), 0) AS max_losses FROM s GROUP BY 1""")
def streaks(spark, sf):
    return sg.streaks(trade_table(spark, sf), ["account"], "trade_no", "pnl")


def stats_sql(p: str) -> str:
    gl = f"abs(coalesce(sum({p}) FILTER ({p} < 0), 0))"
    return (f"count(*) AS num_trades, {r(f'avg(CAST({p} > 0 AS INTEGER))')} AS win_rate, {r(f'coalesce(avg({p}) FILTER ({p} > 0), 0)')} AS avg_win_pct, "
            f"{r(f'coalesce(avg({p}) FILTER ({p} < 0), 0)')} AS avg_loss_pct, {r(f'max({p})')} AS best_trade_pct, {r(f'min({p})')} AS worst_trade_pct, "
            f"{r(f'CASE WHEN {gl} > 0 THEN coalesce(sum({p}) FILTER ({p} > 0), 0) / {gl} ELSE 0 END')} AS profit_factor, {r(f'avg({p})')} AS expectancy")


STAT_COLS = ["win_rate", "avg_win_pct", "avg_loss_pct", "best_trade_pct", "worst_trade_pct", "profit_factor", "expectancy"]


@query("A34_trade_statistics", f"SELECT account, {stats_sql('pnl')} FROM ({TRADE_TABLE}) GROUP BY 1")
def trade_statistics(spark, sf):
    return rounded(sg.trade_statistics(trade_table(spark, sf), ["account"], "pnl"), *STAT_COLS)


# daily prices with a prediction, one series per return flag
PRICES = """SELECT l_returnflag AS symbol, l_shipdate AS ts, 1000 + avg(l_extendedprice) / 1000 AS close, 1000 + avg(l_quantity) AS pred FROM lineitem GROUP BY ALL"""


def prices(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts")).agg(
        (1000 + F.avg("l_extendedprice") / 1000).alias("close"), (1000 + F.avg("l_quantity")).alias("pred"))


def price_series(spark, sf):
    return Series.by_month(prices(spark, sf), ["symbol"], "ts")


def daily_returns(spark, sf):
    rl = price_series(spark, sf).rolling(1)
    rl.add({"ret": ind.simple_return(rl, 1)})
    return rl.series()


RET = f"rt AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM ({PRICES}))"


@query("A30_return_shape", f"""
WITH {RET}, m AS (SELECT symbol, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rt GROUP BY 1)
SELECT symbol, n AS n_returns, {r('max(sd) * sqrt(252)')} AS volatility, {r('avg(pow((ret - mu) / sd, 3))')} AS skewness, {r('avg(pow((ret - mu) / sd, 4)) - 3')} AS kurtosis,
  {r('quantile_cont(ret, 0.95) / abs(quantile_cont(ret, 0.05))')} AS tail_ratio FROM rt JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol, n""")
def return_shape(spark, sf):
    s = sg.return_shape(daily_returns(spark, sf).df.filter("ret IS NOT NULL"), ["symbol"])
    return rounded(s.select("symbol", "n_returns", "volatility", "skewness", "kurtosis", "tail_ratio"), "volatility", "skewness", "kurtosis", "tail_ratio")


@query("A31_sharpe_and_drawdown", f"""
WITH {RET}, e AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM rt WHERE ret IS NOT NULL),
d AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT symbol, count(*) AS n_returns, {r('avg(ret) / stddev_pop(ret) * sqrt(252)')} AS sharpe, {r('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))')} AS profit_factor,
  {r('max((peak - eq) / CASE WHEN peak > 0 THEN peak ELSE 1 END)')} AS max_drawdown FROM d GROUP BY 1""")
def sharpe_and_drawdown(spark, sf):
    m = pf.equity(daily_returns(spark, sf)).df.groupBy("symbol").agg(*pf.return_metrics())
    return rounded(m, "sharpe", "profit_factor", "max_drawdown")


FC = f"""fc AS (SELECT *, close - lag(close) OVER w AS dt, pred - lag(pred) OVER w AS dp, lag(close) OVER w AS pt, lag(pred) OVER w AS pp FROM ({PRICES})
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)), fr AS (SELECT *, sign(dp / pp) * dt / pt AS ret FROM fc)"""
ERR = f"""{r('sqrt(avg(pow((close - pred) / 0.01, 2)))')} AS rmse_pips, {r('avg(abs(close - pred) / 0.01)')} AS mae_pips,
 {r('avg(CAST(sign(dt) = sign(dp) AS INTEGER)) FILTER (dt IS NOT NULL)')} AS directional_accuracy"""


@query("A32_forecast_errors", f"WITH {FC} SELECT symbol, {ERR} FROM fr GROUP BY 1")
def forecast_errors(spark, sf):
    s = pf.forecast_steps(price_series(spark, sf), "close", "pred")
    return rounded(s.df.groupBy("symbol").agg(*pf.forecast_errors("close", "pred", 0.01)), "rmse_pips", "mae_pips", "directional_accuracy")


@query("A33_prediction_strategy", f"""
WITH {FC}, e AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM fr),
d AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM e)
SELECT symbol, {ERR}, count(ret) AS n_returns, {r('avg(ret) / stddev_pop(ret) * sqrt(252)')} AS sharpe,
  {r('sum(ret) FILTER (ret > 0) / abs(sum(ret) FILTER (ret < 0))')} AS profit_factor, {r('max((peak - eq) / peak)')} AS max_drawdown FROM d GROUP BY 1""")
def prediction_strategy(spark, sf):
    s = pf.equity(pf.forecast_steps(price_series(spark, sf), "close", "pred"))
    m = s.df.groupBy("symbol").agg(*pf.forecast_errors("close", "pred", 0.01), *pf.return_metrics())
    return rounded(m, "rmse_pips", "mae_pips", "directional_accuracy", "sharpe", "profit_factor", "max_drawdown")


def _psr(tail):
    return f"CASE WHEN n >= 3 AND 1 - skew * s + ({tail}) * s * s > 0 THEN {cdf(f'(s * sqrt(n - 1) / sqrt(1 - skew * s + ({tail}) * s * s))')} ELSE 0 END"


@query("A35_probabilistic_sharpe", f"""WITH {RET}, m AS (SELECT symbol, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rt GROUP BY 1),
g AS (SELECT symbol, n, max(mu) / max(sd) AS s, avg(pow((ret - mu) / sd, 3)) AS skew, avg(pow((ret - mu) / sd, 4)) - 3 AS ex FROM rt JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol, n)
SELECT symbol, n AS n_returns, {r(_psr('ex / 4'))} AS psr, {r(_psr('(ex + 2) / 4'))} AS psr_plain FROM g""")
def probabilistic_sharpe(spark, sf):
    s = sg.return_shape(daily_returns(spark, sf).df.filter("ret IS NOT NULL"), ["symbol"])
    plain = sg.psr(F.col("n_returns"), F.col("mean_ret"), F.col("sd_ret"), F.col("skewness"), F.col("kurtosis"), variant="plain")
    return rounded(s.select("symbol", "n_returns", "psr", plain.alias("psr_plain")), "psr", "psr_plain")


@query("A36_recovery_and_duration", pos_sql(ENTRIES, f"""SELECT symbol, param_id, {r('avg_trade_duration_hours')} AS avg_trade_duration_hours,
 {r('dd_hours')} AS max_drawdown_duration_hours, {r('CASE WHEN mdd > 1e-12 THEN total / mdd ELSE 0 END')} AS recovery_factor
FROM (SELECT symbol, param_id, exp(arg_max(le, rn)) - 1 AS total, max(drawdown) AS mdd, max(under) / 60.0 AS dd_hours FROM b6 GROUP BY 1, 2)
LEFT JOIN (SELECT symbol, param_id, avg(bars_held) / 60.0 AS avg_trade_duration_hours FROM tr GROUP BY 1, 2) USING (symbol, param_id)"""))
def recovery_and_duration(spark, sf):
    pts = sg.distinct_signals("breakout", sg.grid_points("breakout", BREAKOUT_GRID))
    m = sg.grid_metrics(bars(spark, sf), "breakout", pts)
    cols = ["avg_trade_duration_hours", "max_drawdown_duration_hours", "recovery_factor"]
    return rounded(m.select("symbol", "param_id", *cols), *cols)


GRID_SQL = " UNION ALL ".join(f"SELECT {i} AS param_id, {n} AS donchian_period" for i, n in enumerate(PERIODS))


@query("M21_grid_metrics", pos_sql(ENTRIES, f"g AS ({GRID_SQL})", 
    f"""bm AS (SELECT symbol, param_id, count(*) AS n, exp(arg_max(le, rn)) - 1 AS total_return, max(drawdown) AS max_drawdown, max(under) / 60.0 AS dd_hours,
  avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sdp, sqrt(avg(pow(least(ret, 0), 2))) AS down, sum(greatest(ret, 0)) AS up_sum, sum(greatest(-ret, 0)) AS down_sum,
  quantile_cont(ret, 0.95) AS p95, quantile_cont(ret, 0.05) AS p05 FROM b6 GROUP BY 1, 2)""",
    "sh AS (SELECT symbol, param_id, avg(pow((ret - mu) / sd, 3)) AS skew, avg(pow((ret - mu) / sd, 4)) - 3 AS ex, max(mu) / max(sd) AS s, count(ret) AS nr FROM b6 JOIN bm USING (symbol, param_id) GROUP BY 1, 2)",
    "hd AS (SELECT symbol, param_id, avg(bars_held) / 60.0 AS held FROM tr GROUP BY 1, 2)",
    f"ts AS (SELECT symbol, param_id, {stats_sql('pnl_pct')} FROM tr GROUP BY 1, 2)",
    f"""SELECT symbol, 'breakout' AS strategy_type, donchian_period, {r('total_return')} AS total_return,
  {r('greatest(-10, least(10, mu / sdp * sqrt(252)))')} AS sharpe_ratio, {r('max_drawdown')} AS max_drawdown, win_rate, num_trades, profit_factor,
  {r('greatest(-10, least(10, mu / down * sqrt(252)))')} AS sortino_ratio, {r('greatest(-10, least(100, up_sum / down_sum))')} AS omega_ratio, expectancy,
  avg_win_pct, avg_loss_pct, best_trade_pct, worst_trade_pct, {r('dd_hours')} AS max_drawdown_duration_hours, {r('sd * sqrt(252)')} AS volatility,
  {r('skew')} AS skewness, {r('ex')} AS kurtosis, {r(_psr('ex / 4').replace('n - 1', 'nr - 1').replace('n >= 3', 'nr >= 3'))} AS psr,
  {r('greatest(-10, least(10, (pow(1 + total_return, 252.0 / n) - 1) / max_drawdown))')} AS calmar_ratio, {r('coalesce(held, 0)')} AS avg_trade_duration_hours, {r('CASE WHEN abs(p05) > 1e-12 THEN p95 / abs(p05) ELSE 0 END')} AS tail_ratio
FROM bm JOIN sh USING (symbol, param_id) JOIN ts USING (symbol, param_id) LEFT JOIN hd USING (symbol, param_id) JOIN g USING (param_id)"""))
def grid_metrics(spark, sf):
    return _grid(bars(spark, sf))


def _grid(b):
    m = sg.backtest(b, "breakout", BREAKOUT_GRID)
    cols = ["total_return", "sharpe_ratio", "max_drawdown", *STAT_COLS, "sortino_ratio", "omega_ratio", "max_drawdown_duration_hours",
            "volatility", "skewness", "kurtosis", "tail_ratio", "psr", "calmar_ratio", "avg_trade_duration_hours"]
    par = F.from_json("params", "donchian_period int")
    return rounded(m.select("symbol", "strategy_type", par.alias("p"), "num_trades", *cols), *cols).select(
        "symbol", "strategy_type", "p.*", "num_trades", *cols)


@query("M21_grid_null_symbol", unnamed(SQL["M21_grid_metrics"], "symbol"))
def grid_metrics_without_name(spark, sf):
    return _grid(unnamed_bars(spark, sf))


@query("J10_parameter_grid", f"""
WITH s AS (SELECT DISTINCT event_type AS symbol FROM events), f AS (SELECT unnest([5, 10, 20, 40]) AS fast_window), w AS (SELECT unnest([20, 40, 60]) AS slow_window)
SELECT symbol, fast_window, slow_window FROM s, f, w WHERE fast_window < slow_window""")
def parameter_grid(spark, sf):
    pts = sg.grid_points("trend_following", {"ma_type": ["sma"], "fast_window": [5, 10, 20, 40], "slow_window": [20, 40, 60], "sl_pct": [0.01], "tp_pct": [0.02]})
    cells = F.array(*(F.struct(*(F.lit(p[k]).alias(k) for k in ("fast_window", "slow_window"))) for p in pts))
    return table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct().select("symbol", F.inline(cells))


def _counts(name, signal_query, param=0):
    rows = SQL[signal_query]
    pick = f"WHERE param_id = {param}" if "param_id" in rows else ""
    return (f"SELECT s.symbol, '{name}' AS strategy, count(*) FILTER (signal = 1) AS entries, count(*) FILTER (signal = -1) AS exits "
            f"FROM (SELECT DISTINCT event_type AS symbol FROM events) s LEFT JOIN (SELECT symbol, signal FROM ({rows}) {pick}) x ON x.symbol = s.symbol GROUP BY 1, 2")


@query("F4_strategy_registry", " UNION ALL ".join([
    _counts("trend_following", "W18a_trend_signal"), _counts("scalping", "W18b_scalping_signal"), _counts("breakout", "W18c_breakout_signal"),
    _counts("mean_reversion", "W18d_mean_reversion_signal", 1), _counts("macd", "W18e_macd_signal"), _counts("stochastic", "W18f_stochastic_signal"),
    _counts("atr_breakout", "W18g_atr_breakout_signal")]))
def strategy_registry(spark, sf):
    """Signal counts of every registered strategy over all bars."""
    grids = {
        "trend_following": TREND[0], "scalping": {"rsi_period": 14, "oversold": 30, "overbought": 70, "sl_pct": 0.01, "tp_pct": 0.01},
        "breakout": {"donchian_period": 20, "sl_pct": 0.01, "tp_pct": 0.02}, "mean_reversion": {"bb_period": 20, "bb_std": 2.0, "sl_pct": 0.01, "tp_pct": 0.02},
        "macd": {"fast_window": 12, "slow_window": 26, "signal_window": 9, "sl_pct": 0.01, "tp_pct": 0.02},
        "stochastic": {"k_period": 14, "d_period": 3, "oversold": 25, "overbought": 75, "sl_pct": 0.01, "tp_pct": 0.02},
        "atr_breakout": {"donchian_period": 15, "atr_window": 14, "atr_multiplier": 2.0, "sl_pct": 0.015, "tp_pct": 0.02},
    }
    out = None
    for name, p in grids.items():
        c = sg.signals(bars(spark, sf), name, [p]).groupBy("symbol").agg(
            F.lit(name).alias("strategy"), F.count_if(F.col("signal") == 1).alias("entries"), F.count_if(F.col("signal") == -1).alias("exits"))
        out = c if out is None else out.unionByName(c)
    return out


# a result table of many runs: one row per order
RESULTS = """SELECT o_orderkey AS result_id, o_custkey AS run_id, o_orderstatus AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'H4' ELSE 'D' END AS timeframe,
 o_orderpriority AS strategy_type, '{"w": ' || (o_orderkey % 50) || '}' AS params, o_totalprice / 500000 - 0.5 AS total_return, o_totalprice / 100000 - 2.5 AS sharpe_ratio,
 o_totalprice / 500000 AS psr, o_orderkey % 40 AS num_trades, (o_custkey % 100) / 100 AS max_drawdown FROM orders"""


def results(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("symbol"),
        F.element_at(F.array(F.lit("H1"), F.lit("H4"), F.lit("D")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("timeframe"),
        F.col("o_orderpriority").alias("strategy_type"),
        F.concat(F.lit('{"w": '), (F.col("o_orderkey") % 50).cast("string"), F.lit("}")).alias("params"),
        (F.col("o_totalprice") / 500000 - 0.5).alias("total_return"), (F.col("o_totalprice") / 100000 - 2.5).alias("sharpe_ratio"),
        (F.col("o_totalprice") / 500000).alias("psr"), (F.col("o_orderkey") % 40).alias("num_trades"), (F.col("o_custkey") % 100 / 100).alias("max_drawdown"))


@query("A27_best_parameters", f"""SELECT strategy_type, symbol, timeframe, arg_max(params, (sharpe_ratio, -result_id)) AS best_params, {r('max(sharpe_ratio)')} AS best_sharpe
FROM ({RESULTS}) GROUP BY 1, 2, 3""")
def best_parameters(spark, sf):
    return rounded(results(spark, sf).groupBy("strategy_type", "symbol", "timeframe").agg(
        F.max_by("params", F.struct("sharpe_ratio", -F.col("result_id"))).alias("best_params"), F.max("sharpe_ratio").alias("best_sharpe")), "best_sharpe")


@query("A28_timeframe_comparison", f"""SELECT timeframe, strategy_type, {r('avg(total_return)')} AS avg_return, {r('avg(sharpe_ratio)')} AS avg_sharpe,
 {r('avg(max_drawdown)')} AS avg_drawdown FROM ({RESULTS}) GROUP BY 1, 2""")
def timeframe_comparison(spark, sf):
    g = results(spark, sf).groupBy("timeframe", "strategy_type").agg(
        F.avg("total_return").alias("avg_return"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("max_drawdown").alias("avg_drawdown"))
    return rounded(g.orderBy(F.desc("avg_sharpe")), "avg_return", "avg_sharpe", "avg_drawdown")


@query("A29_strategy_comparison", f"""SELECT strategy_type, count(*) AS n_runs, {r('avg(sharpe_ratio)')} AS avg_sharpe, {r('max(sharpe_ratio)')} AS max_sharpe,
 {r('avg(total_return)')} AS avg_return FROM ({RESULTS}) GROUP BY 1""")
def strategy_comparison(spark, sf):
    g = results(spark, sf).groupBy("strategy_type").agg(
        F.count("*").alias("n_runs"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.max("sharpe_ratio").alias("max_sharpe"), F.avg("total_return").alias("avg_return"))
    return rounded(g, "avg_sharpe", "max_sharpe", "avg_return")


@query("O2_top_by_sharpe", f"""WITH g AS ({RESULTS}), t AS (SELECT * FROM g WHERE sharpe_ratio > 0.5 ORDER BY sharpe_ratio DESC, result_id LIMIT 10)
SELECT result_id, symbol, timeframe, strategy_type, {r('sharpe_ratio')} AS sharpe_ratio, params FROM t""")
def top_by_sharpe(spark, sf):
    t = results(spark, sf).filter("sharpe_ratio > 0.5").orderBy(F.desc("sharpe_ratio"), "result_id").limit(10)
    return rounded(t.select("result_id", "symbol", "timeframe", "strategy_type", "sharpe_ratio", "params"), "sharpe_ratio")


@query("O3_grid_order", f"""SELECT result_id, num_trades, {r('s')} AS sharpe_ratio, rank FROM (SELECT result_id, num_trades, sharpe_ratio AS s,
 row_number() OVER (ORDER BY num_trades > 0 DESC, sharpe_ratio DESC, result_id) AS rank FROM ({RESULTS})) WHERE rank <= 100""")
def grid_order(spark, sf):
    top = results(spark, sf).orderBy(F.desc(F.col("num_trades") > 0), F.desc("sharpe_ratio"), "result_id").limit(100)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc(F.col("num_trades") > 0), F.desc("sharpe_ratio"), "result_id")  # 100 rows
    return rounded(top.select("result_id", "num_trades", "sharpe_ratio", F.row_number().over(w).alias("rank")), "sharpe_ratio")


@query("O4_best_per_run", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sharpe_ratio DESC, result_id) AS rn FROM ({RESULTS}))
SELECT run_id, result_id, strategy_type, {r('sharpe_ratio', 9)} AS sharpe_ratio, {r('100000 * (1 + total_return)', 4)} AS final_capital FROM b WHERE rn = 1""")
def best_per_run(spark, sf):
    b = sc.latest_by(results(spark, sf).withColumn("_first", -F.col("result_id")), ["run_id"], ["sharpe_ratio", "_first"])
    out = b.select("run_id", "result_id", "strategy_type", "sharpe_ratio", rnd(100000 * (1 + F.col("total_return")), 4).alias("final_capital"))
    return rounded(out, "sharpe_ratio", digits=9)


@query("O13_result_filters", f"""SELECT 'sharpe' AS view_name, result_id, {r('sharpe_ratio', 9)} AS sharpe_ratio, psr, num_trades FROM ({RESULTS}) WHERE sharpe_ratio >= 1 AND num_trades >= 5
UNION ALL SELECT 'psr', result_id, {r('sharpe_ratio', 9)}, psr, num_trades FROM ({RESULTS}) WHERE psr >= 0.5 AND num_trades >= 5""")
def result_filters(spark, sf):
    res = results(spark, sf).filter("num_trades >= 5")
    views = F.array_compact(F.array(F.when(F.col("sharpe_ratio") >= 1, "sharpe"), F.when(F.col("psr") >= 0.5, "psr")))
    return rounded(res.select(F.explode(views).alias("view_name"), "result_id", "sharpe_ratio", "psr", "num_trades"), "sharpe_ratio", digits=9)
