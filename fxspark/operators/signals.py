"""Strategy signals, positions, trades and performance metrics.

The position model here is long or flat, entered and left at the closing price of the
signal bar, without cash, fees, slippage or stop orders. ``sl_pct`` and ``tp_pct`` may stand in a grid
(the stop width of the ATR strategy is an output column) but do not end trades, so runs do not differ by them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import TIMEFRAME_HOURS, finite
from ..functions.stats import norm_cdf
from . import indicators as ind
from .grid import run_statistics
from .quantiles import HOT_ROWS, group_quantiles
from .series import ALL_BEFORE, BLOCK_ROWS, Rolling, Series

Params = dict[str, Any]
MAX_GRID = 100_000


@dataclass(frozen=True)
class Strategy:
    """One registered strategy: its grid keys, which points are valid and how it signals."""

    keys: tuple[str, ...]
    signal_keys: tuple[str, ...]
    lookback: Callable[[Params], int]
    signal: Callable[[Rolling, Params], tuple[Column, Column]]
    valid: Callable[[Params], bool] = lambda p: True
    averages: Callable[[Params], dict[str, tuple[str, int, bool]]] = lambda p: {}


def _need(rl: Rolling, name: str, make: Callable[[], Any]) -> None:
    """Add an indicator once, however many grid points use it."""
    if name not in rl.df.columns:
        make()


def _crosses(rl: Rolling, a: str, b: str) -> tuple[Column, Column]:
    return ind.crossed_above(rl, a, b), ind.crossed_below(rl, a, b)


def _trend(rl: Rolling, p: Params):
    return _crosses(rl, f"{p['ma_type']}_{p['fast_window']}", f"{p['ma_type']}_{p['slow_window']}")


def _scalping(rl: Rolling, p: Params):
    name = f"rsi_{p['rsi_period']}"
    _need(rl, name, lambda: ind.rsi(rl, p["rsi_period"]))
    return ind.crossed_below(rl, name, float(p["oversold"])), ind.crossed_above(rl, name, float(p["overbought"]))


def _breakout(rl: Rolling, p: Params):
    pre = f"dc{p['donchian_period']}"
    _need(rl, f"{pre}_upper", lambda: ind.donchian(rl, p["donchian_period"], pre))
    return F.col("close") > F.col(f"{pre}_upper"), F.col("close") < F.col(f"{pre}_lower")


def _reversion(rl: Rolling, p: Params):
    pre = f"bb{p['bb_period']}"
    _need(rl, f"{pre}_mid", lambda: ind.bollinger(rl, p["bb_period"], 2.0, pre))
    mid, sd = F.col(f"{pre}_mid"), F.col(f"{pre}_sd")
    return F.col("close") < mid - p["bb_std"] * sd, F.col("close") > mid + p["bb_std"] * sd


def _macd(rl: Rolling, p: Params):
    pre = f"macd_{p['fast_window']}_{p['slow_window']}"
    return _crosses(rl, pre, f"{pre}_{p['signal_window']}")


def _stochastic(rl: Rolling, p: Params):
    pre = f"st{p['k_period']}_{p['d_period']}"
    _need(rl, f"{pre}_k", lambda: ind.stochastic(rl, p["k_period"], p["d_period"], pre))
    up, down = _crosses(rl, f"{pre}_k", f"{pre}_d")
    before = rl.prev(f"{pre}_k")
    return up & (before < p["oversold"]), down & (before > p["overbought"])


STRATEGIES: dict[str, Strategy] = {
    "trend_following": Strategy(
        ("ma_type", "fast_window", "slow_window", "sl_pct", "tp_pct"), ("ma_type", "fast_window", "slow_window"),
        lambda p: p["slow_window"] + 1, _trend, lambda p: p["fast_window"] < p["slow_window"],
        lambda p: {f"ema_{n}": ("close", n, False) for n in (p["fast_window"], p["slow_window"])} if p["ma_type"] == "ema" else {},
    ),
    "scalping": Strategy(
        ("rsi_period", "oversold", "overbought", "sl_pct", "tp_pct"), ("rsi_period", "oversold", "overbought"),
        lambda p: p["rsi_period"] + 2, _scalping, lambda p: p["oversold"] < p["overbought"],
    ),
    "breakout": Strategy(
        ("donchian_period", "sl_pct", "tp_pct"), ("donchian_period",), lambda p: p["donchian_period"] + 1, _breakout,
    ),
    "mean_reversion": Strategy(
        ("bb_period", "bb_std", "sl_pct", "tp_pct"), ("bb_period", "bb_std"), lambda p: p["bb_period"] + 1, _reversion,
    ),
    "macd": Strategy(
        ("fast_window", "slow_window", "signal_window", "sl_pct", "tp_pct"), ("fast_window", "slow_window", "signal_window"),
        lambda p: 2, _macd, lambda p: p["fast_window"] < p["slow_window"],
    ),
    "stochastic": Strategy(
        ("k_period", "d_period", "oversold", "overbought", "sl_pct", "tp_pct"), ("k_period", "d_period", "oversold", "overbought"),
        lambda p: p["k_period"] + p["d_period"] + 1, _stochastic, lambda p: p["d_period"] < p["k_period"],
    ),
    "atr_breakout": Strategy(
        ("donchian_period", "atr_window", "atr_multiplier", "sl_pct", "tp_pct"), ("donchian_period",),
        lambda p: max(p["donchian_period"], p["atr_window"]) + 1, _breakout,
    ),
}


def validate_grid(strategy: str, grid: dict[str, list]) -> None:
    """Every required key must be present with a non-empty list."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    missing = [k for k in STRATEGIES[strategy].keys if k not in grid]
    if missing:
        raise ValueError(f"strategy {strategy!r} lacks grid keys {missing}")
    for k in STRATEGIES[strategy].keys:
        if not isinstance(grid[k], list) or not grid[k]:
            raise ValueError(f"grid key {k!r} must be a non-empty list")


def grid_points(strategy: str, grid: dict[str, list]) -> list[Params]:
    """All valid points of a grid, in the order of its lists."""
    validate_grid(strategy, grid)
    st = STRATEGIES[strategy]
    points = [dict(zip(st.keys, v)) for v in product(*(grid[k] for k in st.keys))]
    points = [p for p in points if st.valid(p)]
    if len(points) > MAX_GRID:
        raise ValueError(f"{len(points)} grid points exceed {MAX_GRID}; split the grid")
    return points


def distinct_signals(strategy: str, points: list[Params]) -> list[Params]:
    """Points that differ in what they signal; stop and target widths do not."""
    st = STRATEGIES[strategy]
    seen = {tuple(p[k] for k in st.signal_keys): p for p in reversed(points)}
    return list(reversed(seen.values()))


def atr_stop(close, atr, multiplier: float, fallback: float) -> Column:
    """Stop width from the ATR, clipped to 0.1 % .. 10 %; the fallback where it is undefined."""
    return F.greatest(F.lit(0.001), F.least(F.lit(0.1), finite(F.try_divide(atr, close) * multiplier, fallback)))


def signal_frame(bars: DataFrame, strategy: str, points: list[Params]) -> Rolling:
    """A rolling frame holding every indicator the points need, each computed once."""
    st = STRATEGIES[strategy]
    s = ind.bar_series(bars).number()
    averages: dict[str, tuple[str, int, bool]] = {}
    for p in points:
        averages |= st.averages(p)
    if strategy == "macd":
        spans = sorted({p[k] for p in points for k in ("fast_window", "slow_window")})
        s = s.ema({f"_e{n}": ("close", n, False) for n in spans})
        lines = sorted({(p["fast_window"], p["slow_window"]) for p in points})
        s = s.with_columns({f"macd_{f}_{w}": F.col(f"_e{f}") - F.col(f"_e{w}") for f, w in lines})
        s = Series(s.df.drop(*(f"_e{n}" for n in spans)), s.keys, s.order, s.bucket)
        ends = sorted({(p["fast_window"], p["slow_window"], p["signal_window"]) for p in points})
        s = s.ema({f"macd_{f}_{w}_{g}": (f"macd_{f}_{w}", g, False) for f, w, g in ends})
    elif averages:
        s = s.ema(averages)
    rl = s.rolling(max(st.lookback(p) for p in points) + 1, numbered=True)
    if strategy == "trend_following":
        windows = sorted({p[k] for p in points if p["ma_type"] == "sma" for k in ("fast_window", "slow_window")})
        rl.add({f"sma_{n}": ind.sma(rl, n) for n in windows})
    return rl


def signal_value(up: Column, down: Column) -> Column:
    """1 to enter, -1 to leave, NULL for neither or both."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.nullif(one(up) - one(down), F.lit(0))


def signals(bars: DataFrame, strategy: str, points: list[Params]) -> DataFrame:
    """Long rows (series, param_id, _rn, ts, close, log_ret, signal): 1 enters, -1 leaves, NULL holds."""
    s = signal_rows(bars, strategy, points)
    return s.df.select(*s.keys, "_rn", "ts", "close", "log_ret", F.posexplode_outer("_signals").alias("param_id", "signal"))


def signal_rows(bars: DataFrame, strategy: str, points: list[Params]) -> Series:
    """Bars with the array ``_signals``: for each point 1 where it enters, -1 where it leaves, else NULL."""
    st = STRATEGIES[strategy]
    rl = signal_frame(bars, strategy, points)
    # entries and exits read the row before through shared columns, so one window serves all points
    flags = [signal_value(*st.signal(rl, p)) for p in points]
    rl.waiting["log_ret"] = F.coalesce(ind.log_return(rl), F.lit(0.0))
    return rl.flush().add({"_signals": F.array(*flags)}).series()


PARAM_KEYS = [*ind.BAR_KEYS, "param_id"]


def positions(long: DataFrame, keys: list[str] = PARAM_KEYS) -> DataFrame:
    """Position, strategy return, equity, drawdown and finished trades for every bar.

    One pass over blocks of bars. What a block contributes depends on the position it is entered with
    only until its first signal, so each block keeps its results for "entered flat" and "entered long",
    and the block table picks one of the two per block.
    """
    # a struct of NULLs equals itself, so series without a key keep their blocks
    df = long.withColumn("_part", F.struct(*keys, F.floor((F.col("_rn") - 1) / BLOCK_ROWS).alias("_blk")))
    part = ["_part"]
    w = Window.partitionBy("_part").orderBy("_rn")
    run, before = w.rowsBetween(*ALL_BEFORE), w.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_prev", F.last("signal", ignorenulls=True).over(before)).withColumn(
        "_last", F.last("signal", ignorenulls=True).over(run)
    )
    first_known = F.col("signal").eqNullSafe(1) & F.col("_prev").eqNullSafe(-1)
    first_any = F.col("signal").eqNullSafe(1) & (F.coalesce("_prev", F.lit(-1)) == -1)
    entry = {"rn": "_rn", "ts": "ts", "close": "close"}
    local = local.withColumns(
        {
            "_known": F.coalesce(F.sum(F.when(F.col("_prev") == 1, F.col("log_ret"))).over(run), F.lit(0.0)),
            "_open": F.coalesce(F.sum(F.when(F.col("_prev").isNull(), F.col("log_ret"))).over(run), F.lit(0.0)),
            **{f"_e1_{k}": F.last(F.when(first_known, F.col(c)), ignorenulls=True).over(run) for k, c in entry.items()},
            **{f"_e0_{k}": F.last(F.when(first_any, F.col(c)), ignorenulls=True).over(run) for k, c in entry.items()},
        }
    )
    both = F.col("_known") + F.col("_open")
    local = local.withColumns({"_v0": F.max("_known").over(run), "_v1": F.max(both).over(run)})
    # the latest row at the running peak
    local = local.withColumns(
        {
            "_a0": F.max(F.when(F.col("_known") == F.col("_v0"), F.col("_rn"))).over(run),
            "_a1": F.max(F.when(both == F.col("_v1"), F.col("_rn"))).over(run),
        }
    )
    kept = ["_last", "_known", "_open", "_v0", "_v1", "_a0", "_a1", *(f"_e{i}_{k}" for i in (0, 1) for k in entry)]
    ends = local.groupBy(*part).agg(*(F.max_by(c, "_rn").alias(f"b{c}") for c in kept))
    by_block = Window.partitionBy(*(f"_part.{k}" for k in keys)).orderBy("_part._blk")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_in", F.coalesce(F.last("b_last", ignorenulls=True).over(earlier), F.lit(-1)) == 1)
    pick = lambda yes, no: F.when(F.col("_in"), F.col(yes)).otherwise(F.col(no))
    ends = ends.withColumns(
        {"_sum": F.col("b_known") + F.when(F.col("_in"), F.col("b_open")).otherwise(0.0), "_pv": pick("b_v1", "b_v0"), "_pa": pick("b_a1", "b_a0")}
        | {f"_ne_{k}": pick(f"b_e1_{k}", f"b_e0_{k}") for k in entry}
    )
    ends = ends.withColumns(
        {"_base": F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))}
        | {f"_pe_{k}": F.last(f"_ne_{k}", ignorenulls=True).over(earlier) for k in entry}
    )
    top = F.max(F.struct((F.col("_base") + F.col("_pv")).alias("v"), F.col("_pa").alias("at"))).over(earlier)
    ends = ends.withColumn("_peak0", top).select(
        *part, "_in", "_base", F.col("_peak0.v").alias("_tv"), F.col("_peak0.at").alias("_ta"), *(f"_pe_{k}" for k in entry))

    rows = local.join(ends, part)
    was_long = F.when(F.col("_prev").isNull(), F.col("_in")).otherwise(F.col("_prev") == 1)
    here = F.col("_base") + pick("_v1", "_v0")
    mine = F.col("_tv").isNull() | (here >= F.col("_tv"))
    rows = rows.withColumns(
        {
            "was_long": was_long,
            "is_long": F.coalesce(F.col("_last") == 1, F.col("_in")),
            "log_equity": F.col("_base") + F.col("_known") + F.when(F.col("_in"), F.col("_open")).otherwise(0.0),
            "_topv": F.when(mine, here).otherwise(F.col("_tv")),
            "_topa": F.when(mine, pick("_a1", "_a0")).otherwise(F.col("_ta")),
        }
    )
    # equity starts at 1 before the first bar
    top = F.greatest(F.col("_topv"), F.lit(0.0))
    since = F.when(F.col("_topv") >= 0, F.col("_rn") - F.col("_topa")).otherwise(F.col("_rn"))
    closes = F.col("was_long") & (F.col("signal") == -1)
    return rows.select(
        *keys, "_rn", "ts", "close", "signal", "was_long", "is_long",
        F.when(F.col("was_long"), F.expm1("log_ret")).otherwise(0.0).alias("ret"),
        "log_equity",
        (1 - F.exp(F.col("log_equity") - top)).alias("drawdown"),
        since.alias("bars_under_peak"),
        *(F.when(closes, F.coalesce(pick(f"_e1_{k}", f"_e0_{k}"), F.col(f"_pe_{k}"))).alias(f"entry_{k}") for k in entry),
    )


def trades(pos: DataFrame, keys: list[str] = PARAM_KEYS) -> DataFrame:
    """One row per finished trade."""
    return pos.filter(F.col("entry_rn").isNotNull()).select(
        *keys,
        F.col("entry_rn").alias("entry_bar"), F.col("_rn").alias("exit_bar"),
        "entry_ts", F.col("ts").alias("exit_ts"),
        F.lit("long").alias("side"),
        F.col("entry_close").alias("entry_price"), F.col("close").alias("exit_price"),
        (F.col("_rn") - F.col("entry_rn")).alias("bars_held"),
        (F.col("close") / F.col("entry_close") - 1).alias("pnl_pct"),
    )


def streaks(df: DataFrame, keys: list[str], order: str, pnl: str) -> DataFrame:
    """Longest run of winning and of losing trades per key; a zero result breaks both."""
    s = Series.by_id(df, keys, order).number()
    n = F.col("_rn")
    s = s.scan(
        {
            "_nowin": ("max", F.when(~(F.col(pnl) > 0), n)),
            "_noloss": ("max", F.when(~(F.col(pnl) < 0), n)),
        }
    )
    run = lambda c: F.max(n - F.coalesce(c, F.lit(0)))
    return s.df.groupBy(*keys).agg(run("_nowin").alias("max_wins"), run("_noloss").alias("max_losses"))


def trade_statistics(tr: DataFrame, keys: list[str], pnl: str = "pnl_pct", aggs: list[Column] | tuple = ()) -> DataFrame:
    """Win rate, mean win and loss, best, worst, profit factor and expectancy per key."""
    x = F.col(pnl)
    wins, losses = F.when(x > 0, x), F.when(x < 0, x)
    zero = F.lit(0.0)
    gross_loss = F.abs(F.coalesce(F.sum(losses), zero))
    return tr.groupBy(*keys).agg(
        F.count("*").alias("num_trades"),
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(wins), zero).alias("avg_win_pct"),
        F.coalesce(F.avg(losses), zero).alias("avg_loss_pct"),
        F.max(x).alias("best_trade_pct"),
        F.min(x).alias("worst_trade_pct"),
        F.when(gross_loss > 0, F.coalesce(F.sum(wins), zero) / gross_loss).otherwise(0.0).alias("profit_factor"),
        F.avg(x).alias("expectancy"),
        *aggs,
    )


def psr(n: Column, mean: Column, sd1: Column, skew: Column, excess: Column, benchmark: float = 0.0, variant: str = "excess") -> Column:
    """Probabilistic Sharpe ratio; ``variant`` "plain" uses (kurtosis - 1) / 4 in place of excess / 4."""
    sr = F.when(sd1 > 0, mean / sd1).otherwise(0.0)
    tail = excess / 4 if variant == "excess" else (excess + 2) / 4
    denom = 1 - skew * sr + tail * sr * sr
    z = (sr - benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(F.when(denom > 0, denom))
    return F.when((n >= 3) & (denom > 0), norm_cdf(z)).otherwise(0.0)


def return_shape(df: DataFrame, keys: list[str], ret: str = "ret", periods: int = 252, aggs: list[Column] | tuple = (), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Mean, deviation, annual volatility, skewness and excess kurtosis (deviation with n-1), tail ratio, PSR."""
    base = group_quantiles(df, keys, [ret], {"p05": 0.05, "p95": 0.95}, hot_rows, [
        F.count(ret).alias("n_returns"), F.avg(ret).alias("mean_ret"), F.stddev_samp(ret).alias("sd_ret"),
        F.skewness(ret).alias("_g1"), F.kurtosis(ret).alias("_g2"), *aggs,
    ])
    return _shape(base, periods, ret)


def _shape(base: DataFrame, periods: int, ret: str = "ret") -> DataFrame:
    """The shape of returns from their moments and tails; other columns stay."""
    n = F.col("n_returns").cast("double")
    shrink = F.try_divide(n - 1, n)
    ok = (F.col("n_returns") > 2) & (F.col("sd_ret") > 0)
    more = [c for c in base.columns if c not in {"_g1", "_g2"} and not c.startswith(f"{ret}_p")]
    out = base.select(
        *more,
        F.when(ok, F.col("sd_ret") * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("volatility"),
        F.when(ok, F.col("_g1") * F.pow(shrink, F.lit(1.5))).otherwise(0.0).alias("skewness"),
        F.when(ok, (F.col("_g2") + 3) * shrink * shrink - 3).otherwise(0.0).alias("kurtosis"),
        F.when(F.abs(f"{ret}_p05") > 1e-12, F.col(f"{ret}_p95") / F.abs(f"{ret}_p05")).otherwise(0.0).alias("tail_ratio"),
    )
    return out.withColumn("psr", psr(F.col("n_returns"), F.col("mean_ret"), F.col("sd_ret"), F.col("skewness"), F.col("kurtosis")))


def sharpe(mean: Column, sd_pop: Column, n: Column, periods: int = 252) -> Column:
    return F.when((n < 2) | (sd_pop == 0), F.lit(0.0)).otherwise(mean / sd_pop * F.sqrt(F.lit(float(periods))))


def profit_factor(ret: Column) -> Column:
    gains = F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0)))
    return F.when(losses > 0, gains / losses).when(gains > 0, F.lit(float("inf"))).otherwise(0.0)


def grid_metrics(bars: DataFrame, strategy: str, runs: list[Params], periods: int = 252, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The metric row of every run, numbered by ``param_id``; :mod:`grid` says how bars and runs meet."""
    s = signal_rows(bars, strategy, runs)
    keys = PARAM_KEYS
    flags = s.with_columns({"_signals": F.transform("_signals", lambda x: F.coalesce(x, F.lit(0)).cast("tinyint"))})
    out = _shape(run_statistics(flags.df, list(s.keys), hot_rows), periods)
    hours = F.create_map(*(F.lit(v) for kv in TIMEFRAME_HOURS.items() for v in kv))[F.col("timeframe")]
    root = F.sqrt(F.lit(float(periods)))
    annual = F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n_bars")) - 1
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), finite(c, 0.0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    zf = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select(
        *keys, "total_return",
        clip(sharpe(F.col("mean_ret"), F.col("_sdp"), F.col("n_bars"), periods), -10.0, 10.0).alias("sharpe_ratio"),
        "psr", "max_drawdown", zf("win_rate"), zero("num_trades"), zf("profit_factor"),
        F.coalesce(F.col("_held") * hours, F.lit(0.0)).alias("avg_trade_duration_hours"),
        clip(F.try_divide(F.col("mean_ret"), F.col("_down")) * root, -10.0, 10.0).alias("sortino_ratio"),
        clip(F.try_divide(annual, F.col("max_drawdown")), -10.0, 10.0).alias("calmar_ratio"),
        clip(F.try_divide(F.col("_up_sum"), F.col("_down_sum")), -10.0, 100.0).alias("omega_ratio"),
        zf("expectancy"),
        F.coalesce("max_wins", F.lit(0)).cast("bigint").alias("max_consecutive_wins"),
        F.coalesce("max_losses", F.lit(0)).cast("bigint").alias("max_consecutive_losses"),
        zf("avg_win_pct"), zf("avg_loss_pct"), zf("best_trade_pct"), zf("worst_trade_pct"),
        (F.col("_dd_bars") * hours).alias("max_drawdown_duration_hours"),
        "volatility", "skewness", "kurtosis", "tail_ratio",
        F.when(F.col("max_drawdown") > 1e-12, F.col("total_return") / F.col("max_drawdown")).otherwise(0.0).alias("recovery_factor"),
    )


def backtest(bars: DataFrame, strategy: str, grid: dict[str, list]) -> DataFrame:
    """Metric row for every run of the grid: its points that signal alike are one run.

    ``params`` names what the run depends on; stop and target widths do not end trades here and are left out.
    """
    st = STRATEGIES[strategy]
    runs = distinct_signals(strategy, grid_points(strategy, grid))
    metrics = grid_metrics(bars, strategy, runs)
    params = F.array(*(F.to_json(F.struct(*(F.lit(p[k]).alias(k) for k in st.signal_keys))) for p in runs))
    return metrics.select(F.lit(strategy).alias("strategy_type"), params[F.col("param_id")].alias("params"), *(c for c in metrics.columns if c != "param_id"))
