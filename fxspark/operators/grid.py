"""Metric rows of a parameter grid from packed blocks of bars.

What a run does is one bit per bar: held or not. Bars come with the signals of all runs beside them and are packed in blocks of
``BLOCK_ROWS``: a block keeps its bars once, and for each run a bitset of the bars that the run surely holds, how many bars come before
its first signal, and its results for "entered flat" and "entered long". Windows over the blocks settle which of the two it was, what
equity, peak and open trade it was entered with; then each block measures its runs. Bars never meet runs as rows: a run costs a
bit per bar in storage, and numpy sees one block at a time.

A run's returns must come together once for their exact quantiles. Runs of up to ``hot_rows`` bars are summed up in one task each, from
the returns of held bars alone; longer ones are aggregated, and ranked across the cluster. NULL keys are series like others. A
trade without a price has no result and counts in ``num_trades`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .joins import same_keys
from .quantiles import HOT_ROWS, group_quantiles

BLOCK_ROWS = 4096
RUNS = 128  # runs of a block that are measured side by side
TAILS = {"p05": 0.05, "p95": 0.95}


def _columns(n: int) -> Iterator[slice]:
    return (slice(at, min(n, at + RUNS)) for at in range(0, n, RUNS))


def _last_where(hit: np.ndarray) -> np.ndarray:
    """The last row of each column where ``hit`` holds, -1 for none."""
    m = len(hit)
    return np.where(hit.any(axis=0), m - 1 - np.argmax(hit[::-1], axis=0), -1)


def _parts(column: pa.ChunkedArray, rows: np.ndarray) -> pa.StructArray:
    """Block names of these rows, with fields that may be null as the schema has them."""
    taken = column.combine_chunks().take(pa.array(rows, pa.int64()))
    return pa.StructArray.from_arrays([taken.field(i) for i in range(taken.type.num_fields)], [f.name for f in taken.type])


PACKED = ("param_id int, rn array<bigint>, close array<double>, move array<double>, held binary, open int, last int, known double, opened double, "
          "v0 double, a0 bigint, v1 double, a1 bigint, e0 bigint, p0 double, e1 bigint, p1 double")


def _pack(names: list[str]):
    """A row with the bars of the block, and a row for each run."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        rn, close, move = (table.column(c).to_numpy() for c in ("_rn", "close", "log_ret"))
        m = len(rn)
        signals = table.column("_signals").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
        out = {c: [None] for c in names}
        out["param_id"], out["rn"], out["close"], out["move"] = [-1], [rn], [close], [move]
        for cols in _columns(signals.shape[1]):
            s = signals[:, cols]
            at = np.maximum.accumulate(np.where(s != 0, np.arange(m)[:, None], -1), axis=0)
            before = np.vstack([np.full((1, s.shape[1]), -1), at[:-1]])
            state = np.where(before >= 0, np.take_along_axis(s, np.maximum(before, 0), 0), 0)
            known, opened = state == 1, before < 0
            sums = np.cumsum(np.where(known, move[:, None], 0.0), axis=0)
            ahead = np.cumsum(np.where(opened, move[:, None], 0.0), axis=0)
            both = sums + ahead
            enters = s == 1
            bits = np.packbits(known, axis=0)
            found = {
                "param_id": np.arange(cols.start, cols.stop), "held": [bits[:, j].tobytes() for j in range(s.shape[1])], "open": opened.sum(axis=0),
                "last": np.where(at[-1] >= 0, np.take_along_axis(s, np.maximum(at[-1:], 0), 0)[0], 0), "known": sums[-1], "opened": ahead[-1],  # both may be -inf
            }
            for i, (total, entry) in enumerate(((sums, enters & ((state == -1) | opened)), (both, enters & (state == -1)))):
                top, first = total.max(axis=0), _last_where(entry)
                found |= {f"v{i}": top, f"a{i}": rn[_last_where(total == top)], f"e{i}": [int(rn[k]) if k >= 0 else None for k in first],
                          f"p{i}": [float(close[k]) if k >= 0 else None for k in first]}
            for c in names:
                out[c] += list(found[c]) if c in found else [None] * s.shape[1]
        part = _parts(table.column("_part"), np.zeros(len(out["param_id"]), np.int64))
        kinds = {"param_id": pa.int32(), "rn": pa.list_(pa.int64()), "close": pa.list_(pa.float64()), "move": pa.list_(pa.float64()), "held": pa.binary(), "open": pa.int32(),
                 "last": pa.int32(), **{c: pa.int64() for c in ("a0", "a1", "e0", "e1")}}
        return pa.table({"_part": part, **{c: pa.array(out[c], kinds.get(c, pa.float64())) for c in names}})

    return run


def packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (_rn, close, log_ret, _signals) of series in packed blocks, stored."""
    part = F.struct(*keys, F.floor((F.col("_rn") - 1) / BLOCK_ROWS).alias("_blk"))
    rows = df.select(part.alias("_part"), "_rn", "close", "log_ret", "_signals")
    names = [c.split()[0] for c in PACKED.split(", ")]
    return kept(rows.groupBy("_part").applyInArrow(_pack(names), f"_part {rows.schema['_part'].dataType.simpleString()}, {PACKED}"), "runs")


def entered(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """What each run enters each block with: position, equity, peak (value and bar) and the open trade."""
    runs = blocks.filter("param_id >= 0").withColumns({f"_k_{k}": F.col(f"_part.{k}") for k in keys} | {"_blk": F.col("_part._blk")})
    earlier = Window.partitionBy(*(f"_k_{k}" for k in keys), "param_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("long", F.coalesce(F.last(F.when(F.col("last") != 0, F.col("last")), ignorenulls=True).over(earlier), F.lit(-1)) == 1)
    pick = lambda c: F.when(F.col("long"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    runs = runs.withColumns({
        "base": F.coalesce(F.sum(F.col("known") + F.when(F.col("long"), F.col("opened")).otherwise(0.0)).over(earlier), F.lit(0.0)),
        "entry": F.last(F.when(pick("e").isNotNull(), F.struct(pick("e").alias("rn"), pick("p").alias("close"))), ignorenulls=True).over(earlier)})
    top = F.max(F.struct((F.col("base") + pick("v")).alias("v"), pick("a").alias("a"))).over(earlier)
    runs = runs.withColumn("top", top).withColumn("over", F.coalesce(F.col("top.v") >= 0, F.lit(False)))  # equity is 1 before the first bar
    return runs.select("_part", "param_id", "held", "open", "last", "long", "base", F.when(F.col("over"), F.col("top.v")).otherwise(0.0).alias("peak"),
                       F.when(F.col("over"), F.col("top.a")).otherwise(0).alias("peak_rn"), F.col("entry.rn").alias("entry_rn"), F.col("entry.close").alias("entry_close"))


SUMS = ("s1", "s2", "s3", "s4", "below", "up", "down")
MEASURED = (f"param_id int, n bigint, log_equity double, fall double, under bigint, {', '.join(f'{s} double' for s in SUMS)}, "
            "held array<double>, trades array<struct<exit_bar: bigint, bars_held: bigint, pnl_pct: double>>")
TRADES = pa.list_(pa.struct([("exit_bar", pa.int64()), ("bars_held", pa.int64()), ("pnl_pct", pa.float64())]))


def _measure(table: pa.Table) -> pa.Table:
    """Of each run in a block: bars, equity behind it, deepest fall and longest time below a peak, sums of returns, returns of held bars, ended trades."""
    bars = table.filter(pc.equal(table.column("param_id"), -1))
    runs = table.filter(pc.greater_equal(table.column("param_id"), 0)).sort_by("param_id")
    rn, close, move = (bars.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("rn", "close", "move"))
    m, gain = len(rn), np.expm1(move)
    of = {c: runs.column(c).to_numpy() for c in ("open", "last", "long", "base", "peak", "peak_rn", "entry_rn", "entry_close")}
    bits = runs.column("held").to_pylist()
    out = {c.split()[0]: [] for c in MEASURED.split(", ") if " " in c and ":" not in c}
    out |= {"held": [], "trades": []}
    for cols in _columns(len(bits)):
        on, now = {c: v[cols] for c, v in of.items()}, bits[cols]
        held = np.unpackbits(np.frombuffer(b"".join(now), np.uint8).reshape(len(now), -1), axis=1)[:, :m].T.astype(bool)
        long = on["long"].astype(bool)
        held |= (np.arange(m)[:, None] < on["open"][None, :]) & long[None, :]
        after = np.vstack([held[1:], ((on["last"] == 1) | ((on["last"] == 0) & long))[None, :]])
        equity = on["base"] + np.cumsum(np.where(held, move[:, None], 0.0), axis=0)
        peak = np.maximum(np.maximum.accumulate(equity, axis=0), on["peak"])
        peak_rn = np.maximum(np.maximum.accumulate(np.where(equity >= peak, rn[:, None], -1), axis=0), on["peak_rn"])
        r = np.where(held, gain[:, None], 0.0)
        loss, win = np.minimum(r, 0.0), np.maximum(r, 0.0)
        found = {"n": np.full(len(now), m), "log_equity": equity[-1], "fall": (equity - peak).min(axis=0), "under": (rn[:, None] - peak_rn).max(axis=0),
                 **{f"s{k}": (r**k).sum(axis=0) for k in (1, 2, 3, 4)}, "below": (loss**2).sum(axis=0), "up": win.sum(axis=0), "down": -loss.sum(axis=0)}
        out["param_id"] += runs.column("param_id").to_pylist()[cols]
        for c, v in found.items():
            out[c] += v.tolist()
        leaves, enters = held & ~after, ~held & after
        for j in range(len(now)):
            out["held"].append(gain[held[:, j]])
            ends, starts = np.flatnonzero(leaves[:, j]), np.flatnonzero(enters[:, j])
            at, paid = rn[starts], close[starts]
            if long[j]:
                at, paid = np.r_[on["entry_rn"][j], at], np.r_[on["entry_close"][j], paid]
            k = len(ends)
            with np.errstate(divide="ignore", invalid="ignore"):
                pnl = close[ends] / paid[:k] - 1
            out["trades"].append([{"exit_bar": a, "bars_held": int(a - b), "pnl_pct": None if np.isnan(c) else c} for a, b, c in zip(rn[ends].tolist(), at[:k].tolist(), pnl.tolist())])
    part = _parts(runs.column("_part"), np.arange(len(runs)))
    kinds = {"param_id": pa.int32(), "n": pa.int64(), "under": pa.int64(), "held": pa.list_(pa.float64()), "trades": TRADES}
    return pa.table({"_part": part, **{c: pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items()}})


def measured(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block and run; see :func:`_measure`."""
    bars = blocks.filter("param_id < 0").select("_part", "param_id", "rn", "close", "move")
    both = bars.unionByName(entered(blocks, keys), allowMissingColumns=True)
    return both.groupBy("_part").applyInArrow(_measure, f"_part {blocks.schema['_part'].dataType.simpleString()}, {MEASURED}")


def longest_run(hit: np.ndarray) -> int:
    """The most rows in a row that hold."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


STATS = ("n_bars", "n_returns", "mean_ret", "sd_ret", "_sdp", "_g1", "_g2", "ret_p05", "ret_p95", "total_return", "max_drawdown", "_dd_bars", "_down", "_up_sum", "_down_sum",
         "num_trades", "win_rate", "avg_win_pct", "avg_loss_pct", "best_trade_pct", "worst_trade_pct", "profit_factor", "expectancy", "_held", "max_wins", "max_losses")
WHOLE = {"n_bars", "n_returns", "_dd_bars", "num_trades", "max_wins", "max_losses"}


def _between(values: np.ndarray, p: float) -> float:
    """The interpolated quantile, to the last bit as the built-in aggregate has it."""
    at = p * (len(values) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    lo, hi = np.partition(values, sorted({low, high}))[[low, high]]
    return float(lo if lo == hi else (high - at) * lo + (at - low) * hi)


def _summed(keys: list[str]):
    """All statistics of one run."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_blk")
        col = lambda c: table.column(c).to_numpy()
        n = int(col("n").sum())
        r = np.zeros(n)
        held = table.column("held").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        r[: len(held)] = held
        mean, d = r.mean(), r - r.mean()
        m2, m3, m4 = ((d**k).mean() for k in (2, 3, 4))
        s = dict(n_bars=n, n_returns=n, mean_ret=mean, sd_ret=np.sqrt((d**2).sum() / (n - 1)) if n > 1 else None, _sdp=np.sqrt(m2), _g1=m3 / m2**1.5 if m2 > 0 else None,
                 _g2=m4 / m2**2 - 3 if m2 > 0 else None, ret_p05=_between(r, 0.05), ret_p95=_between(r, 0.95), total_return=np.expm1(col("log_equity")[-1]),
                 max_drawdown=-np.expm1(col("fall").min()), _dd_bars=int(col("under").max()), _down=np.sqrt(col("below").sum() / n), _up_sum=col("up").sum(), _down_sum=col("down").sum())
        trades = table.column("trades").combine_chunks().flatten()
        s["num_trades"] = len(trades)
        if len(trades):
            x = trades.field("pnl_pct").to_numpy(zero_copy_only=False)
            s["_held"] = trades.field("bars_held").to_numpy().mean()
            with np.errstate(invalid="ignore"):
                s["max_wins"], s["max_losses"] = longest_run(x > 0), longest_run(x < 0)
            x = x[~np.isnan(x)]
            wins, losses = x[x > 0], x[x < 0]
            lost = abs(losses.sum())
            s |= dict(avg_win_pct=wins.mean() if len(wins) else 0.0, avg_loss_pct=losses.mean() if len(losses) else 0.0, profit_factor=wins.sum() / lost if lost > 0 else 0.0)
            if len(x):
                s |= dict(win_rate=(x > 0).mean(), best_trade_pct=x.max(), worst_trade_pct=x.min(), expectancy=x.mean())
        named = {k: pa.array([v.as_py()], v.type) for k, v in zip([*keys, "param_id"], key)}
        return pa.table({**named, **{c: pa.array([s.get(c)], pa.int64() if c in WHOLE else pa.float64()) for c in STATS}})

    return run


def run_statistics(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """A row of statistics for each series and run; ``df`` has the bars with ``_rn``, close, log_ret and the array ``_signals`` of all runs."""
    from .signals import streaks, trade_statistics

    blocks = packed(df, keys)
    sizes = blocks.filter("param_id < 0").groupBy(*(F.col(f"_part.{k}").alias(k) for k in keys)).agg(F.sum(F.size("rn")).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    each = [*keys, "param_id"]
    rows = measured(blocks, keys).select(*(F.col(f"_part.{k}").alias(k) for k in keys), F.col("_part._blk").alias("_blk"), "param_id", "n", "log_equity", "fall", "under", *SUMS, "held", "trades")
    if largest <= hot_rows:
        kinds = dict(rows.dtypes)
        schema = ", ".join([*(f"{k} {kinds[k]}" for k in each), *(f"{c} {'bigint' if c in WHOLE else 'double'}" for c in STATS)])
        return rows.groupBy(*each).applyInArrow(_summed(keys), schema)
    returns = rows.select(*each, F.explode(F.concat("held", F.array_repeat(F.lit(0.0), (F.col("n") - F.size("held")).cast("int")))).alias("ret"))
    shape = group_quantiles(returns, each, ["ret"], TAILS, hot_rows, [
        F.count("ret").alias("n_returns"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret"), F.stddev_pop("ret").alias("_sdp"),
        F.skewness("ret").alias("_g1"), F.kurtosis("ret").alias("_g2")])
    stored = kept(rows.drop("held"), "measured")
    sums = stored.groupBy(*each).agg(
        F.sum("n").alias("n_bars"), F.expm1(F.max_by("log_equity", "_blk")).alias("total_return"), (-F.expm1(F.min("fall"))).alias("max_drawdown"), F.max("under").alias("_dd_bars"),
        F.sqrt(F.sum("below") / F.sum("n")).alias("_down"), F.sum("up").alias("_up_sum"), F.sum("down").alias("_down_sum"))
    trades = stored.select(*each, F.inline("trades"))
    out = same_keys(shape, sums, each)
    out = same_keys(out, trade_statistics(trades, each, aggs=[F.avg("bars_held").alias("_held")]), each, "left")
    return same_keys(out, streaks(trades, each, "exit_bar", "pnl_pct"), each, "left").select(*each, *STATS)
