"""Technical indicators over bars, computed on bounded blocks of each series.

Every function adds columns to a :class:`Rolling` frame; the caller sizes its ``lookback``. "Full"
windows are NULL until complete, as in the usual charting definitions.
"""

from __future__ import annotations

import sys
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import Rolling, Series

BAR_KEYS = ["symbol", "timeframe"]

# How a window without losses divides (RS = gain / loss)
ZERO_LOSS = {"eps": sys.float_info.epsilon, "tiny": 1e-10, "inf": float("inf")}


def bar_series(bars: DataFrame) -> Series:
    return Series.by_day(bars, BAR_KEYS, "ts")


def simple_return(rl: Rolling, n: int, col: str = "close") -> Column:
    return F.try_divide(F.col(col), rl.lag(col, n)) - 1


def log_return(rl: Rolling, col: str = "close") -> Column:
    """A fall to zero is -inf; without a value before it, or behind a zero, there is no return."""
    ratio = F.try_divide(F.col(col), rl.lag(col))
    return F.when(ratio == 0, F.lit(float("-inf"))).otherwise(F.ln(ratio))


def sma(rl: Rolling, n: int, col: str = "close", full: bool = True) -> Column:
    return rl.full(F.avg, col, n) if full else F.avg(col).over(rl.rows(n))


def rolling_std(rl: Rolling, n: int, col: str = "close") -> Column:
    return rl.full(F.stddev_samp, col, n)


def rsi(rl: Rolling, n: int = 14, zero_loss: str = "eps", name: str | None = None) -> Rolling:
    name = name or f"rsi_{n}"
    d = F.col("close") - rl.lag("close")
    rl.add({"_gain": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), "_loss": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0))})
    rl.add({"_ag": rl.full(F.avg, "_gain", n), "_al": rl.full(F.avg, "_loss", n)})
    loss = F.when(F.col("_al") == 0, F.lit(ZERO_LOSS[zero_loss])).otherwise(F.col("_al"))
    rl.add({name: 100 - 100 / (1 + F.col("_ag") / loss)})
    rl.df = rl.df.drop("_gain", "_loss", "_ag", "_al")
    return rl


def true_range(rl: Rolling, first_null: bool = False) -> Column:
    pc = rl.lag("close")
    hl, hc, lc = F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)
    tr = F.greatest(hl, hc, lc)
    return F.when(pc.isNotNull(), tr) if first_null else tr


def atr(rl: Rolling, n: int = 14, name: str = "atr") -> Rolling:
    rl.add({"true_range": true_range(rl)})
    return rl.add({name: rl.full(F.avg, "true_range", n)})


def bollinger(rl: Rolling, n: int = 20, width: float = 2.0, prefix: str = "bb") -> Rolling:
    mid, sd = f"{prefix}_mid", f"{prefix}_sd"
    rl.add({mid: sma(rl, n), sd: rolling_std(rl, n)})
    return rl.add(
        {
            f"{prefix}_upper": F.col(mid) + width * F.col(sd),
            f"{prefix}_lower": F.col(mid) - width * F.col(sd),
            f"{prefix}_width": F.try_divide(2 * width * F.col(sd), F.col(mid)),
        }
    )


def donchian(rl: Rolling, n: int, prefix: str = "dc") -> Rolling:
    """Highest high and lowest low of the ``n`` bars before the current one."""
    return rl.add({f"{prefix}_upper": rl.full(F.max, "high", n, -1), f"{prefix}_lower": rl.full(F.min, "low", n, -1)})


def stochastic(rl: Rolling, k: int = 14, d: int = 3, prefix: str = "st") -> Rolling:
    rl.add({"_ll": rl.full(F.min, "low", k), "_hh": rl.full(F.max, "high", k)})
    raw = 100 * (F.col("close") - F.col("_ll")) / (F.col("_hh") - F.col("_ll") + 1e-12)
    rl.add({f"{prefix}_k": F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))})
    rl.add({f"{prefix}_d": rl.full(F.avg, f"{prefix}_k", d)})
    rl.df = rl.df.drop("_ll", "_hh")
    return rl


def volume_ratio(rl: Rolling, n: int = 10) -> Rolling:
    rl.add({f"volume_sma_{n}": sma(rl, n, "volume")})
    # an average of zero divides to zero
    ratio = F.when(F.col(f"volume_sma_{n}") == 0, F.lit(0.0)).otherwise(F.try_divide("volume", f"volume_sma_{n}"))
    return rl.add({"volume_ratio": ratio})


def rolling_shape(rl: Rolling, col: str, n: int = 60) -> Rolling:
    """Bias-adjusted skewness (from 3 rows) and excess kurtosis (from 4) over at most ``n`` rows."""
    w = rl.rows(n)
    rl.add({"_n": F.count(col).over(w).cast("double"), "_g1": F.skewness(col).over(w), "_g2": F.kurtosis(col).over(w)})
    m = F.col("_n")
    rl.add(
        {
            f"{col}_skew": F.when(m >= 3, F.sqrt(m * (m - 1)) / (m - 2) * F.col("_g1")),
            f"{col}_kurtosis": F.when(m >= 4, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.col("_g2") + 6)),
        }
    )
    rl.df = rl.df.drop("_n", "_g1", "_g2")
    return rl


def crossed_above(rl: Rolling, a: str, b: str | float) -> Column:
    """``a`` is above ``b`` (a column or a level) now and was not on the row before. Needs ``rl.flush()``."""
    now, before = (F.col(b), rl.prev(b)) if isinstance(b, str) else (F.lit(b), F.lit(b))
    return F.coalesce((F.col(a) > now) & (rl.prev(a) <= before), F.lit(False))


def crossed_below(rl: Rolling, a: str, b: str | float) -> Column:
    """``a`` is below ``b`` (a column or a level) now and was not on the row before. Needs ``rl.flush()``."""
    now, before = (F.col(b), rl.prev(b)) if isinstance(b, str) else (F.lit(b), F.lit(b))
    return F.coalesce((F.col(a) < now) & (rl.prev(a) >= before), F.lit(False))


def macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False, prefix: str = "macd") -> Series:
    s = s.ema({"_fast": ("close", fast, adjust), "_slow": ("close", slow, adjust)})
    s = s.with_columns({prefix: F.col("_fast") - F.col("_slow")})
    s = s.ema({f"{prefix}_signal": (prefix, signal, adjust)})
    s = s.with_columns({f"{prefix}_hist": F.col(prefix) - F.col(f"{prefix}_signal")})
    return Series(s.df.drop("_fast", "_slow"), s.keys, s.order, s.bucket)


def fill_gaps(s: Series, cols: list[str], backward: bool = True, default: float | None = None) -> Series:
    """Forward fill, then backward fill, then a constant."""
    specs = {f"_f_{c}": ("last", F.col(c)) for c in cols}
    if backward:
        specs |= {f"_b_{c}": ("next", F.col(c)) for c in cols}
    s = s.scan(specs)
    parts = lambda c: [f"_f_{c}", *([f"_b_{c}"] if backward else [])]
    tail = [] if default is None else [F.lit(float(default))]
    s = s.with_columns({c: F.coalesce(*map(F.col, parts(c)), *tail) for c in cols})
    return Series(s.df.drop(*specs), s.keys, s.order, s.bucket)


def features(bars: DataFrame, adjust: bool = True, zero_loss: str = "inf") -> DataFrame:
    """The serving feature table of all indicators; rows before the longest window are left out."""
    s = bar_series(bars)
    averages = {f"ema_{n}": ("close", n, adjust) for n in (5, 10, 21, 50)} | {"_fast": ("close", 12, adjust), "_slow": ("close", 26, adjust)}
    s = s.ema(averages).with_columns({"macd": F.col("_fast") - F.col("_slow")})
    s = s.ema({"macd_signal": ("macd", 9, adjust)}).with_columns({"macd_hist": F.col("macd") - F.col("macd_signal")})
    rl = replace(s, df=s.df.drop("_fast", "_slow")).rolling(51)
    rl.add({f"return_{n}": simple_return(rl, n) for n in (1, 5, 10, 21)})
    rl.add({f"sma_{n}": sma(rl, n) for n in (5, 10, 21, 50)})
    rl.add({f"volatility_{n}": rolling_std(rl, n, "return_1") for n in (10, 21)})
    rsi(rl, 14, zero_loss)
    bollinger(rl)
    atr(rl, 14, "atr_14")
    volume_ratio(rl, 10)
    rl.add({"price_vs_sma50": F.try_divide("close", "sma_50") - 1})
    return rl.done().drop("bb_mid", "bb_sd", "true_range").dropna()


def sequences(rl: Rolling, cols: list[str], target: str, length: int, name: str = "sequence") -> Rolling:
    """The ``length`` rows before each row as an array, with the row's own target."""
    row = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
    rl.add({name: F.collect_list(row).over(rl.rows(length, -1)), "target": F.col(target)})
    rl.df = rl.df.filter(F.col("_rn") > length)
    return rl
