"""Market scalars: sessions, candle shape, decay weights, pips."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Disjoint UTC hours of the five trading sessions
SESSION_HOURS = {
    "sydney": [22, 23, 0, 1, 2, 3, 4, 5, 6],
    "tokyo": [7, 8],
    "london": [9, 10, 11, 12],
    "london_new_york_overlap": [13, 14, 15, 16],
    "new_york": [17, 18, 19, 20, 21],
}

# Pip sizes; every other pair has DEFAULT_PIP
PIP_SIZES = {"USD_JPY": 0.01, "EUR_JPY": 0.01, "GBP_JPY": 0.01}
DEFAULT_PIP = 0.0001

# Hours per bar of each timeframe
TIMEFRAME_HOURS = {
    "M1": 1 / 60, "M5": 5 / 60, "M15": 0.25, "M30": 0.5, "H1": 1.0, "H4": 4.0, "D": 24.0, "W": 168.0, "M": 720.0,
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def session_of(hour) -> Column:
    out = None
    for name, hours in SESSION_HOURS.items():
        hit = _c(hour).isin(hours)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def finite(c, default: float | None = None, lo: float | None = None, hi: float | None = None) -> Column:
    """NaN and infinities become ``default``; optional clamp of the rest."""
    x = _c(c)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    kept = x
    if lo is not None:
        kept = F.greatest(F.lit(float(lo)), kept)
    if hi is not None:
        kept = F.least(F.lit(float(hi)), kept)
    return F.when(bad, F.lit(default).cast("double")).otherwise(kept)


def is_bad(c) -> Column:
    """NaN or infinite."""
    x = _c(c).cast("double")
    return F.isnan(x) | (F.abs(x) == F.lit(math.inf))


def candle_shape() -> dict[str, Column]:
    return {
        "bar_range": F.col("high") - F.col("low"),
        "bar_body": F.abs(F.col("close") - F.col("open")),
        "bar_sign": F.signum(F.col("close") - F.col("open")),
    }


def price_range() -> dict[str, Column]:
    spread = F.col("high") - F.col("low")
    return {"price_range": spread, "price_range_pct": F.try_divide(spread, F.col("close"))}


def log_decay(hours, tau_hours: float = 20 / 60, k: float = 1.8, cap: float = 1.0) -> Column:
    """``min(cap, 1 / (k * log10(1 + h / tau)))``; ``cap`` at or before time zero."""
    h = _c(hours)
    slope = F.log10(1 + F.greatest(h, F.lit(0.0)) / tau_hours) * k
    return F.when((h <= 0) | (slope <= 0), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), 1.0 / slope))


def pip_size(pair) -> Column:
    table = F.create_map(*(F.lit(v) for kv in PIP_SIZES.items() for v in kv))
    return F.coalesce(F.try_element_at(table, _c(pair)), F.lit(DEFAULT_PIP))


def error_pips(predicted, actual, pair) -> Column:
    return F.abs(_c(predicted) - _c(actual)) / pip_size(pair)


def hours_between(later, earlier) -> Column:
    return seconds(later) / 3600.0 - seconds(earlier) / 3600.0


def seconds(ts) -> Column:
    """Seconds since the epoch with microseconds, for either timestamp type in UTC."""
    return F.unix_micros(_c(ts).cast("timestamp")) / 1e6
