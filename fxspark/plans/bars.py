"""Indicator windows over minute bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import indicators as ind
from ..operators import quality as ql
from ..operators.series import Series
from .inputs import BARS, bars, r, rounded, table
from .registry import query

ID = ["symbol", "ts"]


def rolling(spark, sf, lookback):
    return ind.bar_series(bars(spark, sf)).rolling(lookback)


def out(rl, *cols, digits=6):
    return rounded(rl.done().select(*ID, *cols), *cols, digits=digits)


def win(*parts: str) -> str:
    """SQL over numbered bars b0; all parts but the last are further levels b1, b2, ..."""
    sql = f"WITH b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({BARS}))"
    for i, m in enumerate(parts[:-1]):
        sql += f", b{i + 1} AS ({m})"
    return f"{sql} {parts[-1]}"


def fr(expr: str, n: int, end: int = 0) -> str:
    """``n`` rows ending at the current row (0) or ``-end`` rows before it."""
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"{expr} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 - end} PRECEDING AND {last})"


def full(expr: str, n: int, end: int = 0, lead: int = 0) -> str:
    return f"CASE WHEN rn >= {n - end + lead} THEN {fr(expr, n, end)} END"


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"


def final(level: int, digits: int = 6, **cols: str) -> str:
    return f"SELECT symbol, ts, {', '.join(f'{r(e, digits)} AS {c}' for c, e in cols.items())} FROM b{level}"


def step(level: int, **cols: str) -> str:
    return f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM b{level}"


RETURNS = {f"return_{n}": n for n in (1, 5, 10, 21)}


@query("W1_simple_returns", win(final(0, **{c: f"close / nullif({lag('close', n)}, 0) - 1" for c, n in RETURNS.items()})))
def simple_returns(spark, sf):
    rl = rolling(spark, sf, 21)
    return out(rl.add({c: ind.simple_return(rl, n) for c, n in RETURNS.items()}), *RETURNS)


@query("W2_log_return", win(final(0, log_return=f"ln(close / nullif({lag('close')}, 0))")))
def log_returns(spark, sf):
    rl = rolling(spark, sf, 1)
    return out(rl.add({"log_return": ind.log_return(rl)}), "log_return")


SMA = (5, 10, 20, 21, 50)
SMA_PARTIAL = (30, 50, 100, 200)


@query("W3_moving_averages", win(final(0, 9,  # averages of cents over up to 200 rows have no ties at nine digits
       **{f"sma_{n}": full("avg(close)", n) for n in SMA}, **{f"volume_sma_{n}": full("avg(volume)", n) for n in SMA},
       **{f"sma_any_{n}": fr("avg(close)", n) for n in SMA_PARTIAL})))
def moving_averages(spark, sf):
    rl = rolling(spark, sf, 200)
    cols = {f"sma_{n}": ind.sma(rl, n) for n in SMA} | {f"volume_sma_{n}": ind.sma(rl, n, "volume") for n in SMA}
    cols |= {f"sma_any_{n}": ind.sma(rl, n, full=False) for n in SMA_PARTIAL}
    return out(rl.add(cols), *cols, digits=9)


def ema_sql(col: str, span: int, adjust: bool) -> str:
    q = f"CAST({1 - 2 / (span + 1)!r} AS DOUBLE)"
    xs = f"list({col}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    if adjust:
        return f"list_reduce({xs}, lambda a, x: a * {q} + x) * (1 - {q}) / (1 - pow({q}, rn))"
    return f"list_reduce({xs}, lambda a, x: a * {q} + x * (1 - {q}))"


SPANS = (5, 12, 50, 200)


@query("W4_ema_recursive", win(final(0, **{f"ema_{n}": ema_sql("close", n, False) for n in SPANS})))
def ema_recursive(spark, sf):
    s = ind.bar_series(bars(spark, sf)).ema({f"ema_{n}": ("close", n, False) for n in SPANS})
    return rounded(s.result().select(*ID, *(f"ema_{n}" for n in SPANS)), *(f"ema_{n}" for n in SPANS))


@query("W5_ema_weighted", win(final(0, **{f"ema_{n}": ema_sql("close", n, True) for n in SPANS})))
def ema_weighted(spark, sf):
    s = ind.bar_series(bars(spark, sf)).ema({f"ema_{n}": ("close", n, True) for n in SPANS})
    return rounded(s.result().select(*ID, *(f"ema_{n}" for n in SPANS)), *(f"ema_{n}" for n in SPANS))


@query("W6_rolling_deviation", win(step(0, ret=f"close / nullif({lag('close')}, 0) - 1"), final(1,
       std_20=full("stddev_samp(close)", 20), vol_10=full("stddev_samp(ret)", 10, lead=1), vol_21=full("stddev_samp(ret)", 21, lead=1))))
def rolling_deviation(spark, sf):
    rl = rolling(spark, sf, 22)
    rl.add({"ret": ind.simple_return(rl, 1)})
    rl.add({"std_20": ind.rolling_std(rl, 20), **{f"vol_{n}": ind.rolling_std(rl, n, "ret") for n in (10, 21)}})
    return out(rl, "std_20", "vol_10", "vol_21")


def rsi_levels(level: int, n: int = 14):
    return (
        step(level, d=f"close - {lag('close')}"),
        step(level + 1, gain="coalesce(greatest(d, 0), 0)", loss="coalesce(greatest(-d, 0), 0)"),
        step(level + 2, ag=full("avg(gain)", n), al=full("avg(loss)", n)),
    )


def rsi_expr(zero: str) -> str:
    return f"100 - 100 / (1 + ag / CASE WHEN al = 0 THEN {zero} ELSE al END)"


@query("W7_rsi", win(*rsi_levels(0), final(3, rsi_eps=rsi_expr("2.220446049250313e-16"), rsi_tiny=rsi_expr("1e-10"),
                                               rsi_inf=rsi_expr("CAST('inf' AS DOUBLE)"))))
def rsi(spark, sf):
    rl = rolling(spark, sf, 15)
    for z in ind.ZERO_LOSS:
        ind.rsi(rl, 14, z, f"rsi_{z}")
    return out(rl, "rsi_eps", "rsi_tiny", "rsi_inf")


def _macd_cols(p, adjust):
    return step(0, **{p: f"{ema_sql('close', 12, adjust)} - {ema_sql('close', 26, adjust)}"}), \
        step(1, **{f"{p}_signal": ema_sql(p, 9, adjust)})


@query("W8_macd", win(*_macd_cols("macd", False), final(2, macd="macd", macd_signal="macd_signal", macd_hist="macd - macd_signal")))
def macd(spark, sf):
    s = ind.macd(ind.bar_series(bars(spark, sf)))
    return rounded(s.result().select(*ID, "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


@query("W8_macd_weighted", win(*_macd_cols("macd", True), final(2, macd="macd", macd_signal="macd_signal", macd_hist="macd - macd_signal")))
def macd_weighted(spark, sf):
    s = ind.macd(ind.bar_series(bars(spark, sf)), adjust=True)
    return rounded(s.result().select(*ID, "macd", "macd_signal", "macd_hist"), "macd", "macd_signal", "macd_hist")


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


@query("W9_average_true_range", win(step(0, tr=TR), final(1, true_range="tr", atr=full("avg(tr)", 14))))
def average_true_range(spark, sf):
    return out(ind.atr(rolling(spark, sf, 15)), "true_range", "atr")


@query("W10_bollinger_bands", win(step(0, m=full("avg(close)", 20), s=full("stddev_samp(close)", 20)),
       final(1, bb_upper="m + 2 * s", bb_lower="m - 2 * s", bb_width="4 * s / nullif(m, 0)")))
def bollinger_bands(spark, sf):
    return out(ind.bollinger(rolling(spark, sf, 20)), "bb_upper", "bb_lower", "bb_width")


@query("W11_donchian_channel", win(final(0, dc_upper=full("max(high)", 20, -1),
                                             dc_lower=full("min(low)", 20, -1))))
def donchian_channel(spark, sf):
    return out(ind.donchian(rolling(spark, sf, 20), 20), "dc_upper", "dc_lower")


@query("W12_stochastic", win(step(0, ll=full("min(low)", 14), hh=full("max(high)", 14)),
       step(1, k="CASE WHEN rn >= 14 THEN greatest(0, least(100, 100 * (close - ll) / (hh - ll + 1e-12))) END"),
       final(2, st_k="k", st_d=full("avg(k)", 3, lead=13))))
def stochastic(spark, sf):
    return out(ind.stochastic(rolling(spark, sf, 17)), "st_k", "st_d")


@query("W13_volume_ratio", win(step(0, v=full("avg(volume)", 10), m=full("avg(close)", 50)),
       final(1, volume_sma_10="v", volume_ratio="CASE WHEN v = 0 THEN 0 ELSE volume / v END", price_vs_sma50="(close - m) / nullif(m, 0)")))
def volume_ratio(spark, sf):
    rl = ind.volume_ratio(rolling(spark, sf, 50))
    rl.add({"_m": ind.sma(rl, 50)})
    rl.add({"price_vs_sma50": F.try_divide(F.col("close") - F.col("_m"), F.col("_m"))})
    return out(rl, "volume_sma_10", "volume_ratio", "price_vs_sma50")


@query("W14_rolling_shape", win(final(0, close_skew=f"CASE WHEN rn >= 3 THEN {fr('skewness(close)', 60)} END",
                                          close_kurtosis=f"CASE WHEN rn >= 4 THEN {fr('kurtosis(close)', 60)} END")))
def rolling_shape(spark, sf):
    return out(ind.rolling_shape(rolling(spark, sf, 60), "close"), "close_skew", "close_kurtosis")


GAPPY = "CASE WHEN volume % 3 = 0 THEN NULL ELSE close END"


@query("W15_fill_gaps", win(step(0, x=GAPPY), final(1, x=
       "coalesce(last(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
       "first(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")))
def fill_gaps(spark, sf):
    s = ind.fill_gaps(ind.bar_series(bars(spark, sf).withColumn("x", F.expr(GAPPY))), ["x"], default=0)
    return rounded(s.result().select(*ID, "x"), "x")


SPOILED = "CASE WHEN volume % 5 = 0 THEN CAST('inf' AS DOUBLE) WHEN volume % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE {0} END"


def _repair_sql(c):
    return (f"coalesce(last(x_{c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
            f"first(x_{c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@query("P1_repair_prices", win(step(0, b_open=SPOILED.format("open"), b_close=SPOILED.format("close")),
       step(1, x_open="CASE WHEN isinf(b_open) OR isnan(b_open) THEN NULL ELSE b_open END",
            x_close="CASE WHEN isinf(b_close) OR isnan(b_close) THEN NULL ELSE b_close END"),
       final(2, open=_repair_sql("open"), close=_repair_sql("close"))))
def repair_prices(spark, sf):
    b = bars(spark, sf).withColumns({c: F.expr(SPOILED.format(c)) for c in ("open", "close")})
    s = ind.fill_gaps(ind.bar_series(b.withColumns({c: mk.finite(c) for c in ("open", "close")})), ["open", "close"])
    return rounded(s.result().select(*ID, "open", "close"), "open", "close")


@query("P2_drop_incomplete", win(step(0, return_21=f"close / nullif({lag('close', 21)}, 0) - 1", sma_50=full("avg(close)", 50)),
       f"SELECT symbol, ts, {r('return_21')} AS return_21, {r('sma_50')} AS sma_50 FROM b1 WHERE return_21 IS NOT NULL AND sma_50 IS NOT NULL"))
def drop_incomplete(spark, sf):
    rl = rolling(spark, sf, 50)
    rl.add({"return_21": ind.simple_return(rl, 21), "sma_50": ind.sma(rl, 50)})
    return out(rl, "return_21", "sma_50").dropna()


@query("P3_minimum_length", f"""WITH b AS ({BARS}), d AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n FROM b GROUP BY ALL)
SELECT symbol, day, n FROM d WHERE n >= 50""")
def minimum_length(spark, sf):
    n = bars(spark, sf).groupBy("symbol", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("n"))
    return n.filter("n >= 50")


@query("P21_candle_shape", win(final(0, bar_range="high - low", bar_body="abs(close - open)", bar_sign="sign(close - open)",
                                         log_return=f"ln(close / nullif({lag('close')}, 0))")))
def candle_shape(spark, sf):
    rl = rolling(spark, sf, 1)
    rl.add(mk.candle_shape() | {"log_return": ind.log_return(rl)})
    return out(rl, "bar_range", "bar_body", "bar_sign", "log_return")


@query("P22_price_range", f"SELECT symbol, ts, {r('high - low')} AS price_range, {r('(high - low) / nullif(close, 0)')} AS price_range_pct FROM ({BARS})")
def price_range(spark, sf):
    return rounded(bars(spark, sf).select(*ID, *(e.alias(n) for n, e in mk.price_range().items())), "price_range", "price_range_pct")


@query("W16_lag_features", win(f"SELECT symbol, ts, volume, {lag('volume')} AS lag1, {lag('volume', 2)} AS lag2, isodow(ts) - 1 AS dow FROM b0"))
def lag_features(spark, sf):
    rl = rolling(spark, sf, 2)
    rl.add({"lag1": rl.lag("volume"), "lag2": rl.lag("volume", 2), "dow": F.weekday(F.col("ts").cast("timestamp"))})
    return rl.done().select(*ID, "volume", "lag1", "lag2", "dow")


@query("W17_crosses", win(step(0, a=full("avg(close)", 5), b=full("avg(close)", 20)),
       f"SELECT symbol, ts, coalesce(a > b AND {lag('a')} <= {lag('b')}, false) AS above, coalesce(a < b AND {lag('a')} >= {lag('b')}, false) AS below FROM b1"))
def crosses(spark, sf):
    rl = rolling(spark, sf, 21)
    rl.add({"a": ind.sma(rl, 5), "b": ind.sma(rl, 20)})
    flags = {"above": ind.crossed_above(rl, "a", "b"), "below": ind.crossed_below(rl, "a", "b")}
    rl.flush().add(flags)
    return rl.done().select(*ID, "above", "below")


@query("W24_time_order", """
WITH s AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM events)
SELECT event_type, min(gap) >= 0 AS monotonic, count(*) FILTER (gap < 0) AS backward_steps FROM s GROUP BY 1""")
def time_order(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rl = Series.by_id(e, ["event_type"], "event_id").rolling(1)
    rl.add({"gap": F.col("us") - rl.lag("us")})
    return rl.done().groupBy("event_type").agg(
        (F.min("gap") >= 0).alias("monotonic"), F.count_if(F.col("gap") < 0).alias("backward_steps"))


@query("W25_sequences", f"""
WITH b AS (SELECT *, date_trunc('day', ts) AS split FROM ({BARS})),
s AS (SELECT symbol, ts, close AS target, list(close) OVER w AS seq FROM b
      WINDOW w AS (PARTITION BY symbol, split ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, {r('target')} AS target, len(seq) AS n, {r('list_sum(seq)')} AS seq_sum, {r('seq[1]')} AS seq_first, {r('seq[8]')} AS seq_last
FROM s WHERE len(seq) = 8""")
def sequences(spark, sf):
    b = bars(spark, sf).withColumn("split", F.to_date("ts"))
    rl = ind.sequences(Series.by_day(b, ["symbol", "split"]).rolling(8), ["close"], "close", 8)
    s = F.col("sequence")
    return rounded(rl.done().select(
        *ID, "target", F.size(s).alias("n"), F.aggregate(s, F.lit(0.0), lambda a, x: a + x).alias("seq_sum"),
        F.element_at(s, 1).alias("seq_first"), F.element_at(s, -1).alias("seq_last")), "target", "seq_sum", "seq_first", "seq_last")


@query("S19_feature_table", win(*_macd_cols("macd", True), *rsi_levels(2), step(5, tr=TR, ret=f"close / nullif({lag('close')}, 0) - 1"),
       step(6, m=full("avg(close)", 20), s=full("stddev_samp(close)", 20), v=full("avg(volume)", 10)), f"""
SELECT symbol, ts, {r(ema_sql('close', 21, True))} AS ema_21, {r('macd - macd_signal')} AS macd_hist, {r(rsi_expr("CAST('inf' AS DOUBLE)"))} AS rsi_14,
  {r(full('avg(tr)', 14))} AS atr_14, {r(full('stddev_samp(ret)', 21, lead=1))} AS volatility_21, {r('m + 2 * s')} AS bb_upper, {r('volume / v')} AS volume_ratio,
  {r(f"close / nullif({full('avg(close)', 50)}, 0) - 1")} AS price_vs_sma50 FROM b7 QUALIFY rn >= 50"""))
def feature_table(spark, sf):
    # the store keeps features as a map; the training scan turns its entries back into columns
    f = ind.features(bars(spark, sf))
    names = ["ema_21", "macd_hist", "rsi_14", "atr_14", "volatility_21", "bb_upper", "volume_ratio", "price_vs_sma50"]
    from ..sources.readers import columns_to_map, flatten_map
    return rounded(flatten_map(f.select(*ID, columns_to_map(names).alias("features")), "features", names), *names)


@query("A11_bad_value_audit", f"""
WITH t AS (SELECT {SPOILED.format('close')} AS close, CASE WHEN volume % 3 = 0 THEN NULL ELSE high END AS high, low FROM ({BARS}))
SELECT 'close' AS column_name, count(*) FILTER (isnan(close)) AS nan_count, count(*) FILTER (isinf(close)) AS inf_count, count(*) FILTER (close IS NULL) AS null_count FROM t
UNION ALL SELECT 'high', count(*) FILTER (isnan(high)), count(*) FILTER (isinf(high)), count(*) FILTER (high IS NULL) FROM t
UNION ALL SELECT 'low', count(*) FILTER (isnan(low)), count(*) FILTER (isinf(low)), count(*) FILTER (low IS NULL) FROM t""")
def bad_value_audit(spark, sf):
    b = bars(spark, sf).select(F.expr(SPOILED.format("close")).alias("close"),
                               F.expr("CASE WHEN volume % 3 = 0 THEN NULL ELSE high END").alias("high"), "low")
    return ql.bad_value_audit(b, ["close", "high", "low"])


@query("A12_bad_rows_last_hours", f"""
WITH t AS (SELECT symbol, ts, {SPOILED.format('close')} AS close FROM ({BARS}))
SELECT symbol, count(*) AS bad_rows FROM t WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR AND (isnan(close) OR isinf(close) OR close = 0) GROUP BY 1""")
def bad_rows(spark, sf):
    b = bars(spark, sf).withColumn("close", F.expr(SPOILED.format("close")))
    newest = b.select(F.max("ts")).scalar()
    return b.filter((F.col("ts") >= newest - F.expr("INTERVAL 24 HOURS")) & (mk.is_bad("close") | (F.col("close") == 0))).groupBy(
        "symbol").agg(F.count("*").alias("bad_rows"))


@query("A44_quality_report", f"""
WITH t AS (SELECT {SPOILED.format('close')} AS close, CASE WHEN volume % 3 = 0 THEN NULL ELSE high END AS high, 1.0 AS flat FROM ({BARS}))
SELECT count(*) AS n_rows, 'close' AS column_name, count(*) FILTER (close IS NULL) AS null_count, count(*) FILTER (isnan(close) OR isinf(close)) AS bad_count,
   min(close) = max(close) AS zero_variance FROM t
UNION ALL SELECT count(*), 'high', count(*) FILTER (high IS NULL), count(*) FILTER (isnan(high) OR isinf(high)), min(high) = max(high) FROM t
UNION ALL SELECT count(*), 'flat', 0, 0, true FROM t""")
def quality_report(spark, sf):
    b = bars(spark, sf).select(F.expr(SPOILED.format("close")).alias("close"),
                               F.expr("CASE WHEN volume % 3 = 0 THEN NULL ELSE high END").alias("high"), F.lit(1.0).alias("flat"))
    return ql.quality_report(b, ["close", "high", "flat"])


@query("A43_zscore", f"""
WITH t AS (SELECT symbol, ts, CASE WHEN volume % 3 = 0 THEN NULL ELSE close END AS x FROM ({BARS})),
m AS (SELECT symbol, avg(x) AS mu, stddev_pop(x) AS sd FROM t GROUP BY 1)
SELECT symbol, ts, {r('coalesce((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 0)')} AS x_z FROM t JOIN m USING (symbol)""")
def zscore(spark, sf):
    from ..operators.models import zscore as fit
    b = bars(spark, sf).withColumn("x", F.expr(GAPPY))
    return rounded(fit(b, ["symbol"], ["x"]).select(*ID, "x_z"), "x_z")
