"""Volume by hour and session, anomalies, forecasts and clusters of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import SESSION_HOURS, session_of
from ..functions.stats import correlation
from . import indicators as ind
from ..session import cut, kept
from .isolation import anomalies
from .joins import same_keys
from .quantiles import group_quantiles
from .series import Series


def hour_of(ts: str = "ts"):
    return F.hour(F.col(ts).cast("timestamp"))


def hourly_totals(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.col("symbol").alias("pair"), hour_of().alias("hour_gmt")).agg(
        F.sum("volume").alias("total_volume"), F.count("*").alias("bar_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def hourly_breakdown(bars: DataFrame) -> DataFrame:
    """Totals with the 75th percentile and z-scores of the bar volumes; the mean z-score is zero by algebra."""
    b = bars.select(F.col("symbol").alias("pair"), hour_of().alias("hour_gmt"), "ts", "volume")
    keys = ["pair", "hour_gmt"]
    # bars per (pair, hour) are bounded by the calendar: 60 a day
    base = group_quantiles(b, keys, ["volume"], {"p75": 0.75}, None, [
        F.sum("volume").alias("total_volume"), F.count("*").alias("bar_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.avg("volume").alias("_m"), F.stddev_pop("volume").alias("_s"), F.max("volume").alias("_x"),
    ])
    z = F.when(F.col("_s") > 0, (F.col("_x") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return base.select(
        *keys, "total_volume", "bar_count", "first_ts", "last_ts", F.col("volume_p75").alias("p75_volume"),
        F.lit(0.0).alias("avg_z_score"), z.alias("max_z_score"),
    )


def daily_totals(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.col("symbol").alias("pair"), F.to_date("ts").alias("date")).agg(F.sum("volume").alias("daily_volume"))


def date_hour_totals(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.col("symbol").alias("pair"), F.to_date("ts").alias("date"), hour_of().alias("hour_gmt")).agg(
        F.sum("volume").alias("hourly_volume")
    )


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.col("symbol").alias("pair")).agg(
        F.count_distinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def session_statistics(hourly: DataFrame) -> DataFrame:
    """Per (pair, session): totals, mean per bar, and deviation, median, min, max over the hourly totals."""
    h = hourly.withColumn("session", session_of("hour_gmt"))
    got = h.groupBy("pair", "session").agg(
        F.sum("total_volume").alias("volume"), F.sum("bar_count").alias("bar_count"),
        F.stddev_samp("total_volume").alias("std_volume"), F.median("total_volume").alias("median_volume"),
        F.min("total_volume").alias("min_volume"), F.max("total_volume").alias("max_volume"),
    )
    # every pair shows every session, also those without bars
    every = hourly.select("pair").distinct().withColumn("session", F.explode(F.array(*map(F.lit, SESSION_HOURS))))
    full = same_keys(every, got, ["pair", "session"], "left").na.fill(0)
    avg = F.when(F.col("bar_count") > 0, F.col("volume") / F.col("bar_count")).otherwise(0.0)
    return full.withColumn("avg_volume", avg).withColumn(
        "cv", F.when(F.col("avg_volume") != 0, F.col("std_volume") / F.col("avg_volume")).otherwise(0.0)
    )


def session_summary(sessions: DataFrame) -> DataFrame:
    """Per session over all pairs: total, pairs, mean per pair, rank and share. One row per session."""
    t = sessions.filter("volume > 0").groupBy("session").agg(
        F.sum("volume").alias("total_volume"), F.count("*").alias("pair_count")
    )
    w = Window.orderBy(F.desc("total_volume"), "session")  # five rows
    return t.select(
        "session", "total_volume", "pair_count", (F.col("total_volume") / F.col("pair_count")).alias("average_per_pair"),
        F.row_number().over(w).alias("rank"),
        F.round(100 * F.col("total_volume") / F.sum("total_volume").over(Window.partitionBy()), 2).alias("pct_of_total"),
    )


def atr_volume_correlation(bars: DataFrame, period: int = 14) -> DataFrame:
    """Correlation of ATR and volume per pair; 0 where undefined. The first bar has no true range here."""
    rl = ind.bar_series(bars).rolling(period + 1)
    rl.add({"_tr": ind.true_range(rl, first_null=True)})
    rl.add({"_atr": rl.full(F.avg, "_tr", period)})
    df = rl.done().filter(F.col("_atr").isNotNull())
    got = df.groupBy(F.col("symbol").alias("pair")).agg(correlation("_atr", "volume").alias("c"))
    pairs = bars.select(F.col("symbol").alias("pair")).distinct()
    return same_keys(pairs, got, ["pair"], "left").select("pair", F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def session_baselines(bars: DataFrame, period: int = 14) -> DataFrame:
    """Mean and deviation of volume and ATR per (pair, session)."""
    vol = session_statistics(hourly_totals(bars)).select("pair", "session", F.col("avg_volume").alias("mean_volume"), "std_volume")
    rl = ind.atr(ind.bar_series(bars).rolling(period + 1), period)
    atr = rl.done().filter(F.col("atr").isNotNull()).groupBy(
        F.col("symbol").alias("pair"), session_of(hour_of()).alias("session")
    ).agg(F.avg("atr").alias("mean_atr"), F.stddev_samp("atr").alias("std_atr"), F.count("*").alias("_n"))
    some = F.col("_n") > 1
    return same_keys(vol, atr, ["pair", "session"], "left").select(
        "pair", "session", "mean_volume", "std_volume",
        F.when(some, F.col("mean_atr")).otherwise(0.0).alias("mean_atr"),
        F.when(some, F.col("std_atr")).otherwise(0.0).alias("std_atr"),
    )


def _robust_flags(df: DataFrame, keys: list[str], scope: list[str], feats: list[str], contamination: float) -> DataFrame:
    """Distance from the median in units of the median absolute deviation, summed over features.

    The rows above the ``1 - contamination`` quantile of their ``scope`` are anomalies. This stands in for an
    isolation forest: the question (which rows are unusual) is the same, the score differs by design.
    """
    # at most one row per hour of the calendar and pair; read by several branches below
    df = cut(df)
    med = group_quantiles(df, keys, feats, {"med": 0.5}, None)
    d = same_keys(df, med, keys).withColumns({f"_d_{f}": F.abs(F.col(f) - F.col(f"{f}_med")) for f in feats})
    mad = group_quantiles(d, keys, [f"_d_{f}" for f in feats], {"mad": 0.5}, None)
    d = same_keys(d, mad, keys)
    parts = [
        F.col(f"_d_{f}") / F.when(F.col(f"_d_{f}_mad") == 0, F.lit(1.0)).otherwise(F.col(f"_d_{f}_mad")) for f in feats
    ]
    d = d.withColumn("anomaly_score", sum(parts[1:], parts[0]))
    limit = group_quantiles(d, scope, ["anomaly_score"], {"cut": 1 - contamination}, None)
    return same_keys(d, limit, scope).withColumn("is_anomaly", (F.col("anomaly_score") > F.col("anomaly_score_cut")).cast("int"))


def daily_anomalies(daily: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Unusual days per pair by [volume, lag 1, lag 2]; days without both lags are never flagged."""
    rl = Series.of(daily, ["pair"], ["date"], {"_year": F.trunc("date", "year")}).rolling(2)
    rl.add({"v": F.col("daily_volume"), "lag1": rl.lag("daily_volume"), "lag2": rl.lag("daily_volume", 2)})
    rows = cut(rl.done())
    long_enough = rows.groupBy("pair").agg(F.count("*").alias("_n")).filter("_n >= 3").select("pair")
    rows = same_keys(rows, long_enough, ["pair"], "left_semi")
    flagged = _robust_flags(rows.filter(F.col("lag2").isNotNull()), ["pair"], ["pair"], ["v", "lag1", "lag2"], contamination)
    first = rows.filter(F.col("lag2").isNull()).select(
        "pair", "date", "daily_volume", F.lit(0).alias("is_anomaly"), F.lit(0.0).alias("anomaly_score"))
    return flagged.select("pair", "date", "daily_volume", "is_anomaly", "anomaly_score").unionByName(first)


def isolated_days(daily: DataFrame, contamination: float = 0.1, **forest) -> DataFrame:
    """Unusual days per pair by isolation trees over [volume, lag 1, lag 2]; days without both lags are never flagged."""
    rl = Series.of(daily, ["pair"], ["date"], {"_year": F.trunc("date", "year")}).rolling(2)
    rl.add({"lag1": rl.lag("daily_volume"), "lag2": rl.lag("daily_volume", 2)})
    return _isolated(rl.done(), ["date"], "lag2", ["daily_volume", "lag1", "lag2"], contamination, **forest)


def isolated_hours(totals: DataFrame, contamination: float = 0.1, **forest) -> DataFrame:
    """Unusual (date, hour) per pair by isolation trees over [volume, lag 1, weekday]; the first hour of a pair is never flagged."""
    rl = Series.of(totals, ["pair"], ["date", "hour_gmt"], {"_month": F.trunc("date", "month")}).rolling(1)
    rl.add({"lag1": rl.lag("hourly_volume"), "dow": F.weekday("date")})
    return _isolated(rl.done(), ["date", "hour_gmt"], "lag1", ["hourly_volume", "lag1", "dow"], contamination, **forest)


def _isolated(rows: DataFrame, order: list[str], lag: str, feats: list[str], contamination: float, **forest) -> DataFrame:
    rows = kept(rows, "lags")
    own = ["pair", *order, feats[0]]
    found = anomalies(rows.filter(F.col(lag).isNotNull()), ["pair"], feats, order, contamination, **forest)
    first = rows.filter(F.col(lag).isNull()).select(*own, F.lit(0).alias("is_anomaly"), F.lit(None).cast("double").alias("anomaly_score"))
    return found.select(*own, "is_anomaly", "anomaly_score").unionByName(first)


def hourly_anomalies(totals: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Unusual (date, hour) per pair by [volume, lag 1] against rows of the same weekday."""
    rl = Series.of(totals, ["pair"], ["date", "hour_gmt"], {"_month": F.trunc("date", "month")}).rolling(1)
    rl.add({"v": F.col("hourly_volume"), "lag1": rl.lag("hourly_volume"), "dow": F.weekday("date")})
    rows = cut(rl.done().filter(F.col("lag1").isNotNull()))
    long_enough = rows.groupBy("pair").agg(F.count("*").alias("_n")).filter("_n >= 3").select("pair")
    flagged = _robust_flags(same_keys(rows, long_enough, ["pair"], "left_semi"), ["pair", "dow"], ["pair"], ["v", "lag1"], contamination)
    return flagged.select("pair", "date", "hour_gmt", "hourly_volume", "is_anomaly", "anomaly_score")


def next_volume_forecast(totals: DataFrame, train_share: float = 0.8, min_points: int = 5) -> DataFrame:
    """One-step forecast per (pair, hour): first-order autoregression by least squares.

    The mean absolute error comes from a fit on the first ``train_share`` of the days, applied one step
    ahead to the rest; the forecast from a fit on all days. Stands in for a search over ARIMA orders.
    """
    keys = ["pair", "hour_gmt"]
    s = Series.of(totals, keys, ["date"], {"_year": F.trunc("date", "year")})
    rl = s.rolling(1)
    rl.add({"_lag": rl.lag("hourly_volume")})
    rows = cut(rl.series().df)
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= min_points)
    rows = same_keys(rows, size, keys).withColumn("_train", F.col("_rn") <= F.floor(F.col("n_points") * train_share))
    y, x = F.col("hourly_volume"), F.col("_lag")
    on = lambda c: F.when(F.col("_train"), c)
    fit = rows.groupBy(*keys).agg(
        F.max("n_points").alias("n_points"),
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("_m"),
        F.regr_slope(on(y), on(x)).alias("_bt"), F.regr_intercept(on(y), on(x)).alias("_at"), F.avg(on(y)).alias("_mt"),
        F.max_by(y, "_rn").alias("_last"),
    )
    guess = F.coalesce(F.col("_at") + F.col("_bt") * x, F.col("_mt"))
    err = same_keys(rows.filter(~F.col("_train")), fit.select(*keys, "_at", "_bt", "_mt"), keys).groupBy(*keys).agg(
        F.avg(F.abs(y - guess)).alias("holdout_mae"))
    return same_keys(fit, err, keys, "left").select(
        *keys, "n_points", F.coalesce(F.col("_a") + F.col("_b") * F.col("_last"), F.col("_m")).alias("next_volume_forecast"), "holdout_mae")


def autoregression(totals: DataFrame, max_order: int = 3, min_points: int = 5) -> DataFrame:
    """One-step forecast per (pair, hour) by the autoregression whose order, up to ``max_order``, has the least AIC.

    One pass over blocks of rows gives the products of centred volumes at each lag; Levinson and Durbin's recursion turns their
    sums into the coefficients of every order, column by column, and ``n ln(error) + 2 (order + 1)`` picks one. A series that never
    changes has order 0 and forecasts its mean; of equal criteria the smaller order wins. Series with fewer than ``min_points`` days are left out.
    """
    keys = ["pair", "hour_gmt"]
    totals = kept(totals.select(*keys, "date", F.col("hourly_volume").cast("double").alias("_x")).filter(F.col("_x").isNotNull()), "totals")
    mean = totals.groupBy(*keys).agg(F.avg("_x").alias("mean"), F.count("*").alias("n_points"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter(F.col("n_points") >= min_points)
    rows = same_keys(totals, mean, keys).withColumn("_x", F.when(F.col("_lo") < F.col("_hi"), F.col("_x") - F.col("mean")).otherwise(0.0))
    rl = Series.of(rows, keys, ["date"], {"_year": F.trunc("date", "year")}).rolling(max_order)
    rl.add({f"_x{k}": rl.lag("_x", k) for k in range(1, max_order + 1)})
    fit = rl.series().df.groupBy(*keys).agg(
        F.max("n_points").alias("n_points"), F.max("mean").alias("mean"), F.sum(F.col("_x") * F.col("_x")).alias("_r0"),
        *(F.coalesce(F.sum(F.col("_x") * F.col(f"_x{k}")), F.lit(0.0)).alias(f"_r{k}") for k in range(1, max_order + 1)),
        F.max_by("_x", "_rn").alias("_last0"), *(F.max_by(f"_x{k}", "_rn").alias(f"_last{k}") for k in range(1, max_order)))
    zero = F.lit(0.0)
    fit = fit.withColumn("_e0", F.col("_r0") / F.col("n_points"))
    for m in range(1, max_order + 1):
        a = lambda j, m=m: F.col(f"_a{m - 1}_{j}")
        gap = F.col(f"_r{m}") - sum((a(j) * F.col(f"_r{m - j}") for j in range(1, m)), zero)
        fit = fit.withColumn("_k", F.coalesce(F.try_divide(gap, F.col(f"_e{m - 1}") * F.col("n_points")), zero))
        fit = fit.withColumns({f"_a{m}_{m}": F.col("_k"), f"_e{m}": F.col(f"_e{m - 1}") * (1 - F.col("_k") * F.col("_k")), **{f"_a{m}_{j}": a(j) - F.col("_k") * a(m - j) for j in range(1, m)}})
    orders = range(max_order + 1)
    aic = F.array_sort(F.array(*(F.struct((F.col("n_points") * F.ln(F.when(F.col(f"_e{m}") > 0, F.col(f"_e{m}"))) + 2 * (m + 1)).alias("aic"), F.lit(m).alias("order")) for m in orders)))
    best = F.filter(aic, lambda s: s["aic"].isNotNull())
    fit = fit.withColumn("ar_order", F.coalesce(F.get(best, F.lit(0))["order"], F.lit(0)))
    chosen = F.get(F.array(*(F.array(*(F.col(f"_a{m}_{j}") for j in range(1, m + 1))).cast("array<double>") for m in orders)), F.col("ar_order"))
    ahead = F.get(F.array(*(sum((F.col(f"_a{m}_{j}") * F.coalesce(f"_last{j - 1}", zero) for j in range(1, m + 1)), zero) for m in orders)), F.col("ar_order"))
    return fit.select(*keys, "n_points", "ar_order", chosen.alias("coefficients"), (F.col("mean") + ahead).alias("next_volume_forecast"))


def run_summary(anomalies: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per pair: days, flagged days, forecast count and mean forecast."""
    a = anomalies.groupBy("pair").agg(F.count("*").alias("days"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"))
    f = forecasts.groupBy("pair").agg(
        F.count("*").alias("forecasts"), F.count_distinct("hour_gmt").alias("hours"), F.avg("next_volume_forecast").alias("avg_forecast"))
    return same_keys(a, f, ["pair"], "left").na.fill(0, ["forecasts", "hours"])


def volume_signal(current: DataFrame, hourly: DataFrame, forecasts: DataFrame, hist: float = 1.2, ahead: float = 1.0, floor: float = 1e6) -> DataFrame:
    """Whether the current volume beats history, forecast and floor for its (pair, hour)."""
    keys = ["pair", "hour_gmt"]
    h = hourly.filter("bar_count > 0").select(*keys, (F.col("total_volume") / F.col("bar_count")).alias("hist_avg"))
    f = forecasts.select(*keys, "next_volume_forecast")
    limit = F.greatest(F.col("hist_avg") * hist, F.coalesce("next_volume_forecast", F.lit(0.0)) * ahead, F.lit(float(floor)))
    return same_keys(same_keys(current, h, keys, "left"), f, keys, "left").withColumn(
        "is_good", F.when(F.col("hist_avg").isNull(), F.lit(False)).otherwise(F.col("volume") > limit))


def volume_profile(totals: DataFrame) -> DataFrame:
    """Share of each hour in the volume of its pair: 24 columns; pairs without volume are left out."""
    hours = [F.sum(F.when(F.col("hour_gmt") == h, F.col("total_volume"))).alias(f"h{h:02d}") for h in range(24)]
    p = totals.groupBy("pair").agg(F.sum("total_volume").alias("_t"), *hours).filter("_t > 0")
    return p.select("pair", *((F.coalesce(F.col(f"h{h:02d}"), F.lit(0.0)) / F.col("_t")).alias(f"h{h:02d}") for h in range(24)))


def component_variance(rows: DataFrame, keys: list[str], high: float = 0.1, low: float = 0.05) -> DataFrame:
    """Components above ``high`` and below ``low`` explained variance, with totals."""
    join = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.col("component")))), lambda c: c.cast("string")), ",")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_components"), F.sum("explained").alias("total_explained"),
        join(F.col("explained") > high).alias("high_components"), join(F.col("explained") < low).alias("low_components"))
