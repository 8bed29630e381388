"""Statistics of article scores: per hour or minute, mergeable states, decayed scores."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import hours_between, log_decay
from ..functions.stats import finished, merged_moments, moment_state
from .joins import same_keys
from .quantiles import HOT_ROWS, group_quantiles

# The quantiles kept per score
QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def bucket(ts, unit: str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c.cast("timestamp")).cast("timestamp_ntz")


def _moment_columns(metrics: list[str]) -> list[Column]:
    aggs = [F.count("*").alias("article_count")]
    for m in metrics:
        aggs += [
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_stddev"),
            F.skewness(m).alias(f"{m}_skewness"),
            (F.kurtosis(m) + 3).alias(f"{m}_kurtosis"),
        ]
    return aggs


def _keyed(df: DataFrame, metrics: list[str], unit: str, ts: str, key: str) -> tuple[DataFrame, list[str]]:
    keys = [f"{unit}_bucket", "symbol"]
    return df.select(bucket(ts, unit).alias(keys[0]), F.col(key).alias("symbol"), *metrics), keys


def score_statistics(df: DataFrame, metrics: list[str], unit: str = "hour", ts: str = "ts", key: str = "primary_ccy") -> DataFrame:
    """Count and, per metric, min, max, mean, population deviation, skewness and plain kurtosis."""
    src, keys = _keyed(df, metrics, unit, ts, key)
    return src.groupBy(*keys).agg(*_moment_columns(metrics))


def score_statistics_with_quantiles(df: DataFrame, metrics: list[str], unit: str = "hour", ts: str = "ts", key: str = "primary_ccy", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """:func:`score_statistics` plus range, variance and seven exact quantiles per metric.

    One scan and one shuffle unless a group is too large for one task.
    """
    src, keys = _keyed(df, metrics, unit, ts, key)
    out = group_quantiles(src, keys, metrics, QUANTILES, hot_rows, _moment_columns(metrics))
    return out.withColumns(
        {f"{m}_range": F.col(f"{m}_max") - F.col(f"{m}_min") for m in metrics}
        | {f"{m}_variance": F.pow(f"{m}_stddev", F.lit(2)) for m in metrics}
    )


def partial_states(df: DataFrame, keys: list[str], metrics: list[str], sketch: bool = True) -> DataFrame:
    """Mergeable states per key: moments and, for quantiles, a KLL sketch."""
    aggs = []
    for m in metrics:
        x = F.col(m).cast("double")
        aggs += moment_state(x, m)
        if sketch:
            aggs.append(F.kll_sketch_agg_double(x).alias(f"{m}_kll"))
    return df.groupBy(*keys).agg(F.count("*").alias("article_count"), *aggs)


def merge_states(states: DataFrame, keys: list[str], metrics: list[str], sketch: bool = True) -> DataFrame:
    """States of the same key become one: first the common mean, then all moments around it."""
    n = lambda m: F.col(f"{m}_n")
    means = states.groupBy(*keys).agg(
        *((F.sum(n(m) * F.col(f"{m}_mean")) / F.sum(n(m))).alias(f"_mu_{m}") for m in metrics))
    aggs = []
    for m in metrics:
        aggs += merged_moments(m, f"_mu_{m}")
        if sketch:
            aggs.append(F.kll_merge_agg_double(f"{m}_kll").alias(f"{m}_kll"))
    return same_keys(states, means, keys).groupBy(*keys).agg(F.sum("article_count").alias("article_count"), *aggs)


def finish_states(states: DataFrame, keys: list[str], metrics: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Statistics from merged states; quantiles are those of the sketch (approximate)."""
    cols = [*keys, "article_count"]
    for m in metrics:
        cols += [f"{m}_min", f"{m}_max"]
        cols += [e.alias(f"{m}_{n}") for n, e in finished(m).items()]
        for nm, p in (quantiles or {}).items():
            cols.append(F.kll_sketch_get_quantile_double(f"{m}_kll", F.lit(p)).alias(f"{m}_{nm}"))
    return states.select(*cols)


def bias_rollup(df: DataFrame, fields: list[str], ts: str = "ts", unit: str = "hour") -> DataFrame:
    """Fields become rows; sum and count per (bucket, field)."""
    return (
        df.select(bucket(ts, unit).alias(f"{unit}_bucket"), *fields)
        .unpivot([f"{unit}_bucket"], fields, "symbol", "score")
        .groupBy(f"{unit}_bucket", "symbol")
        .agg(F.sum("score").alias("sum_score"), F.count("*").alias("article_count"))
    )


def decayed_scores(hourly: DataFrame, as_of: Column, lookback_hours: int = 168, tau_hours: float = 20 / 60, k: float = 1.8, cap: float = 1.0) -> DataFrame:
    """Weighted mean of hourly means per symbol; the weight falls with the age of the hour.

    ``hourly`` holds (hour_bucket, symbol, sum_score, article_count) and may carry several partial rows
    per hour and symbol.
    """
    recent = hourly.filter(F.col("hour_bucket") >= as_of - F.expr(f"INTERVAL {lookback_hours} HOURS"))
    per_hour = recent.groupBy("hour_bucket", "symbol").agg(
        F.sum("sum_score").alias("sum_score"), F.sum("article_count").alias("article_count")
    )
    latest = per_hour.select(F.max("hour_bucket")).scalar()
    w = log_decay(hours_between(as_of, "hour_bucket"), tau_hours, k, cap)
    return (
        per_hour.filter("article_count > 0")
        .select("symbol", "article_count", (F.col("sum_score") / F.col("article_count")).alias("m"), w.alias("w"))
        .groupBy("symbol")
        .agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("decayed_score"), F.sum("article_count").alias("article_count"))
        .select("symbol", "decayed_score", "article_count", latest.alias("latest_hour"))
    )


def window_average(df: DataFrame, fields: list[str], digits: int = 4) -> DataFrame:
    """Rounded averages of the fields over all rows with a count; zeros when there is no row."""
    return df.agg(
        *(F.coalesce(F.round(F.avg(f), digits), F.lit(0.0)).alias(f) for f in fields), F.count("*").alias("article_count")
    )


def symbol_snapshots(df: DataFrame, symbols: str, score: str, minutes: int = 60, ts: str = "ts", **decay) -> DataFrame:
    """Score per symbol at the end of every window of ``minutes``, articles weighted by their age."""
    end = F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes")["end"]
    return (
        df.withColumn("snapshot_ts", end)
        .withColumn("symbol", F.explode(symbols))
        .withColumn("_w", log_decay(hours_between("snapshot_ts", ts), **decay))
        .groupBy(F.col("snapshot_ts").cast("timestamp_ntz").alias("snapshot_ts"), "symbol")
        .agg((F.sum(F.col("_w") * F.col(score)) / F.sum("_w")).alias("score"), F.count("*").alias("article_count"))
    )


#: Bits of the order columns that fit into one number beside a place for NULL.
WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64, "timestamp_ntz": 64, "boolean": 1}
ROOM = 19 * 10**37  # different values that a decimal(38, 0) surely holds around 0


def order_key(df: DataFrame, order: list[str]) -> Column:
    """A fixed-width value that never falls while (order, ...) grows; NULLs come first.

    Whole numbers, times and flags are digits of one decimal until its room is used up: what is left of the room goes to the leading
    bits of the next column, later ones do not count. A first column of another kind is its own key. Rows with equal keys may
    therefore still differ in their order.
    """
    kinds = dict(df.dtypes)
    if kinds[order[0]] not in WIDTHS:
        return F.col(order[0])
    key, used = F.lit(0).cast("decimal(38,0)"), 1
    for c in order:
        if kinds[c] not in WIDTHS:
            break
        bits, x = WIDTHS[kinds[c]], F.col(c)
        if kinds[c].startswith("timestamp"):
            x = F.unix_micros(x.cast("timestamp"))
        elif kinds[c] == "date":
            x = F.unix_date(x)
        drop = 0
        while drop < bits and used * (2 ** (bits - drop) + 1) > ROOM:
            drop += 1
        if drop == bits:
            break
        least = -1 if bits == 1 else -(2 ** (bits - drop - 1)) - 1  # NULL
        size = 2 ** (bits - drop) + 1
        digit = F.coalesce(F.shiftright(x.cast("bigint"), drop).cast("decimal(38,0)"), F.lit(Decimal(least)))
        key, used = (key * F.lit(Decimal(size)) + digit).cast("decimal(38,0)"), used * size
        if drop:
            break
    return key


def latest_by(df: DataFrame, keys: list[str], order: list[str], aggs: list[Column] | tuple = ()) -> DataFrame:
    """The newest row per key, with ``aggs`` over all rows of the key; NULL keys are one key, NULLs in the order are oldest.

    Late materialisation: a hash aggregate with map-side merging finds the greatest :func:`order_key` of each key from the narrow columns
    alone, and a join brings back only the winning rows. Rows that tie are cut to one by the whole order, in each task before any shuffle.
    """
    own = df.columns
    keyed = df.withColumn("_order", order_key(df, order))
    best = keyed.groupBy(*keys).agg(F.max("_order").alias("_order"), *aggs)
    more = [c for c in best.columns if c not in (*keys, "_order")]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return same_keys(keyed, best, [*keys, "_order"]).withColumn("_first", first).filter("_first = 1").select(*own, *more)


def trend_frames(hourly: DataFrame, as_of: Column, frames: list[int] = [24, 48, 72], **decay) -> DataFrame:
    """Hourly rows repeated for every look-back frame they fall into, with a decay weight."""
    age = hours_between(as_of, "hour_bucket")
    return (
        hourly.withColumn("frame_hours", F.explode(F.array(*map(F.lit, frames))))
        .withColumn("_age", age)
        .filter(F.col("_age") <= F.col("frame_hours"))
        .withColumn("decay_weight", log_decay("_age", **decay))
        .drop("_age")
    )
