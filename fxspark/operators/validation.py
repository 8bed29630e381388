"""Splits of series for validation, overfitting checks, gates."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_cdf, norm_ppf
from .joins import same_keys
from .series import Series

MAX_COMBINATIONS = 20_000


def indexed(s: Series) -> DataFrame:
    """Rows with their index from 0 and the length of their series."""
    rows = s.number().result()
    n = s.df.groupBy(*s.keys).agg(F.count("*").alias("n_rows"))
    return same_keys(rows, n, list(s.keys)).withColumn("idx", F.col("_rn") - 1).drop("_rn")


def walk_forward(rows: DataFrame, train: int = 8, val: int = 2, test: int = 2, step: int = 2, per_month: int = 500) -> DataFrame:
    """Each row once per split it belongs to, with its role. A row lies in at most window / step splits."""
    tr, va, te, st = (x * per_month for x in (train, val, test, step))
    window = tr + va + te
    i = F.col("idx")
    lo = F.greatest(F.lit(0), F.ceil((i - window + 1) / st)).cast("bigint")
    hi = F.least(F.floor(i / st), F.floor((F.col("n_rows") - window) / st)).cast("bigint")
    splits = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    at = i - F.col("split") * st
    return rows.withColumn("split", F.explode(splits)).withColumn(
        "role", F.when(at < tr, "train").when(at < tr + va, "val").otherwise("test"))


def combos(n: int, k: int) -> list[tuple[int, ...]]:
    if math.comb(n, k) > MAX_COMBINATIONS:
        raise ValueError(f"{math.comb(n, k)} combinations exceed {MAX_COMBINATIONS}")
    return list(combinations(range(n), k))


def group_of(n_splits: int) -> Column:
    """Group of a row; the last group takes the remainder, and every row of a series shorter than ``n_splits``."""
    size = F.floor(F.col("n_rows") / n_splits)
    return F.least(F.coalesce(F.floor(F.try_divide("idx", size)), F.lit(n_splits - 1)), F.lit(n_splits - 1))


def split_spans(series: DataFrame, n_splits: int, n_test: int) -> DataFrame:
    """First and last test index of every split, per series (a frame with ``n_rows``)."""
    cells = [
        F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, c)).alias("groups"), F.lit(c[0]).alias("_g0"), F.lit(c[-1]).alias("_g1"))
        for i, c in enumerate(combos(n_splits, n_test))
    ]
    size = F.floor(F.col("n_rows") / n_splits)
    last = F.when(F.col("_g1") == n_splits - 1, F.col("n_rows") - 1).otherwise((F.col("_g1") + 1) * size - 1)
    return series.select("*", F.inline(F.array(*cells))).withColumns({"test_min": F.col("_g0") * size, "test_max": last}).drop("_g0", "_g1")


def purged_splits(rows: DataFrame, keys: list[str], n_splits: int = 6, n_test: int = 2, gap: int = 10) -> DataFrame:
    """Rows x splits with role test, train or purged.

    A row outside the test groups trains only if it lies before the first or after the last test row by
    more than ``gap``; everything between the first and the last test group is purged.
    """
    series = rows.select(*keys, "n_rows").distinct()
    spans = split_spans(series, n_splits, n_test).drop("n_rows")
    j = same_keys(rows.withColumn("grp", group_of(n_splits)), spans, keys)
    free = (F.col("idx") < F.col("test_min") - gap) | (F.col("idx") > F.col("test_max") + gap)
    return j.withColumn("role", F.when(F.array_contains("groups", F.col("grp").cast("int")), "test").when(free, "train").otherwise("purged")).drop(
        "groups", "test_min", "test_max")


def pbo(perf: DataFrame, strategy: str, partition: str, value: str, n_partitions: int) -> DataFrame:
    """Probability of backtest overfitting: how often the in-sample best falls into the lower half out of sample.

    The combinations are a literal list of bounded length; each strategy is one row with its partition
    means, so the work is strategies x combinations without any join between strategies.
    """
    spark = perf.sparkSession
    if n_partitions < 4:
        return spark.range(1).select(F.lit(1.0).alias("pbo"), F.lit(0).alias("n_combinations"))
    half = n_partitions // 2
    m = perf.groupBy(strategy).agg(F.array(*(F.avg(F.when(F.col(partition) == i, F.col(value))) for i in range(n_partitions))).alias("_p"))
    cells = [
        F.struct(F.lit(i).alias("combo"), F.array(*map(F.lit, c)).alias("_in"),
                 F.array(*(F.lit(j) for j in range(n_partitions) if j not in c)).alias("_out"))
        for i, c in enumerate(combos(n_partitions, half))
    ]
    mean = lambda ix: F.aggregate(ix, F.lit(0.0), lambda a, i: a + F.col("_p")[i]) / F.size(ix)
    long = m.select(strategy, "_p", F.inline(F.array(*cells))).select(
        strategy, "combo", mean(F.col("_in")).alias("is_perf"), mean(F.col("_out")).alias("oos_perf"))
    best = long.groupBy("combo").agg(F.max_by("oos_perf", F.struct("is_perf", -F.col(strategy))).alias("_best"))
    n = m.agg(F.count("*")).scalar()
    ranks = long.join(best, "combo").groupBy("combo").agg(F.count_if(F.col("oos_perf") >= F.col("_best")).alias("rank"))
    return ranks.agg(F.avg((F.col("rank") > n / 2).cast("double")).alias("pbo"), F.count("*").alias("n_combinations"))


def expected_max_sharpe(n_trials: Column, n_obs: Column) -> Column:
    gamma = 0.5772156649
    t = F.greatest(n_trials.cast("double"), F.lit(2.0))  # fewer trials answer 0 below
    e = norm_ppf(1 - 1 / t) * (1 - gamma) + gamma * norm_ppf(1 - 1 / (t * math.e))
    return F.when(n_trials <= 1, F.lit(0.0)).otherwise(F.try_divide(e, F.sqrt(F.greatest(n_obs, F.lit(0)).cast("double"))))


def deflated_sharpe(sharpe: Column, n_trials: Column, n_obs: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a Sharpe ratio is genuine given the number of trials; ``kurt`` is the plain kurtosis."""
    var = F.try_divide(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, n_obs - 1)
    z = (sharpe - expected_max_sharpe(n_trials, n_obs)) / F.sqrt(F.when(var > 0, var))
    return F.when((n_obs < 2) | (n_trials < 1) | (var == 0), F.lit(0.0)).otherwise(norm_cdf(z))


def information_criteria(ll: Column, n_states: Column, n_features: Column, n_samples: Column) -> dict[str, Column]:
    """AIC and BIC of a state model with full covariances."""
    k = n_states * n_features + n_states * n_features * (n_features + 1) / 2 + n_states * (n_states - 1)
    return {"n_params": k, "aic": 2 * k - 2 * ll, "bic": k * F.ln(n_samples.cast("double")) - 2 * ll}


def threshold_gate(metrics: DataFrame, run: str, thresholds: DataFrame) -> DataFrame:
    """Whether each run meets all thresholds it has a metric for.

    Names with "mae" or "error" must not exceed their threshold, others must reach it. A metric is also
    found without its ``validation_`` prefix.
    """
    bare = lambda c: F.regexp_replace(c, "validation_", "")
    t = thresholds.select(F.col("metric").alias("_key"), "threshold", bare(F.col("metric")).alias("_bare"))
    m = metrics.withColumn("_bare", bare(F.col("metric"))).join(t, "_bare").filter(F.col("metric").isin(F.col("_key"), F.col("_bare")))
    v = m.groupBy(run, "_key").agg(F.max_by("value", (F.col("metric") == F.col("_key")).cast("int")).alias("v"), F.max("threshold").alias("t"))
    lower = F.lower("_key").rlike("mae|error")
    ok = F.when(lower, F.col("v") <= F.col("t")).otherwise(F.col("v") >= F.col("t"))
    verdict = v.groupBy(run).agg(F.bool_and(ok).alias("promote"), F.count("*").alias("checked"))
    return metrics.select(run).distinct().join(verdict, run, "left").select(
        run, F.coalesce("promote", F.lit(True)).alias("promote"), F.coalesce("checked", F.lit(0)).alias("checked"))


def promotion(candidates: DataFrame, champions: DataFrame, keys: list[str], min_accuracy: float = 0.52, max_pbo: float = 0.30, min_gain: float = 0.05) -> DataFrame:
    """Gate of each candidate against fixed limits and the champion of its key."""
    # a champion without the metric counts as 0, no champion sets no bar
    ch = champions.select(*keys, F.coalesce("deflated_sharpe", F.lit(0.0)).alias("champion_dsr"))
    j = same_keys(candidates, ch, keys, "left")
    gain = F.coalesce("deflated_sharpe", F.lit(0.0)) - F.col("champion_dsr")
    reason = (
        F.when(F.coalesce("directional_accuracy", F.lit(0.0)) < min_accuracy, "accuracy")
        .when(F.coalesce("pbo", F.lit(1.0)) > max_pbo, "pbo")
        .when(gain < min_gain, "improvement")
        .otherwise("promoted")
    )
    return j.withColumn("reason", reason).withColumn("promoted", F.col("reason") == "promoted")
