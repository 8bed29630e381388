"""Serving tables and experiment bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market import error_pips
from .scores import latest_by

# Metric prefixes that show a finished training
TRAINED = "^(kmeans_|arima_|if_)"


def backfill(predictions: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Missing actual closes from the feature table, and the error in pips."""
    found = actuals.select(*keys, F.col("close").alias("_close"))
    j = predictions.join(found, keys, "left").withColumn("actual_close", F.coalesce("actual_close", "_close")).drop("_close")
    return j.withColumn("error_pips", error_pips("pred_next_close", "actual_close", "pair"))


def stale(universe: DataFrame, features: DataFrame, keys: list[str], at: str, as_of: Column, age: str) -> DataFrame:
    """Members of the universe without a feature row younger than ``age``."""
    last = features.groupBy(*keys).agg(F.max(at).alias("last_insert"))
    old = F.col("last_insert").isNull() | (F.col("last_insert") < as_of - F.expr(f"INTERVAL {age}"))
    return universe.join(last, keys, "left").filter(old)


def cross_timeframe(predictions: DataFrame, pair: str, order: list[str], active: DataFrame | None = None) -> DataFrame:
    """Newest prediction of each timeframe as one map per pair, and whether their directions agree.

    Rows have pred, actual and error_pips. Directions count where pred and actual are present, and at least two are
    needed. ``active`` holds the pairs to keep.
    """
    if active is not None:
        predictions = predictions.join(active.select(pair).distinct(), pair, "left_semi")
    last = latest_by(predictions, [pair, "timeframe"], order)
    tf = F.lower("timeframe")
    way = F.when(F.col("actual").isNotNull(), F.when(F.col("pred") > F.col("actual"), 1).otherwise(-1))
    # three entries per timeframe
    entries = F.array(*(F.struct(F.concat(tf, F.lit(f"_{v}")).alias("k"), F.col(v).cast("double").alias("v")) for v in ("pred", "actual", "error_pips")))
    g = last.select(pair, way.alias("way"), entries.alias("e")).groupBy(pair).agg(
        F.map_from_entries(F.filter(F.flatten(F.collect_list("e")), lambda x: x["v"].isNotNull())).alias("data"),
        F.count("way").alias("_n"), F.count_distinct("way").alias("_d"))
    return g.select(pair, "data", ((F.col("_n") >= 2) & (F.col("_d") == 1)).cast("int").alias("trend_aligned"))


def best_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest finished run that shows a training metric."""
    trained = F.exists(F.map_keys("metrics"), lambda k: k.rlike(TRAINED))
    return latest_by(runs.filter((F.col("status") == "FINISHED") & trained), keys, ["started", "run_id"])


def arm_posterior(log: DataFrame) -> DataFrame:
    """Beta parameters per arm: 1 + rewards, 1 + unrewarded trials."""
    r = F.col("reward")
    return log.groupBy("arm").agg(
        (1.0 + F.sum(F.greatest(r, F.lit(0)))).alias("alpha"), (1.0 + F.count_if(r <= 0)).alias("beta"))


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    """The table, or the seed rows where it has none."""
    n = table.limit(1).agg(F.count("*")).scalar()
    return table.unionByName(seed.filter(n == 0))


def retained(df: DataFrame, at: str, as_of: Column, age: str) -> DataFrame:
    return df.filter(F.col(at) >= as_of - F.expr(f"INTERVAL {age}"))
