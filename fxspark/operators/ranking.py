"""Sorts, top rows per group, latest versions and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scores import latest_by

__all__ = ["latest_by", "newest_run", "merge_directions", "quota", "top_per_group", "dedup_events"]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Every task keeps only its own best ``k`` per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def newest_run(df: DataFrame, run: str, at: str) -> DataFrame:
    """Rows of the newest run; its name is one row, joined by equality."""
    newest = df.agg(F.max_by(run, F.struct(at, run)).alias(run))
    return df.join(F.broadcast(newest), run)


def merge_directions(hits: DataFrame, direction: str, position: str, item: str, score: str, per_direction: int, n_directions: int) -> DataFrame:
    """Best hits of several searches: per direction the top 2L, each item once where first seen, L per direction in all.

    The cap follows the order of the searches, the result the score.
    """
    best = top_per_group(hits, [direction], [F.desc(score), F.col(item)], 2 * per_direction, "_rank")
    rest = [c for c in best.columns if c != item]
    first = best.groupBy(item).agg(F.min_by(F.struct(*rest), F.struct(position, "_rank")).alias("_r")).select(item, "_r.*")
    return first.orderBy(position, "_rank").limit(per_direction * n_directions).orderBy(F.desc(score), item).drop("_rank")


def quota(df: DataFrame, source: str, cap: str, priority: str, order: str, total: int) -> DataFrame:
    """At most ``cap`` items per source, then at most ``total`` by source priority."""
    w = Window.partitionBy(source).orderBy(order)
    # no source can place more than ``total``; the constant limit lets every task cut before the shuffle
    kept = (F.col("_n") <= total) & (F.col("_n") <= F.col(cap))
    return df.withColumn("_n", F.row_number().over(w)).filter(kept).orderBy(priority, source, "_n").limit(total).drop("_n")


def dedup_events(df: DataFrame, keys: list[Column], actual: str, name: str, arrival: str) -> DataFrame:
    """One event per key: with a released value first, then the longer name, then the earlier arrival."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    best = {"_known": F.col(actual).isNotNull(), "_long": F.length(name), "_early": -F.col(arrival)}
    rows = df.withColumns(named | best)
    return latest_by(rows, list(named), list(best), [F.count("*").alias("copies")]).drop(*named, *best)
