"""Exact interpolated quantiles per group, safe for very large groups.

The built-in ``percentile`` keeps one map of all distinct values of a group in one task. That is the
fastest way for groups of ordinary size and impossible for a group holding a large share of all rows.
So the largest group is measured first, with a count over the key columns only. Groups above
``hot_rows`` take a second path: distinct values are counted, dealt out by range over all groups together, ranked by a block
scan and picked by rank. What a row costs does not depend on how large its group is. Both paths are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .joins import same_keys
from .series import Series

HOT_ROWS = 1_000_000
RANGE_ROWS = 250_000  # rows of the large groups that one range holds, about


def percentile_columns(metrics: list[str], probs: dict[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates (one array per metric) and the columns ``<metric>_<name>`` that unpack them."""
    ps = F.array(*(F.lit(float(p)) for p in probs.values()))
    aggs = [F.percentile(m, ps).alias(f"_q_{m}") for m in metrics]
    cols = [F.col(f"_q_{m}")[i].alias(f"{m}_{nm}") for m in metrics for i, nm in enumerate(probs)]
    return aggs, cols


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """Keys of the groups above ``hot_rows`` (None if there is none) and how many rows these have together. Runs one small job."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    rows = sizes.agg(F.sum("_n")).first()[0] or 0
    return sizes.select(*keys) if rows else None, rows


def _ranked(df: DataFrame, keys: list[str], metrics: list[str], probs: dict[str, float], n_ranges: int) -> DataFrame:
    group = [*keys, "metric"]
    long = df.unpivot(keys, metrics, "metric", "v").filter(F.col("v").isNotNull())
    counted = long.groupBy(*group, "v").agg(F.count("*").alias("cnt"))
    # Spark samples the bounds of the ranges and finds each value's range by halving; stored, because other runs may draw other bounds
    ranged = kept(counted.repartitionByRange(n_ranges, *group, "v").withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*group).agg(F.sum("cnt").alias("n"))
    cum = Series(same_keys(ranged, totals, group), tuple(group), ("v",), ("_range",)).scan({"_cum": ("sum", F.col("cnt"))}).df
    picks, cols = [], []
    for nm, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_cum") - F.col("cnt") <= rank) & (rank < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col("v"))).alias(f"_{side}_{nm}"))
        lo, hi = F.col(f"_lo_{nm}"), F.col(f"_hi_{nm}")
        # to the last bit as the built-in aggregate does it
        cols.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(nm))
    q = cum.groupBy(*group).agg(F.max("n").alias("n"), *picks).select(*group, *cols)
    return q.groupBy(*keys).agg(
        *(F.max(F.when(F.col("metric") == m, F.col(nm))).alias(f"{m}_{nm}") for m in metrics for nm in probs)
    )


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    metrics: list[str],
    probs: dict[str, float],
    hot_rows: int | None = HOT_ROWS,
    aggs: list[Column] | tuple = (),
) -> DataFrame:
    """One row per group with columns ``<metric>_<name>``, after any further aggregates given.

    ``hot_rows=None`` skips the measurement where the size of a group is bounded by its meaning, as for
    the hours of a day or the days of a calendar.
    """
    arrays, cols = percentile_columns(metrics, probs)
    hot, rows = hot_groups(df, keys, hot_rows) if hot_rows is not None else (None, 0)
    small_src = df if hot is None else same_keys(df, hot, keys, "left_anti")
    agg = small_src.groupBy(*keys).agg(*aggs, *arrays)
    kept = [c for c in agg.columns if not c.startswith("_q_")]
    small = agg.select(*kept, *cols)
    if hot is None:
        return small
    big_src = same_keys(df, hot, keys, "left_semi")
    ranked = _ranked(big_src, keys, metrics, probs, max(16, -(-rows * len(metrics) // RANGE_ROWS)))
    # a group without any value of a metric has no rank to pick and stays with NULL
    groups = big_src.groupBy(*keys).agg(*aggs) if aggs else hot
    return small.unionByName(same_keys(groups, ranked, keys, "left"))
