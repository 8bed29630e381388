"""Data-quality reports and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import is_bad

# Outcomes of one ingest cycle
OUTCOMES = ["inserted", "duplicate", "no_content", "no_currency", "error"]


def run_outcomes(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Counters per cycle and its status; more than half errors makes it partial.

    ``weight`` names a count column where rows are already added up.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    tally = lambda cond, name: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint").alias(name)
    counts = df.groupBy(*keys).agg(
        *(tally(F.col("outcome") == o, o) for o in OUTCOMES),
        tally(~F.col("outcome").isin("duplicate", "no_content"), "processed"),
    )
    status = (
        F.when((F.col("processed") == 0) & (F.col("duplicate") == 0), "empty")
        .when(F.col("error") > F.col("processed") * 0.5, "partial")
        .otherwise("ok")
    )
    return counts.withColumn("status", status)


def bad_value_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, nan_count, inf_count, null_count) from one pass."""
    inf = float("inf")
    agg = df.agg(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(F.isnan(F.col(c).cast("double"))).alias("nan_count"),
                F.count_if(F.abs(F.col(c).cast("double")) == F.lit(inf)).alias("inf_count"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        )
    )
    return agg.select(F.inline(F.array(*(f"s{i}" for i in range(len(columns))))))


def quality_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, rows, nulls, bad, zero_variance) from one pass."""
    agg = df.agg(
        F.count("*").alias("n_rows"),
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
                F.count_if(is_bad(c)).alias("bad_count"),
                F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("zero_variance"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ),
    )
    return agg.select("n_rows", F.inline(F.array(*(f"s{i}" for i in range(len(columns))))))


def presence(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Row count per expected key and whether there is any."""
    n = actual.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    return expected.join(n, keys, "left").select(
        *keys, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) > 0).alias("present")
    )
