"""Writers: files, appended tables, purge, deduplicated copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scores import latest_by


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, sort: list[str] | None = None) -> str:
    """Parquet, optionally by partition column and sorted within tasks for row-group statistics."""
    out = df.sortWithinPartitions(*sort) if sort else df
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return path


def write_results(df: DataFrame, path: str) -> str:
    """Result rows as JSON lines, one folder per strategy."""
    df.write.mode("overwrite").partitionBy("strategy_type").json(path)
    return path


def append(df: DataFrame, path: str, ts: str = "ts") -> str:
    """Append to a result table partitioned by month."""
    df.withColumn("month", F.date_format(F.col(ts).cast("timestamp"), "yyyyMM")).write.mode("append").partitionBy("month").parquet(path)
    return path


def purge(df: DataFrame, path: str, confirm: bool = False) -> str:
    """Replace a table by an empty one of the same schema; needs ``confirm``."""
    if not confirm:
        raise ValueError("purge needs confirm=True")
    df.limit(0).write.mode("overwrite").parquet(path)
    return path


def copy_deduplicated(df: DataFrame, keys: list[str], version: list[str], path: str) -> str:
    """Newest version of each key, written to a new table."""
    return write_parquet(latest_by(df, keys, version), path)
