"""Set operations and keyed unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unseen(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of the batch, one per key, whose key is not stored yet.

    Copies inside the batch collapse before the join, so a key repeated many times reaches it once.
    """
    return batch.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def ordered_distinct(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Each value once with the order of its first appearance."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first")).select(value, "_first.*")


def domain_list(include: DataFrame, exclude: DataFrame, domain: str, order: list[str], cap: int = 300) -> DataFrame:
    """Allow list: ordered distinct domains without the excluded ones, first ``cap`` kept."""
    kept = ordered_distinct(include, domain, order).join(exclude.select(domain).distinct(), domain, "left_anti")
    return kept.orderBy(*order).limit(cap)


def override(base: DataFrame, over: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keyed union in which the second frame wins."""
    o = over.select(*keys, *(F.col(v).alias(f"_o_{v}") for v in values), F.lit(True).alias("_hit"))
    return base.join(o, keys, "full").select(
        *keys, *(F.when(F.col("_hit"), F.col(f"_o_{v}")).otherwise(F.col(v)).alias(v) for v in values)
    )


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def align_schema(df: DataFrame, columns: dict[str, object], renames: dict[str, str] | None = None) -> DataFrame:
    """Old names become new ones and absent columns appear with their default."""
    out = df.withColumnsRenamed({o: n for o, n in (renames or {}).items() if o in df.columns})
    return out.withColumns({c: F.lit(d) for c, d in columns.items() if c not in out.columns})
