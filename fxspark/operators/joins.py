"""Joins that keep rows whose keys are NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on ``keys`` where NULL equals NULL; the columns of ``left`` come first."""
    own = {k: f"_right_{k}" for k in keys}
    r = right.withColumnsRenamed(own)
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()))
    return left.join(r, match, how).drop(*own.values())
