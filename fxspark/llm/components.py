"""Connected components of a table of edges, by alternating star contraction over joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import stored


def _pull(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (all of them, or the smaller ones) move to the least of them and itself."""
    if both:
        side = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        side = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = side.join(least, "a")
    if both:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for every node of the long edges ``a``, ``b``.

    Rounds go on until nothing moves; each round's edges are stored in the shared folder.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = stored(_pull(_pull(now, True), False), tag)
        new = mark(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(roots)
