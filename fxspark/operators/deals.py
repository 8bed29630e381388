"""Composite scores, ranks and explanations of deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import params as pm
from ..functions.text import two_places
from .series import Series


def dimension_map(scores: dict[str, Column], overrides: dict[str, float] | None = None) -> Column:
    """Dimension scores with their weights as a map; ``overrides`` replaces single weights."""
    w = {k: v[0] for k, v in pm.DIMENSIONS.items()} | (overrides or {})
    return F.map_from_arrays(
        F.array(*map(F.lit, scores)),
        F.array(*(F.struct(s.cast("double").alias("score"), F.lit(float(w.get(k, 1.0))).alias("weight")) for k, s in scores.items())),
    )


def composite(dims, inverted: list[str] | None = None, digits: int = 4) -> Column:
    """Weighted mean of the dimension scores, inverted ones as 10 - score; no dimensions give 0."""
    c = F.col(dims) if isinstance(dims, str) else dims
    inverted = [k for k, v in pm.DIMENSIONS.items() if v[1]] if inverted is None else inverted
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def add(acc, e):
        v = e["value"]
        eff = F.when(e["key"].isin(inverted), 10.0 - v["score"]).otherwise(v["score"]) if inverted else v["score"]
        return F.struct((acc["n"] + eff * v["weight"]).alias("n"), (acc["d"] + v["weight"]).alias("d"))

    return F.aggregate(
        F.map_entries(c), start, add,
        lambda a: F.when(a["d"] != 0, F.round(F.try_divide(a["n"], a["d"]), digits)).otherwise(0.0),
    )


def rank(df: DataFrame, score: str, position: str, name: str = "rank") -> DataFrame:
    """Rank by score, highest first, ties by input position.

    Scores are rounded, so there are at most some ten thousand distinct ones: their counts give the
    offset of each score, and rows of one score are numbered in blocks. No task sorts all rows.
    """
    counts = df.groupBy(score).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct score
    offsets = counts.select(score, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = Series.by_id(df, [score], position).number().result()
    return numbered.join(offsets, score).withColumn(name, F.col("_off") + F.col("_rn")).drop("_off", "_rn")


def explanation(dims="dimensions", rank="rank", score="composite_score") -> Column:
    """One sentence naming the two strongest dimensions and the weakest by weight x score."""
    c = F.col(dims)
    order = F.array(*map(F.lit, pm.DIMENSIONS))
    parts = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(
        (-(e["value"]["weight"] * e["value"]["score"])).alias("neg"), F.array_position(order, e["key"]).alias("pos"), e["key"].alias("k"))))
    labels = F.create_map(*(F.lit(v) for kv in pm.DIMENSION_LABELS.items() for v in kv))
    say = lambda k: F.coalesce(F.try_element_at(labels, k), k)
    strong = F.array_join(F.transform(F.slice(parts, 1, 2), lambda p: say(p["k"])), " and ")
    text = F.concat(
        F.lit("Rank #"), F.col(rank).cast("string"), F.lit(" (composite "), two_places(F.col(score)), F.lit("/10): strong "),
        strong, F.lit(" drive this result, despite moderate "), say(F.try_element_at(parts, F.lit(-1))["k"]), F.lit("."))
    return F.when(F.size(F.map_keys(c)) > 0, text).otherwise("No dimension scores available.")
