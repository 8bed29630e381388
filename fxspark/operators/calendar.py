"""Scores of calendar events per currency pair and the risk that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import params as pm
from ..functions.text import two_places
from ..functions.market import seconds
from .joins import same_keys
from .ranking import dedup_events
from .scores import bucket


def named(events: DataFrame, name: str = "event_name", country: str = "country", impact: str | None = None) -> DataFrame:
    """Events with ``event_type`` and, where a raw ``impact`` column is named, the corrected ``impact``.

    Names repeat far more often than they are coined: the patterns are matched once for each distinct (name, country), and the
    dictionary is joined back by key. A NULL name or country is a key like any other.
    """
    key = [name, country]
    raised = {} if impact is None else {"_high": cal.high_impact(country, name)}
    names = events.select(*key).distinct().withColumns({"event_type": cal.event_type(name, country), **raised})
    out = same_keys(events, names, key)
    return out if impact is None else out.withColumn("impact", cal.raised(impact, F.col("_high"))).drop("_high")


def normalize(raw: DataFrame) -> DataFrame:
    """Raw calendar rows (event, date, country, currency, impact, actual, estimate, previous) to events.

    Rows whose date cannot be read are left out.
    """
    at = F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    land = F.coalesce("country", F.lit("US"))
    rows = raw.withColumns({"event_datetime": at, "_land": land, "_name": F.coalesce("event", F.lit(""))}).filter("event_datetime IS NOT NULL")
    land, kind = F.col("_land"), F.col("_kind")
    rows = named(rows.withColumnRenamed("impact", "_impact").drop("event_type"), "_name", "_land", "_impact").withColumnRenamed("event_type", "_kind")
    return rows.select(
        F.concat_ws("-", land, kind, F.date_format("event_datetime", "yyyy-MM-dd'T'HH:mm:ss")).alias("event_id"),
        F.coalesce("event", F.lit("Unknown")).alias("event_name"),
        kind.alias("event_type"), land.alias("country"), F.coalesce("currency", F.lit("USD")).alias("currency"),
        "event_datetime", "impact", "actual", "estimate", "previous",
    )


def deduplicate(events: DataFrame, arrival: str) -> DataFrame:
    """One event per (country, minute, bare name)."""
    keys = [F.col("country"), bucket("event_datetime", "minute"), cal.dedup_name("event_name")]
    return dedup_events(events, keys, "actual", "event_name", arrival)


def timing(events: DataFrame, as_of: Column, decay: DataFrame | None = None) -> DataFrame:
    """Minutes since release (NULL before it) and the decay or anticipation factor."""
    decay = pm.decay_frame(events.sparkSession) if decay is None else decay
    passed = (seconds(as_of) - seconds("event_datetime")) / 60
    d = events.join(decay, "event_type", "left").withColumn("_passed", passed)
    fast, slow, alpha = (F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("fast_halflife", "slow_halflife", "alpha"), pm.DECAY_DEFAULT))
    released = F.col("actual").isNotNull()
    factor = (
        F.when(released & (F.col("_passed") > 0), cal.decay("_passed", fast, slow, alpha))
        .when(F.col("_passed") < 0, cal.anticipation(-F.col("_passed")))
        .otherwise(1.0)
    )
    return d.withColumns(
        {"minutes_since_release": F.when(released, F.col("_passed")), "time_factor": factor}
    ).drop("_passed", "fast_halflife", "slow_halflife", "alpha")


def pair_relevance(events: DataFrame, pairs: list[str] | None = None, relevance: DataFrame | None = None, gate: bool = True) -> DataFrame:
    """One row per (event, pair) with its relevance; 0 where the table has none.

    With ``gate`` an event counts for a pair only if its country belongs to the pair or its type is
    known to matter across countries.
    """
    spark = events.sparkSession
    relevance = pm.relevance_frame(spark) if relevance is None else relevance
    pairs = pairs or pm.PAIRS
    land = F.create_map(*(x for p in pairs for x in (F.lit(p), F.array(*map(F.lit, pm.PAIR_COUNTRIES.get(p, []))).cast("array<string>"))))
    long = events.withColumn("pair", F.explode(F.array(*map(F.lit, pairs)))).join(relevance, ["event_type", "pair"], "left")
    rel = F.coalesce("relevance", F.lit(0.0))
    if gate:
        rel = F.when(F.array_contains(land[F.col("pair")], F.col("country")) | cal.is_cross_type("event_type"), rel).otherwise(0.0)
    return long.withColumn("relevance", rel)


def score(events: DataFrame, as_of: Column, pairs: list[str] | None = None, relevance: DataFrame | None = None, decay: DataFrame | None = None, sigma: DataFrame | None = None) -> DataFrame:
    """Composite score per (event, pair): relevance x impact x surprise x time.

    ``sigma`` (event_type, sigma) turns released values into a multiplier of at most 3; without it the
    multiplier is 1.
    """
    ev = timing(events, as_of, decay)
    if sigma is None:
        ev = ev.withColumn("surprise_z", F.lit(None).cast("double"))
    else:
        known = F.col("actual").isNotNull() & F.col("estimate").isNotNull() & (F.col("sigma") != 0)
        ev = ev.join(sigma, "event_type", "left").withColumn(
            "surprise_z", F.when(known, cal.surprise_z("actual", "estimate", "sigma"))).drop("sigma")
    boost = F.when(F.col("surprise_z").isNull(), F.lit(1.0)).otherwise(F.least(F.abs("surprise_z"), F.lit(3.0)))
    long = pair_relevance(ev, pairs, relevance)
    return long.withColumn("score", F.col("relevance") * cal.impact_weight("impact") * boost * F.col("time_factor"))


def macro_risk(scored: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW per pair."""
    m, s = F.col("minutes_since_release"), F.col("score")
    g = scored.groupBy("pair").agg(
        F.coalesce(F.max(m.between(-30, 30) & (s > 0.7)), F.lit(False)).alias("_hot"),
        F.coalesce(F.sum(F.when(m.isNull() | m.between(-120, 120), s)), F.lit(0.0)).alias("near_score"),
    )
    return g.select("pair", "near_score", F.when(F.col("_hot"), "HIGH").when(F.col("near_score") > 1.5, "MEDIUM").otherwise("LOW").alias("risk"))


def relevant(scored: DataFrame, cut: float = 0.05, high: float = 0.7, imminent: float = -30) -> DataFrame:
    """Events whose best score reaches ``cut``, with a flag for high impact that is near or past."""
    top = scored.groupBy("row_id").agg(F.max("score").alias("best_score"), F.max("minutes_since_release").alias("minutes_since_release"))
    near = F.coalesce("minutes_since_release", F.lit(0.0)) >= imminent
    return top.filter(F.col("best_score") >= cut).withColumn("high_impact_imminent", (F.col("best_score") >= high) & near)


def report_lines(scored: DataFrame, top: int = 3, floor: float = 0.1) -> DataFrame:
    """Per event its time bucket and its best pairs as text. Events released over four hours ago are left out."""
    m = F.col("minutes_since_release")
    when = F.when(m.isNull() | (m < 0), "upcoming").when(m <= 30, "imminent").when(m <= 240, "recent")
    order = F.array_position(F.array(*map(F.lit, pm.PAIRS)), F.col("pair"))
    # an event has one row per requested pair, so the list is as long as the pair list
    g = scored.withColumn("bucket", when).filter("bucket IS NOT NULL").groupBy("row_id", "bucket").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), order.alias("pos"), "pair"))).alias("_l"))
    kept = F.filter(F.slice("_l", 1, top), lambda x: -x["neg"] > floor)
    return g.select("row_id", "bucket", F.array_join(
        F.transform(kept, lambda x: F.concat(x["pair"], F.lit(" ("), two_places(-x["neg"]), F.lit(")"))), ", ").alias("affected_pairs"))


def weighted_surprise(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Weighted mean of indicator surprises per key; indicators without a value count as 0."""
    # absent indicators add nothing to the numerator, so only the weight total needs the whole list
    z = rows.groupBy(*keys, "indicator").agg(F.avg("z").alias("z")).join(weights, "indicator").groupBy(*keys).agg(
        F.sum(F.col("z") * F.col("weight")).alias("_s"))
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).scalar()
    known = rows.select(*keys).distinct().join(z, keys, "left").withColumn("_w", total)
    return known.select(*keys, F.when(F.col("_w") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.coalesce("_s", F.lit(0.0)), F.col("_w"))).alias("surprise_index"))
