"""Streaming queries over the scored articles, delivered as several files and read batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores as sc
from ..session import work_dir
from ..streaming import jobs
from .inputs import articles, rounded, table
from .news import BIAS, OUTCOME, STATE_FIELDS, _stats_sql, as_of
from .registry import SQL, query

FILES = 3


def stream(spark, sf, copies=False):
    """The articles staged as files, then read as a stream; ``copies`` adds repeated deliveries."""
    a = articles(spark, sf)
    if copies:
        a = a.unionByName(a.filter("user_id % 3 = 0"))
    path = work_dir(spark, "inbox")
    a.repartition(FILES, "event_id").write.mode("overwrite").parquet(path)
    return jobs.article_stream(spark, path, a.schema)


@query("T1_hourly_stream", _stats_sql(STATE_FIELDS, "hour", False).replace("AS hour_bucket", "AS bucket"))
def hourly_stream(spark, sf):
    out = jobs.hourly_statistics(stream(spark, sf), STATE_FIELDS)
    return rounded(out, *(c for c in out.columns if c not in ("bucket", "symbol", "article_count")))


@query("T2_minute_stream", _stats_sql(STATE_FIELDS, "minute", False,
       "WHERE date_trunc('minute', ts) >= (SELECT max(ts) FROM events) - INTERVAL 100 MINUTE").replace("AS minute_bucket", "AS bucket"))
def minute_stream(spark, sf):
    path = jobs.score_states(stream(spark, sf), STATE_FIELDS, "minute")
    recent = spark.read.parquet(path).filter(F.col("bucket") >= as_of(spark, sf) - F.expr("INTERVAL 100 MINUTES"))
    return _finish(recent)


def _finish(states):
    keys = ["bucket", "symbol"]
    out = sc.finish_states(sc.merge_states(states, keys, STATE_FIELDS), keys, STATE_FIELDS)
    out = out.drop(*(f"{m}_variance" for m in STATE_FIELDS))
    return rounded(out, *(c for c in out.columns if c not in (*keys, "article_count")))


@query("T3_additive_stream", SQL["A5_bias_rollup"])
def additive_stream(spark, sf):
    return rounded(jobs.additive_rollup(stream(spark, sf), BIAS), "sum_score")


@query("T4_latest_state_stream", "SELECT event_type AS primary_ccy, ts, event_id, value AS volatility_impact FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_state_stream(spark, sf):
    out = jobs.latest_state(stream(spark, sf), "primary_ccy", ["ts", "event_id"], ["volatility_impact"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T5_forward_stream", "SELECT event_id, event_type AS primary_ccy, value AS volatility_impact FROM events WHERE value >= 100 AND CAST(props->>'$.k' AS DOUBLE) >= 5")
def forward_stream(spark, sf):
    cond = (F.col("volatility_impact") >= 100) & (F.col("timeliness") >= 5)
    return jobs.forward(stream(spark, sf), cond, ["event_id", "primary_ccy", "volatility_impact"])


@query("T6_ingest_once_stream", "SELECT event_id, event_type AS primary_ccy FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def ingest_once_stream(spark, sf):
    stored = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return jobs.ingest_once(stream(spark, sf, copies=True), stored, "event_id", ["event_id", "primary_ccy"])


@query("T7_late_rows_stream", """WITH h AS (SELECT DISTINCT date_trunc('hour', ts), event_type FROM events)
SELECT lateness, (SELECT count(*) FROM h) AS buckets, (SELECT count(*) FROM events) AS articles FROM (SELECT unnest(['none', '40 days']) AS lateness)""")
def late_rows_stream(spark, sf):
    """Buckets and rows kept with no lateness limit and with one that covers all input."""
    s = stream(spark, sf)
    count = lambda name, late: jobs.hourly_statistics(s, ["timeliness"], lateness=late).agg(
        F.lit(name).alias("lateness"), F.count("*").alias("buckets"), F.sum("article_count").alias("articles"))
    return count("none", None).unionByName(count("40 days", "40 days"))


@query("T8_backfill_parity", _stats_sql(STATE_FIELDS, "hour", False).replace("AS hour_bucket", "AS bucket"))
def backfill_parity(spark, sf):
    """States written batch by batch for even identifiers and by one backfill for odd ones, merged."""
    s = stream(spark, sf)
    path = jobs.score_states(s.filter(F.col("event_id") % 2 == 0), STATE_FIELDS, "hour")
    rest = articles(spark, sf).filter("event_id % 2 = 1").select(sc.bucket("ts", "hour").alias("bucket"), F.col("primary_ccy").alias("symbol"), *STATE_FIELDS)
    back = sc.partial_states(rest, ["bucket", "symbol"], STATE_FIELDS)
    return _finish(spark.read.parquet(path).drop("batch").unionByName(back))


@query("T9_ingest_cycles", SQL["A46_run_outcomes"])
def ingest_cycles(spark, sf):
    outcome = F.expr(OUTCOME.replace("value", "volatility_impact").replace("event_type", "primary_ccy"))
    return jobs.cycles(stream(spark, sf), outcome, sc.bucket("ts", "day"))


# -- two runs over a growing folder -------------------------------------------------------


def arrivals(spark, sf):
    """A folder that grows: ``arrive(0)`` and ``arrive(1)`` deliver a half of the articles each; and the stream over it."""
    a = articles(spark, sf)
    path = work_dir(spark, "inbox")

    def arrive(half):
        a.filter(F.col("event_id") % 2 == half).repartition(2, "event_id").write.mode("append").parquet(path)
        return jobs.article_stream(spark, path, a.schema)

    return arrive


@query("T1_resumed_hourly_stream", SQL["T1_hourly_stream"])
def resumed_hourly_stream(spark, sf):
    arrive, home = arrivals(spark, sf), work_dir(spark, "home")
    for half in (0, 1):
        out = jobs.hourly_statistics(arrive(half), STATE_FIELDS, home=home)
    return rounded(out, *(c for c in out.columns if c not in ("bucket", "symbol", "article_count")))


@query("T3_resumed_additive_stream", SQL["T3_additive_stream"])
def resumed_additive_stream(spark, sf):
    arrive, home = arrivals(spark, sf), work_dir(spark, "home")
    for half in (0, 1):
        out = jobs.additive_rollup(arrive(half), BIAS, home=home)
    return rounded(out, "sum_score")


@query("T6_resumed_ingest_once_stream", SQL["T6_ingest_once_stream"])
def resumed_ingest_once_stream(spark, sf):
    """The second run delivers the first half once more."""
    stored = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    arrive, home = arrivals(spark, sf), work_dir(spark, "home")
    for half in (0, 1, 0):
        out = jobs.ingest_once(arrive(half), stored, "event_id", ["event_id", "primary_ccy"], home=home)
    return out
