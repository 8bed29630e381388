"""News scoring: article texts to rows, hourly and minute statistics, decayed currency scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..functions import text as tx
from ..operators import scores as sc
from .inputs import ARTICLES, SCORE_FIELDS, articles, r, rnd, rounded, table
from .registry import query

AS_OF_SQL = "(SELECT max(ts) FROM events)"
V1_FIELDS = ["relevance_score", *SCORE_FIELDS]


def as_of(spark, sf):
    return table(spark, sf, "events").select(F.max("ts")).scalar()


def _stats_sql(fields, unit, quantiles, where=""):
    base = f"a AS (SELECT *, date_trunc('{unit}', ts) AS b FROM ({ARTICLES}) {where})"
    mids = ", ".join(f"avg({f}) OVER (PARTITION BY b, primary_ccy) AS mu_{f}" for f in fields)
    cols = [f"b AS {unit}_bucket", "primary_ccy AS symbol", "count(*) AS article_count"]
    for f in fields:
        d = f"({f} - mu_{f})"
        m2, m3, m4 = (f"avg({' * '.join([d] * p)})" for p in (2, 3, 4))
        guard = f"min({f}) = max({f})"
        cols += [
            f"{r(f'min({f})')} AS {f}_min", f"{r(f'max({f})')} AS {f}_max", f"{r(f'avg({f})')} AS {f}_mean",
            f"{r(f'stddev_pop({f})')} AS {f}_stddev",
            f"CASE WHEN {guard} THEN NULL ELSE {r(f'{m3} / pow({m2}, 1.5)')} END AS {f}_skewness",
            f"CASE WHEN {guard} THEN NULL ELSE {r(f'{m4} / ({m2} * {m2})')} END AS {f}_kurtosis",
        ]
        if quantiles:
            cols += [f"{r(f'max({f}) - min({f})')} AS {f}_range", f"{r(f'var_pop({f})')} AS {f}_variance"]
            cols += [f"{r(f'quantile_cont({f}, {p})')} AS {f}_{n}" for n, p in sc.QUANTILES.items()]
    return f"WITH {base}, c AS (SELECT *, {mids} FROM a) SELECT {', '.join(cols)} FROM c GROUP BY b, primary_ccy"


def _round_stats(df):
    keep = {"hour_bucket", "minute_bucket", "symbol", "article_count"}
    return rounded(df, *(c for c in df.columns if c not in keep))


@query("A1_hourly_score_statistics_v1", _stats_sql(V1_FIELDS, "hour", False))
def hourly_v1(spark, sf):
    return _round_stats(sc.score_statistics(articles(spark, sf), V1_FIELDS))


@query("A2_hourly_score_statistics", _stats_sql(SCORE_FIELDS, "hour", True))
def hourly_v2(spark, sf):
    return _round_stats(sc.score_statistics_with_quantiles(articles(spark, sf), SCORE_FIELDS))


@query("A3_minute_score_statistics", _stats_sql(SCORE_FIELDS, "minute", True))
def minute(spark, sf):
    return _round_stats(sc.score_statistics_with_quantiles(articles(spark, sf), SCORE_FIELDS, "minute"))


@query("A3_last_100_minutes", _stats_sql(SCORE_FIELDS, "minute", True,
       f"WHERE date_trunc('minute', ts) >= {AS_OF_SQL} - INTERVAL 100 MINUTE"))
def last_minutes(spark, sf):
    a = articles(spark, sf).filter(sc.bucket("ts", "minute") >= as_of(spark, sf) - F.expr("INTERVAL 100 MINUTES"))
    return _round_stats(sc.score_statistics_with_quantiles(a, SCORE_FIELDS, "minute"))


STATE_FIELDS = ["volatility_impact", "timeliness"]


@query("A4_merged_score_states", _stats_sql(STATE_FIELDS, "hour", False).replace(
    "date_trunc('hour', ts)", "date_trunc('day', ts)").replace("b AS hour_bucket", "b AS day_bucket"))
def merged_states(spark, sf):
    # partial states per insert block, merged on read
    a = articles(spark, sf).select(
        sc.bucket("ts", "day").alias("day_bucket"), F.col("primary_ccy").alias("symbol"),
        F.floor(F.col("event_id") / 1000).alias("insert_block"), *STATE_FIELDS)
    part = sc.partial_states(a, ["day_bucket", "symbol", "insert_block"], STATE_FIELDS)
    keys = ["day_bucket", "symbol"]
    out = sc.finish_states(sc.merge_states(part, keys, STATE_FIELDS), keys, STATE_FIELDS)
    out = out.drop(*(f"{m}_variance" for m in STATE_FIELDS))
    return rounded(out, *(c for c in out.columns if c not in {*keys, "article_count"}))


BIAS = ["bearish_prob", "bullish_prob", "neutral_prob", "relevance_score"]
UNPIVOT_SQL = " UNION ALL ".join(
    f"SELECT event_id, ts, '{f}' AS symbol, {f} AS score FROM a" for f in BIAS)


@query("P16_unpivot_bias", f"WITH a AS ({ARTICLES}) SELECT event_id, symbol, {r('score')} AS score FROM ({UNPIVOT_SQL})")
def unpivot_bias(spark, sf):
    return articles(spark, sf).unpivot(["event_id"], BIAS, "symbol", "score").withColumn("score", rnd("score"))


BIAS_SQL = f"""SELECT date_trunc('hour', ts) AS hour_bucket, symbol, sum(score) AS sum_score, count(*) AS article_count
FROM ({UNPIVOT_SQL}) GROUP BY ALL"""


@query("A5_bias_rollup", f"WITH a AS ({ARTICLES}) SELECT hour_bucket, symbol, {r('sum_score')} AS sum_score, article_count FROM ({BIAS_SQL})")
def bias_rollup(spark, sf):
    return rounded(sc.bias_rollup(articles(spark, sf), BIAS), "sum_score")


def decay_sql(h: str) -> str:
    slope = f"(log10(1 + greatest({h}, 0) / (20.0 / 60)) * 1.8)"
    return f"CASE WHEN {h} <= 0 OR {slope} <= 0 THEN 1.0 ELSE least(1.0, 1.0 / {slope}) END"


def age_sql(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) / 1e6) / 3600.0 - (epoch_us({earlier}) / 1e6) / 3600.0)"


@query("A6_decayed_currency_score", f"""
WITH a AS ({ARTICLES}), h AS ({BIAS_SQL}),
rec AS (SELECT * FROM h WHERE hour_bucket >= {AS_OF_SQL} - INTERVAL 168 HOUR),
w AS (SELECT *, {decay_sql(age_sql(AS_OF_SQL, 'hour_bucket'))} AS w, sum_score / article_count AS m FROM rec)
SELECT symbol, {r('sum(w * m) / sum(w)')} AS decayed_score, CAST(sum(article_count) AS BIGINT) AS article_count,
       (SELECT max(hour_bucket) FROM rec) AS latest_hour FROM w GROUP BY symbol""")
def decayed_currency_score(spark, sf):
    hourly = sc.bias_rollup(articles(spark, sf), BIAS)
    return rounded(sc.decayed_scores(hourly, as_of(spark, sf)), "decayed_score")


@query("A7_window_average", f"""
SELECT {', '.join(f'coalesce({r(f"avg({f})", 4)}, 0) AS {f}' for f in BIAS)}, count(*) AS article_count
FROM ({ARTICLES}) WHERE ts >= {AS_OF_SQL} - INTERVAL 24 HOUR""")
def window_average(spark, sf):
    a = articles(spark, sf).filter(F.col("ts") >= as_of(spark, sf) - F.expr("INTERVAL 24 HOURS"))
    return sc.window_average(a, BIAS)


@query("A8_latest_snapshot", f"""
SELECT primary_ccy AS symbol, arg_max(relevance_score, ts) AS score, max(ts) AS snapshot_ts FROM ({ARTICLES}) GROUP BY 1""")
def latest_snapshot(spark, sf):
    return articles(spark, sf).groupBy(F.col("primary_ccy").alias("symbol")).agg(
        F.max_by("relevance_score", "ts").alias("score"), F.max("ts").alias("snapshot_ts"))


@query("A9_table_profile", """
SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event_type <> '') AS with_currency,
       count(*) FILTER (value > 100) AS high_impact FROM events""")
def table_profile(spark, sf):
    return table(spark, sf, "events").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("event_type") != "").alias("with_currency"), F.count_if(F.col("value") > 100).alias("high_impact"))


@query("A10_group_count", "SELECT event_type AS primary_ccy, count(*) AS n FROM events GROUP BY 1")
def group_count(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("primary_ccy")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "primary_ccy")


@query("A49_symbol_snapshots", f"""
WITH a AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS snapshot_ts, unnest([primary_ccy, 'U' || (user_id % 3)]) AS symbol
           FROM ({ARTICLES})), w AS (SELECT *, {decay_sql(age_sql('snapshot_ts', 'ts'))} AS w FROM a)
SELECT snapshot_ts, symbol, {r('sum(w * relevance_score) / sum(w)')} AS score, count(*) AS article_count FROM w GROUP BY ALL""")
def symbol_snapshots(spark, sf):
    a = articles(spark, sf).withColumn(
        "symbols", F.array("primary_ccy", F.concat(F.lit("U"), (F.col("user_id") % 3).cast("string"))))
    return rounded(sc.symbol_snapshots(a, "symbols", "relevance_score"), "score")


@query("A50_trend_frames", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS hour_bucket, primary_ccy AS symbol, count(*) AS article_count, avg(bullish_prob) AS mean_score
           FROM ({ARTICLES}) GROUP BY ALL),
f AS (SELECT *, unnest([24, 48, 72]) AS frame_hours, {age_sql(AS_OF_SQL, 'hour_bucket')} AS age FROM h)
SELECT hour_bucket, symbol, article_count, {r('mean_score')} AS mean_score, frame_hours, {r(decay_sql('age'))} AS decay_weight
FROM f WHERE age <= frame_hours""")
def trend_frames(spark, sf):
    h = articles(spark, sf).groupBy(sc.bucket("ts", "hour").alias("hour_bucket"), F.col("primary_ccy").alias("symbol")).agg(
        F.count("*").alias("article_count"), F.avg("bullish_prob").alias("mean_score"))
    return rounded(sc.trend_frames(h, as_of(spark, sf)), "mean_score", "decay_weight")


@query("O1_recent_articles", """
SELECT event_id, ts, event_type AS primary_ccy, CAST(props->>'$.k' AS DOUBLE) AS k FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AND CAST(props->>'$.k' AS DOUBLE) >= 10
ORDER BY ts DESC, event_id LIMIT 50""")
def recent_articles(spark, sf):
    return (table(spark, sf, "events")
            .filter((F.col("ts") >= as_of(spark, sf) - F.expr("INTERVAL 48 HOURS")) & (tx.json_float("props", "k") >= 10))
            .select("event_id", "ts", F.col("event_type").alias("primary_ccy"), tx.json_float("props", "k").alias("k"))
            .orderBy(F.desc("ts"), "event_id").limit(50))


@query("P32_time_range", f"""
SELECT count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 6 HOUR) AS last_6_hours,
       count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 7 DAY) AS last_7_days,
       count(*) FILTER (ts >= {AS_OF_SQL} - INTERVAL 90 MINUTE) AS last_90_minutes FROM events""")
def time_range(spark, sf):
    now = as_of(spark, sf)
    since = lambda i: F.count_if(F.col("ts") >= now - F.expr(f"INTERVAL {i}"))
    return table(spark, sf, "events").agg(
        since("6 HOURS").alias("last_6_hours"), since("7 DAYS").alias("last_7_days"), since("90 MINUTES").alias("last_90_minutes"))


@query("P33_time_buckets", """
SELECT date_trunc('day', ts) AS day_bucket, hour(ts) AS hour_gmt, isodow(ts) - 1 AS dow, strftime(ts, '%Y%m') AS month_part,
       count(DISTINCT date_trunc('minute', ts)) AS minutes, count(*) AS n FROM events GROUP BY ALL""")
def time_buckets(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(
        sc.bucket("ts", "day").alias("day_bucket"), F.hour("t").alias("hour_gmt"), F.weekday("t").alias("dow"),
        F.date_format("t", "yyyyMM").alias("month_part"),
    ).agg(F.count_distinct(F.date_trunc("minute", "t")).alias("minutes"), F.count("*").alias("n"))


@query("P23_log_decay_weight", f"""
SELECT event_id, {r(decay_sql(age_sql(AS_OF_SQL, 'ts')))} AS weight FROM events""")
def log_decay_weight(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", rnd(mk.log_decay(mk.hours_between(as_of(spark, sf), "ts"))).alias("weight"))


# model answers as text: reasoning blocks, fences, bare and nested objects, no object at all
ANSWER = """CASE event_type
 WHEN 'view' THEN '<think>maybe {"k": 1}</think> Answer:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
 WHEN 'click' THEN 'Score is ' || props || ' and {"other": 2}'
 WHEN 'signup' THEN '<THINK>x' || chr(10) || 'y</THINK>' || '{"k": 15, "detail": ' || props || '} end'
 WHEN 'purchase' THEN '  {"score": ' || value || ', "rationale": "ok"'
 ELSE 'no object here' END"""


def answers(spark, sf):
    return table(spark, sf, "events").withColumn("answer", F.expr(ANSWER))


_T = r"regexp_replace(regexp_replace(answer, '<think>.*?</think>', '', 'gis'), '^\s+|\s+$', '', 'g')"
BODY_SQL = rf"""
t AS (SELECT event_id, event_type, value, {_T} AS t FROM (SELECT *, {ANSWER} AS answer FROM events)),
x AS (SELECT *, regexp_extract(t, '\{{.*?\}}', 0, 's') AS s, nullif(regexp_extract(t, '\{{.*\}}', 0, 's'), '') AS l FROM t),
body AS (SELECT event_id, event_type, value, CASE WHEN regexp_matches(t, '```(?:json)?\s*(.*?)```', 's')
   THEN nullif(regexp_replace(regexp_extract(t, '```(?:json)?\s*(.*?)```', 1, 's'), '^\s+|\s+$', '', 'g'), '')
   ELSE coalesce(CASE WHEN s <> '' AND json_valid(s) THEN s ELSE l END, CASE WHEN t LIKE '{{%' THEN t END) END AS body FROM x)"""


@query("P7_json_body", f"WITH {BODY_SQL} SELECT event_id, body FROM body")
def json_body(spark, sf):
    return answers(spark, sf).select("event_id", tx.json_body("answer").alias("body"))


@query("P8_score_extraction", rf"""WITH {BODY_SQL}
SELECT event_id, {r("coalesce(try_cast(CASE WHEN json_valid(body) THEN body->>'$.k' END AS DOUBLE), 0)")} AS k,
       {r("greatest(0, least(10, coalesce(try_cast(CASE WHEN json_valid(body) THEN body->>'$.k' END AS DOUBLE), 0)))")} AS k_clamped,
       {r("coalesce(try_cast(CASE WHEN json_valid(body) THEN body->>'$.missing' END AS DOUBLE), 0)")} AS missing FROM body""")
def score_extraction(spark, sf):
    b = answers(spark, sf).withColumn("body", tx.json_body("answer"))
    valid = F.when(F.try_parse_json("body").isNotNull(), F.col("body"))
    return b.withColumn("body", valid).select(
        "event_id", rnd(tx.json_float("body", "k")).alias("k"),
        rnd(tx.clamp(tx.json_float("body", "k"), 0, 10)).alias("k_clamped"), rnd(tx.json_float("body", "missing")).alias("missing"))


CCY_TEXT = """CASE event_type WHEN 'click' THEN ' usd ' WHEN 'view' THEN 'eur/usd cross, dollar leg' WHEN 'signup' THEN 'none'
 WHEN 'error' THEN '' ELSE 'jpy' || user_id END"""


@query("P9_primary_currency", f"""
WITH t AS (SELECT event_id, upper(trim({CCY_TEXT})) AS c FROM events)
SELECT event_id, CASE WHEN regexp_matches(c, '{"|".join(tx.MAJOR_CURRENCIES)}') THEN substr(c, 1, 16) END AS primary_ccy,
       regexp_matches(c, '{"|".join(tx.MAJOR_CURRENCIES)}') AS valid FROM t""")
def primary_currency(spark, sf):
    return table(spark, sf, "events").withColumn("c", F.expr(CCY_TEXT)).select(
        "event_id", tx.primary_currency("c").alias("primary_ccy"), tx.is_major_currency("c").alias("valid"))


@query("P10_symbols_default", """
SELECT event_id, array_to_string(CASE WHEN event_type IN ('view', 'click') THEN [event_type, 'EURUSD'] ELSE ['USDJPY', 'EURUSD', 'USD'] END, ',') AS symbols
FROM events""")
def symbols_default(spark, sf):
    found = F.when(F.col("event_type").isin("view", "click"), F.array("event_type", F.lit("EURUSD"))).otherwise(
        F.array().cast("array<string>"))
    return table(spark, sf, "events").select(
        "event_id", F.array_join(tx.symbols_or_default(found, ["USDJPY", "EURUSD", "USD"]), ",").alias("symbols"))


@query("P15_json_scalars", """
SELECT event_type, sum(coalesce(try_cast(props->>'$.k' AS DOUBLE), 0)) AS sum_k, sum(coalesce(try_cast(props->>'$.none' AS DOUBLE), 0)) AS sum_none,
       max(coalesce(props->>'$.k', '')) AS max_text FROM events GROUP BY 1""")
def json_scalars(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.sum(tx.json_float("props", "k")).alias("sum_k"), F.sum(tx.json_float("props", "none")).alias("sum_none"),
        F.max(tx.json_text("props", "k")).alias("max_text"))


@query("P30_safe_float", f"""
WITH t AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CAST('nan' AS DOUBLE) WHEN 'view' THEN CAST('inf' AS DOUBLE)
  WHEN 'error' THEN CAST('-inf' AS DOUBLE) ELSE value END AS x FROM events)
SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS safe,
       CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE greatest(-10, least(10, x)) END AS clamped FROM t""")
def safe_float(spark, sf):
    x = F.expr("CASE event_type WHEN 'click' THEN double('nan') WHEN 'view' THEN double('inf') WHEN 'error' THEN double('-inf') ELSE value END")
    return table(spark, sf, "events").withColumn("x", x).select(
        "event_id", mk.finite("x", 0.0).alias("safe"), mk.finite("x", 0.0, -10, 10).alias("clamped"))


@query("F5_score_schema", f"""WITH {BODY_SQL}
SELECT event_type, count(*) AS n, {", ".join(f"sum(coalesce(try_cast(CASE WHEN json_valid(body) THEN body->>'$.{f}' END AS DOUBLE), 0)) AS {f}" for f in ("k", "detail", "score"))}
FROM body GROUP BY 1""")
def score_schema(spark, sf):
    fields = ["k", "detail", "score"]
    b = answers(spark, sf).withColumn("body", tx.json_body("answer"))
    b = b.withColumn("body", F.when(F.try_parse_json("body").isNotNull(), F.col("body")))
    return b.withColumns(tx.score_columns("body", fields)).groupBy("event_type").agg(
        F.count("*").alias("n"), *(F.sum(f).alias(f) for f in fields))


@query("J4_new_articles", """
SELECT e.event_type, count(DISTINCT e.event_id) AS fresh FROM events e
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_orderstatus = 'F') GROUP BY 1""")
def new_articles(spark, sf):
    # stored ids are those of the finished orders; the batch is read once per id
    stored = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    batch = table(spark, sf, "events").select("event_id", "event_type")
    from ..operators.sets import unseen
    return unseen(batch, stored, "event_id").groupBy("event_type").agg(F.count("*").alias("fresh"))


OUTCOME = """CASE WHEN user_id % 7 = 0 THEN 'duplicate' WHEN value < 1 THEN 'no_content' WHEN event_type = 'signup' THEN 'no_currency'
 WHEN event_type = 'error' THEN 'error' ELSE 'inserted' END"""


@query("A46_run_outcomes", f"""
WITH o AS (SELECT date_trunc('day', ts) AS cycle, {OUTCOME} AS outcome FROM events),
c AS (SELECT cycle, {", ".join(f"count(*) FILTER (outcome = '{n}') AS {n}" for n in ("inserted", "duplicate", "no_content", "no_currency", "error"))},
      count(*) FILTER (outcome NOT IN ('duplicate', 'no_content')) AS processed FROM o GROUP BY 1)
SELECT *, CASE WHEN processed = 0 AND duplicate = 0 THEN 'empty' WHEN error > processed * 0.5 THEN 'partial' ELSE 'ok' END AS status FROM c""")
def run_outcomes(spark, sf):
    from ..operators.quality import run_outcomes as count_outcomes
    o = table(spark, sf, "events").select(sc.bucket("ts", "day").alias("cycle"), F.expr(OUTCOME).alias("outcome"))
    return count_outcomes(o, ["cycle"])
