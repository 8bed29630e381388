"""Session and hour volume statistics, anomalies, forecasts, clusters, feature ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..operators import models as md
from ..operators import quality as ql
from ..operators import ranking as rk
from ..operators import volume as vo
from ..operators.series import Series
from .bars import TR, fr, full, step, win
from .inputs import BARS, bars, r, rnd, rounded, table, unnamed, unnamed_bars
from .registry import SQL, query

SESSION_SQL = "CASE " + " ".join(f"WHEN hour_gmt IN ({', '.join(map(str, h))}) THEN '{s}'" for s, h in mk.SESSION_HOURS.items()) + " END"
B = f"b AS (SELECT symbol AS pair, hour(ts) AS hour_gmt, strftime(ts, '%Y-%m-%d') AS date, ts, volume, close, high, low FROM ({BARS}))"
HOURLY = "h AS (SELECT pair, hour_gmt, sum(volume) AS total_volume, count(*) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1, 2)"
SESSIONS = f"""s AS (SELECT pair, {SESSION_SQL} AS session, sum(total_volume) AS volume, CAST(sum(bar_count) AS BIGINT) AS bar_count,
  sum(total_volume) / sum(bar_count) AS avg_volume, coalesce(stddev_samp(total_volume), 0) AS std_volume, median(total_volume) AS median_volume,
  min(total_volume) AS min_volume, max(total_volume) AS max_volume FROM h GROUP BY 1, 2)"""
TOTALS = "t AS (SELECT pair, date, hour_gmt, sum(volume) AS hourly_volume FROM b GROUP BY 1, 2, 3)"
DAILY = "d AS (SELECT pair, date, sum(volume) AS daily_volume FROM b GROUP BY 1, 2)"


def as_text(df, c="date"):
    return df.withColumn(c, F.col(c).cast("string"))


@query("P6_trading_session", f"WITH {B} SELECT pair, {SESSION_SQL} AS session, count(*) AS n FROM b GROUP BY 1, 2")
def trading_session(spark, sf):
    return bars(spark, sf).groupBy(F.col("symbol").alias("pair"), mk.session_of(vo.hour_of()).alias("session")).agg(F.count("*").alias("n"))


@query("A17_hourly_volume", f"WITH {B}, {HOURLY} SELECT * FROM h")
def hourly_volume(spark, sf):
    return vo.hourly_totals(bars(spark, sf))


@query("A18_hourly_breakdown", f"""WITH {B} SELECT pair, hour_gmt, sum(volume) AS total_volume, count(*) AS bar_count, min(ts) AS first_ts, max(ts) AS last_ts,
 {r('quantile_cont(volume, 0.75)')} AS p75_volume, CAST(0 AS DOUBLE) AS avg_z_score,
 {r('CASE WHEN stddev_pop(volume) > 0 THEN (max(volume) - avg(volume)) / stddev_pop(volume) ELSE 0 END')} AS max_z_score FROM b GROUP BY 1, 2""")
def hourly_breakdown(spark, sf):
    return rounded(vo.hourly_breakdown(bars(spark, sf)), "p75_volume", "max_z_score")


@query("A19_coverage", f"WITH {B} SELECT pair, count(DISTINCT date) AS days, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY 1")
def coverage(spark, sf):
    return vo.coverage(bars(spark, sf))


@query("A20_daily_volume", f"WITH {B}, {DAILY} SELECT * FROM d")
def daily_volume(spark, sf):
    return as_text(vo.daily_totals(bars(spark, sf)))


@query("A21_date_hour_volume", f"WITH {B}, {TOTALS} SELECT * FROM t")
def date_hour_volume(spark, sf):
    return as_text(vo.date_hour_totals(bars(spark, sf)))


@query("A22_session_statistics", f"""WITH {B}, {HOURLY}, {SESSIONS} SELECT pair, session, volume, bar_count, {r('avg_volume')} AS avg_volume, {r('std_volume')} AS std_volume,
 median_volume, min_volume, max_volume, {r('CASE WHEN avg_volume <> 0 THEN std_volume / avg_volume ELSE 0 END')} AS cv FROM s""")
def session_statistics(spark, sf):
    return rounded(vo.session_statistics(vo.hourly_totals(bars(spark, sf))), "avg_volume", "std_volume", "cv")


@query("A22_null_pair", unnamed(SQL["A22_session_statistics"], "pair"))
def session_statistics_without_name(spark, sf):
    return rounded(vo.session_statistics(vo.hourly_totals(unnamed_bars(spark, sf))), "avg_volume", "std_volume", "cv")


@query("A23_session_summary", f"""WITH {B}, {HOURLY}, {SESSIONS}, g AS (SELECT session, sum(volume) AS total_volume, count(*) AS pair_count FROM s WHERE volume > 0 GROUP BY 1)
SELECT session, total_volume, pair_count, {r('total_volume / pair_count')} AS average_per_pair, row_number() OVER (ORDER BY total_volume DESC, session) AS rank,
 {r('100 * total_volume / sum(total_volume) OVER ()', 2)} AS pct_of_total FROM g""")
def session_summary(spark, sf):
    return rounded(vo.session_summary(vo.session_statistics(vo.hourly_totals(bars(spark, sf)))), "average_per_pair")


@query("A24_pair_counts", f"WITH {B} SELECT pair, count(*) AS n FROM b GROUP BY 1")
def pair_counts(spark, sf):
    return bars(spark, sf).groupBy(F.col("symbol").alias("pair")).agg(F.count("*").alias("n"))


TR1 = TR.replace("greatest(", "CASE WHEN lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts) IS NOT NULL THEN greatest(", 1) + " END"


@query("A25_atr_volume_correlation", win(step(0, tr=TR1), step(1, atr=full("avg(tr)", 14, lead=1)),
       f"SELECT symbol AS pair, {r('coalesce(corr(atr, volume), 0)')} AS correlation FROM b2 WHERE atr IS NOT NULL GROUP BY 1"))
def atr_volume_correlation(spark, sf):
    return rounded(vo.atr_volume_correlation(bars(spark, sf)), "correlation")


@query("A25_constant_pair", f"SELECT pair, CASE WHEN pair = 'view' THEN 0 ELSE correlation END AS correlation FROM ({SQL['A25_atr_volume_correlation']})")
def correlation_of_a_constant(spark, sf):
    """One pair never moves: its range has no deviation to correlate."""
    still = {c: F.when(F.col("symbol") == "view", F.lit(1.0)).otherwise(F.col(c)) for c in ("high", "low", "close")}
    return rounded(vo.atr_volume_correlation(bars(spark, sf).withColumns(still)), "correlation")


@query("A26_session_baselines", win(step(0, tr=TR, pair="symbol", hour_gmt="hour(ts)"), step(1, atr=full("avg(tr)", 14)), f"""
SELECT pair, session, {r('mean_volume')} AS mean_volume, {r('std_volume')} AS std_volume, {r('mean_atr')} AS mean_atr, {r('std_atr')} AS std_atr FROM (
 SELECT pair, {SESSION_SQL} AS session, avg(atr) AS mean_atr, stddev_samp(atr) AS std_atr FROM b2 WHERE atr IS NOT NULL GROUP BY 1, 2)
JOIN (WITH {B}, {HOURLY}, {SESSIONS} SELECT pair, session, avg_volume AS mean_volume, std_volume FROM s) USING (pair, session)"""))
def session_baselines(spark, sf):
    return rounded(vo.session_baselines(bars(spark, sf)), "mean_volume", "std_volume", "mean_atr", "std_atr")


def _mad_sql(feats, part):
    med = ", ".join(f"median({f}) AS m_{f}" for f in feats)
    dev = ", ".join(f"abs({f} - m_{f}) AS d_{f}" for f in feats)
    mad = ", ".join(f"median(d_{f}) AS s_{f}" for f in feats)
    sc = " + ".join(f"d_{f} / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END" for f in feats)
    p = ", ".join(part)
    return f"""med AS (SELECT {p}, {med} FROM x GROUP BY {p}), dev AS (SELECT x.*, {dev} FROM x JOIN med USING ({p})),
mad AS (SELECT {p}, {mad} FROM dev GROUP BY {p}), sc AS (SELECT dev.*, {sc} AS score FROM dev JOIN mad USING ({p})),
cut AS (SELECT pair, quantile_cont(score, 0.9) AS cut FROM sc GROUP BY pair)"""


DAILY_ANOMALY = f"""{B}, {DAILY}, l AS (SELECT *, daily_volume AS v, lag(daily_volume) OVER w AS lag1, lag(daily_volume, 2) OVER w AS lag2 FROM d WINDOW w AS (PARTITION BY pair ORDER BY date)),
x AS (SELECT * FROM l WHERE lag2 IS NOT NULL), {_mad_sql(['v', 'lag1', 'lag2'], ['pair'])},
a AS (SELECT pair, date, daily_volume, CAST(score > cut AS INTEGER) AS is_anomaly, score AS anomaly_score FROM sc JOIN cut USING (pair)
 UNION ALL SELECT pair, date, daily_volume, 0, 0 FROM l WHERE lag2 IS NULL)"""


@query("M9_daily_anomalies", f"WITH {DAILY_ANOMALY} SELECT pair, date, daily_volume, is_anomaly, {r('anomaly_score')} AS anomaly_score FROM a")
def daily_anomalies(spark, sf):
    return as_text(rounded(vo.daily_anomalies(vo.daily_totals(bars(spark, sf))), "anomaly_score"))


@query("M9_hourly_anomalies", f"""WITH {B}, {TOTALS}, x AS (SELECT *, hourly_volume AS v, lag(hourly_volume) OVER (PARTITION BY pair ORDER BY date, hour_gmt) AS lag1,
 isodow(CAST(date AS DATE)) - 1 AS dow FROM t QUALIFY lag1 IS NOT NULL), {_mad_sql(['v', 'lag1'], ['pair', 'dow'])}
SELECT pair, date, hour_gmt, hourly_volume, CAST(score > cut AS INTEGER) AS is_anomaly, {r('score')} AS anomaly_score FROM sc JOIN cut USING (pair)""")
def hourly_anomalies(spark, sf):
    return as_text(rounded(vo.hourly_anomalies(vo.date_hour_totals(bars(spark, sf))), "anomaly_score"))


# each 29th hour of a pair is planted: a hundred times its volume and more
PLANTED = f"""{B}, {TOTALS}, n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY date, hour_gmt) AS rn FROM t)"""


def planted_hours(spark, sf):
    rl = Series.of(vo.date_hour_totals(bars(spark, sf)), ["pair"], ["date", "hour_gmt"], {"_month": F.trunc("date", "month")}).number().result()
    high = F.when(F.col("_rn") % 29 == 0, 100 * F.col("hourly_volume") + 10_000).otherwise(F.col("hourly_volume"))
    return rl.withColumns({"planted": F.col("_rn") % 29 == 0, "hourly_volume": high}).drop("_rn")


@query("M9_isolated_hours", f"""WITH {PLANTED} SELECT pair, count(*) AS n_hours, count(*) FILTER (rn % 29 = 0) AS planted, count(*) FILTER (rn % 29 = 0) AS caught FROM n GROUP BY 1""")
def isolated_hours(spark, sf):
    """Planted hours that isolation trees flag at a share of a tenth. The hour behind a planted one has an unusual lag and may be flagged too."""
    p = planted_hours(spark, sf)
    found = vo.isolated_hours(p.drop("planted")).join(p.select("pair", "date", "hour_gmt", "planted"), ["pair", "date", "hour_gmt"])
    return found.groupBy("pair").agg(F.count("*").alias("n_hours"), F.count_if("planted").alias("planted"), F.count_if(F.col("planted") & (F.col("is_anomaly") == 1)).alias("caught"))


@query("M9_null_pair", unnamed(SQL["M9_hourly_anomalies"], "pair"))
def hourly_anomalies_without_name(spark, sf):
    return as_text(rounded(vo.hourly_anomalies(vo.date_hour_totals(unnamed_bars(spark, sf))), "anomaly_score"))


FORECAST = """n AS (SELECT *, lag(hourly_volume) OVER w AS x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY pair, hour_gmt) AS n FROM t
  WINDOW w AS (PARTITION BY pair, hour_gmt ORDER BY date)), k AS (SELECT *, rn <= floor(n * 0.8) AS train FROM n WHERE n >= 5),
f AS (SELECT pair, hour_gmt, max(n) AS n_points, coalesce(regr_intercept(hourly_volume, x) + regr_slope(hourly_volume, x) * arg_max(hourly_volume, rn), avg(hourly_volume)) AS next_volume_forecast,
  regr_slope(hourly_volume, x) FILTER (train) AS bt, regr_intercept(hourly_volume, x) FILTER (train) AS a_t, avg(hourly_volume) FILTER (train) AS mt FROM k GROUP BY 1, 2),
e AS (SELECT pair, hour_gmt, avg(abs(hourly_volume - coalesce(a_t + bt * x, mt))) AS holdout_mae FROM k JOIN f USING (pair, hour_gmt) WHERE NOT train GROUP BY 1, 2)"""


@query("M10_next_volume_forecast", f"""WITH {B}, {TOTALS}, {FORECAST}
SELECT pair, hour_gmt, n_points, {r('next_volume_forecast')} AS next_volume_forecast, {r('holdout_mae')} AS holdout_mae FROM f LEFT JOIN e USING (pair, hour_gmt)""")
def next_volume_forecast(spark, sf):
    return rounded(vo.next_volume_forecast(vo.date_hour_totals(bars(spark, sf))), "next_volume_forecast", "holdout_mae")


@query("M10_autoregression", f"""WITH {B}, {TOTALS}, m AS (SELECT pair, hour_gmt, avg(hourly_volume) AS mean, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 5),
x AS (SELECT pair, hour_gmt, n, mean, hourly_volume - mean AS x, lag(hourly_volume - mean) OVER w AS x1, lag(hourly_volume - mean, 2) OVER w AS x2, row_number() OVER w AS rn FROM t JOIN m USING (pair, hour_gmt)
  WINDOW w AS (PARTITION BY pair, hour_gmt ORDER BY date)),
s AS (SELECT pair, hour_gmt, max(n) AS n, max(mean) AS mean, sum(x * x) AS r0, coalesce(sum(x * x1), 0) AS r1, coalesce(sum(x * x2), 0) AS r2, arg_max(x, rn) AS l0, arg_max(x1, rn) AS l1 FROM x GROUP BY 1, 2),
c AS (SELECT *, r1 / r0 AS k1, (r1 * r0 - r1 * r2) / (r0 * r0 - r1 * r1) AS b1, (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) AS b2 FROM s),
e AS (SELECT *, n * ln(r0 / n) + 2 AS c0, n * ln(r0 / n * (1 - k1 * k1)) + 4 AS c1, n * ln(r0 / n * (1 - k1 * k1) * (1 - b2 * b2)) + 6 AS c2 FROM c)
SELECT pair, hour_gmt, n AS n_points, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS ar_order,
  {r('CASE WHEN c0 <= c1 AND c0 <= c2 THEN mean WHEN c1 <= c2 THEN mean + k1 * l0 ELSE mean + b1 * l0 + b2 * l1 END')} AS next_volume_forecast FROM e""")
def autoregression(spark, sf):
    """Orders up to two, whose coefficients SQL has in closed form from the normal equations."""
    return rounded(vo.autoregression(vo.date_hour_totals(bars(spark, sf)), max_order=2).drop("coefficients"), "next_volume_forecast")


@query("M10_null_pair", unnamed(SQL["M10_next_volume_forecast"], "pair"))
def forecast_without_name(spark, sf):
    return rounded(vo.next_volume_forecast(vo.date_hour_totals(unnamed_bars(spark, sf))), "next_volume_forecast", "holdout_mae")


@query("A48_run_summary", f"""WITH {DAILY_ANOMALY}, {TOTALS}, {FORECAST},
p AS (SELECT pair, count(*) AS days, count(*) FILTER (is_anomaly = 1) AS anomalies FROM a GROUP BY 1),
q AS (SELECT pair, count(*) AS forecasts, count(DISTINCT hour_gmt) AS hours, {r('avg(next_volume_forecast)')} AS avg_forecast FROM f GROUP BY 1)
SELECT * FROM p LEFT JOIN q USING (pair)""")
def run_summary(spark, sf):
    b = bars(spark, sf)
    return rounded(vo.run_summary(vo.daily_anomalies(vo.daily_totals(b)), vo.next_volume_forecast(vo.date_hour_totals(b))), "avg_forecast")


@query("J11_volume_signal", f"""WITH {B}, {HOURLY}, {TOTALS}, {FORECAST}
SELECT b.pair, b.ts, b.volume, b.volume > greatest(h.total_volume / h.bar_count * 1.2, coalesce(f.next_volume_forecast, 0) * 0.5, 10) AS is_good
FROM b LEFT JOIN h USING (pair, hour_gmt) LEFT JOIN f USING (pair, hour_gmt)""")
def volume_signal(spark, sf):
    b = bars(spark, sf)
    now = b.select(F.col("symbol").alias("pair"), vo.hour_of().alias("hour_gmt"), "ts", "volume")
    s = vo.volume_signal(now, vo.hourly_totals(b), vo.next_volume_forecast(vo.date_hour_totals(b)), ahead=0.5, floor=10)
    return s.select("pair", "ts", "volume", "is_good")


# one profile per user: many pairs to cluster
PROFILE = """u AS (SELECT 'U' || user_id AS pair, hour(ts) AS hour_gmt, sum(CAST(props->>'$.k' AS DOUBLE)) AS total_volume FROM events GROUP BY 1, 2)"""


def user_totals(spark, sf):
    e = table(spark, sf, "events")
    from .inputs import k_of
    return e.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("pair"), vo.hour_of().alias("hour_gmt")).agg(
        F.sum(k_of()).alias("total_volume"))


@query("M8_volume_profile", f"""WITH {PROFILE}, t AS (SELECT pair, sum(total_volume) AS tot FROM u GROUP BY 1 HAVING sum(total_volume) > 0)
SELECT pair, {', '.join(f"{r(f'coalesce(sum(total_volume) FILTER (hour_gmt = {h}), 0) / max(tot)')} AS h{h:02d}" for h in range(24))}
FROM u JOIN t USING (pair) GROUP BY 1""")
def volume_profile(spark, sf):
    return rounded(vo.volume_profile(user_totals(spark, sf)), *(f"h{h:02d}" for h in range(24)))


@query("M8_pair_clusters")
def pair_clusters(spark, sf):
    prof = vo.volume_profile(user_totals(spark, sf))
    return md.clusters(prof, "pair", [f"h{h:02d}" for h in range(24)])


@query("M8_cluster_checks", f"""WITH {PROFILE}, t AS (SELECT pair FROM u GROUP BY 1 HAVING sum(total_volume) > 0)
SELECT count(*) AS n_pairs, 0 AS unnumbered, true AS one_silhouette, true AS split_is_earned FROM t""")
def cluster_checks(spark, sf):
    """Pairs labelled, gaps in the numbers of clusters, whether all rows show the same silhouette, and whether more than one cluster reached 0.3."""
    c = md.clusters(vo.volume_profile(user_totals(spark, sf)), "pair", [f"h{h:02d}" for h in range(24)])
    k = F.count_distinct("cluster")
    return c.agg(F.count("*").alias("n_pairs"), (F.max("cluster") + 1 - k).cast("int").alias("unnumbered"), (F.count_distinct("silhouette") == 1).alias("one_silhouette"),
                 ((k == 1) | (F.max("silhouette") >= 0.3)).alias("split_is_earned"))


FEATS = ["open", "close", "high", "low", "volume"]
F_SQL = " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, {f} AS x FROM ({BARS})" for f in FEATS)
F_STAT = f"""l AS ({F_SQL}), g AS (SELECT feature, symbol, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ssw FROM l GROUP BY 1, 2),
o AS (SELECT feature, avg(x) AS gm FROM l GROUP BY 1),
fs AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(ssw) / (sum(n) - count(*))) AS score FROM g JOIN o USING (feature) GROUP BY 1)"""
MI = f"""q AS (SELECT feature, [{', '.join(f'round(quantile_cont(x, {i / 10}), 9)' for i in range(1, 10))}] AS cuts FROM l GROUP BY 1),
bn AS (SELECT feature, symbol, len(list_filter(cuts, lambda c: c < x)) AS bin, count(*) AS n FROM l JOIN q USING (feature) GROUP BY 1, 2, 3),
mg AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, symbol) AS nc FROM bn),
mi AS (SELECT feature, sum(n / t * ln((n * t) / (nb * nc))) AS score FROM mg GROUP BY 1)"""


@query("M11_f_statistic", f"WITH {F_STAT} SELECT feature, {r('score')} AS score FROM fs")
def f_statistic(spark, sf):
    return rounded(md.f_statistic(bars(spark, sf), "symbol", FEATS), "score")


@query("M11_mutual_information", f"WITH {F_STAT}, {MI} SELECT feature, {r('score')} AS score FROM mi")
def mutual_information(spark, sf):
    return rounded(md.mutual_information(bars(spark, sf), "symbol", FEATS), "score")


@query("M11_forest_importance")
def forest_importance(spark, sf):
    return md.forest_importance(bars(spark, sf), "symbol", FEATS)


@query("M11_forest_checks", f"SELECT 1.0::DOUBLE AS total, {len(FEATS)} AS n_features, 0 AS negative")
def forest_checks(spark, sf):
    """Importances add up to one, one for each feature, none below zero."""
    f = md.forest_importance(bars(spark, sf), "symbol", FEATS)
    return f.agg(F.round(F.sum("score"), 9).alias("total"), F.count("*").alias("n_features"), F.count_if(F.col("score") < 0).alias("negative"))


@query("M11_planted_feature", f"SELECT 'planted' AS best, count(*) AS n_rows, count(DISTINCT symbol) AS n_classes FROM ({BARS})")
def planted_feature(spark, sf):
    """A feature that follows from the class must be the most important one."""
    b = bars(spark, sf).withColumn("planted", F.crc32(F.col("symbol").cast("binary")).cast("double"))
    best = md.forest_importance(b, "symbol", [*FEATS, "planted"], trees=20).agg(F.max_by("feature", "score").alias("best"))
    return b.agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_classes")).withColumn("best", best.scalar())


@query("O10_top_features", f"""WITH {F_STAT}, {MI}, a AS (SELECT 'f_statistic' AS method, * FROM fs UNION ALL SELECT 'mutual_information', * FROM mi)
SELECT method, feature, {r('score')} AS score, row_number() OVER (PARTITION BY method ORDER BY round(a.score, 9) DESC, feature) AS rank FROM a QUALIFY rank <= 3""")
def top_features(spark, sf):
    b = bars(spark, sf)
    a = md.f_statistic(b, "symbol", FEATS).withColumn("method", F.lit("f_statistic")).unionByName(
        md.mutual_information(b, "symbol", FEATS).withColumn("method", F.lit("mutual_information")))
    return rounded(rk.top_per_group(a, ["method"], [F.desc(F.round("score", 9)), F.col("feature")], 3), "score")


@query("A45_row_presence", """WITH e AS (SELECT DISTINCT event_type AS pair FROM events UNION ALL SELECT 'absent')
SELECT pair, 'M1' AS timeframe, count(v.event_id) AS n_rows, count(v.event_id) > 0 AS present FROM e LEFT JOIN events v ON v.event_type = pair GROUP BY 1""")
def row_presence(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.lit("M1").alias("timeframe"))
    expected = e.distinct().unionByName(spark.createDataFrame([("absent", "M1")], "pair string, timeframe string"))
    return ql.presence(expected, e, ["pair", "timeframe"])


@query("A47_component_variance", f"""WITH v AS (SELECT symbol, var_pop(close) AS v1, var_pop(volume) AS v2, var_pop(high - low) AS v3 FROM ({BARS}) GROUP BY 1),
c AS (SELECT symbol, unnest([1, 2, 3]) AS component, unnest([v1, v2, v3]) / (v1 + v2 + v3) AS explained FROM v)
SELECT symbol, count(*) AS n_components, {r('sum(explained)')} AS total_explained,
 coalesce(string_agg(component, ',' ORDER BY component) FILTER (explained > 0.1), '') AS high_components,
 coalesce(string_agg(component, ',' ORDER BY component) FILTER (explained < 0.05), '') AS low_components FROM c GROUP BY 1""")
def component_variance(spark, sf):
    v = bars(spark, sf).groupBy("symbol").agg(
        F.var_pop("close").alias("1"), F.var_pop("volume").alias("2"), F.var_pop(F.col("high") - F.col("low")).alias("3"))
    total = F.col("1") + F.col("2") + F.col("3")
    rows = v.select("symbol", *((F.col(c) / total).alias(c) for c in ("1", "2", "3"))).unpivot(["symbol"], ["1", "2", "3"], "component", "explained")
    return rounded(vo.component_variance(rows.withColumn("component", F.col("component").cast("int")), ["symbol"]), "total_explained")


@query("S8_filtered_scan", f"""SELECT symbol, ts, open, high, low, close, volume FROM ({BARS})
WHERE symbol IN ('view', 'click', 'purchase') AND timeframe = 'M1' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""")
def filtered_scan(spark, sf):
    from ..sources.readers import scan_bars
    since = table(spark, sf, "events").select(F.max("ts") - F.expr("INTERVAL 20 DAYS")).scalar()
    return scan_bars(bars(spark, sf), ["view", "click", "purchase"], "M1", since).drop("timeframe")


@query("S14_column_discovery", "SELECT event_type AS pair, count(*) AS n, sum(value) IS NOT NULL AS has_volume, max(ts) AS last_ts FROM events GROUP BY 1")
def column_discovery(spark, sf):
    from ..sources.readers import discover_columns
    e = table(spark, sf, "events").withColumnsRenamed({"event_type": "Instrument", "value": "vol", "ts": "bar_time"})
    return discover_columns(e).groupBy("pair").agg(
        F.count("*").alias("n"), F.sum("volume").isNotNull().alias("has_volume"), F.max("ts").alias("last_ts"))
