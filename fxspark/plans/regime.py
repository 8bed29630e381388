"""Market regimes: states over bars, transition matrices, macro joins, mixtures and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..functions.stats import correlation
from ..operators import indicators as ind
from ..operators import models as md
from ..operators import regime as rg
from ..operators import scores as sc
from ..operators.series import Series
from .inputs import BARS, bars, r, rounded, table
from .registry import query

STATE = "CASE WHEN close < 30 THEN 0 WHEN close < 70 THEN 1 ELSE 2 END"
S = f"""s0 AS (SELECT symbol, timeframe, ts, {STATE} AS state, high - low AS ret, close / (close + 100) AS confidence,
  row_number() OVER w AS rn, lag({STATE}) OVER w AS prev FROM ({BARS}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s1 AS (SELECT *, CAST(coalesce(state <> prev, false) AS INTEGER) AS regime_change FROM s0),
s AS (SELECT *, rn - max(CASE WHEN prev IS NULL OR regime_change = 1 THEN rn END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1 AS regime_duration FROM s1)"""


def states(spark, sf):
    b = bars(spark, sf).select("symbol", "timeframe", "ts", F.expr(STATE).alias("state"), (F.col("high") - F.col("low")).alias("ret"),
                               (F.col("close") / (F.col("close") + 100)).alias("confidence"))
    return ind.bar_series(b)


def regimes(spark, sf):
    return rg.changes_and_durations(states(spark, sf)).result()


@query("W22_regime_change", f"WITH {S} SELECT symbol, ts, state, regime_change FROM s")
def regime_change(spark, sf):
    return regimes(spark, sf).select("symbol", "ts", "state", "regime_change")


@query("W23_regime_duration", f"WITH {S} SELECT symbol, ts, state, regime_duration FROM s")
def regime_duration(spark, sf):
    return regimes(spark, sf).select("symbol", "ts", "state", "regime_duration")


@query("A13_current_regime", f"""WITH {S} SELECT symbol, ts, state, {r('confidence')} AS confidence, regime_duration, regime_change FROM s
QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1""")
def current_regime(spark, sf):
    now = sc.latest_by(regimes(spark, sf), ["symbol", "timeframe"], ["ts"])
    return rounded(now.select("symbol", "ts", "state", "confidence", "regime_duration", "regime_change"), "confidence")


@query("A14_daily_regime_statistics", f"""WITH {S} SELECT symbol, state, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, {r('avg(ret)')} AS avg_return, {r('stddev_pop(ret)')} AS return_std,
 {r('avg(confidence)')} AS avg_confidence, {r('avg(regime_duration)')} AS avg_duration FROM s GROUP BY 1, 2, 3""")
def daily_regime_statistics(spark, sf):
    d = rg.daily_statistics(regimes(spark, sf), ["symbol"]).withColumn("date", F.col("date").cast("string"))
    return rounded(d, "avg_return", "return_std", "avg_confidence", "avg_duration")


@query("A15_emission_parameters", f"""WITH {S}, e AS (SELECT DISTINCT symbol, unnest([0, 1, 2, 3]) AS state FROM s),
g AS (SELECT symbol, state, avg(ret) AS m, stddev_pop(ret) AS v FROM s GROUP BY 1, 2)
SELECT symbol, state, {r('coalesce(m, 0)')} AS mean_return, {r('coalesce(v, 0)')} AS volatility FROM e LEFT JOIN g USING (symbol, state)""")
def emission_parameters(spark, sf):
    return rounded(rg.emission_parameters(states(spark, sf).df, ["symbol"], 4), "mean_return", "volatility")


@query("A16_state_relabel", f"""WITH {S}, g AS (SELECT symbol, state, row_number() OVER (PARTITION BY symbol ORDER BY avg(confidence * -1), state) - 1 AS new FROM s GROUP BY 1, 2)
SELECT symbol, ts, new AS state FROM s JOIN g USING (symbol, state)""")
def state_relabel(spark, sf):
    b = states(spark, sf).df.withColumn("falling", -F.col("confidence"))
    return rg.relabel(b, ["symbol"], "state", "falling").select("symbol", "ts", "state")


T = f"""{S}, c AS (SELECT symbol, prev AS from_state, state AS to_state, count(*) AS n FROM s WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT symbol, f.i AS from_state, t.i AS to_state FROM s, (SELECT unnest([0, 1, 2]) AS i) f, (SELECT unnest([0, 1, 2]) AS i) t),
tm AS (SELECT symbol, from_state, to_state, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY symbol, from_state) AS p FROM e LEFT JOIN c USING (symbol, from_state, to_state))"""


@query("M14_transition_matrix", f"WITH {T} SELECT symbol, from_state, to_state, n, {r('p')} AS p FROM tm")
def transition_matrix(spark, sf):
    return rounded(rg.transitions(states(spark, sf), 3).drop("timeframe"), "p")


@query("M15_regime_forecast", f"""WITH RECURSIVE {T}, m AS (SELECT symbol, from_state AS i, to_state AS j, p FROM tm),
cur AS (SELECT symbol, arg_max(state, ts) AS state FROM s GROUP BY 1),
h AS (SELECT symbol, 0 AS step, CAST(i AS INTEGER) AS j, CASE WHEN i = state THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM cur, (SELECT unnest([0, 1, 2]) AS i)
 UNION ALL SELECT symbol, step + 1, j, p FROM (SELECT h.symbol, h.step, CAST(m.j AS INTEGER) AS j, sum(h.p * m.p) AS p FROM h JOIN m ON m.symbol = h.symbol AND m.i = h.j WHERE h.step < 5 GROUP BY h.symbol, h.step, m.j))
SELECT symbol, {', '.join(f'{r(f"max(p) FILTER (j = {k})")} AS p{k}' for k in range(3))} FROM h WHERE step = 5 GROUP BY 1""")
def regime_forecast(spark, sf):
    s = states(spark, sf)
    m = rg.matrix_form(rg.transitions(s, 3), ["symbol", "timeframe"])
    now = sc.latest_by(s.df.select("symbol", "timeframe", "ts", "state"), ["symbol", "timeframe"], ["ts"])
    start = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("state"), 1.0).otherwise(0.0))
    f = now.join(m, ["symbol", "timeframe"]).withColumn("start", start)
    f = f.withColumn("f", rg.forecast(F.col("start"), F.col("transition_matrix"), 5))
    return rounded(f.select("symbol", *(F.col("f")[k].alias(f"p{k}") for k in range(3))), "p0", "p1", "p2")


@query("M19_matrix_distance", f"""WITH {T}, d AS (SELECT symbol, from_state, to_state, p, avg(p) OVER (PARTITION BY from_state, to_state) AS q FROM tm)
SELECT symbol, {r('avg(abs(p - q))')} AS mean_abs_diff FROM d GROUP BY 1""")
def matrix_distance(spark, sf):
    from ..session import cut
    a = cut(rg.transitions(states(spark, sf), 3).drop("timeframe"))  # a few rows per series
    mean = a.groupBy("from_state", "to_state").agg(F.avg("p").alias("p"))
    b = a.select("symbol", "from_state", "to_state").join(mean, ["from_state", "to_state"])
    return rounded(rg.matrix_distance(a, b, ["symbol"]), "mean_abs_diff")


DAILY = "d AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS close FROM orders GROUP BY 1)"
MACRO = "m AS (SELECT date_trunc('month', l_shipdate) AS ts, sum(l_quantity) AS macro FROM lineitem GROUP BY 1)"


def daily(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("close"))


def macro(spark, sf, *keys):
    li = table(spark, sf, "lineitem")
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast(li.schema["l_shipdate"].dataType).alias("ts")
    return li.groupBy(month, *keys).agg(F.sum("l_quantity").alias("macro"))


def _year():
    return {"_year": F.date_trunc("year", F.col("ts").cast("timestamp"))}


@query("J6_macro_as_of", f"WITH {DAILY}, {MACRO} SELECT d.ts, {r('close', 4)} AS close, macro FROM d ASOF LEFT JOIN m ON d.ts >= m.ts")
def macro_as_of(spark, sf):
    return rounded(rg.as_of_join(daily(spark, sf), macro(spark, sf), [], "ts", ["macro"], _year()), "close", digits=4)


@query("J6_macro_exact_then_fill", f"""WITH {DAILY}, {MACRO} SELECT ts, {r('close', 4)} AS close, last(macro IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS macro FROM d LEFT JOIN m USING (ts)""")
def macro_exact(spark, sf):
    return rounded(rg.as_of_join(daily(spark, sf), macro(spark, sf), [], "ts", ["macro"], _year(), exact_then_fill=True), "close", digits=4)


@query("W27_macro_differential", f"""WITH g AS (SELECT date_trunc('month', l_shipdate) AS ts, l_returnflag AS land, sum(l_quantity) AS macro FROM lineitem GROUP BY 1, 2),
y AS (SELECT *, macro / nullif(lag(macro, 12) OVER (PARTITION BY land ORDER BY ts), 0) - 1 AS growth FROM g)
SELECT a.ts, a.macro - b.macro AS differential, {r('a.growth - b.growth')} AS growth_differential FROM y a JOIN y b ON a.ts = b.ts AND a.land = 'A' AND b.land = 'R'""")
def macro_differential(spark, sf):
    m = macro(spark, sf, F.col("l_returnflag").alias("land"))
    y = rg.growth(Series.of(m, ["land"], ["ts"], _year()), "macro")
    base, quote = (y.filter(F.col("land") == k).select("ts", F.col("macro").alias(f"m{k}"), F.col("macro_growth").alias(f"g{k}")) for k in ("A", "R"))
    return rounded(base.join(quote, "ts").select("ts", (F.col("mA") - F.col("mR")).alias("differential"), (F.col("gA") - F.col("gR")).alias("growth_differential")),
                   "growth_differential")


PRICED = f"""p AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM ({BARS})), q AS (SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS lr FROM p),
f AS (SELECT * FROM (SELECT *, count(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS n FROM q) WHERE n = 20 AND lr IS NOT NULL)"""


def feature_rows(spark, sf):
    rl = ind.bar_series(bars(spark, sf)).rolling(21)
    rl.add({"log_return": ind.log_return(rl)})
    rl.add({"log_return": mk.finite("log_return")})  # no model takes a total loss
    rl.add({"volatility": ind.rolling_std(rl, 20, "log_return"), "sma_10": ind.sma(rl, 10)})
    ind.rsi(rl, 14)
    ind.atr(rl, 14)
    return rl.done().drop("true_range").dropna()


@query("M12_regime_mixture")
def regime_mixture(spark, sf):
    m = md.mixture_states(feature_rows(spark, sf), ["log_return", "volatility", "rsi_14", "atr"])
    return rg.relabel(m, ["timeframe"], "state", "log_return", "state_probabilities").select("symbol", "ts", "state", "state_probabilities", "confidence")


@query("M7_principal_components")
def principal_components(spark, sf):
    return md.principal_components(feature_rows(spark, sf), COMPONENT_FEATURES)[1]


COMPONENT_FEATURES = ["close", "volume", "log_return", "volatility", "sma_10", "rsi_14", "atr"]


@query("M7_component_checks", f"""WITH {PRICED} SELECT count(*) AS n_rows, 0 AS correlated, 0 AS wrong_share, 0 AS rising, true AS reaches_threshold FROM f""")
def component_checks(spark, sf):
    """Rows scored, pairs of scores that correlate, scores whose variance is not their share, shares that rise, and whether the shares reach 95 %."""
    scores, parts = md.principal_components(feature_rows(spark, sf), COMPONENT_FEATURES)
    rows = parts.orderBy("component").collect()  # one row for each component
    pcs = [f"pc{r['component']}" for r in rows]
    off = [F.abs(correlation(a, b)) > 1e-6 for i, a in enumerate(pcs) for b in pcs[i + 1 :]]
    share = [F.abs(F.var_samp(p) / len(COMPONENT_FEATURES) - r["explained"]) > 1e-6 for p, r in zip(pcs, rows)]
    count = lambda flags: sum((x.cast("int") for x in flags), F.lit(0))
    rising = sum(b["explained"] > a["explained"] + 1e-12 for a, b in zip(rows, rows[1:]))
    return scores.agg(F.count("*").alias("n_rows"), count(off).alias("correlated"), count(share).alias("wrong_share"), F.lit(rising).alias("rising"),
                      F.lit(rows[-1]["cumulative"] >= 0.95).alias("reaches_threshold"))


@query("M7_two_components", f"""WITH c AS (SELECT abs(corr(close, volume)) AS c FROM ({BARS})) SELECT 1 AS component, {r('(1 + c) / 2')} AS explained FROM c UNION ALL SELECT 2, {r('(1 - c) / 2')} FROM c""")
def two_components(spark, sf):
    """Two columns, whose components SQL has in closed form: the shares are (1 + |correlation|) / 2 and the rest."""
    return rounded(md.principal_components(bars(spark, sf), ["close", "volume"], threshold=1.0)[1].select("component", "explained"), "explained")


@query("M12_mixture_checks", f"""WITH {PRICED} SELECT count(*) AS n_rows, 0 AS bad_sums, 0 AS other_state, 0 AS other_confidence, 0 AS wrong_order FROM f""")
def mixture_checks(spark, sf):
    """Rows, probabilities that do not add up, labels and confidences that are not the largest probability, states out of order."""
    m = rg.relabel(md.mixture_states(feature_rows(spark, sf), ["log_return", "volatility", "rsi_14", "atr"]), ["timeframe"], "state", "log_return", "state_probabilities")
    p = F.col("state_probabilities")
    flaws = m.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).alias("bad_sums"),
                  F.count_if(F.get(p, F.col("state").cast("int")) < F.array_max(p)).alias("other_state"), F.count_if(F.col("confidence") != F.array_max(p)).alias("other_confidence"))
    means = m.groupBy("timeframe").agg(F.array_sort(F.collect_set("state")).alias("states"))
    by = m.groupBy("timeframe", "state").agg(F.avg("log_return").alias("mean"))
    order = by.groupBy("timeframe").agg(F.array_sort(F.collect_list(F.struct("state", "mean"))).alias("s")).join(means, "timeframe")
    wrong = order.agg(F.coalesce(F.sum(F.size(F.filter("s", lambda x, i: (i > 0) & (F.get("s", i - 1)["mean"] > x["mean"])))), F.lit(0)).alias("wrong_order"))
    return flaws.withColumn("wrong_order", wrong.scalar())


def next_close_rows(spark, sf):
    """Features of each bar with the close of the next one, which the newest bar of a series does not have."""
    rl = ind.bar_series(feature_rows(spark, sf)).rolling(1)
    rows = rl.series().df
    nxt = rows.select("symbol", "timeframe", (F.col("_rn") - 1).alias("_rn"), F.col("close").alias("next_close"))
    return rows.join(nxt, ["symbol", "timeframe", "_rn"], "left")


NEXT_FEATURES = ["close", "volatility", "sma_10", "rsi_14"]


@query("M20_batch_predictions")
def batch_predictions(spark, sf):
    return md.batch_predictions(next_close_rows(spark, sf), NEXT_FEATURES, "next_close", "linear", "1", ["symbol", "timeframe", "ts"])


@query("M20_single_feature", f"""WITH b AS ({BARS}), m AS (SELECT regr_slope(volume, close) AS s, regr_intercept(volume, close) AS i FROM b)
SELECT symbol, ts, {r('i + s * close')} AS pred_volume FROM b, m""")
def single_feature(spark, sf):
    """One feature: SQL has the same line by its aggregates."""
    p = md.batch_predictions(bars(spark, sf), ["close"], "volume", "linear", "1", ["symbol", "ts"])
    return rounded(p.select("symbol", "ts", F.col("pred_next_close").alias("pred_volume")), "pred_volume")


@query("M20_prediction_checks", f"""WITH {PRICED} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_newest, 0 AS unscored, 0 AS unbalanced FROM f""")
def prediction_checks(spark, sf):
    """Rows scored, newest rows among them, rows without a prediction, and features (and the constant) that still correlate with the errors of the training rows."""
    rows = next_close_rows(spark, sf)
    p = md.batch_predictions(rows, NEXT_FEATURES, "next_close", "linear", "1", ["symbol", "timeframe", "ts", "next_close", *NEXT_FEATURES])
    e = F.col("next_close") - F.col("pred_next_close")
    flat = [F.abs(F.avg(e)) / F.stddev_pop("next_close") > 1e-6] + [F.abs(correlation(c, e)) > 1e-5 for c in NEXT_FEATURES]
    return p.agg(F.count("*").alias("n_rows"), F.count_if(F.col("next_close").isNull()).alias("n_newest"), F.count_if(F.col("pred_next_close").isNull()).alias("unscored"),
                 sum((F.coalesce(x, F.lit(False)).cast("int") for x in flat), F.lit(0)).alias("unbalanced"))


@query("O6_regime_versions", f"""WITH {S} SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, state, ts FROM s QUALIFY row_number() OVER (PARTITION BY symbol, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC) = 1""")
def regime_versions(spark, sf):
    d = states(spark, sf).df.select("symbol", F.to_date("ts").cast("string").alias("date"), "state", "ts")
    return sc.latest_by(d, ["symbol", "date"], ["ts"])
