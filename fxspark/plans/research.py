"""Research and serving: backfill, snapshots, splits, overfitting, gates, memory, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market as mk
from ..functions import params as pm
from ..functions import text as tx
from ..functions.stats import norm_cdf, norm_ppf
from ..operators import indicators as ind
from ..operators import models as md
from ..operators import ranking as rk
from ..operators import research as rs
from ..operators import scores as sc
from ..operators import sets as st
from ..operators import validation as va
from ..operators import vector_lists as vl
from ..operators import vectors as ve
from .backtest import RET, daily_returns
from .inputs import BARS, bars, r, rnd, rounded, table
from .normal_sql import cdf, ppf
from .registry import query

PAIR_NAMES = {"view": "USD_JPY", "click": "EUR_USD", "signup": "GBP_JPY", "purchase": "AUD_USD", "error": "USD_CHF"}
PAIR_SQL = "CASE symbol " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PAIR_NAMES.items()) + " END"
PIP_SQL = "CASE WHEN pair IN ('USD_JPY', 'EUR_JPY', 'GBP_JPY') THEN 0.01 ELSE 0.0001 END"
PRED = f"""p AS (SELECT {PAIR_SQL} AS pair, timeframe, ts, open AS pred_next_close, CASE WHEN volume % 2 = 0 THEN NULL ELSE close END AS actual_close FROM ({BARS})),
f AS (SELECT {PAIR_SQL} AS pair, timeframe, ts, close FROM ({BARS}) WHERE volume % 5 <> 0)"""


def predictions(spark, sf):
    b = bars(spark, sf)
    name = F.create_map(*(F.lit(v) for kv in PAIR_NAMES.items() for v in kv))[F.col("symbol")]
    b = b.withColumn("pair", name)
    p = b.select("pair", "timeframe", "ts", F.col("open").alias("pred_next_close"), F.when(F.col("volume") % 2 != 0, F.col("close")).alias("actual_close"))
    return p, b.filter("volume % 5 <> 0").select("pair", "timeframe", "ts", "close")


@query("J1_backfill_actuals", f"""WITH {PRED} SELECT pair, ts, {r('pred_next_close')} AS pred_next_close, {r('coalesce(actual_close, close)')} AS actual_close,
 {r(f'abs(pred_next_close - coalesce(actual_close, close)) / {PIP_SQL}', 3)} AS error_pips FROM p LEFT JOIN f USING (pair, timeframe, ts)""")
def backfill_actuals(spark, sf):
    p, f = predictions(spark, sf)
    out = rs.backfill(p, f, ["pair", "timeframe", "ts"]).select("pair", "ts", "pred_next_close", "actual_close", "error_pips")
    return rounded(rounded(out, "pred_next_close", "actual_close"), "error_pips", digits=3)


@query("J3_known_timestamps", f"""WITH {PRED} SELECT pair, ts FROM p WHERE actual_close IS NULL AND (pair, ts) IN (SELECT (pair, ts) FROM f)""")
def known_timestamps(spark, sf):
    p, f = predictions(spark, sf)
    return p.filter("actual_close IS NULL").join(f, ["pair", "ts"], "left_semi").select("pair", "ts")


@query("P28_error_pips", f"""WITH {PRED} SELECT pair, ts, CAST({PIP_SQL} AS DOUBLE) AS pip, {r(f'abs(pred_next_close - actual_close) / {PIP_SQL}', 3)} AS error_pips FROM p WHERE actual_close IS NOT NULL""")
def error_pips(spark, sf):
    p, _ = predictions(spark, sf)
    return p.filter("actual_close IS NOT NULL").select(
        "pair", "ts", mk.pip_size("pair").alias("pip"), rnd(mk.error_pips("pred_next_close", "actual_close", "pair"), 3).alias("error_pips"))


@query("J2_stale_features", """WITH u AS (SELECT DISTINCT 'U' || user_id AS pair FROM events UNION ALL SELECT 'absent'),
f AS (SELECT 'U' || user_id AS pair, max(ts) AS last_insert FROM events GROUP BY 1)
SELECT pair, last_insert FROM u LEFT JOIN f USING (pair) WHERE last_insert IS NULL OR last_insert < (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stale_features(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("pair"), "ts")
    universe = e.select("pair").distinct().unionByName(pm.frame(spark, ["pair"], [("absent",)]))
    return rs.stale(universe, e, ["pair"], "ts", e.select(F.max("ts")).scalar(), "2 HOURS")


SNAP = """s AS (SELECT o_orderpriority AS pair, CASE o_orderkey % 3 WHEN 0 THEN 'H1' WHEN 1 THEN 'H4' ELSE 'D' END AS timeframe, o_orderdate AS ts, o_orderkey AS id,
 o_totalprice AS pred, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice + (o_custkey % 7 - 3) END AS actual,
 CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE abs(o_custkey % 7 - 3) / 0.01 END AS error_pips FROM orders)"""


def snapshots(spark, sf):
    tf = F.element_at(F.array(F.lit("H1"), F.lit("H4"), F.lit("D")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pair"), tf.alias("timeframe"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("pred"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice") + (F.col("o_custkey") % 7 - 3)).alias("actual"),
        F.when(F.col("o_custkey") % 4 != 0, F.abs(F.col("o_custkey") % 7 - 3) / 0.01).alias("error_pips"))


@query("O5_latest_per_group", f"WITH {SNAP} SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts DESC, id DESC) = 1")
def latest_per_group(spark, sf):
    return sc.latest_by(snapshots(spark, sf), ["pair", "timeframe"], ["ts", "id"])


@query("A42_cross_timeframe_snapshot", f"""WITH {SNAP}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts DESC, id DESC) = 1)
SELECT pair, {', '.join(f"max({v}) FILTER (timeframe = '{t}') AS {t.lower()}_{v}" for t in ('H1', 'H4', 'D') for v in ('pred', 'actual', 'error_pips'))},
 CAST(count(actual) >= 2 AND count(DISTINCT CASE WHEN actual IS NOT NULL THEN CASE WHEN pred > actual THEN 1 ELSE -1 END END) = 1 AS INTEGER) AS trend_aligned FROM l WHERE pair <> '5-LOW' GROUP BY 1""")
def cross_timeframe_snapshot(spark, sf):
    p = snapshots(spark, sf)
    active = p.filter("pair <> '5-LOW'").select("pair").distinct()  # the universe's active pairs
    s = rs.cross_timeframe(p, "pair", ["ts", "id"], active)
    cells = [F.try_element_at("data", F.lit(f"{t}_{v}")).alias(f"{t}_{v}") for t in ("h1", "h4", "d") for v in ("pred", "actual", "error_pips")]
    return s.select("pair", *cells, "trend_aligned")


@query("O6_latest_version", """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_version(spark, sf):
    return sc.latest_by(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("O14_latest_parameters", """SELECT o_orderpriority AS pair, o_orderdate AS ts, '{"id": ' || o_orderkey || '}' AS params FROM orders WHERE o_orderkey % 3 <> 0
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_parameters(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pair"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit("}"))).otherwise("").alias("params"))
    return sc.latest_by(o.filter("params <> ''"), ["pair"], ["ts", "id"]).drop("id")


# -- splits -------------------------------------------------------------------------------

IDX = f"i AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM ({BARS}))"


def idx_rows(spark, sf):
    return va.indexed(ind.bar_series(bars(spark, sf))).select("symbol", "ts", "close", "idx", "n_rows")


@query("M1_walk_forward_splits", f"""WITH {IDX}, g AS (SELECT symbol, idx, n, unnest(range(greatest(0, CAST(ceil((idx - 600 + 1) / 100) AS BIGINT)), CAST(floor(idx / 100) AS BIGINT) + 1)) AS split FROM i),
v AS (SELECT *, CASE WHEN idx - split * 100 < 400 THEN 'train' WHEN idx - split * 100 < 500 THEN 'val' ELSE 'test' END AS role FROM g WHERE split * 100 + 600 <= n)
SELECT symbol, split, role, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx FROM v GROUP BY 1, 2, 3""")
def walk_forward_splits(spark, sf):
    w = va.walk_forward(idx_rows(spark, sf), per_month=50)
    return w.groupBy("symbol", "split", "role").agg(F.count("*").alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


COMBO = ("c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {list(c)})" for i, c in enumerate(va.combos(6, 2))) + ") v(split, groups))")
PURGE = f"""{IDX}, {COMBO}, g AS (SELECT *, least(idx // (n // 6), 5) AS grp FROM i),
j AS (SELECT g.*, split, list_contains(groups, CAST(grp AS INTEGER)) AS is_test FROM g, c),
m AS (SELECT symbol, split, min(idx) AS t0, max(idx) AS t1 FROM j WHERE is_test GROUP BY 1, 2),
x AS (SELECT j.*, CASE WHEN is_test THEN 'test' WHEN idx < t0 - 10 OR idx > t1 + 10 THEN 'train' ELSE 'purged' END AS role FROM j JOIN m USING (symbol, split))"""


@query("M2_test_combinations", f"WITH {PURGE} SELECT symbol, split, grp, count(*) AS n_test FROM x WHERE role = 'test' GROUP BY 1, 2, 3")
def test_combinations(spark, sf):
    p = va.purged_splits(idx_rows(spark, sf), ["symbol"])
    return p.filter("role = 'test'").groupBy("symbol", "split", "grp").agg(F.count("*").alias("n_test"))


@query("M3_purged_splits", f"WITH {PURGE} SELECT symbol, split, role, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx FROM x GROUP BY 1, 2, 3")
def purged_splits(spark, sf):
    return va.purged_splits(idx_rows(spark, sf), ["symbol"]).groupBy("symbol", "split", "role").agg(
        F.count("*").alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("J15_training_rows", f"WITH {PURGE} SELECT symbol, split, idx FROM x WHERE role = 'train'")
def training_rows(spark, sf):
    return va.purged_splits(idx_rows(spark, sf), ["symbol"]).filter("role = 'train'").select("symbol", "split", "idx")


PERF = """pm AS (SELECT l_suppkey AS strategy, least(CAST(floor(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) / 320.0) AS INTEGER), 7) AS part, l_extendedprice * (1 - l_discount) AS v FROM lineitem),
a AS (SELECT strategy, part, avg(v) AS v FROM pm GROUP BY 1, 2), c AS (SELECT m FROM (SELECT unnest(range(256)) AS m) WHERE bit_count(CAST(m AS INTEGER)) = 4),
q AS (SELECT m, strategy, avg(v) FILTER ((m >> part) & 1 = 1) AS isp, avg(v) FILTER ((m >> part) & 1 = 0) AS oos FROM a, c GROUP BY 1, 2),
b AS (SELECT m, arg_max(oos, (isp, -strategy)) AS best FROM q GROUP BY 1), k AS (SELECT m, count(*) FILTER (oos >= best) AS rank FROM q JOIN b USING (m) GROUP BY 1)"""


@query("M4_backtest_overfitting", f"""WITH {PERF} SELECT {r('avg(CAST(rank > (SELECT count(DISTINCT strategy) FROM a) / 2.0 AS INTEGER))')} AS pbo, count(*) AS n_combinations FROM k""")
def backtest_overfitting(spark, sf):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("strategy"), F.least(F.floor(day / 320.0), F.lit(7)).alias("part"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rounded(va.pbo(li, "strategy", "part", "v", 8), "pbo")


_DSR_E = f"(({ppf('1 - 1 / 20.0')}) * (1 - 0.5772156649) + 0.5772156649 * ({ppf('1 - 1 / (20.0 * exp(1))')})) / sqrt(n)"


@query("M5_deflated_sharpe", f"""WITH {RET}, m AS (SELECT symbol, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd FROM rt GROUP BY 1),
g AS (SELECT symbol, n, max(mu) / max(sd) AS s, avg(pow((ret - mu) / sd, 3)) AS skew, avg(pow((ret - mu) / sd, 4)) AS kurt FROM rt JOIN m USING (symbol) WHERE ret IS NOT NULL GROUP BY symbol, n),
z AS (SELECT symbol, n, s, (s - {_DSR_E}) / sqrt((1 - skew * s + (kurt - 1) / 4 * s * s) / (n - 1)) AS z FROM g)
SELECT symbol, n AS n_returns, {r('s')} AS sharpe, {r(cdf('z'))} AS dsr FROM z""")
def deflated_sharpe(spark, sf):
    from ..operators.signals import return_shape
    s = return_shape(daily_returns(spark, sf).df.filter("ret IS NOT NULL"), ["symbol"])
    sr = F.when(F.col("sd_ret") > 0, F.col("mean_ret") / F.col("sd_ret")).otherwise(0.0)
    return rounded(s.select("symbol", "n_returns", sr.alias("sharpe"), va.deflated_sharpe(sr, F.lit(20), F.col("n_returns"), F.col("skewness"), F.col("kurtosis") + 3).alias("dsr")),
                   "sharpe", "dsr")


@query("F1_normal_distribution", f"""WITH m AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1),
z AS (SELECT event_id, coalesce((value - mu) / sd, 0) AS z FROM events JOIN m USING (event_type)), p AS (SELECT event_id, z, {cdf('z')} AS p FROM z)
SELECT event_id, {r('z')} AS value_z, {r('p')} AS p, CASE WHEN p BETWEEN 1e-6 AND 1 - 1e-6 THEN {r(ppf('p'))} END AS back FROM p""")
def normal_distribution(spark, sf):
    """Distribution function of the standardised values, and the quantile that leads back to them."""
    z = md.zscore(table(spark, sf, "events"), ["event_type"], ["value"])
    p = z.select("event_id", "value_z", norm_cdf("value_z").alias("p"))
    return rounded(p.withColumn("back", F.when(F.col("p").between(1e-6, 1 - 1e-6), norm_ppf("p"))), "value_z", "p", "back")


@query("M6_train_only_scaler", f"""WITH {IDX}, m AS (SELECT symbol, avg(close) AS mu, stddev_pop(close) AS sd FROM i WHERE idx < floor(n * 0.8) GROUP BY 1)
SELECT symbol, ts, {r('(close - mu) / sd')} AS close_z FROM i JOIN m USING (symbol)""")
def train_only_scaler(spark, sf):
    z = md.zscore(idx_rows(spark, sf), ["symbol"], ["close"], fit_on=F.col("idx") < F.floor(F.col("n_rows") * 0.8))
    return rounded(z.select("symbol", "ts", "close_z"), "close_z")


@query("M13_information_criteria", f"""WITH x AS (SELECT event_type, -sum(ln(1 + value)) AS ll, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, 3 * 4 + 3 * 4 * 5 / 2 + 3 * 2 AS k FROM x)
SELECT event_type, CAST(k AS DOUBLE) AS n_params, {r('2 * k - 2 * ll', 4)} AS aic, {r('k * ln(n) - 2 * ll', 4)} AS bic FROM k""")
def information_criteria(spark, sf):
    x = table(spark, sf, "events").groupBy("event_type").agg((-F.sum(F.log1p("value"))).alias("ll"), F.count("*").alias("n"))
    ic = va.information_criteria(F.col("ll"), F.lit(3), F.lit(4), F.col("n"))
    return rounded(x.select("event_type", *(e.cast("double").alias(n) for n, e in ic.items())), "aic", "bic", digits=4)


METRICS = """m AS (SELECT o_orderkey AS run_id, 'forecast_accuracy_mae' AS metric, o_totalprice / 4 AS value FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_orderkey, 'validation_signal_precision', (o_custkey % 100) / 100.0 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'other', 1 FROM orders)"""


@query("M16_threshold_gate", f"""WITH {METRICS} SELECT run_id, coalesce(bool_and(CASE metric WHEN 'forecast_accuracy_mae' THEN value <= 50000 WHEN 'validation_signal_precision' THEN value >= 0.65 END), true) AS promote,
 count(*) FILTER (metric <> 'other') AS checked FROM m GROUP BY 1""")
def threshold_gate(spark, sf):
    o = table(spark, sf, "orders")
    m = o.select(F.col("o_orderkey").alias("run_id"), F.inline(F.array_compact(F.array(
        F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.lit("forecast_accuracy_mae").alias("metric"), (F.col("o_totalprice") / 4).alias("value"))),
        F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit("validation_signal_precision").alias("metric"), (F.col("o_custkey") % 100 / 100).alias("value"))),
        F.struct(F.lit("other").alias("metric"), F.lit(1.0).alias("value"))))))
    limits = pm.frame(spark, ["metric", "threshold"], [("validation_forecast_accuracy_mae", 50000.0), ("validation_signal_precision", 0.65)])
    return va.threshold_gate(m, "run_id", limits)


@query("M17_best_run", """SELECT o_orderpriority AS experiment, o_orderkey AS run_id, o_orderdate AS started FROM orders
WHERE o_orderstatus = 'F' AND o_orderkey % 4 IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def best_run(spark, sf):
    names = F.array(*map(F.lit, ["kmeans_k", "arima_mae", "if_rate", "loss"]))
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("experiment"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("status"),
        F.create_map(F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_totalprice")).alias("metrics"))
    return rs.best_run(o.withColumn("status", F.when(F.col("status") == "F", "FINISHED").otherwise("RUNNING")), ["experiment"]).select("experiment", "run_id", "started")


CAND = """c AS (SELECT o_orderkey AS run_id, o_orderpriority AS pair, o_orderstatus AS timeframe, (o_custkey % 100) / 100.0 AS da, (o_orderkey % 10) / 10.0 AS pbo, o_totalprice / 500000 AS dsr FROM orders),
h AS (SELECT pair, timeframe, avg(dsr) AS champion_dsr FROM c WHERE timeframe <> 'P' GROUP BY 1, 2)"""


@query("J12_promotion_gate", f"""WITH {CAND}, x AS (SELECT *, CASE WHEN da < 0.52 THEN 'accuracy' WHEN pbo > 0.3 THEN 'pbo' WHEN dsr - champion_dsr < 0.05 THEN 'improvement' ELSE 'promoted' END AS reason
 FROM c LEFT JOIN h USING (pair, timeframe)) SELECT run_id, pair, timeframe, reason, reason = 'promoted' AS promoted FROM x""")
def promotion_gate(spark, sf):
    c = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("timeframe"),
        (F.col("o_custkey") % 100 / 100).alias("directional_accuracy"), (F.col("o_orderkey") % 10 / 10).alias("pbo"), (F.col("o_totalprice") / 500000).alias("deflated_sharpe"))
    ch = c.filter("timeframe <> 'P'").groupBy("pair", "timeframe").agg(F.avg("deflated_sharpe").alias("deflated_sharpe"))
    return va.promotion(c, ch, ["pair", "timeframe"]).select("run_id", "pair", "timeframe", "reason", "promoted")


@query("J14_workspace_runs", "SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def workspace_runs(spark, sf):
    listed = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")).join(listed, "run_id", "left_semi")


# -- experiments --------------------------------------------------------------------------


@query("A40_failure_patterns", f"""SELECT o_orderstatus AS status, o_orderpriority AS architecture, count(*) AS cnt, {r('avg((o_custkey % 100) / 100.0)')} AS avg_da
FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2 ORDER BY cnt DESC, status, architecture LIMIT 20""")
def failure_patterns(spark, sf):
    g = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("architecture")).agg(
        F.count("*").alias("cnt"), rnd(F.avg(F.col("o_custkey") % 100 / 100)).alias("avg_da"))
    return g.orderBy(F.desc("cnt"), "status", "architecture").limit(20)


@query("A41_arm_posterior", """SELECT o_orderpriority AS arm, CAST(1 + sum(greatest(o_custkey % 3 - 1, 0)) AS DOUBLE) AS alpha, CAST(1 + count(*) FILTER (o_custkey % 3 - 1 <= 0) AS DOUBLE) AS beta FROM orders GROUP BY 1""")
def arm_posterior(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_custkey") % 3 - 1).alias("reward"))
    return rs.arm_posterior(o)


@query("O11_best_by_direction", f"""SELECT o_orderkey AS run_id, o_orderpriority AS direction, {r('o_totalprice')} AS score FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def best_by_direction(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("direction"), rnd("o_totalprice").alias("score"))


@query("O11_recent_experiments", "SELECT o_orderkey AS run_id, o_orderdate AS ts, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_experiments(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status")).orderBy(
        F.desc("ts"), "run_id").limit(50)


@query("O12_multi_query_merge", f"""WITH h AS (SELECT o_orderpriority AS direction, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS position, o_custkey AS entry_id, o_orderkey AS hit, o_totalprice AS score FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY score DESC, entry_id) AS rk FROM h QUALIFY rk <= 10),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY position, rk) = 1)
SELECT entry_id, direction, position, hit, {r('score')} AS score FROM (SELECT * FROM d ORDER BY position, rk LIMIT 25)""")
def multi_query_merge(spark, sf):
    h = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("direction"), F.substring("o_orderpriority", 1, 1).cast("int").alias("position"), F.col("o_custkey").alias("entry_id"),
        F.col("o_orderkey").alias("hit"), F.col("o_totalprice").alias("score"))
    return rounded(rk.merge_directions(h, "direction", "position", "entry_id", "score", 5, 5), "score")


@query("O16_admission_quota", """WITH s AS (SELECT source, length(source) AS priority, 3 + length(source) % 4 AS cap, doc_id FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM s QUALIFY n <= cap) SELECT source, priority, cap, doc_id FROM t ORDER BY priority, source, n LIMIT 20""")
def admission_quota(spark, sf):
    d = table(spark, sf, "documents").select("source", F.length("source").alias("priority"), (3 + F.length("source") % 4).alias("cap"), "doc_id")
    return rk.quota(d, "source", "cap", "priority", "doc_id", 20)


@query("P29_experiment_text", """SELECT o_orderkey AS run_id, 'Architecture: ' || o_orderpriority || ', Strategy: ' || o_orderstatus || CASE WHEN o_custkey % 2 = 0 THEN ', Detail: late' ELSE '' END AS text FROM orders""")
def experiment_text(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), tx.experiment_text(
        Architecture=F.col("o_orderpriority"), Strategy=F.col("o_orderstatus"), Detail=F.when(F.col("o_custkey") % 2 == 0, F.lit("late"))).alias("text"))


# -- vectors: one query per label, its mean vector -----------------------------------------

VEC = """x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM x GROUP BY 1), s AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1] AS DOUBLE) AS sharpe FROM embeddings),
c AS (SELECT query_id, item_id, label, sharpe, list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v)) AS score FROM q, s)"""


def label_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return ve.mean_vector(e, "label", "embedding").select(F.col("label").cast("bigint").alias("query_id"), "vector")


def vector_store(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


@query("J13_nearest_vectors", f"""WITH {VEC} SELECT query_id, item_id, {r('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c
WHERE list_has_any([label, label + 1], [1, 3, 5]) AND sharpe >= -0.1 QUALIFY rank <= 10""")
def nearest_vectors(spark, sf):
    # payload filters: any-of over an array, and a range
    store = vector_store(spark, sf).filter(
        F.arrays_overlap(F.array("label", F.col("label") + 1), F.array(F.lit(1), F.lit(3), F.lit(5)))
        & (F.element_at("vector", 1).cast("double") >= -0.1))
    return rounded(ve.nearest(label_queries(spark, sf), store, 10), "score")


# every hundredth vector against all of them
HUNDREDTH = """s AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT q.item_id AS query_id, s.item_id, round(list_dot_product(q.v, s.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(s.v, s.v)), 12) AS score FROM s q, s WHERE q.item_id % 100 = 0)"""


def hundredth(spark, sf):
    store = vector_store(spark, sf)
    return store.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector"), store


@query("J13_certified_lists", f"""WITH {HUNDREDTH} SELECT query_id, item_id, {r('score')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c QUALIFY rank <= 10""")
def certified_lists(spark, sf):
    queries, store = hundredth(spark, sf)
    return rounded(vl.search(queries, vl.build(store), 10, certify=True), "score")


@query("J13_list_recall", "SELECT count(*) AS n_queries, true AS nine_in_ten FROM embeddings WHERE vec_id % 100 = 0")
def list_recall(spark, sf):
    """Probing alone, held against the exact search of all queries."""
    queries, store = hundredth(spark, sf)
    index = vl.build(store)
    found = vl.recall(vl.search(queries, index, 10, probes=vl.calibrated(index, 10)), ve.nearest(queries, store, 10))
    return found.select("n_queries", (F.col("recall") >= 0.9).alias("nine_in_ten"))


@query("M18_novelty", f"WITH {VEC} SELECT query_id, {r('1 - max(score)')} AS novelty FROM c GROUP BY 1")
def novelty(spark, sf):
    return rounded(ve.novelty(label_queries(spark, sf), vector_store(spark, sf)), "novelty")


# -- sets and tables ------------------------------------------------------------------------

UNI = "SELECT 'EURUSD' AS pair, 'H1' AS timeframe UNION ALL SELECT 'EURUSD', 'H4' UNION ALL SELECT 'USDJPY', 'H1'"


@query("S13_seed_if_empty", f"""WITH full_t AS (SELECT DISTINCT event_type AS pair, 'M1' AS timeframe FROM events), empty_t AS (SELECT event_type AS pair, 'M1' AS timeframe FROM events WHERE value < 0), u AS ({UNI})
SELECT 'full' AS name, * FROM full_t UNION ALL SELECT 'full', * FROM u WHERE (SELECT count(*) FROM full_t) = 0 UNION ALL SELECT 'empty', * FROM empty_t UNION ALL SELECT 'empty', * FROM u WHERE (SELECT count(*) FROM empty_t) = 0""")
def seed_if_empty(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.lit("M1").alias("timeframe"), "value")
    seed = pm.frame(spark, ["pair", "timeframe"], [("EURUSD", "H1"), ("EURUSD", "H4"), ("USDJPY", "H1")])
    a = rs.seed_if_empty(e.drop("value").distinct(), seed).withColumn("name", F.lit("full"))
    return a.unionByName(rs.seed_if_empty(e.filter("value < 0").drop("value"), seed).withColumn("name", F.lit("empty")))


@query("S15_retention", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def retention(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rs.retained(o, "o_orderdate", o.select(F.max("o_orderdate")).scalar(), "90 DAYS")


@query("U1_union_all", f"SELECT *, 1 AS priority FROM ({UNI}) UNION ALL SELECT DISTINCT event_type, 'M1', 2 FROM events")
def union_all(spark, sf):
    seed = pm.frame(spark, ["pair", "timeframe", "priority"], [("EURUSD", "H1", 1), ("EURUSD", "H4", 1), ("USDJPY", "H1", 1)])
    return seed.unionByName(table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.lit("M1").alias("timeframe"), F.lit(2).alias("priority")).distinct())


@query("U3_distinct", "SELECT DISTINCT o_orderpriority AS pair, o_orderstatus AS timeframe FROM orders")
def distinct(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pair"), F.col("o_orderstatus").alias("timeframe")).distinct()


@query("U4_keyed_override", """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 5000)
SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def keyed_override(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    b = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return st.override(a, b, ["k"], ["v"])


@query("P19_schema_alignment", """SELECT o_orderkey AS order_id, o_totalprice AS fedfunds_us, CAST(0 AS DOUBLE) AS cpi_us, CAST(0 AS DOUBLE) AS dgs10_us FROM orders""")
def schema_alignment(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("fed_funds"))
    return st.align_schema(o, {"cpi_us": 0.0, "dgs10_us": 0.0}, {"fed_funds": "fedfunds_us", "absent": "x"})


@query("P17_columns_to_map", """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'price,rank' ELSE 'price' END AS names, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice + o_orderkey % 10 ELSE o_totalprice END AS total FROM orders""")
def columns_to_map(spark, sf):
    from ..sources.readers import columns_to_map as to_map
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 10).alias("rank"))
    m = o.select("o_orderkey", to_map(["price", "rank"]).alias("m"))
    return m.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
                    F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).alias("total"))
