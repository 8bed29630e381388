"""Deal scoring: weighted dimensions, rank, explanation, newest run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import params as pm
from ..operators import deals as de
from ..operators import ranking as rk
from .inputs import rounded, table
from .registry import query

# dimension scores of one deal per customer
DIMS = {
    "market": "least(10, greatest(0, (c_acctbal + 1000) / 1100))", "team": "(c_custkey * 7 % 101) / 10.0", "product": "(c_custkey * 13 % 101) / 10.0",
    "traction": "(c_custkey * 29 % 101) / 10.0", "syndication_fit": "(c_nationkey % 11) * 1.0", "risk_regulatory": "(c_custkey * 3 % 101) / 10.0",
    "japan_fit": "length(c_mktsegment) * 1.0",
}


def composite_sql(weights):
    num = " + ".join(f"({'10 - ' if pm.DIMENSIONS[k][1] else ''}{k}) * {weights[k]}" for k in DIMS)
    # rounded by the shortest decimal text of the value, as Spark does
    return f"CAST(round(CAST(CAST(({num}) / {sum(weights.values())!r} AS VARCHAR) AS DECIMAL(30, 18)), 4) AS DOUBLE)"


W = {k: v[0] for k, v in pm.DIMENSIONS.items()}
D = f"d AS (SELECT c_custkey AS deal_id, c_mktsegment AS sector, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in DIMS.items())} FROM customer)"
RANKED = f"{D}, s AS (SELECT *, {composite_sql(W)} AS composite_score FROM d), k AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, deal_id) AS rank FROM s)"


def deals(spark, sf, overrides=None):
    c = table(spark, sf, "customer")
    scores = {k: F.expr(e.replace("/ 10.0", "/ 10D")).cast("double") for k, e in DIMS.items()}
    return c.select(F.col("c_custkey").alias("deal_id"), F.col("c_mktsegment").alias("sector"), de.dimension_map(scores, overrides).alias("dimensions"))


def ranked(spark, sf):
    return de.rank(deals(spark, sf).withColumn("composite_score", de.composite("dimensions")), "composite_score", "deal_id")


@query("A39_composite_score", f"WITH {RANKED} SELECT deal_id, composite_score FROM s")
def composite_score(spark, sf):
    return deals(spark, sf).select("deal_id", de.composite("dimensions").alias("composite_score"))


@query("W26_rank_numbers", f"WITH {RANKED} SELECT deal_id, composite_score, rank FROM k")
def rank_numbers(spark, sf):
    return ranked(spark, sf).select("deal_id", "composite_score", "rank")


LABEL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pm.DIMENSION_LABELS.items()) + " END"
LONG = "u AS (" + " UNION ALL ".join(f"SELECT deal_id, '{k}' AS dim, {i} AS pos, {k} * {W[k]} AS c FROM d" for i, k in enumerate(DIMS)) + ")"


@query("P34_rank_explanation", f"""WITH {RANKED}, {LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY c DESC, pos) AS n FROM u),
x AS (SELECT deal_id, string_agg({LABEL.format('dim')}, ' and ' ORDER BY n) FILTER (n <= 2) AS strong, max({LABEL.format('dim')}) FILTER (n = {len(DIMS)}) AS weak FROM o GROUP BY 1)
SELECT deal_id, 'Rank #' || rank || ' (composite ' || printf('%.2f', composite_score) || '/10): strong ' || strong || ' drive this result, despite moderate ' || weak || '.' AS explanation
FROM k JOIN x USING (deal_id)""")
def rank_explanation(spark, sf):
    return ranked(spark, sf).select("deal_id", de.explanation().alias("explanation"))


OVER = {"japan_fit": 3.0, "team": 0.5}


@query("F3_weight_overrides", f"WITH {D} SELECT deal_id, {composite_sql(W | OVER)} AS composite_score FROM d")
def weight_overrides(spark, sf):
    return deals(spark, sf, OVER).select("deal_id", de.composite("dimensions").alias("composite_score"))


# a ranking table of many runs: one run per customer, one row per order
RUNS = "SELECT o_custkey AS run_id, o_orderkey AS deal_id, o_orderdate AS ranked_at, o_totalprice AS composite_score FROM orders"


@query("J9_newest_run", f"WITH q AS ({RUNS}), l AS (SELECT arg_max(run_id, (ranked_at, run_id)) AS run_id FROM q) SELECT run_id, deal_id, composite_score FROM q JOIN l USING (run_id)")
def newest_run(spark, sf):
    return rk.newest_run(_runs(spark, sf), "run_id", "ranked_at").select("run_id", "deal_id", "composite_score")


@query("O7_top_of_newest_run", f"""WITH q AS ({RUNS}), l AS (SELECT arg_max(run_id, (ranked_at, run_id)) AS run_id FROM q)
SELECT run_id, deal_id, composite_score FROM q JOIN l USING (run_id) ORDER BY composite_score DESC, deal_id LIMIT 5""")
def top_of_newest_run(spark, sf):
    return newest_run(spark, sf).orderBy(F.desc("composite_score"), "deal_id").limit(5)


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("deal_id"), F.col("o_orderdate").alias("ranked_at"), F.col("o_totalprice").alias("composite_score"))
