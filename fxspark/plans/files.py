"""Sources and sinks: every query writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as rd
from ..sources import writers as wr
from ..session import work_dir
from .backtest import RESULTS, results
from .inputs import ARTICLES, BARS, articles, bars, r, rnd, rounded, table
from .registry import query

BAR_COLS = "symbol, ts, open, high, low, close, volume"
NO_TF = ["symbol", "ts", "open", "high", "low", "close", "volume"]
SPOIL = "CASE WHEN volume % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE close END"


@query("S1_bars_csv", f"""WITH b AS (SELECT *, {SPOIL} AS x FROM ({BARS})), c AS (SELECT * REPLACE (CASE WHEN isinf(x) THEN NULL ELSE x END AS x) FROM b)
SELECT symbol, ts, open, high, low, coalesce(last(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
 first(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close, volume FROM c""")
def bars_csv(spark, sf):
    b = bars(spark, sf).withColumn("close", F.expr("CASE WHEN volume % 5 = 0 THEN double('inf') ELSE close END"))
    path = wr.write_csv(b.select("symbol", "timeframe", *NO_TF[1:]), work_dir(spark, "bars-csv"))
    return rd.read_bars_csv(spark, path).select(*NO_TF)


@query("S2_csv_sink", f"SELECT {BAR_COLS} FROM ({BARS})")
def csv_sink(spark, sf):
    path = wr.write_csv(bars(spark, sf).select("symbol", "timeframe", *NO_TF[1:]), work_dir(spark, "csv"))
    return spark.read.csv(path, header=True, schema=rd.BARS_SCHEMA).select(*NO_TF)


@query("S3_headerless_scan", f"SELECT {BAR_COLS} FROM ({BARS}) WHERE symbol IN ('view', 'click') AND timeframe = 'M1'")
def headerless_scan(spark, sf):
    path = work_dir(spark, "text")
    b = bars(spark, sf).select("symbol", "timeframe", *NO_TF[1:])
    lines = b.select(F.concat_ws(", ", *(F.col(c).cast("string") for c in b.columns)).alias("value"))
    rule = b.select(F.concat(F.lit("=== "), "symbol").alias("value"))  # comment lines among the rows
    lines.unionByName(rule).write.mode("overwrite").text(path)
    return rd.read_headerless(spark, path).filter("symbol IN ('view', 'click') AND timeframe = 'M1'").select(*NO_TF)


@query("S4_parquet_round_trip", f"SELECT {BAR_COLS} FROM ({BARS})")
def parquet_round_trip(spark, sf):
    path = wr.write_parquet(bars(spark, sf), work_dir(spark, "parquet"), ["timeframe"], ["symbol", "ts"])
    return spark.read.parquet(path).select(*NO_TF)


DOCS = f"SELECT result_id, CAST(run_id AS VARCHAR) AS run_id, symbol, timeframe, strategy_type, num_trades, total_return, sharpe_ratio, psr, max_drawdown FROM ({RESULTS})"


@query("S5_result_documents", f"""WITH d AS ({DOCS}), x AS (SELECT *, unnest([1, 2]) AS variant FROM d)
SELECT run_id, symbol, strategy_type, variant * 1.0::DOUBLE AS variant, num_trades, {r('total_return', 9)} AS total_return, {r('CASE WHEN variant = 1 THEN psr ELSE 0 END', 9)} AS psr, 0.0::DOUBLE AS omega_ratio FROM x""")
def result_documents(spark, sf):
    res = results(spark, sf)
    cell = lambda v, psr: F.struct(
        F.create_map(F.lit("variant"), F.lit(float(v))).alias("params"), "total_return", "sharpe_ratio", "max_drawdown",
        F.lit(0.5).alias("win_rate"), F.col("num_trades").cast("int").alias("num_trades"), psr.alias("psr"))
    docs = res.select(F.col("run_id").cast("string").alias("run_id"), "symbol", "timeframe", "strategy_type", F.lit("2024-01-01T00:00:00").alias("timestamp"),
                      F.array(cell(1, F.col("psr")), cell(2, F.lit(None).cast("double"))).alias("results"))
    path = work_dir(spark, "results")
    docs.write.mode("overwrite").json(path)
    out = rd.read_results(spark, path).withColumn("variant", F.get_json_object("params", "$.variant").cast("double"))
    return rounded(out.select("run_id", "symbol", "strategy_type", "variant", "num_trades", "total_return", "psr", "omega_ratio"), "total_return", "psr", digits=9)


@query("S6_result_sink", f"SELECT result_id, strategy_type, params, {r('sharpe_ratio', 9)} AS sharpe_ratio FROM ({RESULTS})")
def result_sink(spark, sf):
    path = wr.write_results(results(spark, sf), work_dir(spark, "result-lines"))
    out = spark.read.schema("result_id bigint, strategy_type string, params string, sharpe_ratio double").json(path)
    return rounded(out.select("result_id", "strategy_type", "params", "sharpe_ratio"), "sharpe_ratio", digits=9)


@query("S7_partial_merge", """WITH p AS (SELECT strftime(ts, '%Y%m%d') AS part, event_type AS pair, count(*) AS n FROM events GROUP BY 1, 2)
SELECT pair, arg_max(n, part) AS last_count, CAST(sum(n) AS BIGINT) AS records FROM p GROUP BY 1""")
def partial_merge(spark, sf):
    # one file per day, each with a map (the last file wins) and a list (lists are concatenated)
    p = table(spark, sf, "events").groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("part"), F.col("event_type").alias("pair")).agg(F.count("*").alias("n"))
    path = work_dir(spark, "partials")
    p.select("part", F.create_map("pair", "n").alias("clusters"), F.array(F.struct("pair", "n")).alias("records")).write.mode("overwrite").partitionBy("part").json(path)
    parts = rd.read_partials(spark, path, "part string, clusters map<string, bigint>, records array<struct<pair: string, n: bigint>>")
    last = rd.merge_last(parts, "clusters").select(F.col("key").alias("pair"), F.col("value").alias("last_count"))
    lists = parts.select(F.inline("records")).groupBy("pair").agg(F.sum("n").alias("records"))
    return last.join(lists, "pair")


@query("S9_append_sink", """SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) * 2 AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1""")
def append_sink(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    path = wr.append(o, wr.append(o, work_dir(spark, "append")))
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


@query("S10_candles", f"SELECT symbol, ts, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM ({BARS})")
def candle_rows(spark, sf):
    text = lambda c: F.col(c).cast("string")
    one = lambda done: F.struct(
        F.lit(done).alias("complete"), F.col("volume").cast("bigint").alias("volume"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'.000000000Z'").alias("time"),
        F.struct(text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c")).alias("mid"))
    docs = bars(spark, sf).select(F.to_json(F.struct(
        F.col("symbol").alias("instrument"), F.col("timeframe").alias("granularity"), F.array(one(True), one(False)).alias("candles"))).alias("j"))
    return rd.candles(docs, "j").select(*NO_TF)


@query("S11_observations", """SELECT o_orderpriority AS series_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS value FROM orders WHERE o_orderkey % 4 <> 0""")
def observation_rows(spark, sf):
    o = table(spark, sf, "orders")
    value = F.when(F.col("o_orderkey") % 4 == 0, F.lit(".")).otherwise(F.col("o_totalprice").cast("string"))
    docs = o.select(F.to_json(F.struct(F.col("o_orderpriority").alias("series_id"), F.array(F.struct(
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations"))).alias("j"))
    return rd.observations(docs, "j")


@query("S16_purge", "SELECT count(*) AS before, 0 AS after FROM orders")
def purge(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    path = wr.write_parquet(o, work_dir(spark, "purge"))
    before = spark.read.parquet(path).agg(F.count("*").alias("before"))
    n = before.first()[0]
    wr.purge(o, path, confirm=True)
    return spark.read.parquet(path).agg(F.lit(n).alias("before"), F.count("*").alias("after"))


@query("S17_article_export", f"""SELECT event_id, array_to_string([primary_ccy, 'USD'], ',') AS symbols, CAST(props->>'$.k' AS DOUBLE) AS k, {r('relevance_score')} AS relevance_score FROM ({ARTICLES})""")
def article_export(spark, sf):
    a = articles(spark, sf).select("event_id", F.array_join(F.array("primary_ccy", F.lit("USD")), ",").alias("symbols"),
                                   F.from_json("props", "k double").getField("k").alias("k"), rnd("relevance_score").alias("relevance_score"))
    path = wr.write_csv(a, work_dir(spark, "export"))
    return spark.read.csv(path, header=True, schema="event_id bigint, symbols string, k double, relevance_score double")


@query("S18_deduplicated_copy", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def deduplicated_copy(spark, sf):
    path = wr.copy_deduplicated(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], work_dir(spark, "copy"))
    return spark.read.parquet(path).select("o_custkey", "o_orderkey", "o_totalprice")


@query("U5_missing_columns", "SELECT 'timeframe,volume' AS missing, count(*) AS n FROM orders")
def missing_columns(spark, sf):
    from ..operators.sets import missing_columns as find
    o = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "ts")
    return o.agg(F.lit(",".join(find(o, ["ts", "timeframe", "volume"]))).alias("missing"), F.count("*").alias("n"))
