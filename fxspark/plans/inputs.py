"""Domain frames built from the delivered tables, each with the same definition in SQL.

events -> minute bars and scored articles; orders and lineitem -> daily and monthly series, experiment
runs and trades; supplier and customer -> deals; embeddings -> vectors; documents and pages -> texts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").try_cast("double")


# -- bars --------------------------------------------------------------------------------

BARS = """
SELECT event_type AS symbol, 'M1' AS timeframe, date_trunc('minute', ts) AS ts,
       first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
       last(value ORDER BY ts, event_id) AS close,
       sum(CAST(props->>'$.k' AS DOUBLE)) AS volume
FROM events GROUP BY ALL
"""


def place(ts: str, id_col: str) -> Column:
    """One number that orders by (time, id).

    A fixed-width ordering keeps min_by and max_by in the hash aggregate; a struct would make Spark sort
    all input before the partial aggregation.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10**19)) + F.col(id_col).cast("decimal(19,0)")


def unnamed(sql: str, column: str) -> str:
    """The rows of ``sql`` where ``view`` has lost its name, as in :func:`unnamed_bars`."""
    return f"SELECT nullif({column}, 'view') AS {column}, * EXCLUDE ({column}) FROM ({sql})"


def unnamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose largest series has a NULL symbol."""
    return bars(spark, sf_dir).withColumn("symbol", F.nullif("symbol", F.lit("view")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars: symbol = event type, prices = value, volume = sum of props.k."""
    e = table(spark, sf_dir, "events")
    at = place("ts", "event_id")
    return (
        e.groupBy(
            F.col("event_type").alias("symbol"),
            F.lit("M1").alias("timeframe"),
            F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
        )
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.sum(k_of()).alias("volume"),
        )
    )


# -- scored articles -----------------------------------------------------------------------

SCORE_FIELDS = ["volatility_impact", "timeliness", "bearish_prob", "bullish_prob", "neutral_prob"]

ARTICLES = """
SELECT event_id, ts, event_type AS primary_ccy, user_id, props,
       value AS volatility_impact,
       CAST(props->>'$.k' AS DOUBLE) AS timeliness,
       CAST(props->>'$.k' AS DOUBLE) / 100 AS bearish_prob,
       value / (value + 100) AS bullish_prob,
       1 / (1 + value) AS neutral_prob,
       value / 10 AS relevance_score
FROM events
"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles: one per event."""
    e = table(spark, sf_dir, "events")
    k = k_of()
    return e.select(
        "event_id", "ts", F.col("event_type").alias("primary_ccy"), "user_id", "props",
        F.col("value").alias("volatility_impact"),
        k.alias("timeliness"),
        (k / 100).alias("bearish_prob"),
        (F.col("value") / (F.col("value") + 100)).alias("bullish_prob"),
        (1 / (1 + F.col("value"))).alias("neutral_prob"),
        (F.col("value") / 10).alias("relevance_score"),
    )
