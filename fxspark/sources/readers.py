"""Readers and row-shape helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import finite
from ..operators.indicators import bar_series, fill_gaps
from ..operators.sets import missing_columns


def columns_to_map(names: list[str]) -> Column:
    """Numeric columns as a map; entries without a value are left out."""
    full = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("double") for n in names)))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def flatten_map(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Map entries back to columns."""
    return df.select(*(c for c in df.columns if c != column), *(F.try_element_at(F.col(column), F.lit(n)).alias(n) for n in names))


# Accepted names of each bar column, best first
CANDIDATES = {
    "pair": ["pair", "symbol", "instrument", "currency_pair", "ticker"],
    "volume": ["volume", "vol", "tick_volume", "total_volume"],
    "ts": ["timestamp", "bar_time", "ts", "time", "datetime", "date"],
}
OPTIONAL = {"open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c"]}


def discover_columns(df: DataFrame) -> DataFrame:
    """Bars under their usual names, whatever the table calls them."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for target, names in {**CANDIDATES, **OPTIONAL}.items():
        hit = next((have[n] for n in names if n in have), None)
        if hit is not None:
            cols.append(F.col(hit).alias(target))
        elif target in CANDIDATES:
            raise ValueError(f"no column for {target!r} among {df.columns}")
    return df.select(*cols)


def scan_bars(bars: DataFrame, symbols: list[str], timeframe: str, since: Column) -> DataFrame:
    """Bars of some symbols since a time; unreadable numbers become NULL."""
    nums = ["open", "high", "low", "close", "volume"]
    return bars.filter(F.col("symbol").isin(symbols) & (F.col("timeframe") == timeframe) & (F.col("ts") >= since)).select(
        "symbol", "timeframe", "ts", *(F.col(c).try_cast("double").alias(c) for c in nums)
    )


BARS_SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
REQUIRED_BAR_COLUMNS = ["ts", "open", "high", "low", "close", "volume"]
MIN_BARS = 50


def read_bars_csv(spark: SparkSession, path: str, min_bars: int = MIN_BARS) -> DataFrame:
    """Bars from CSV with a header: required columns, repaired prices, series of at least ``min_bars`` rows.

    Infinite and missing prices take the value before them, else the one after.
    """
    header = spark.read.csv(path, header=True).limit(0)
    missing = missing_columns(header, REQUIRED_BAR_COLUMNS)
    if missing:
        raise ValueError(f"missing columns {missing} in {path}")
    raw = spark.read.csv(path, header=True, schema=BARS_SCHEMA, enforceSchema=False)
    prices = ["open", "high", "low", "close"]
    long_enough = raw.groupBy("symbol", "timeframe").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_bars)
    kept = raw.join(long_enough.select("symbol", "timeframe"), ["symbol", "timeframe"], "left_semi")
    return fill_gaps(bar_series(kept.withColumns({c: finite(c) for c in prices})), prices).result()


def read_headerless(spark: SparkSession, path: str, schema: str = BARS_SCHEMA, comment: str = "=") -> DataFrame:
    """Delimited text without a header; lines starting with ``comment`` are skipped."""
    return spark.read.csv(path, schema=schema, comment=comment, ignoreLeadingWhiteSpace=True)


# Metrics of a result; the optional ones may be missing and read as 0
RESULT_METRICS = ["total_return", "sharpe_ratio", "max_drawdown", "win_rate"]
RESULT_COUNTS = ["num_trades"]
OPTIONAL_COUNTS = ["max_consecutive_wins", "max_consecutive_losses"]
OPTIONAL_METRICS = [
    "psr", "profit_factor", "avg_trade_duration_hours", "sortino_ratio", "calmar_ratio", "omega_ratio", "expectancy", "avg_win_pct", "avg_loss_pct", "best_trade_pct",
    "worst_trade_pct", "max_drawdown_duration_hours", "volatility", "skewness", "kurtosis", "tail_ratio", "recovery_factor"]
RESULT_SCHEMA = (
    "run_id string, symbol string, timeframe string, strategy_type string, timestamp string, results array<struct<params: string, "
    + ", ".join([f"{m}: double" for m in [*RESULT_METRICS, *OPTIONAL_METRICS]] + [f"{m}: int" for m in [*RESULT_COUNTS, *OPTIONAL_COUNTS]]) + ">>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents to one row per result with the document's constants.

    ``params`` is the JSON text as it stands, whatever its values are; absent optional metrics are 0.
    """
    docs = spark.read.schema(RESULT_SCHEMA).json(path)
    rows = docs.select("run_id", "symbol", "timeframe", "strategy_type", "timestamp", F.inline("results"))
    return rows.na.fill(0.0, OPTIONAL_METRICS).na.fill(0, OPTIONAL_COUNTS)


def read_partials(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Partial outputs of many writers with the name of their file."""
    return spark.read.schema(schema).json(path).withColumn("file", F.input_file_name())


def merge_last(partials: DataFrame, entries: str, file: str = "file") -> DataFrame:
    """Maps of many files merged into one: for equal keys the file that sorts last wins."""
    rows = partials.select(file, F.explode(entries).alias("key", "value"))
    return rows.groupBy("key").agg(F.max_by("value", file).alias("value"))


CANDLE_SCHEMA = (
    "instrument string, granularity string, candles array<struct<complete: boolean, volume: bigint, time: string, "
    "mid: struct<o: string, h: string, l: string, c: string>>>"
)


def candles(responses: DataFrame, json: str) -> DataFrame:
    """Complete candles of landed price responses, prices as numbers."""
    rows = responses.select(F.from_json(json, CANDLE_SCHEMA).alias("d")).select("d.instrument", "d.granularity", F.inline("d.candles"))
    return rows.filter("complete").select(
        F.col("instrument").alias("symbol"), F.col("granularity").alias("timeframe"),
        F.to_timestamp_ntz(F.substring("time", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"),
        *(F.col(f"mid.{k}").try_cast("double").alias(n) for k, n in zip("ohlc", ("open", "high", "low", "close"))), "volume")


def observations(responses: DataFrame, json: str) -> DataFrame:
    """Macro observations; a value of "." is missing and left out."""
    schema = "series_id string, observations array<struct<date: string, value: string>>"
    rows = responses.select(F.from_json(json, schema).alias("d")).select("d.series_id", F.inline("d.observations"))
    return rows.select("series_id", "date", F.col("value").try_cast("double").alias("value")).filter("value IS NOT NULL")
