"""Structured Streaming versions of the insert-triggered aggregates.

Every job reads a stream of scored articles, runs until the available input is used up, and leaves a
table. ``home`` is the folder of its table and progress: a later call with the same ``home`` goes on where
the last one stopped, over what has arrived since; without it a call starts afresh below the shared folder.
Writes are keyed by batch number and overwrite their own folder, so a batch that is run again after a
failure leaves the same rows. ``lateness=None`` keeps every bucket open
for late rows; a duration closes buckets that far behind the newest row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import scores as sc
from ..operators.quality import run_outcomes
from ..session import work_dir


def article_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, ts: str = "ts") -> DataFrame:
    """Stream over a folder of Parquet files with a zoned timestamp, as watermarks need it."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def places(spark: SparkSession, home: str | None, tag: str) -> tuple[str, str]:
    """Folders of a job's table and progress."""
    home = home or work_dir(spark, tag)
    return f"{home}/table", f"{home}/progress"


def run(df: DataFrame, write: Callable[[DataFrame, int], None], mode: str, progress: str) -> None:
    """Run a stream over all available input; ``write`` receives each batch and its number."""
    q = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, overwriting what an earlier attempt left."""

    def write(batch: DataFrame, number: int) -> None:
        out = shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _late(df: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return df.withWatermark(ts, lateness) if lateness else df


def hourly_statistics(stream: DataFrame, metrics: list[str], unit: str = "1 hour", ts: str = "ts", key: str = "primary_ccy", lateness: str | None = None, home: str | None = None) -> DataFrame:
    """Tumbling statistics kept in state; the newest version of each bucket is the result."""
    aggs: list[Column] = [F.count("*").alias("article_count")]
    for m in metrics:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_stddev"),
                 F.skewness(m).alias(f"{m}_skewness"), (F.kurtosis(m) + 3).alias(f"{m}_kurtosis")]
    agg = _late(stream, ts, lateness).groupBy(F.window(ts, unit), F.col(key).alias("symbol")).agg(*aggs)
    flat = agg.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "symbol", *(c for c in agg.columns if c not in ("window", "symbol")))
    path, progress = places(stream.sparkSession, home, "hourly")
    run(flat, batch_writer(path), "update", progress)
    return sc.latest_by(stream.sparkSession.read.parquet(path), ["bucket", "symbol"], ["batch"]).drop("batch")


def score_states(stream: DataFrame, metrics: list[str], unit: str, ts: str = "ts", key: str = "primary_ccy", home: str | None = None) -> str:
    """Partial states of every batch appended to a table; readers merge them. No state is kept between batches."""
    path, progress = places(stream.sparkSession, home, "states")

    def shape(batch: DataFrame) -> DataFrame:
        rows = batch.select(sc.bucket(ts, unit).alias("bucket"), F.col(key).alias("symbol"), *metrics)
        return sc.partial_states(rows, ["bucket", "symbol"], metrics)

    run(stream, batch_writer(path, shape), "append", progress)
    return path


def additive_rollup(stream: DataFrame, fields: list[str], ts: str = "ts", home: str | None = None) -> DataFrame:
    """Sums and counts per batch; the table is added up on read."""
    path, progress = places(stream.sparkSession, home, "rollup")
    run(stream, batch_writer(path, lambda b: sc.bias_rollup(b, fields, ts)), "append", progress)
    return stream.sparkSession.read.parquet(path).groupBy("hour_bucket", "symbol").agg(
        F.sum("sum_score").alias("sum_score"), F.sum("article_count").alias("article_count"))


def latest_state(stream: DataFrame, key: str, order: list[str], cols: list[str], home: str | None = None) -> DataFrame:
    """Newest row per key, kept in state and written as updates."""
    agg = stream.groupBy(key).agg(F.max_by(F.struct(*order, *cols), F.struct(*order)).alias("row"))
    path, progress = places(stream.sparkSession, home, "latest")
    run(agg, batch_writer(path), "update", progress)
    return sc.latest_by(stream.sparkSession.read.parquet(path), [key], ["batch"]).select(key, "row.*")


def forward(stream: DataFrame, condition: Column, cols: list[str], home: str | None = None) -> DataFrame:
    """Rows meeting a condition, passed on to a table."""
    spark = stream.sparkSession
    path, progress = places(spark, home, "forward")
    q = (
        stream.filter(condition).select(*cols).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(path)


def ingest_once(stream: DataFrame, stored: DataFrame, key: str, cols: list[str], home: str | None = None) -> DataFrame:
    """Each identifier once, however late a copy comes: a batch drops its own copies, stored identifiers and those of earlier batches.

    Of copies in one batch the least row stays. The stored and earlier identifiers are cut down to those of the batch first, so
    it is the batch, not the history, that is dealt out.
    """
    spark = stream.sparkSession
    path, progress = places(spark, home, "ingest")
    known = stored.select(key)
    kinds = stream.select(*cols).schema
    numbered = StructType([*kinds, StructField("batch", IntegerType())])
    spark.createDataFrame([], kinds).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in cols if c != key]
        rows = batch.select(*cols).groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*").select(*cols)
        earlier = spark.read.schema(numbered).parquet(path).filter(F.col("batch") < number).select(key)
        seen = known.unionByName(earlier).join(batch.select(key), key, "left_semi")
        rows.join(seen, key, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    run(stream.select(*cols), write, "append", progress)
    return spark.read.parquet(path).drop("batch")


def cycles(stream: DataFrame, outcome: Column, cycle: Column, home: str | None = None) -> DataFrame:
    """Outcome counters and status per cycle over all batches."""
    path, progress = places(stream.sparkSession, home, "cycles")
    shape = lambda b: b.groupBy(cycle.alias("cycle"), outcome.alias("outcome")).agg(F.count("*").alias("n"))
    run(stream, batch_writer(path, shape), "append", progress)
    rows = stream.sparkSession.read.parquet(path)
    return run_outcomes(rows, ["cycle"], weight="n")
