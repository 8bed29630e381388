"""Session helpers: default settings, lineage cuts and shared work folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fxspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, ANSI on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local a folder of this machine is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="fxspark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name below the shared folder."""
    return os.path.join(shared_dir(spark), "fxspark", f"{tag}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the frame is written once and its lineage ends there.

    Used where several branches of one plan read the same derived rows, so that the rows
    are computed once and a lost executor re-reads files instead of replaying the plan.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a Parquet table of the shared folder, read back: like :func:`cut`, with columns that readers can leave out."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
