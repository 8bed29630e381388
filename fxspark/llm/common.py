"""Small helpers of the operators: documents in a defined shape, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fxspark.session import work_dir

#: A word is a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends there, lost executors only cost a reread."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(share: float | Column, *by: str | Column) -> Column:
    """Whether a row belongs to a sample of about this share, by the 64-bit hash of ``by``; no share is too small to draw."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return (F.xxhash64(*by).cast("double") / 2.0**64 + 0.5) < share


#: Texts may be long: Arrow batches hold so many rows and bytes, unless the session sets bounds of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def bounded(frame: DataFrame) -> DataFrame:
    """The frame itself; its session's Arrow batches are bounded from now on where they have Spark's own bounds."""
    conf = frame.sparkSession.conf
    for name, (usual, bound) in BATCHES.items():
        if conf.get(name) == usual:
            conf.set(name, bound)
    return frame


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of documents, and what else is named; other columns stay behind."""
    return bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def batches(arrays: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(arrays, types)], names)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to ``most`` words at a time."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
