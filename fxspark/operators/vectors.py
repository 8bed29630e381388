"""Nearest vectors by cosine similarity.

Exact search: every query is compared with every stored vector, by matrix products inside Arrow batches,
and only the best ``k`` per query leave a task. Few queries (measured) are broadcast and the store is read
once where it lies. More queries are cut into blocks and multiplied with slices of the store, so no task
holds more than one block and one slice, and of their similarities ``CELLS`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_per_group

BROADCAST_QUERIES = 2048
SLICE_ROWS = 65_536
CELLS = 1 << 21  # similarities in memory at a time; ranking them takes a few arrays of this size


def _unit(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the best ``k`` scores of each row; of equal scores the smaller ids."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (scores.shape[0], 1))
    idx = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, idx, axis=1).min(axis=1)
    for i in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > k):  # ties at the border
        at = np.flatnonzero(scores[i] >= least[i])
        idx[i] = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
    return idx


def _pairs(q_ids, s_ids, scores: np.ndarray, k: int) -> pd.DataFrame:
    # products of differently shaped blocks may differ in the last bits
    scores, s_ids = np.round(scores, 12), np.asarray(s_ids)
    idx = _best(scores, s_ids, k)
    return pd.DataFrame({
        "query_id": np.repeat(np.asarray(q_ids), idx.shape[1]),
        "item_id": s_ids[idx.ravel()],
        "score": np.take_along_axis(scores, idx, axis=1).ravel(),
    })


def best_pairs(q_ids, q: np.ndarray, s_ids, s: np.ndarray, k: int) -> pd.DataFrame:
    """Best ``k`` of the unit vectors ``s`` for each of ``q``, so many rows of ``q`` at a time that memory does not grow with them."""
    q_ids, step = np.asarray(q_ids), max(1, CELLS // max(1, len(s)))
    return pd.concat([_pairs(q_ids[i : i + step], s_ids, q[i : i + step] @ s.T, k) for i in range(0, len(q), step)])


def nearest(queries: DataFrame, store: DataFrame, k: int = 10, broadcast_limit: int = BROADCAST_QUERIES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Best ``k`` stored vectors per query: rows (query_id, item_id, score, rank).

    ``queries`` has (query_id bigint, vector), ``store`` (item_id bigint, vector); payload filters are
    applied to the store beforehand.
    """
    spark = store.sparkSession
    head = queries.select("query_id", "vector").limit(broadcast_limit + 1).collect()
    out = "query_id bigint, item_id bigint, score double"
    if not head:
        return spark.createDataFrame([], out + ", rank int")
    if len(head) <= broadcast_limit:
        shared = spark.sparkContext.broadcast(([r[0] for r in head], _unit([r[1] for r in head])))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = shared.value
            best = None
            for b in batches:
                if len(b):
                    new = best_pairs(q_ids, q, b["item_id"], _unit(b["vector"]), k)
                    best = new if best is None else pd.concat([best, new]).sort_values(
                        ["query_id", "score", "item_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if best is not None:
                yield best

        hits = store.select("item_id", "vector").mapInPandas(scan, out)
    else:
        n_q, n_s = queries.count(), store.count()
        q_blocks, s_slices = -(-n_q // broadcast_limit), max(1, -(-n_s // slice_rows))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        q = queries.select("query_id", "vector", part("query_id", q_blocks).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(s_slices - 1))).alias("_s"))
        s = store.select("item_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("_q"), part("item_id", s_slices).alias("_s"))

        def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
            return best_pairs(a["query_id"], _unit(a["vector"]), b["item_id"], _unit(b["vector"]), k)

        cast = lambda d: d.withColumns({"_q": F.col("_q").cast("int"), "_s": F.col("_s").cast("int")})
        hits = cast(q).groupBy("_q", "_s").cogroup(cast(s).groupBy("_q", "_s")).applyInPandas(block, out)
    return top_per_group(hits, ["query_id"], [F.desc("score"), F.col("item_id")], k)


def novelty(queries: DataFrame, store: DataFrame, **kw) -> DataFrame:
    """1 - best similarity to the store; 1 where the store is empty."""
    best = nearest(queries, store, 1, **kw).select("query_id", "score")
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.coalesce(1 - F.col("score"), F.lit(1.0)).alias("novelty"))


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, one sum per position."""
    long = df.select(key, F.posexplode(vector).alias("pos", "x"))
    m = long.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # as many entries as the vector has dimensions
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))
