"""Nearest vectors by inverted lists over coarse centroids.

Centroids come from a bounded sample of the store; then every stored vector goes to the list of its nearest centroid. A query
probes the lists of its ``probes`` nearest centroids. Each stored vector lies in one piece of one list and meets the queries that probe it
there: the store is dealt out once, however many queries there are, and only the best ``k`` of a query leave a piece. Lists above ``PIECE``
vectors are cut into pieces, so a list that holds a large share of the store is no single task.

With ``certify`` a second round probes every other list that could still hold a better vector: two unit vectors x, q in a list of
radius r around c are at least angle(q, c) - r apart. The result then equals :func:`vectors.nearest` in full.

Vectors that are NULL are in no list, and queries without a vector find nothing. Equal scores are ranked by item_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .ranking import top_per_group
from .vectors import _unit, best_pairs, nearest

SAMPLE = 20_000  # stored vectors that the centroids are learnt from, at most
MOST_LISTS = 1_024
PIECE = 50_000  # vectors of a piece, about
PROBES = 65_536  # pairs of a query and a list that are looked at, and rows that are handed on, at a time
ROUNDS = 10
TRIALS = 64  # queries that a calibration tries
HITS = "query_id bigint, item_id bigint, score double"


@dataclass(frozen=True)
class Lists:
    """Rows (item_id, vector, list, piece) and, for each list, its unit centroid, its radius (an angle) and its number of pieces."""

    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    pieces: np.ndarray


def centroids(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Directions of ``n`` groups of unit vectors at most; those that lose all members are left out."""
    at = np.sort(np.random.default_rng(seed).permutation(len(sample))[:n])
    c = np.unique(sample[at], axis=0)
    for _ in range(ROUNDS):
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c = _unit(sums[np.bincount(own, minlength=len(c)) > 0])
    return c


def build(store: DataFrame, lists: int | None = None) -> Lists:
    """The index of ``store`` (item_id bigint, vector); about the square root of its size in lists. The rows are stored."""
    store = store.select("item_id", "vector").filter(F.col("vector").isNotNull())
    # the least hashes: a sample that does not depend on order or size
    found = store.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).collect()
    if not found:
        return Lists(store.withColumns({"list": F.lit(0), "piece": F.lit(0)}), np.zeros((0, 1)), np.zeros(0), np.zeros(0, int))
    n = store.count()
    c = centroids(_unit([r["vector"] for r in found]), lists or int(np.clip(round(n**0.5), 1, MOST_LISTS)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = _unit(b["vector"]) @ c.T
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(b)), own], -1.0, 1.0))
                yield b.assign(list=own.astype("int32"), angle=angle)

    kind = dict(store.dtypes)["vector"]
    rows = kept(store.mapInPandas(assign, f"item_id bigint, vector {kind}, list int, angle double"), "lists")
    radius, pieces = np.zeros(len(c)), np.zeros(len(c), int)
    for r in rows.groupBy("list").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # at most MOST_LISTS rows
        radius[r["list"]], pieces[r["list"]] = r["r"], -(-r["n"] // PIECE)
    per_list = F.array(*(F.lit(int(p)) for p in np.maximum(pieces, 1)))
    piece = F.pmod(F.xxhash64("item_id"), F.get(per_list, F.col("list"))).cast("int")
    return Lists(rows.select("item_id", "vector", "list", piece.alias("piece")), c, radius, pieces)


def _probe(queries: DataFrame, index: Lists, pick) -> DataFrame:
    """Queries with each piece that they probe; ``pick(near, batch)`` says which lists, for rows of similarities to the centroids."""
    kind = dict(queries.dtypes)["vector"]
    return queries.mapInPandas(_probing(index.centroids, index.pieces, pick), f"query_id bigint, vector {kind}, list int, piece int")


def _probing(c: np.ndarray, pieces: np.ndarray, pick):
    """A query is repeated for each list it probes, so a batch of queries is handed on in frames of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, PROBES // max(1, len(c)))
        for b in (whole.iloc[i : i + step] for whole in batches for i in range(0, len(whole), step)):
            row, lst = np.nonzero(pick(_unit(b["vector"]) @ c.T, b) & (pieces > 0)[None, :])
            n = pieces[lst]
            row, lst, piece = np.repeat(row, n), np.repeat(lst, n), np.concatenate([np.arange(k) for k in n]) if len(n) else n
            q_ids, vectors = b["query_id"].to_numpy(), b["vector"].to_numpy()
            for i in range(0, len(row), PROBES):
                at = slice(i, i + PROBES)
                yield pd.DataFrame({"query_id": q_ids[row[at]], "vector": vectors[row[at]], "list": lst[at].astype("int32"), "piece": piece[at].astype("int32")})

    return run


def _hits(probes: DataFrame, index: Lists, k: int) -> DataFrame:
    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if q.empty or s.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        return best_pairs(q["query_id"], _unit(q["vector"]), s["item_id"], _unit(s["vector"]), k)

    return probes.groupBy("list", "piece").cogroup(index.rows.groupBy("list", "piece")).applyInPandas(block, HITS)


def search(queries: DataFrame, index: Lists, k: int = 10, probes: int = 8, certify: bool = False) -> DataFrame:
    """Best ``k`` stored vectors per query: rows (query_id, item_id, score, rank)."""
    queries = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    n = len(index.centroids)
    if not n:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")

    def near(sims: np.ndarray) -> np.ndarray:
        chosen = np.zeros(sims.shape, bool)
        np.put_along_axis(chosen, np.argsort(-sims, axis=1, kind="stable")[:, :probes], True, axis=1)
        return chosen

    best = top_per_group(_hits(_probe(queries, index, lambda sims, b: near(sims)), index, k), ["query_id"], [F.desc("score"), F.col("item_id")], k)
    if not certify or probes >= n:
        return best
    best = kept(best, "hits")
    worst = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    known = queries.join(worst, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
    radius = index.radius

    def open_(sims: np.ndarray, b: pd.DataFrame) -> np.ndarray:
        reach = np.cos(np.maximum(0.0, np.arccos(np.clip(sims, -1.0, 1.0)) - radius[None, :]))
        return ~near(sims) & (reach + 1e-9 >= b["least"].to_numpy()[:, None])

    more = _hits(_probe(known, index, open_), index, k)
    return top_per_group(best.drop("rank").unionByName(more), ["query_id"], [F.desc("score"), F.col("item_id")], k)


def calibrated(index: Lists, k: int = 10, target: float = 0.95, queries: int = TRIALS) -> int:
    """The least number of probes that finds a share ``target`` of the true neighbours of ``queries`` stored vectors (those with the least hashes)."""
    if not len(index.centroids):
        return 1
    tried = index.rows.orderBy(F.xxhash64("item_id", F.lit(1)), "item_id").limit(queries).select(F.col("item_id").alias("query_id"), "vector").collect()
    frame = index.rows.sparkSession.createDataFrame(tried, index.rows.select(F.col("item_id").alias("query_id"), "vector").schema)
    hits = nearest(frame, index.rows, k).join(index.rows.select("item_id", "list"), "item_id").select("query_id", "list").collect()  # queries * k rows
    order = np.argsort(-(_unit([r["vector"] for r in tried]) @ index.centroids.T), axis=1, kind="stable")
    place = {r["query_id"]: np.argsort(order[i]) for i, r in enumerate(tried)}
    ranks = np.sort([place[h["query_id"]][h["list"]] for h in hits])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, over all queries: one row (n_queries, recall)."""
    hit = exact.join(found.select("query_id", "item_id", F.lit(1).alias("_hit")), ["query_id", "item_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), (F.count("_hit") / F.count("*")).alias("recall"))
