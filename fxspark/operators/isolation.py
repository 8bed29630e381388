"""Unusual rows of each key by a forest of isolation trees.

A tree halves a small sample of a key's rows at random places of random features until each row stands alone or the tree is as high
as a balanced one would be; rows that stand alone early are unusual. Trees are grown from bounded pools (``POOL`` rows with the least
hashes of each key, ``SAMPLE`` of them per tree), flattened into arrays, and meet the key's rows in pieces of bounded size, so a key
that holds a large share of all rows is many tasks. All rows are scored.

A missing feature goes to the lower side. Keys may be NULL. Keys with fewer than three rows have no forest and come back
without a score, unflagged; a key whose rows are all alike scores every row the same and flags none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .joins import same_keys
from .quantiles import HOT_ROWS, group_quantiles
from .ranking import top_per_group

TREES, SAMPLE, POOL = 100, 256, 4_096
PIECE = 100_000  # rows that one task scores, about
LEAST = 3  # rows of a key that a forest needs
EULER = 0.5772156649015329


def mean_path(n) -> np.ndarray:
    """Mean depth at which a search ends in a random tree over ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(m - 1) + EULER) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree over the rows of ``x`` as arrays: feature (-1 in a leaf), split, the lower child (the upper one follows it), path length at a leaf."""
    height = int(np.ceil(np.log2(max(2, len(x)))))
    feature, split, child, path = [-1], [0.0], [0], [0.0]
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == height or not len(open_):
            path[node] = depth + float(mean_path(len(rows)))
            continue
        f = int(rng.choice(open_))
        at = float(rng.uniform(low[f], high[f]))
        at = high[f] if at <= low[f] else at  # both sides keep a row
        feature[node], split[node], child[node] = f, at, len(feature)
        below = x[rows, f] < at
        for side in (rows[below], rows[~below]):
            waiting.append((len(feature), side, depth + 1))
            for values, empty in ((feature, -1), (split, 0.0), (child, 0), (path, 0.0)):
                values.append(empty)
    return np.array(feature, np.int16), np.array(split), np.array(child, np.int32), np.array(path)


def scores(x: np.ndarray, trees: list[tuple], size: int) -> np.ndarray:
    """Between 0 and 1, higher for rows that stand alone early; all rows walk down a tree together."""
    total = np.zeros(len(x))
    for feature, split, child, path in trees:
        node = np.zeros(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            value = np.take_along_axis(x, np.maximum(f, 0)[:, None].astype(np.int64), axis=1)[:, 0]
            node = np.where(inner, child[node] + (value >= split[node]), node)
        total += path[node]
    return 2.0 ** (-total / len(trees) / max(1.0, float(mean_path(size))))


def _features(table: pa.Table, feats: list[str]) -> np.ndarray:
    cols = [np.nan_to_num(table.column(f).to_numpy().astype(np.float64), nan=-np.inf) for f in feats]
    return np.clip(np.stack(cols, axis=1), -1e300, 1e300)


def forests(df: DataFrame, keys: list[str], feats: list[str], order: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """A row per key with its forest: the trees' arrays behind each other, where each begins, and how many rows a tree has seen."""
    pool = top_per_group(df.select(*keys, *feats, *order), keys, [F.xxhash64(*order, F.lit(seed)), *map(F.col, order)], POOL, "_pool")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_pool")
        x, n = _features(table, feats), min(len(table), sample)
        named = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}
        rng = np.random.default_rng([seed, zlib.crc32(repr([v.as_py() for v in key]).encode())])
        grown = [grow(x[rng.permutation(len(x))[:n]], rng) for _ in range(trees)] if len(x) >= LEAST else []
        begin = np.cumsum([0, *(len(t[0]) for t in grown)])[:-1]
        joined = [np.concatenate([t[i] for t in grown]) if grown else np.zeros(0) for i in range(4)]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.float64()]
        return pa.table({**named, "size": pa.array([n], pa.int32()), "begin": pa.array([begin.tolist()], pa.list_(pa.int32())),
                         **{c: pa.array([v.tolist()], pa.list_(k)) for c, v, k in zip(("feature", "split", "child", "path"), joined, kinds)}})

    named = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return pool.groupBy(*keys).applyInArrow(run, f"{named}, size int, begin array<int>, feature array<int>, split array<double>, child array<int>, path array<double>")


def anomalies(df: DataFrame, keys: list[str], feats: list[str], order: list[str], contamination: float = 0.1, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Rows with anomaly_score and is_anomaly: above the ``1 - contamination`` quantile of their key. ``order`` names rows within a key."""
    df = kept(df, "anomalies")
    own = df.columns
    pieces = max(1, -(-df.count() // PIECE))
    forest = forests(df, keys, feats, order, trees, sample, seed).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    rows = df.withColumn("_piece", F.pmod(F.xxhash64(*keys, *order), F.lit(pieces)).cast("int"))

    def run(key: tuple, table: pa.Table, grown: pa.Table) -> pa.Table:
        table = table.select(own)
        score = pa.nulls(len(table), pa.float64())
        begin = grown.column("begin")[0].as_py() if len(grown) else []
        if begin and len(table):
            arrays = [grown.column(c)[0].values.to_numpy() for c in ("feature", "split", "child", "path")]
            score = pa.array(scores(_features(table, feats), list(zip(*(np.split(a, begin[1:]) for a in arrays))), grown.column("size")[0].as_py()))
        return table.append_column("anomaly_score", score)

    each = [*keys, "_piece"]
    scored = kept(rows.groupBy(*each).cogroup(forest.groupBy(*each)).applyInArrow(run, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, anomaly_score double"), "scores")
    limit = group_quantiles(scored, keys, ["anomaly_score"], {"cut": 1 - contamination}, HOT_ROWS)
    flag = F.coalesce(F.col("anomaly_score") > F.col("anomaly_score_cut"), F.lit(False)).cast("int")
    return same_keys(scored, limit, keys).withColumn("is_anomaly", flag).drop("anomaly_score_cut")
