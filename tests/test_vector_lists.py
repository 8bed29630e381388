"""Inverted lists against the exact search."""

import numpy as np
import pytest

from fxspark.operators import vector_lists as vl
from fxspark.operators import vectors as ve

ITEM, QUERY = "item_id bigint, vector array<double>", "query_id bigint, vector array<double>"


def made(n=1500, d=16, groups=20, seed=3):
    """Clustered vectors, a third of them one copied vector, some zero."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, d))
    v = centre[r.integers(0, groups, n)] + 0.25 * r.normal(size=(n, d))
    v[: n // 3] = v[0]
    v[-3:] = 0.0
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.fixture(scope="module")
def data(spark):
    rows = made()
    store = spark.createDataFrame(rows, ITEM).repartition(4).cache()
    queries = spark.createDataFrame([r for r in rows if r[0] % 30 == 0] + [(7_000, [0.0] * 16)], QUERY)
    return queries, store, ve.nearest(queries, store, 5).cache()


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("probes, piece", [(1, 50_000), (3, 40)])
def test_certified_search_is_exact(data, monkeypatch, probes, piece):
    monkeypatch.setattr(vl, "PIECE", piece)
    queries, store, exact = data
    index = vl.build(store, 20)
    assert rows_of(vl.search(queries, index, 5, probes=probes, certify=True)) == rows_of(exact)
    sizes = [r["count"] for r in index.rows.groupBy("list", "piece").count().collect()]
    assert sum(sizes) == 1500  # every vector once
    if piece == 40:
        assert max(sizes) < 120  # the copied vector fills many pieces


def test_calibrated_probes_reach_the_recall(data):
    queries, store, exact = data
    index = vl.build(store)
    probes = vl.calibrated(index, 5)
    assert probes < len(index.centroids) / 2
    assert vl.recall(vl.search(queries, index, 5, probes=probes), exact).first()["recall"] >= 0.9


def test_few_hits_nulls_and_empty_tables(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 1.0])], ITEM)
    queries = spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], QUERY)
    index = vl.build(store, 2)
    for certify in (True, False):
        got = vl.search(queries, index, 10, probes=2, certify=certify).orderBy("rank").collect()
        assert [(r.query_id, r.item_id) for r in got] == [(1, 3), (1, 4), (1, 1)]
    assert vl.search(queries.limit(0), index, 3).count() == 0
    empty = vl.build(store.limit(0))
    assert vl.search(queries, empty, 3, certify=True).count() == 0 and vl.calibrated(empty) == 1


def test_products_are_made_in_bounded_parts(monkeypatch):
    import tracemalloc

    r = np.random.default_rng(2)
    q, s = (ve._unit(r.normal(size=(n, 8))) for n in (1_500, 20_000))
    s[5:9] = s[4]  # ties
    ids = r.permutation(20_000)
    tracemalloc.start()
    got = ve.best_pairs(np.arange(1_500), q, ids, s, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all products at once take 240 MB, and their ranking several times as much
    for i in (0, 77, 1_499):
        score = np.round(s @ q[i], 12)
        want = ids[np.lexsort((ids, -score))[:3]].tolist()
        assert sorted(got[got["query_id"] == i]["item_id"]) == sorted(want)
    assert len(got) == 4_500


def test_probes_are_handed_on_in_bounded_frames(data, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(vl, "PROBES", 100)
    queries, store, exact = data
    vectors = [np.eye(16)[i % 16] for i in range(50)]
    batch = pd.DataFrame({"query_id": range(50), "vector": vectors})
    pieces = np.array([1] * 15 + [20])
    frames = list(vl._probing(np.eye(16), pieces, lambda sims, b: np.ones(sims.shape, bool))(iter([batch, batch.iloc[:0]])))
    assert max(map(len, frames)) <= 100
    rows = pd.concat(frames)
    assert len(rows) == 50 * 35 and not rows.duplicated(["query_id", "list", "piece"]).any()
    assert all(v is vectors[i] or np.array_equal(v, vectors[i]) for i, v in zip(rows["query_id"], rows["vector"]))
