"""Isolation trees: flattened walks against recursion, planted outliers, hot and odd keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fxspark.operators import isolation as iso


def recursive(x, tree, node=0):
    feature, split, child, path = tree
    if feature[node] < 0:
        return path[node]
    return recursive(x, tree, child[node] + (x[feature[node]] >= split[node]))


def test_walks_equal_recursion():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    trees = [iso.grow(x[r.permutation(300)[:64]], r) for _ in range(12)]
    got = iso.scores(x, trees, 64)
    want = [2.0 ** (-np.mean([recursive(row, t) for t in trees]) / float(iso.mean_path(64))) for row in x]
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_a_tree_parts_its_rows():
    """Every row of the sample ends in a leaf of rows that the tree could not tell apart; no leaf is empty."""
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(20, 2)), 3, axis=0)
    feature, split, child, path = iso.grow(x, r)
    assert (feature >= 0).sum() == (feature < 0).sum() - 1 and path[feature >= 0].sum() == 0
    assert np.isclose(iso.mean_path(2), 1) and iso.mean_path(1) == 0 and np.isclose(float(iso.mean_path(256)), 10.244770920119917)


def frame(spark, n=400):
    r = np.random.default_rng(2)
    rows = []
    for key, m in (("hot", 3 * n), (None, n), ("flat", 40), ("two", 2)):
        for i in range(m):
            far = key in ("hot", None) and i % 50 == 7
            x = r.normal(size=2) + (12 if far else 0)
            rows.append((key, i, *(map(float, x) if key != "flat" else (1.0, 1.0)), far))
    rows.append((None, 10_000, None, 0.0, False))
    return spark.createDataFrame(rows, "k string, i bigint, a double, b double, far boolean").repartition(5)


@pytest.mark.parametrize("piece", [100_000, 300])
def test_planted_rows_have_the_highest_scores(spark, monkeypatch, piece):
    monkeypatch.setattr(iso, "PIECE", piece)
    df = frame(spark)
    got = iso.anomalies(df, ["k"], ["a", "b"], ["i"], contamination=0.03, trees=50).collect()
    assert len(got) == df.count()
    for key in ("hot", None):
        mine = [r for r in got if r.k == key]
        least = min(r.anomaly_score for r in mine if r.far)
        assert sum(r.anomaly_score > least and not r.far for r in mine) <= 0.01 * len(mine)
        assert all(r.is_anomaly for r in mine if r.far) and sum(r.is_anomaly for r in mine) <= 0.03 * len(mine) + 1
    assert {r.is_anomaly for r in got if r.k == "flat"} == {0} and len({r.anomaly_score for r in got if r.k == "flat"}) == 1
    assert [(r.anomaly_score, r.is_anomaly) for r in got if r.k == "two"] == [(None, 0)] * 2
    if piece == 300:  # pieces change nothing
        monkeypatch.setattr(iso, "PIECE", 100_000)
        again = iso.anomalies(df.repartition(2), ["k"], ["a", "b"], ["i"], contamination=0.03, trees=50).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))


def test_no_rows(spark):
    assert iso.anomalies(frame(spark, 4).limit(0), ["k"], ["a", "b"], ["i"]).count() == 0
