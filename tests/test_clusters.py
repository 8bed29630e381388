"""K-means of pairs: planted groups are found, by steps of few tasks, whatever the tasks that bring the rows."""

import random

from pyspark.ml.clustering import KMeans

from fxspark.operators import models as md


def planted(n=400, groups=3):
    r = random.Random(4)
    return [(f"P{i}", *(4.0 * (i % groups == j) + r.random() / 10 for j in range(groups))) for i in range(n)]


def test_groups_are_found_by_few_tasks(spark, monkeypatch):
    dealt, fit = [], KMeans.fit

    def counted(self, data, *more):
        dealt.append(data.rdd.getNumPartitions())
        return fit(self, data, *more)

    monkeypatch.setattr(KMeans, "fit", counted)
    monkeypatch.setattr(md, "CLUSTER_ROWS", 150, raising=False)
    rows = planted()
    found = []
    for tasks in (64, 5):
        df = spark.createDataFrame(rows, "pair string, a double, b double, c double").repartition(tasks)
        found.append({r["pair"]: (r["cluster"], r["silhouette"]) for r in md.clusters(df, "pair", ["a", "b", "c"], (2, 4)).collect()})
    assert dealt == [3] * 6
    assert found[0] == found[1]
    groups = [{found[0][f"P{i}"] for i in range(g, 400, 3)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert next(iter(groups[0]))[1] > 0.9


def test_few_rows_are_one_cluster(spark):
    got = md.clusters(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "pair string, x double"), "pair", ["x"]).collect()
    assert sorted((r["pair"], r["cluster"]) for r in got) == [("a", 0), ("b", 0)]
