import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fxspark.llm import toxicity as tx
from tests.llm.conftest import DOCS, rows

SF = "/root/testdata/sf0.1"


def test_pairs_are_learnt():
    """Two terms that are harmless alone and toxic together: no additive weights can tell."""
    r = np.random.default_rng(0)
    sets = [np.array(sorted(set(r.integers(0, 2, 2) * [1, 2]) - {0} | {3 + int(r.integers(5))})) for _ in range(1500)]
    y = np.array([float({1, 2} <= set(s)) for s in sets])
    m = tx.Machine(8)
    m.fit(sets, y, epochs=60)
    assert ((m.score(sets) > 0.5) == (y > 0)).mean() > 0.99
    assert m.v[1] @ m.v[2] > 1


def test_raw_is_the_sum_over_pairs():
    m = tx.Machine(6, factors=3)
    m.w, m.bias = np.arange(6.0), 0.5
    s = np.array([0, 2, 5])
    pairs = sum(m.v[a] @ m.v[b] for i, a in enumerate(s) for b in s[i + 1 :])
    assert np.isclose(m.raw([s, np.array([], np.int64)])[0], 0.5 + 7 + pairs) and m.raw([s, np.array([], np.int64)])[1] == 0.5


def made(n, source="s"):
    """Labels follow a word; the held-out rows say the opposite."""
    out, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        out.append((i, f"plain words number {i % 17} and {'grumbleword' if toxic else 'kindness'} here", "en", source, 0))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, 1, int(toxic != held)))
    return out, labels


def test_held_out_labels_and_other_columns_count_for_nothing(spark):
    data, labels = made(240)
    docs, marks = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.scored(docs, *tx.train(docs, marks)).collect()}
    assert len(got) == 240
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7) == int(i % 3 == 0)
    again = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in tx.scored(again, *tx.train(again, marks)).collect()} == {i: r.score for i, r in got.items()}


def test_odd_rows(spark, docs, clash, none):
    _, labels = made(9)
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for frame in (docs, clash):
        got = tx.scored(frame, *tx.train(frame, marks)).collect()
        assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in rows()) and all(0 <= r.score <= 1 for r in got)
    no_marks = marks.limit(0)
    assert {r.score < 0.01 for r in tx.scored(docs, *tx.train(docs, no_marks)).collect()} == {True}
    assert tx.scored(none, *tx.train(none, no_marks)).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = tx.scored(docs, *tx.train(docs, labels))
    rows_ = scored.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows_}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01


def test_pairs_are_learnt_from_documents(spark):
    """Labels follow only from whether two words stand together or not at all: neither tells anything alone."""
    r = np.random.default_rng(1)
    data, labels = [], []
    for i in range(6000):
        k = int(r.integers(4))
        words = [f"word{j}x" for j in r.choice(300, 10, replace=False)] + ["harmless"] * (k & 1) + ["innocent"] * (k >> 1)
        r.shuffle(words)
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(k in (0, 3))))
    docs, marks = spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept, machine = tx.train(docs, marks)
    assert kept is None and len(machine.w) == 2**18
    got = [(r.score > 0.5) == (labels[r.doc_id][2] == 1) for r in tx.scored(docs, kept, machine).collect() if r.held_out]
    assert np.mean(got) > 0.9
