import heapq

import numpy as np
from pyspark.sql import functions as F

from fxspark.llm import mixing as mx
from tests.llm.conftest import DOCS, long_text, rows


def test_targets_stop_at_three_times_the_size():
    goal = mx.targets([10, 1000, 500, 0], [1, 2, 3, 1])
    assert np.isclose(sum(goal), 1510) and goal[0] == 30 and goal[3] == 0
    assert np.allclose([goal[1], goal[2]], [1480 * 2 / 5, 1480 * 3 / 5])
    assert mx.targets([], []) == [] and mx.targets([0, 0], [1, 2]) == [0, 0]


def test_apportion_takes_the_highest_quotients():
    r = np.random.default_rng(2)
    for _ in range(50):
        votes, seats = r.integers(0, 50, r.integers(1, 9)).astype(float), int(r.integers(0, 60))
        if not votes.sum():
            continue
        heap, want = [(-v, i, 0) for i, v in enumerate(votes) if v], np.zeros(len(votes), int)
        heapq.heapify(heap)
        for _ in range(seats):
            q, i, k = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
        got = mx.apportion(votes, seats)
        assert got.sum() == seats
        # quotients may tie: compare what was taken, not by whom
        assert np.allclose(sorted(votes[i] / (2 * k + 1) for i in range(len(votes)) for k in range(got[i])),
                           sorted(votes[i] / (2 * k + 1) for i in range(len(votes)) for k in range(want[i])))


def test_a_shard_gives_its_quota():
    for size, quota, block in ((1000, 7, 64), (100, 20, 16), (10, 1, 16), (0, 3, 8), (640, 10, 64), (5, 9, 4)):
        passes, takes = mx.plan_shard(size, quota, block, 1)
        assert passes * size + takes.sum() == min(quota * block, 3 * size) if size else takes.sum() == 0
        assert passes <= 3


def check(frame, docs_rows):
    got = mx.mix(frame, F.col("doc_id"), mx.words(F.col("text"))).collect()
    assert sorted((r["row"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in docs_rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.passes * r["size"] + sum(c.end - c.start for c in r.cuts)
        assert all(0 <= c.start < c.end <= r["size"] for c in r.cuts)
    return got


def test_mix(spark, docs, clash, none, monkeypatch):
    monkeypatch.setattr(mx, "SHARD", 4)
    first = check(docs, rows())
    assert sorted(map(str, first)) == sorted(map(str, check(clash, rows())))  # reruns and other columns change nothing
    assert mx.mix(none, F.col("doc_id"), mx.words(F.col("text"))).count() == 0
    data = [(i, long_text(20 + i % 90), "en", ("a", "b", "c", None)[min(3, i % 7)], 0) for i in range(300)]
    got = check(spark.createDataFrame(data, DOCS), data)
    taken, goal = {}, {}
    for r in got:
        source = data[r["row"]][3]
        taken[source] = taken.get(source, 0) + r.taken
        goal[source] = r.target
    assert np.isclose(sum(goal.values()), sum(r["size"] for r in got))
    for source, n in taken.items():
        assert abs(n - goal[source]) <= 0.05 * goal[source]


def test_mixed_texts_hold_what_was_taken(docs, clash):
    for frame in (docs, clash):
        out = mx.mixed(frame)
        assert out.columns == frame.columns
        taken = sum(r.taken for r in mx.mix(frame, F.col("doc_id"), mx.words(F.col("text"))).collect())
        assert sum(len(r.text.split()) for r in out.collect()) == taken


def test_each_shard_keeps_its_quota_over_many_files(spark, tmp_path, monkeypatch):
    """Adaptive plans must not spread a shard over tasks, whatever the number of shuffle partitions is."""
    monkeypatch.setattr(mx, "SHARD", 100)
    data = [(i, long_text(20 + i % 90), "en", ("a", "b", "c", None)[min(3, i % 7)], 0) for i in range(1200)]
    spark.createDataFrame(data, DOCS).repartition(12).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    sources, block = mx.sources_of(frame.select("doc_id", "source", mx.words(F.col("text")).alias("size"))), mx.BLOCK
    found = {r["source"]: r for r in sources.collect()}
    size = {}
    for r in frame.select("source", mx.tie(11).alias("k"), mx.words(F.col("text")).alias("size"), "doc_id").collect():
        own = found[r["source"]]
        size.setdefault(own.number, {}).setdefault(r["k"] % own.shards, {})[r["doc_id"]] = r["size"]
    usual = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold",
                                            "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # less than the documents, more than the plans of shards
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more than one task's worth of rows
        for n in ("4", "7", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            taken = {r["row"]: r["taken"] for r in mx.mix(frame, F.col("doc_id"), mx.words(F.col("text"))).collect()}
            for own in found.values():
                shards = size[own.number]
                assert len(shards) > 1
                votes = [sum(shards[k].values()) for k in sorted(shards)]
                for i, (k, total, quota) in enumerate(zip(sorted(shards), votes, mx.apportion(np.array(votes), own.quota))):
                    more = own.more if i == int(np.argmax(votes)) else 0
                    assert sum(taken[i] for i in shards[k]) == min(quota * block + more, 3 * total), (n, own.number, k)
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_the_shorter_last_block_takes_part():
    """Each block, the last one too, is the first of the order for some seed and then comes before the others."""
    firsts = set()
    for seed in range(40):
        passes, takes = mx.plan_shard(70, 1, 20, seed)  # blocks of 20, 20, 20 and 10 words; one quota
        assert passes == 0 and takes.sum() == 20
        firsts.add(tuple(np.flatnonzero(takes)))
    assert any(3 in f for f in firsts) and {0, 1, 2} <= {i for f in firsts for i in f}


def test_cuts_keep_white_space_and_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK", 8)
    texts = [f" \t{i}" + "".join(f"x{i}y{j}" + ("\n", "\t ", "  ")[j % 3] for j in range(3 + i * 5 % 37)) for i in range(150)]
    data = [(i, t, "en", ("a", "b")[i % 7 == 0], len(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(data, DOCS)
    chosen = {r["row"]: r for r in mx.mix(frame, F.col("doc_id"), mx.words(F.col("text"))).collect()}
    got = {}
    for r in mx.mixed(frame).collect():
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        got.setdefault(r.doc_id, []).append(r.text)
    for i, r in chosen.items():
        whole = r.passes + sum(c.end - c.start == r["size"] for c in r.cuts)
        assert got.get(i, []).count(texts[i]) == whole
        assert len(got.get(i, [])) == r.passes + len(r.cuts)
        assert sorted(t.split() for t in got.get(i, []) if t != texts[i]) == sorted(texts[i].split()[c.start : c.end] for c in r.cuts if c.end - c.start < r["size"])
    assert any(len(r.cuts) > 1 for r in chosen.values()) and any(c.end - c.start == r["size"] for r in chosen.values() for c in r.cuts)


def test_a_tiny_source_leaves_the_others_alone(spark):
    """Sources keep runs of whole blocks beside a source far smaller than a block, and each source's words come to its target."""
    data = [(i, long_text(300), "en", "ab"[i % 2], 0) for i in range(200)]
    alone = mx.mixed(spark.createDataFrame(data, DOCS)).count()
    frame = spark.createDataFrame([*data, (999, "five words and no more", "en", "c", 0)], DOCS)
    chosen = mx.mix(frame, F.col("doc_id"), mx.words(F.col("text")), keep=True).collect()
    runs = [c.end - c.start for r in chosen for c in r.cuts if r["row"] != 999]
    assert np.mean(runs) > 100 and max(len(r.cuts) for r in chosen) <= 3
    assert mx.mixed(frame).count() <= alone + 3
    taken = {}
    for r in chosen:
        taken.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - goal) < 1 for goal, v in taken.items())


def test_regions_divide_as_one_large_source(spark, monkeypatch):
    monkeypatch.setattr(mx, "SHARD", 3)
    monkeypatch.setattr(mx, "REGION", 4)
    monkeypatch.setattr(mx, "BLOCK", 8)
    data = [(i, long_text(400 + i % 50), "en", "ab"[i % 5 == 0], 0) for i in range(200)]
    got = check(spark.createDataFrame(data, DOCS), data)
    taken = {}
    for r in got:
        taken.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - goal) <= 0.01 * goal for goal, v in taken.items())


def test_rows_without_or_with_equal_doc_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mx, "SHARD", 20)
    data = [(None if i % 2 else 7, f"text {i} " * 30, "en", "a", 0) for i in range(400)]
    frame = spark.createDataFrame(data, DOCS)
    assert frame.select((F.pmod(mx.tie(11), F.lit(20))).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0] < 60
    assert len(check(frame, data)) == 400
