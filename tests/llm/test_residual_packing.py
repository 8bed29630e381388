import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fxspark.llm import residual_packing as rp
from tests.llm.conftest import rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_that_of_a_plain_search(lengths):
    n = np.array(lengths, dtype=np.int64)
    bins, offsets = rp.best_fit(n, 50)
    room = []
    for i in np.argsort(-n, kind="stable"):
        fitting = [r for r in room if r >= n[i]]
        if fitting:
            room[room.index(min(fitting))] -= n[i]
        else:
            room.append(50 - n[i])
    fill = defaultdict(list)
    for b, o, x in zip(bins.tolist(), offsets.tolist(), lengths):
        fill[b].append((o, x))
    for members in fill.values():
        at = 0
        for o, x in sorted(members):
            assert o == at
            at += x
        assert at <= 50
    assert sorted(50 - sum(x for _, x in m) for m in fill.values()) == sorted(room)


def whole(result, capacity, texts):
    """Checks pieces and sequences; returns how many sequences there are."""
    got = result.collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    t, expected = Tokenizer.from_file(PATH), defaultdict(list)
    for doc_id, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            body = ids[start : start + capacity]
            expected[doc_id].append((k, start, len(body), zlib.crc32(body.tobytes())))
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for d, v in pieces.items()} == {d: sorted(v) for d, v in expected.items()}
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


def test_packed_rows(docs, clash, none):
    texts = [(r[0], r[1]) for r in rows()]
    sequences, tokens = whole(rp.packed(docs, PATH), rp.CAPACITY, texts)
    assert sequences == -(-tokens // rp.CAPACITY)
    whole(rp.packed(clash, PATH, 64), 64, texts)
    assert rp.packed(none, PATH).count() == 0


@pytest.mark.parametrize("leaf, group", [(5, 4), (3, 20), (40, 1000)])
def test_levels_merge_what_leaves_left(spark, leaf, group):
    texts = [(i, "word " * (1 + i * 37 % 50)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    sequences, tokens = whole(rp.packed(docs, PATH, 100, near=0, leaf=leaf, group=group), 100, texts)
    best = whole(rp.packed(docs.coalesce(1), PATH, 100, near=0), 100, texts)[0]
    assert best <= sequences
    if group == 1000:
        assert sequences <= 1.02 * best + 1


def test_pieces_that_match_nothing_stay_in_nodes_of_bounded_size(spark):
    """All pieces are longer than half a sequence: nothing can be merged, and rounds end before a node would hold everything."""
    texts = [(i, "word " * 60) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert whole(rp.packed(docs, PATH, 100, leaf=10, group=20), 100, texts)[0] == 200


def test_same_sequences_again(docs):
    key = lambda: sorted(map(str, rp.packed(docs, PATH, 128).select("doc_id", "piece", "sequence_id", "offset").collect()))
    assert key() == key()


def test_sums_by_sql(spark, docs):
    full = rp.packed(docs, PATH, 64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end OR n > 64").count() == 0
