import hashlib

import numpy as np

from fxspark.llm import piecewise_hash as ph
from tests.llm.conftest import DOCS, PROSE, long_text, rows


def test_equal_texts_and_segments(monkeypatch):
    texts = [r[1] or "" for r in rows()] + [long_text(5000)]
    whole = [ph.fingerprint(t.encode()) for t in texts]
    for segment in (7, 64, 1000):
        monkeypatch.setattr(ph, "SEGMENT", segment)
        assert [ph.fingerprint(t.encode()) for t in texts] == whole


def test_an_edit_moves_few_symbols():
    a = long_text(2000)
    b = a[:4000] + "something else" + a[4000:]
    x, y = ph.fingerprint(a.encode()), ph.fingerprint(b.encode())
    assert ph.likeness(x, y) > 0.9 and ph.likeness(x, ph.fingerprint(long_text(2000)[::-1].encode())) < 0.15
    assert ph.likeness(x, x) == 1 and ph.likeness(x, "3::") == 0 and ph.likeness("3::", "3::") == 1
    assert 0.35 < ph.likeness(x, ph.fingerprint((a[: len(a) // 2] + a[::-1][: len(a) // 2]).encode())) < 0.75


def test_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = (list("".join(r.choice(list("abcd"), r.integers(0, 25)))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert ph.common(a, b) == t[-1, -1]


def brute(data):
    order = sorted(data, key=lambda d: -d[0])
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other = ph.fingerprint(text.encode()), ph.fingerprint(edited.encode())
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, ph.likeness(own, other), ph.likeness(own, ph.fingerprint(after.encode()))


def test_compared_against_brute_force(spark):
    data = [(i * i * 37 % 100_003, (PROSE + f" {i} ") * (i % 5)) for i in range(150)]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in data], DOCS).repartition(5)
    assert sorted(tuple(r) for r in ph.compared(frame).collect()) == sorted(brute(data))
    one = spark.createDataFrame([(7, PROSE, "en", "s", 0)], DOCS)
    assert [r.near_next for r in ph.compared(one).collect()] == [1.0]


def test_odd_rows(docs, clash, none):
    for frame in (docs, clash):
        got = ph.compared(frame).collect()
        assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((r[0] or -1, len(r[1] or "")) for r in rows())
        prints = {r.doc_id: r.fingerprint for r in ph.fingerprints(frame).collect()}
        assert prints[1] == prints[2] and prints[4] == prints[5] == "3::" and all(r.fingerprint == prints[r.doc_id] for r in got)
    assert ph.compared(none).count() == 0
