from itertools import combinations

import numpy as np

from fxspark.llm import ngram_join as nj
from fxspark.llm.components import components
from tests.llm.conftest import PROSE, DOCS, rows


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(data):
    sets = [grams(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(data)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d if d is not None else -1), len(s), (least.get(find(i)) if s else d) or -1) for i, ((d, _), s) in enumerate(zip(data, sets)))


def got(frame, **more):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id or -1) for r in nj.join(frame, **more).collect())


def test_odd_rows_against_brute_force(docs, clash, none):
    want = brute([r[:2] for r in rows()])
    assert got(docs) == want
    assert got(clash) == want
    assert nj.join(none).count() == 0


def chain(n):
    """Groups of near copies, chains whose ends do not link, boilerplate that many share, exact copies."""
    r = np.random.default_rng(4)
    base = PROSE.split() * 2
    data, i = [], 1
    for _ in range(n):
        w = [f"{x}{k}" for k, x in enumerate(base)]
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = f"edit{i}"
        data.append((i, " ".join(w)))
        i += 1
    step = [f"a{k}" for k in range(80)]
    for k in range(12):
        data.append((i, " ".join(step)))
        step = step[4:] + [f"b{k}-{j}" for j in range(4)]
        i += 1
    for k in range(15):
        data.append((i, PROSE + " " + " ".join(f"own{k}-{j}" for j in range(60))))
        i += 1
    return [*data, (i, data[0][1]), (i + 1, data[0][1].upper())]


def test_large_clusters_take_the_same_links(spark):
    data = chain(40)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in data], DOCS).repartition(4)
    want = brute(data)
    assert got(frame) == want
    for chunk in (150, 700):
        assert got(frame, chunk=chunk) == want


def test_prefix_is_what_no_partner_avoids():
    for n in range(1, 200):
        assert nj.prefix(n) == n - min(k for k in range(n + 1) if 100 * k >= 75 * n) + 1


def test_product_row_is_the_overlap():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 25)).astype(np.uint64) for _ in range(20)]
    m = nj.Incidence(sets)
    for i in range(20):
        assert m.product(i).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


def test_stage_keeps_one_of_each(docs, clash):
    for frame in (docs, clash):
        kept = nj.first_of_each(frame)
        assert kept.columns == frame.columns
        ids = sorted((r.doc_id or -1) for r in kept.collect())
        want = {(d, c) for d, _, c in brute([r[:2] for r in rows()])}
        assert ids == sorted({d for d, c in want if d == c})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 120)] + [(500, 501), (7, 7)], "a long, b long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {*((i, 1) for i in range(1, 121)), (500, 500), (501, 500)}
