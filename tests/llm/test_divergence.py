import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from fxspark.llm import divergence as dv
from fxspark.llm.queries import OP11_SQL
from tests.llm.conftest import rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(data, least=3, top=200):
    """Every value with Python integers, term by term."""
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in data:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = TERM.findall(low)
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        members = {s: c for (l, s), c in groups.items() if l == lang}

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        shares, own = {s: p(c) for s, c in members.items()}, p(sum(members.values(), Counter()))
        for s, mine in shares.items():
            pairs = [(sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            terms = [((mine[t] - own[t]) ** 2 // own[t], t) for t in kept if members[s][t] and mine[t] > own[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("kw", [{}, {"slab": 7}, {"slab": 20, "dense": 3}, {"top": 5, "slab": 11}])
def test_values_are_those_of_plain_integers(spark, docs, kw):
    assert got(dv.audited(docs, **kw)) == brute([(r[1], r[2], r[3]) for r in rows()], top=kw.get("top", 200))


def test_extra_columns_and_no_rows(clash, docs, none):
    assert got(dv.audited(clash)) == got(dv.audited(docs))
    assert got(dv.audited(none)) == []


def test_groups_without_terms_and_odd_letters(spark):
    data = [("12 34", "xx", "a"), (None, "xx", "b"), ("", "xx", None), ("word", "xx", "c")]
    data += [(f"É{i % 2} ß İstanbul x Σ _A^Z", "yy", s) for i in range(3) for s in ("a", "b", None, "é")] + [("alone " * 50_000, "yy", "a")]
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "doc_id long, text string, lang string, source string")
    want = brute(data)
    assert ("xx", "", "pair", "a", 0, 1) in want
    assert got(dv.audited(frame)) == want


def test_counts_are_handed_on_in_parts(docs):
    whole = sorted(map(tuple, dv.counted(docs).collect()))
    assert sorted(map(tuple, dv.counted(docs, held=3).collect())) == whole


def test_shares_stay_exact_beyond_64_bits():
    count, total = np.array([0, 5, 9 * 10**12, 3 * 10**14]), np.array([10**15, 7, 9 * 10**12 + 5, 3 * 10**14 + 1])
    assert dv.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total)]


def test_delivered_documents_equal_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert got(dv.audited(spark.read.parquet(path), slab=500)) == sorted(base.sql(OP11_SQL).fetchall())
