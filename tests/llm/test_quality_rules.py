import re
from collections import Counter

from fxspark.llm import quality_rules as q
from tests.llm.conftest import rows


def brute(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measurements_against_brute_force(docs, clash):
    for frame in (docs, clash):
        got = sorted(((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(frame).collect()))
        assert got == sorted((r[0] or -1, *brute(r[1])) for r in rows())


def test_verdicts_policies_and_ablations(spark, docs, none):
    ledger = q.ledger(docs).cache()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in q.verdicts(ledger).collect()}
    assert kept[1] == (False, True) and kept[4] == (True, False) and kept[13] == (True, False) and kept[9] == (False, True)
    for policy, mask in q.POLICIES.items():
        bits = [r.failed for r in ledger.collect()]
        found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in q.ablations(ledger, policy).collect()}
        assert found == {k: (sum(bool(b & q.BIT[k]) for b in bits), sum(b & mask == q.BIT[k] for b in bits)) for k, _ in q.RULES if q.BIT[k] & mask}
    assert q.verdicts(q.ledger(none)).count() == 0


def test_stage_keeps_rows_and_columns(clash):
    got = q.filtered(clash)
    assert got.columns == clash.columns
    want = sorted((r[0] or -1) for r in rows() if brute(r[1])[0] >= 20 and 100 * brute(r[1])[4] <= 30 * brute(r[1])[0])
    assert sorted((r.doc_id or -1) for r in got.collect()) == want


def test_no_python_on_the_path(docs):
    plan = q.verdicts(q.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
