"""The normal distribution as SQL text, by the approximations of :mod:`fxspark.functions.stats`."""

from __future__ import annotations

from ..functions import stats as st


def _polynomial(x: str, coefficients: list[float]) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def cdf(x: str, depth: int = 0) -> str:
    v = f"x{depth}"
    a = f"abs({v})"
    near = f"exp(-{a} * {a} / 2) * {_polynomial(a, st.CDF_TOP)} / {_polynomial(a, st.CDF_BOTTOM)}"
    far = f"exp(-{a} * {a} / 2) / {st.ROOT_2_PI!r} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"
    below = f"CASE WHEN {a} > 38.4 THEN 0 WHEN {a} < {st.CDF_SPLIT!r} THEN {near} ELSE {far} END"
    return f"list_transform([CAST({x} AS DOUBLE)], lambda {v}: CASE WHEN {v} > 0 THEN 1 - ({below}) ELSE {below} END)[1]"


def ppf(p: str) -> str:
    h, q = "(s - 0.5)", "sqrt(-2 * ln(s))"
    mid = f"{_polynomial(f'({h} * {h})', st.PPF_MID_TOP)} * {h} / {_polynomial(f'({h} * {h})', st.PPF_MID_BOTTOM)}"
    tail = f"{_polynomial(q, st.PPF_TAIL_TOP)} / {_polynomial(q, st.PPF_TAIL_BOTTOM)}"
    first = f"CASE WHEN s >= {st.PPF_SPLIT} THEN {mid} ELSE {tail} END"
    step = f"list_transform([({cdf('v', 1)} - s) * {st.ROOT_2_PI!r} * exp(v * v / 2)], lambda u: v - u / (1 + v * u / 2))[1]"
    lower = f"list_transform([least(w, 1 - w)], lambda s: list_transform([{first}], lambda v: {step})[1])[1]"
    return f"list_transform([CAST({p} AS DOUBLE)], lambda w: CASE WHEN w > 0.5 THEN -({lower}) ELSE {lower} END)[1]"
