"""Expectations of single functions, stated as small frames."""

import json
import math
import uuid
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fxspark.functions import calendar as cal
from fxspark.functions import market as mk
from fxspark.functions import params as pm
from fxspark.functions import text as tx
from fxspark.operators import calendar as oc
from fxspark.operators import deals as de
from fxspark.operators import models as md
from fxspark.operators import ranking as rk
from fxspark.operators import regime as rg
from fxspark.operators import research as rs
from fxspark.operators import scores as sc
from fxspark.operators import sets as st
from fxspark.operators import signals as sg
from fxspark.operators import validation as va
from fxspark.operators import vectors as ve
from fxspark.operators.series import Series


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_uuid5(spark):
    urls = ["https://example.org/a?b=1", "http://ü.example/ß", ""]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(tx.uuid5_url("u")).collect()
    assert [g[0] for g in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in urls]


@pytest.mark.parametrize("text, want", [
    ('<think>{"a": 1}</think> ok {"score": 7, "rationale": "x"}', {"score": 7, "rationale": "x"}),
    ('```json\n{"score": 8}\n```', {"score": 8}),
    ('pre {"a": {"b": 1}} post', {"a": {"b": 1}}),
    ("nothing", None),
    ("", None),
])
def test_json_body(spark, text, want):
    got = one(spark, x=tx.json_body(F.lit(text)))["x"]
    assert (json.loads(got) if got else None) == want


def test_clamped_scores(spark):
    r = one(spark, hi=tx.clamp(F.lit(15.0), 0, 10), lo=tx.clamp(F.lit(-3.0), 0, 10), miss=tx.json_float(F.lit('{"a": 1}'), "b"), bad=tx.json_float(F.lit('{"a": "x"}'), "a"))
    assert (r["hi"], r["lo"], r["miss"], r["bad"]) == (10.0, 0.0, 0.0, 0.0)


def test_chunks(spark):
    t = "".join(chr(97 + i % 26) for i in range(4000))
    got = one(spark, c=tx.chunks(F.lit(t)))["c"]
    want = [t[i:i + 2000].strip() for i in range(0, len(t), 1800)]
    assert got == [w for w in want if len(w) > 100]
    assert one(spark, c=tx.chunks(F.lit("")))["c"] == []


@pytest.mark.parametrize("name, land, want", [
    ("Non-Farm Payrolls", "US", "NFP"), ("Interest Rate Decision", "EU", "ECB"), ("Interest Rate Decision", "XX", "INTEREST_RATE"),
    ("Core CPI m/m", "JP", "JP_CPI"), ("CPI", "GB", "GB_CPI"), ("Caixin Manufacturing PMI", "CN", "CN_PMI"),
    ("Manufacturing PMI", "DE", "MANUFACTURING_PMI"), ("Some Odd Event", "US", "SOME_ODD_EVENT"), ("ECB President Speech", "DE", "ECB"),
])
def test_event_types(spark, name, land, want):
    assert one(spark, x=cal.event_type(F.lit(name), F.lit(land)))["x"] == want


def test_impact_only_rises(spark):
    r = one(spark, a=cal.impact_level(F.lit("Low"), F.lit("US"), F.lit("Core PCE m/m")), b=cal.impact_level(F.lit("Medium"), F.lit("FR"), F.lit("Core PCE")),
            c=cal.impact_level(F.lit(""), F.lit("FR"), F.lit("x")), d=cal.impact_level(F.lit("Low"), F.lit("JP"), F.lit("CPI y/y")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("High", "Medium", "Low", "High")


def test_decay_falls_and_threshold_is_met(spark):
    fast, slow, alpha = (F.lit(v) for v in pm.DECAY["NFP"])
    df = spark.range(0, 200, 10).select(F.col("id").alias("m"), cal.decay(F.col("id"), fast, slow, alpha).alias("d")).orderBy("m").toPandas()
    assert df["d"][0] == 1.0 and (np.diff(df["d"]) < 0).all()
    m = one(spark, m=cal.minutes_until(0.1, fast, slow, alpha))["m"]
    f = lambda t: 0.6 * math.exp(-math.log(2) / 5 * t) + 0.4 * math.exp(-math.log(2) / 60 * t)
    assert f(m) <= 0.1 < f(m - 0.1)
    assert one(spark, x=cal.decay(F.lit(-5.0), fast, slow, alpha))["x"] == 1.0


def test_anticipation(spark):
    r = one(spark, **{f"m{m}": cal.anticipation(F.lit(float(m))) for m in (30, 360, 1440, 2880, 9999)})
    assert [round(x, 6) for x in r] == [1.0, 0.6, 0.2, 0.05, 0.05]


def test_surprise(spark):
    r = one(spark, z=cal.surprise_z(F.lit(250000.0), F.lit(200000.0), F.lit(20000.0)), none=cal.surprise_z(F.lit(1.0), F.lit(0.0), F.lit(0.0)),
            c=cal.surprise_class(F.lit(2.5)), i=cal.surprise_class(F.lit(1.0)), p=cal.surprise_percent(F.lit(1.0), F.lit(0.0)))
    assert (r["z"], r["none"], r["c"], r["i"], r["p"]) == (2.5, 0.0, "LARGE_POSITIVE", "INLINE", 0.0)


def events(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, event_name string, event_type string, country string, event_datetime timestamp_ntz, impact string, actual double, estimate double")


def test_scores_and_risk(spark):
    at = datetime(2024, 1, 1, 12)
    ev = events(spark, [(1, "NFP", "NFP", "US", at, "High", 250000.0, 200000.0), (2, "ECB", "ECB", "DE", datetime(2024, 1, 2, 12), "High", None, 4.0),
                        (3, "RS", "RETAIL_SALES", "CA", at, "High", None, 1.0)])
    now = F.to_timestamp_ntz(F.lit("2024-01-01 12:05:00"))
    got = {(r["row_id"], r["pair"]): r for r in oc.score(ev, now).collect()}
    assert got[(1, "USDJPY")]["relevance"] == 0.95
    assert 0 < got[(1, "USDJPY")]["time_factor"] < 1
    assert got[(2, "USDJPY")]["relevance"] == 0.5  # central bank counts across countries
    assert got[(3, "USDJPY")]["relevance"] == 0.0  # foreign country, not a cross type
    sig = pm.frame(spark, ["event_type", "sigma"], [("NFP", 20000.0)])
    z = {(r["row_id"], r["pair"]): r for r in oc.score(ev, now, sigma=sig).collect()}
    assert z[(1, "USDJPY")]["surprise_z"] == 2.5
    assert z[(1, "USDJPY")]["score"] == pytest.approx(2.5 * got[(1, "USDJPY")]["score"])
    risk = {r["pair"]: r["risk"] for r in oc.macro_risk(oc.score(ev, now, sigma=sig)).collect()}
    assert risk["USDJPY"] == "HIGH"
    calm = {r["risk"] for r in oc.macro_risk(oc.score(ev.filter("row_id = 3"), now)).collect()}
    assert calm == {"LOW"}


def test_event_dedup_prefers_released(spark):
    at = datetime(2024, 1, 1, 12)
    ev = events(spark, [(1, "Fed Chair Powell Speech", "X", "US", at, "Low", None, None), (2, "Fed Powell Speech", "X", "US", at, "Low", 1.0, None),
                        (3, "Fed  Governor Powell Speech", "X", "US", at, "Low", None, None), (4, "Fed Powell Speech", "X", "GB", at, "Low", None, None)])
    got = {r["country"]: (r["row_id"], r["copies"]) for r in oc.deduplicate(ev, "row_id").collect()}
    assert got == {"US": (2, 3), "GB": (4, 1)}


def test_composite_scores(spark):
    a = de.composite(de.dimension_map({"market": F.lit(8.0), "team": F.lit(6.0)}, {"market": 1.0, "team": 2.0}))
    b = de.composite(de.dimension_map({"market": F.lit(8.0), "risk_regulatory": F.lit(8.0)}, {"market": 1.0, "risk_regulatory": 1.0}))
    empty = de.composite(F.create_map().cast("map<string, struct<score: double, weight: double>>"))
    r = one(spark, a=a, b=b, e=empty)
    assert (r["a"], r["b"], r["e"]) == (round(20 / 3, 4), 5.0, 0.0)


def test_rank_with_many_equal_scores(spark):
    pdf = pd.DataFrame({"id": range(9000), "s": [0.0 if i % 3 else float(i % 7) for i in range(9000)]})
    got = de.rank(spark.createDataFrame(pdf), "s", "id").toPandas().sort_values("rank")
    exp = pdf.sort_values(["s", "id"], ascending=[False, True])
    assert got["id"].tolist() == exp["id"].tolist() and got["rank"].tolist() == list(range(1, 9001))


def test_log_decay(spark):
    r = one(spark, a=mk.log_decay(F.lit(0.0)), b=mk.log_decay(F.lit(-1.0)), c=mk.log_decay(F.lit(24.0)))
    assert r["a"] == r["b"] == 1.0
    assert r["c"] == pytest.approx(min(1.0, 1 / (math.log10(1 + 24 / (20 / 60)) * 1.8)))


def test_sessions_partition_the_day(spark):
    got = spark.range(24).select(mk.session_of(F.col("id").cast("int")).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {k: len(v) for k, v in mk.SESSION_HOURS.items()}


def test_states_merge_like_one_pass(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 4000), "part": rng.integers(0, 9, 4000), "x": 1e6 + rng.gamma(2.0, 1.0, 4000)})
    df = spark.createDataFrame(pdf)
    merged = sc.merge_states(sc.partial_states(df, ["k", "part"], ["x"]), ["k"], ["x"])
    got = sc.finish_states(merged, ["k"], ["x"], {"p50": 0.5}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        d = g["x"] - g["x"].mean()
        assert got.loc[k, "x_stddev"] == pytest.approx(g["x"].std(ddof=0), rel=1e-9)
        assert got.loc[k, "x_skewness"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5, rel=1e-6)
        assert got.loc[k, "x_kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2, rel=1e-6)  # plain kurtosis
        rank = (g["x"] < got.loc[k, "x_p50"]).mean()
        assert abs(rank - 0.5) < 0.05  # sketch error


def test_single_article_has_no_skew(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], "primary_ccy string, ts timestamp_ntz, x double")
    r = sc.score_statistics_with_quantiles(df, ["x"]).first()
    assert r["x_skewness"] is None and r["x_stddev"] == 0.0 and r["x_p50"] == 1.0


def test_grids_have_the_configured_sizes():
    grid = {"ma_type": ["sma", "ema"], "fast_window": list(range(5, 55, 5)), "slow_window": list(range(20, 220, 20)), "sl_pct": [1, 2, 3, 4], "tp_pct": [1, 2, 3]}
    pts = sg.grid_points("trend_following", grid)
    assert len(pts) == 2160 and len(sg.distinct_signals("trend_following", pts)) == 180
    with pytest.raises(ValueError):
        sg.grid_points("trend_following", {"ma_type": ["sma"]})


def test_psr_and_deflated_sharpe(spark):
    from statistics import NormalDist
    r = np.random.default_rng(2).normal(0.001, 0.01, 500)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "ret": r}))
    got = sg.return_shape(df, ["k"]).first()
    sd = r.std(ddof=1)
    z = (r - r.mean()) / sd
    sr, sk, ku = r.mean() / sd, (z**3).mean(), (z**4).mean() - 3
    assert got["skewness"] == pytest.approx(sk, abs=1e-9) and got["kurtosis"] == pytest.approx(ku, abs=1e-9)
    assert got["psr"] == pytest.approx(NormalDist().cdf(sr * math.sqrt(499) / math.sqrt(1 - sk * sr + ku / 4 * sr * sr)), abs=1e-9)
    assert got["tail_ratio"] == pytest.approx(np.percentile(r, 95) / abs(np.percentile(r, 5)))
    nd, n, t = NormalDist(), 500, 20
    e = (nd.inv_cdf(1 - 1 / t) * (1 - 0.5772156649) + 0.5772156649 * nd.inv_cdf(1 - 1 / (t * math.e))) / math.sqrt(n)
    want = nd.cdf((0.1 - e) / math.sqrt((1 - 0.2 * 0.1 + (4 - 1) / 4 * 0.01) / (n - 1)))
    lit = lambda v: F.lit(v)
    assert one(spark, d=va.deflated_sharpe(lit(0.1), lit(t), lit(n), lit(0.2), lit(4.0)))["d"] == pytest.approx(want, abs=1e-9)


def test_pbo_against_brute_force(spark):
    from itertools import combinations
    m = np.random.default_rng(5).normal(size=(7, 6))
    rows = [(s, p, float(m[s, p])) for s in range(7) for p in range(6)]
    got = va.pbo(spark.createDataFrame(rows, "s int, p int, v double"), "s", "p", "v", 6).first()
    hits = []
    for c in combinations(range(6), 3):
        o = [i for i in range(6) if i not in c]
        isp, oos = m[:, list(c)].mean(axis=1), m[:, o].mean(axis=1)
        hits.append((oos >= oos[isp.argmax()]).sum() > 3.5)
    assert got["n_combinations"] == 20 and got["pbo"] == pytest.approx(np.mean(hits))
    assert va.pbo(spark.createDataFrame(rows, "s int, p int, v double"), "s", "p", "v", 3).first()["pbo"] == 1.0


def test_purged_splits_against_brute_force(spark):
    from itertools import combinations
    n, k, gap = 103, 5, 3
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(n)}))
    rows = va.indexed(Series.of(df, ["k"], ["i"], {"b": F.floor(F.col("i") / 10)}))
    got = va.purged_splits(rows, ["k"], k, 2, gap).filter("role = 'train'").groupBy("split").agg(F.sort_array(F.collect_set("idx")).alias("s")).collect()
    got = {r["split"]: r["s"] for r in got}
    groups = [list(range(i * (n // k), (i + 1) * (n // k) if i < k - 1 else n)) for i in range(k)]
    for j, c in enumerate(combinations(range(k), 2)):
        test = sorted(groups[c[0]] + groups[c[1]])
        train = [i for g in range(k) if g not in c for i in groups[g] if i < test[0] - gap or i > test[-1] + gap]
        assert got.get(j, []) == train


@pytest.mark.parametrize("limit", [1000, 3])
def test_nearest_vectors_both_ways(spark, limit):
    rng = np.random.default_rng(4)
    q, s = rng.normal(size=(8, 16)), rng.normal(size=(200, 16))
    qd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    sd = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(s)], "item_id bigint, vector array<double>").repartition(3)
    got = ve.nearest(qd, sd, 5, broadcast_limit=limit, slice_rows=64).toPandas()
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (s / np.linalg.norm(s, axis=1, keepdims=True)).T
    for i in range(8):
        g = got[got["query_id"] == i].sort_values("rank")
        assert g["item_id"].tolist() == np.argsort(-cos[i])[:5].tolist()
        np.testing.assert_allclose(g["score"], np.sort(cos[i])[::-1][:5])


def test_novelty_of_empty_store(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert ve.novelty(q, spark.createDataFrame([], "item_id bigint, vector array<double>")).first()["novelty"] == 1.0


def test_regime_durations_and_matrix(spark):
    states = [0, 0, 1, 1, 1, 0, 2, 2]
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(8), "state": states}))
    s = Series.of(df, ["k"], ["i"], {"b": F.floor(F.col("i") / 3)})
    got = rg.changes_and_durations(s).df.orderBy("i").toPandas()
    assert got["regime_change"].tolist() == [0, 0, 1, 0, 0, 1, 1, 0]
    assert got["regime_duration"].tolist() == [1, 2, 1, 2, 3, 1, 1, 2]
    long = rg.transitions(s, 3)
    m = rg.matrix_form(long, ["k"]).first()["transition_matrix"]
    np.testing.assert_allclose(m, [[1 / 3, 1 / 3, 1 / 3], [1 / 3, 2 / 3, 0], [0, 0, 1]])
    v = one(spark, f=rg.forecast(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(*(F.array(*map(F.lit, map(float, row))) for row in m)), 4))["f"]
    np.testing.assert_allclose(v, np.array([1.0, 0, 0]) @ np.linalg.matrix_power(np.array(m), 4))


def test_as_of_join(spark):
    left = spark.createDataFrame([(i, float(i)) for i in (1, 5, 6, 20)], "ts int, x double")
    right = spark.createDataFrame([(2, 10.0), (5, 20.0), (7, 30.0)], "ts int, v double")
    b = {"b": F.floor(F.col("ts") / 3)}
    got = {r["ts"]: r["v"] for r in rg.as_of_join(left, right, [], "ts", ["v"], b).collect()}
    assert got == {1: None, 5: 20.0, 6: 20.0, 20: 30.0}
    only = {r["ts"]: r["v"] for r in rg.as_of_join(left, right, [], "ts", ["v"], b, exact_then_fill=True).collect()}
    assert only == {1: None, 5: 20.0, 6: 20.0, 20: 20.0}


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 0.1, 300), "c": rng.normal(size=300)})
    scores, var = md.principal_components(spark.createDataFrame(pdf), ["a", "b", "c"], 0.9)
    z = ((pdf - pdf.mean()) / pdf.std()).to_numpy()
    w, v = np.linalg.eigh(np.cov(z.T))
    w, v = w[::-1], v[:, ::-1]
    rows = var.orderBy("component").toPandas()
    np.testing.assert_allclose(rows["explained"], (w / w.sum())[:2], atol=1e-9)
    got = scores.toPandas()
    load = v[:, 0] * np.sign(v[np.abs(v[:, 0]).argmax(), 0])
    np.testing.assert_allclose(np.sort(got["pc1"]), np.sort(z @ load), atol=1e-8)


def test_set_helpers(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    over = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in st.override(base, over, ["k"], ["v"]).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    al = st.align_schema(base, {"w": 0.0}, {"v": "value"})
    assert al.columns == ["k", "value", "w"]
    assert st.missing_columns(base, ["k", "z"]) == ["z"]
    assert st.unseen(base.unionByName(base), over, "k").collect() == [("a", 1)]


def test_gates(spark):
    m = spark.createDataFrame([("r1", "forecast_accuracy_mae", 40000.0), ("r1", "validation_signal_precision", 0.7), ("r2", "validation_forecast_accuracy_mae", 60000.0), ("r3", "x", 1.0)],
                              "run string, metric string, value double")
    t = pm.frame(spark, ["metric", "threshold"], [("validation_forecast_accuracy_mae", 50000.0), ("validation_signal_precision", 0.65)])
    assert {r["run"]: (r["promote"], r["checked"]) for r in va.threshold_gate(m, "run", t).collect()} == {"r1": (True, 2), "r2": (False, 1), "r3": (True, 0)}


def test_cross_timeframe_needs_two_complete(spark):
    p = spark.createDataFrame([("P", "H1", 1, 2.0, 1.0, 3.0), ("P", "H4", 1, 2.0, 1.5, 4.0), ("Q", "H1", 1, 2.0, 1.0, 5.0), ("Q", "H4", 1, 2.0, None, None), ("R", "H1", 1, 2.0, 1.0, 1.0),
                               ("R", "D", 1, 1.0, 2.0, 1.0), ("S", "H1", 1, 1.0, 2.0, 1.0)],
                              "pair string, timeframe string, ts int, pred double, actual double, error_pips double")
    got = {r["pair"]: r for r in rs.cross_timeframe(p, "pair", ["ts"], p.filter("pair <> 'S'")).collect()}
    assert set(got) == {"P", "Q", "R"}
    assert (got["P"]["trend_aligned"], got["Q"]["trend_aligned"], got["R"]["trend_aligned"]) == (1, 0, 0)
    assert got["Q"]["data"] == {"h1_pred": 2.0, "h1_actual": 1.0, "h1_error_pips": 5.0, "h4_pred": 2.0}


def test_quota_and_merge(spark):
    d = spark.createDataFrame([("a", 1, 2, i) for i in range(5)] + [("b", 0, 3, i) for i in range(5)], "source string, priority int, cap int, id int")
    assert [(r["source"], r["id"]) for r in rk.quota(d, "source", "cap", "priority", "id", 4).collect()] == [("b", 0), ("b", 1), ("b", 2), ("a", 0)]


def test_clusters_fall_back_to_one(spark):
    pdf = pd.DataFrame({"pair": [f"p{i}" for i in range(12)], "x": np.random.default_rng(0).uniform(size=12)})
    assert md.clusters(spark.createDataFrame(pdf), "pair", ["x"], (2, 3), min_silhouette=1.1).select("cluster").distinct().count() == 1
