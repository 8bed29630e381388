"""Economic calendar: naming, scoring against pairs, decay, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import params as pm
from ..operators import calendar as oc
from ..operators import sets as st
from .inputs import k_of, r, rnd, rounded, table
from .registry import query

NAMES = ["Interest Rate Decision", "Non-Farm Payrolls", "Core CPI m/m", "GDP Growth Rate", "Manufacturing PMI", "Retail Sales", "Fed Chair Speech",
         "Fed Speech", "ECB President Press Conference", "Tankan Large Index", "Durable Goods Orders", "Consumer Confidence", "PCE Price Index",
         "Trade Balance", "CPI", "Building Permits"]
LANDS = ["US", "JP", "DE", "GB", "AU", "CN", "EU"]
AS_OF = "2024-01-16 12:00:00"


def _arr(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


# one calendar event per row of events, at full hours
EVENTS = f"""e AS (SELECT event_id AS row_id, {_arr(NAMES)}[CAST(event_id % {len(NAMES)} + 1 AS INTEGER)] AS event_name,
 {_arr(LANDS)}[CAST((event_id // {len(NAMES)}) % {len(LANDS)} + 1 AS INTEGER)] AS country, date_trunc('hour', ts) AS event_datetime,
 CASE event_type WHEN 'click' THEN 'High' WHEN 'view' THEN 'Medium' WHEN 'signup' THEN 'Low' WHEN 'purchase' THEN '' ELSE 'None' END AS raw_impact,
 CASE WHEN k % 4 = 0 THEN NULL ELSE value / 10 END AS actual, k / 10 AS estimate, value / 20 AS previous
 FROM (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS k FROM events))"""

_KEY = "lower(trim(event_name))"
_FALL = "replace(upper(event_name), ' ', '_')"
_EXACT = "CASE " + " ".join(f"WHEN {_KEY} = '{n}' THEN '{t}'" for n, t in pm.EVENT_NAMES) + " END"
_PART = "CASE " + " ".join(f"WHEN contains({_KEY}, '{n}') THEN '{t}'" for n, t in pm.EVENT_NAMES) + " END"


def _case(col, table, other):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_RAISE = " OR ".join(f"(country = '{c}' AND regexp_matches(lower(event_name), '{p.replace('(?<!' + chr(92) + 'w)', chr(92) + 'b').replace('(?!' + chr(92) + 'w)', chr(92) + 'b')}'))" for c, p in pm.HIGH_IMPACT)
TYPED = f"""{EVENTS}, n AS (SELECT *, coalesce({_EXACT}, {_PART}) AS found FROM e),
t AS (SELECT row_id, event_name, country, event_datetime, actual, estimate, previous,
 CASE WHEN {_RAISE} THEN 'High' ELSE coalesce(nullif(raw_impact, ''), 'Low') END AS impact,
 CASE WHEN contains({_KEY}, 'interest rate') OR contains({_KEY}, 'rate decision') THEN {_case('country', pm.CENTRAL_BANK, "'INTEREST_RATE'")}
      WHEN contains({_KEY}, 'manufacturing pmi') THEN {_case('country', pm.COUNTRY_PMI, _FALL)}
      WHEN country <> 'US' AND found IN ('CPI', 'GDP') THEN country || '_' || found ELSE coalesce(found, {_FALL}) END AS event_type FROM n)"""


def raw_events(spark, sf):
    e = table(spark, sf, "events").withColumn("k", k_of())
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int"))
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("row_id"), pick(NAMES, F.col("event_id") % len(NAMES) + 1).alias("event_name"),
        pick(LANDS, F.floor(F.col("event_id") / len(NAMES)) % len(LANDS) + 1).alias("country"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("event_datetime"),
        F.when(kind == "click", "High").when(kind == "view", "Medium").when(kind == "signup", "Low").when(kind == "purchase", "").otherwise("None").alias("raw_impact"),
        F.when(F.col("k") % 4 != 0, F.col("value") / 10).alias("actual"), (F.col("k") / 10).alias("estimate"), (F.col("value") / 20).alias("previous"))


def typed_events(spark, sf):
    return oc.named(raw_events(spark, sf), impact="raw_impact").drop("raw_impact")


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


@query("P13_impact_override", f"WITH {TYPED} SELECT country, event_name, impact, count(*) AS n FROM t GROUP BY ALL")
def impact_override(spark, sf):
    return typed_events(spark, sf).groupBy("country", "event_name", "impact").agg(F.count("*").alias("n"))


@query("P14_event_type", f"WITH {TYPED} SELECT country, event_name, event_type, count(*) AS n FROM t GROUP BY ALL")
def event_types(spark, sf):
    return typed_events(spark, sf).groupBy("country", "event_name", "event_type").agg(F.count("*").alias("n"))


@query("S12_calendar_rows", f"""WITH {TYPED} SELECT country || '-' || event_type || '-' || strftime(event_datetime, '%Y-%m-%dT%H:%M:%S') AS event_id, event_name, event_type, country,
 'USD' AS currency, event_datetime, impact, {r('actual')} AS actual, {r('estimate')} AS estimate FROM t""")
def calendar_rows(spark, sf):
    # landed responses as JSON text, read back with a schema
    raw = raw_events(spark, sf).select(F.to_json(F.struct(
        F.col("event_name").alias("event"), F.date_format("event_datetime", "yyyy-MM-dd HH:mm:ss").alias("date"), "country",
        F.col("raw_impact").alias("impact"), "actual", "estimate", "previous")).alias("j"))
    schema = "event string, date string, country string, currency string, impact string, actual double, estimate double, previous double"
    ev = oc.normalize(raw.select(F.from_json("j", schema).alias("x")).select("x.*"))
    return rounded(ev.drop("previous"), "actual", "estimate")


_BARE = "trim(regexp_replace(regexp_replace(lower(event_name), '\\b(" + "|".join(pm.TITLE_WORDS) + ")\\b', '', 'g'), '\\s+', ' ', 'g'))"


@query("O9_event_dedup", f"""WITH {TYPED} SELECT row_id, country, event_datetime, event_name, {r('actual')} AS actual, copies FROM (
 SELECT *, row_number() OVER (PARTITION BY country, event_datetime, {_BARE} ORDER BY actual IS NOT NULL DESC, length(event_name) DESC, row_id) AS rn,
  count(*) OVER (PARTITION BY country, event_datetime, {_BARE}) AS copies FROM t) WHERE rn = 1""")
def event_dedup(spark, sf):
    d = oc.deduplicate(typed_events(spark, sf), "row_id")
    return rounded(d.select("row_id", "country", "event_datetime", "event_name", "actual", "copies"), "actual")


_DECAY = [f"CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v[i]}' for k, v in pm.DECAY.items())} ELSE {pm.DECAY_DEFAULT[i]} END" for i in range(3)]


def decay_expr(m):
    return (f"CASE WHEN {m} < 0 THEN 1.0 ELSE {_DECAY[2]} * exp(-ln(2) / {_DECAY[0]} * {m}) + (1 - {_DECAY[2]}) * exp(-ln(2) / {_DECAY[1]} * {m}) END")


def anti_expr(m):
    return (f"CASE WHEN {m} <= 60 THEN 1.0 WHEN {m} <= 360 THEN 1.0 - 0.4 * ({m} - 60) / 300 WHEN {m} <= 1440 THEN 0.6 - 0.4 * ({m} - 360) / 1080 "
            f"WHEN {m} <= 2880 THEN 0.2 - 0.15 * ({m} - 1440) / 1440 ELSE 0.05 END")


PASSED = f"CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(event_datetime) AS DOUBLE) / 60000000"
TIMED = f"""{TYPED}, p AS (SELECT *, {PASSED} AS passed FROM t),
tm AS (SELECT *, CASE WHEN actual IS NOT NULL THEN passed END AS minutes_since_release,
 CASE WHEN actual IS NOT NULL AND passed > 0 THEN {decay_expr('passed')} WHEN passed < 0 THEN {anti_expr('(-passed)')} ELSE 1.0 END AS time_factor FROM p)"""


@query("P24_time_decay", f"WITH {TIMED} SELECT row_id, event_type, {r(decay_expr('passed'))} AS remaining FROM tm")
def time_decay(spark, sf):
    t = typed_events(spark, sf).join(pm.decay_frame(spark), "event_type", "left")
    minutes = (F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.unix_micros(F.col("event_datetime").cast("timestamp"))) / 60e6
    par = [F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("fast_halflife", "slow_halflife", "alpha"), pm.DECAY_DEFAULT)]
    return t.select("row_id", "event_type", rnd(cal.decay(minutes, *par)).alias("remaining"))


@query("P25_anticipation_weight", f"WITH {TIMED} SELECT row_id, {r(anti_expr('(-passed)'))} AS weight FROM tm")
def anticipation_weight(spark, sf):
    minutes = (F.unix_micros(F.to_timestamp(F.lit(AS_OF))) - F.unix_micros(F.col("event_datetime").cast("timestamp"))) / 60e6
    return typed_events(spark, sf).select("row_id", rnd(cal.anticipation(-minutes)).alias("weight"))


def _at(mid):
    return f"{_DECAY[2]} * exp(-ln(2) / {_DECAY[0]} * ({mid})) + (1 - {_DECAY[2]}) * exp(-ln(2) / {_DECAY[1]} * ({mid}))"


@query("P26_minutes_until_threshold", f"""WITH RECURSIVE {TYPED}, g AS (SELECT event_type, count(*) AS n FROM t GROUP BY 1),
b AS (SELECT event_type, n, 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST({_DECAY[1]} AS DOUBLE) * 10 AS hi FROM g
 UNION ALL SELECT event_type, n, step + 1, CASE WHEN {_at('(lo + hi) / 2')} > 0.1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_at('(lo + hi) / 2')} > 0.1 THEN hi ELSE (lo + hi) / 2 END
 FROM b WHERE hi - lo > 0.1) SELECT event_type, n, {r('arg_max(hi, step)')} AS minutes FROM b GROUP BY 1, 2""")
def minutes_until_threshold(spark, sf):
    t = typed_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")).join(pm.decay_frame(spark), "event_type", "left")
    par = [F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("fast_halflife", "slow_halflife", "alpha"), pm.DECAY_DEFAULT)]
    return t.select("event_type", "n", rnd(cal.minutes_until(0.1, *par)).alias("minutes"))


SURPRISE = "(actual - estimate) / 2.0"


@query("P27_surprise", f"""WITH {TYPED} SELECT row_id, {r(SURPRISE)} AS z,
 CASE WHEN {SURPRISE} > 2 THEN 'LARGE_POSITIVE' WHEN {SURPRISE} > 1 THEN 'POSITIVE' WHEN {SURPRISE} < -2 THEN 'LARGE_NEGATIVE' WHEN {SURPRISE} < -1 THEN 'NEGATIVE' ELSE 'INLINE' END AS class,
 {r('CASE WHEN estimate = 0 THEN 0 ELSE abs((actual - estimate) / estimate) * 100 END')} AS pct, CAST(1 AS DOUBLE) AS expected FROM t WHERE actual IS NOT NULL""")
def surprise(spark, sf):
    t = typed_events(spark, sf).filter("actual IS NOT NULL").withColumn("z", cal.surprise_z("actual", "estimate", F.lit(2.0)))
    return t.select("row_id", rnd("z").alias("z"), cal.surprise_class("z").alias("class"), rnd(cal.surprise_percent("actual", "estimate")).alias("pct"),
                    cal.expected_magnitude(F.lit(0.68)).alias("expected"))


REL = "rel AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{p}', CAST({v} AS DOUBLE))" for e, vs in pm.RELEVANCE.items() for p, v in zip(pm.PAIRS, vs)) + ") v(event_type, pair, relevance))"
PAIRS_SQL = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {_arr(cs)})" for p, cs in pm.PAIR_COUNTRIES.items()) + ") v(pair, lands))"


@query("J7_event_pair_relevance", f"""WITH {TYPED}, {REL}, {PAIRS_SQL}
SELECT t.event_type, pr.pair, coalesce(rel.relevance, 0) AS relevance, count(*) AS n FROM t CROSS JOIN pr LEFT JOIN rel ON rel.event_type = t.event_type AND rel.pair = pr.pair GROUP BY ALL""")
def event_pair_relevance(spark, sf):
    return oc.pair_relevance(typed_events(spark, sf), gate=False).groupBy("event_type", "pair", "relevance").agg(F.count("*").alias("n"))


_CROSS = f"(t.event_type IN ({', '.join(repr(c) for c in pm.CROSS_TYPES)}) OR regexp_matches(t.event_type, '^[A-Z]{{2}}_'))"
GATED = f"""{REL}, {PAIRS_SQL}, g AS (SELECT t.*, pr.pair, CASE WHEN list_contains(lands, country) OR {_CROSS} THEN coalesce(rel.relevance, 0) ELSE 0 END AS relevance
 FROM {{src}} t CROSS JOIN pr LEFT JOIN rel ON rel.event_type = t.event_type AND rel.pair = pr.pair)"""


@query("J8_country_gate", f"WITH {TYPED}, {GATED.replace('{src}', 't')} SELECT country, event_type, pair, relevance, count(*) AS n FROM g GROUP BY ALL")
def country_gate(spark, sf):
    return oc.pair_relevance(typed_events(spark, sf)).groupBy("country", "event_type", "pair", "relevance").agg(F.count("*").alias("n"))


_W = "CASE impact " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pm.IMPACT_WEIGHT.items()) + " ELSE 0.5 END"
SCORED = f"{TIMED}, {GATED.replace('{src}', 'tm')}, sc AS (SELECT *, relevance * {_W} * time_factor AS score FROM g)"


def scored(spark, sf):
    return oc.score(typed_events(spark, sf), as_of())


@query("J7_event_scores", f"WITH {SCORED} SELECT row_id, pair, {r('relevance')} AS relevance, {r('time_factor', 9)} AS time_factor, {r('score', 9)} AS score FROM sc")
def event_scores(spark, sf):
    return rounded(scored(spark, sf).select("row_id", "pair", "relevance", "time_factor", "score"), "relevance", "time_factor", "score", digits=9)


@query("A37_macro_risk", f"""WITH {SCORED}, x AS (SELECT pair, coalesce(bool_or(minutes_since_release BETWEEN -30 AND 30 AND score > 0.7), false) AS hot,
 coalesce(sum(score) FILTER (minutes_since_release IS NULL OR minutes_since_release BETWEEN -120 AND 120), 0) AS near_score FROM sc GROUP BY 1)
SELECT pair, {r('near_score')} AS near_score, CASE WHEN hot THEN 'HIGH' WHEN near_score > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def macro_risk(spark, sf):
    return rounded(oc.macro_risk(scored(spark, sf)), "near_score")


@query("O15_relevance_cut", f"""WITH {SCORED}, x AS (SELECT row_id, max(score) AS best_score, max(minutes_since_release) AS m FROM sc GROUP BY 1)
SELECT row_id, {r('best_score')} AS best_score, {r('m')} AS minutes_since_release, best_score >= 0.7 AND coalesce(m, 0) >= -30 AS high_impact_imminent FROM x WHERE best_score >= 0.05""")
def relevance_cut(spark, sf):
    return rounded(oc.relevant(scored(spark, sf)), "best_score", "minutes_since_release")


@query("P35_report_lines", f"""WITH {SCORED}, b AS (SELECT *, CASE WHEN minutes_since_release IS NULL OR minutes_since_release < 0 THEN 'upcoming' WHEN minutes_since_release <= 30 THEN 'imminent'
  WHEN minutes_since_release <= 240 THEN 'recent' END AS bucket, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, list_position({_arr(pm.PAIRS)}, pair)) AS rn FROM sc)
SELECT row_id, bucket, coalesce(string_agg(pair || ' (' || printf('%.2f', score) || ')', ', ' ORDER BY rn) FILTER (rn <= 3 AND score > 0.1), '') AS affected_pairs
FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def report_lines(spark, sf):
    return oc.report_lines(scored(spark, sf))


@query("O8_affected_pairs", f"""WITH {TYPED}, {REL} SELECT t.event_type, pair, relevance, count(*) AS n, row_number() OVER (PARTITION BY t.event_type ORDER BY relevance DESC, pair) AS rank
FROM t JOIN rel USING (event_type) WHERE relevance >= 0.3 GROUP BY 1, 2, 3""")
def affected_pairs(spark, sf):
    from pyspark.sql import Window
    n = typed_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    hit = n.join(pm.relevance_frame(spark).filter("relevance >= 0.3"), "event_type")
    w = Window.partitionBy("event_type").orderBy(F.desc("relevance"), "pair")  # at most one row per pair
    return hit.select("event_type", "pair", "relevance", "n", F.row_number().over(w).alias("rank"))


@query("O8_pairs_by_country", f"WITH {EVENTS}, {PAIRS_SQL} SELECT country, pair, count(*) AS n FROM e JOIN pr ON list_contains(lands, country) GROUP BY 1, 2")
def pairs_by_country(spark, sf):
    return raw_events(spark, sf).groupBy("country").agg(F.count("*").alias("n")).join(pm.pair_countries_frame(spark), "country").select("country", "pair", "n")


@query("P36_pair_parts", f"""WITH {TYPED}, {PAIRS_SQL} SELECT t.event_type, pair, substr(pair, 1, 3) AS base, substr(pair, 4, 3) AS quote, list_contains(lands, country) AS affected,
 regexp_matches(upper(t.event_type), '{"|".join(pm.BANK_WORDS)}') AS central_bank,
 CASE pair {' '.join(f"WHEN '{p}' THEN '{','.join(b)}'" for p, b in pm.PAIR_BANKS.items())} END AS banks, count(*) AS n FROM t CROSS JOIN pr GROUP BY ALL""")
def pair_parts(spark, sf):
    from ..functions.text import split_pair
    land = F.create_map(*(x for p, cs in pm.PAIR_COUNTRIES.items() for x in (F.lit(p), F.array(*map(F.lit, cs)))))
    banks = F.create_map(*(x for p, bs in pm.PAIR_BANKS.items() for x in (F.lit(p), F.array(*map(F.lit, bs)))))
    base, quote = split_pair("pair")
    t = typed_events(spark, sf).withColumn("pair", F.explode(F.array(*map(F.lit, pm.PAIRS))))
    return t.groupBy("event_type", "pair", base.alias("base"), quote.alias("quote"), F.array_contains(land[F.col("pair")], F.col("country")).alias("affected"),
                     cal.is_central_bank("event_type").alias("central_bank"), F.array_join(banks[F.col("pair")], ",").alias("banks")).agg(F.count("*").alias("n"))


@query("A38_weighted_surprise", f"""WITH {TYPED}, z AS (SELECT country, event_type AS indicator, avg({SURPRISE}) AS z FROM t WHERE actual IS NOT NULL GROUP BY 1, 2),
w AS (SELECT * FROM (VALUES ('NFP', 1.0), ('CPI', 0.8), ('RETAIL_SALES', 0.5), ('ABSENT', 0.7)) v(indicator, weight))
SELECT country, {r('sum(coalesce(z, 0) * weight) / 3.0')} AS surprise_index FROM (SELECT DISTINCT country FROM z) CROSS JOIN w LEFT JOIN z USING (country, indicator) GROUP BY 1""")
def weighted_surprise(spark, sf):
    rows = typed_events(spark, sf).filter("actual IS NOT NULL").select(
        "country", F.col("event_type").alias("indicator"), cal.surprise_z("actual", "estimate", F.lit(2.0)).alias("z"))
    w = pm.frame(spark, ["indicator", "weight"], [("NFP", 1.0), ("CPI", 0.8), ("RETAIL_SALES", 0.5), ("ABSENT", 0.7)])
    return rounded(oc.weighted_surprise(rows, ["country"], w), "surprise_index")


@query("F2_relevance_override", f"""WITH {TYPED}, {REL}, o AS (SELECT * FROM (VALUES ('NFP', 'AUDUSD', CAST(0.99 AS DOUBLE)), ('NEW_TYPE', 'EURUSD', 0.5)) v(event_type, pair, relevance)),
m AS (SELECT coalesce(o.event_type, rel.event_type) AS event_type, coalesce(o.pair, rel.pair) AS pair, coalesce(o.relevance, rel.relevance) AS relevance
 FROM rel FULL JOIN o ON o.event_type = rel.event_type AND o.pair = rel.pair)
SELECT m.event_type, m.pair, m.relevance, count(t.row_id) AS n FROM m LEFT JOIN t USING (event_type) GROUP BY 1, 2, 3""")
def relevance_override(spark, sf):
    over = pm.frame(spark, ["event_type", "pair", "relevance"], [("NFP", "AUDUSD", 0.99), ("NEW_TYPE", "EURUSD", 0.5)])
    m = st.override(pm.relevance_frame(spark), over, ["event_type", "pair"], ["relevance"])
    n = typed_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return m.join(n, "event_type", "left").na.fill(0, ["n"])
