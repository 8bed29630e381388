"""Calendar-event scalars: naming, impact, surprise and time decay."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import params as pm


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), key)


def event_type(name, country) -> Column:
    """Canonical type of an event name; rate decisions, PMI, CPI and GDP depend on the country."""
    raw, land = _c(name), _c(country)
    key = F.lower(F.trim(raw))
    fallback = F.regexp_replace(F.upper(raw), " ", "_")
    exact = _lookup(dict(pm.EVENT_NAMES), key)
    # a plain CASE chain stays in generated code; the first part found in the name wins
    part = None
    for text, kind in pm.EVENT_NAMES:
        hit = F.contains(key, F.lit(text))
        part = F.when(hit, kind) if part is None else part.when(hit, kind)
    found = F.coalesce(exact, part)
    foreign = land.isNotNull() & (land != "") & (land != "US") & found.isin("CPI", "GDP")
    named = F.when(foreign, F.concat_ws("_", land, found)).otherwise(found)
    return (
        F.when(F.contains(key, F.lit("interest rate")) | F.contains(key, F.lit("rate decision")),
               F.coalesce(_lookup(pm.CENTRAL_BANK, land), F.lit("INTEREST_RATE")))
        .when(F.contains(key, F.lit("manufacturing pmi")), F.coalesce(_lookup(pm.COUNTRY_PMI, land), fallback))
        .otherwise(F.coalesce(named, fallback))
    )


def impact_level(impact, country, name) -> Column:
    """Impact with the known corrections; a level is only ever raised. Missing impact is Low."""
    return raised(impact, high_impact(country, name))


def raised(impact, high) -> Column:
    base = F.coalesce(F.nullif(_c(impact), F.lit("")), F.lit("Low"))
    return F.when(high, F.lit("High")).otherwise(base)


def high_impact(country, name) -> Column:
    """Whether one of the known corrections applies."""
    raised = None
    for land, pattern in pm.HIGH_IMPACT:
        hit = (_c(country) == land) & _c(name).rlike(f"(?i){pattern}")
        raised = hit if raised is None else raised | hit
    return F.coalesce(raised, F.lit(False))


def impact_weight(impact) -> Column:
    return F.coalesce(_lookup(pm.IMPACT_WEIGHT, _c(impact)), F.lit(0.5))


def dedup_name(name) -> Column:
    """Event name without titles and doubled blanks."""
    bare = F.regexp_replace(F.lower(_c(name)), rf"(?i)\b({'|'.join(pm.TITLE_WORDS)})\b", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def decay(minutes, fast, slow, alpha) -> Column:
    """Remaining share of an impact after some minutes; nothing decays before time zero."""
    t, ln2 = _c(minutes), math.log(2)
    two = _c(alpha) * F.exp(-ln2 / _c(fast) * t) + (1 - _c(alpha)) * F.exp(-ln2 / _c(slow) * t)
    return F.when(t < 0, F.lit(1.0)).otherwise(two)


def minutes_until(threshold, fast, slow, alpha, precision: float = 0.1) -> Column:
    """Minutes until the remaining share falls below a threshold, by bisection over ten slow half-lives."""
    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        above = decay(mid, fast, slow, alpha) > threshold
        go = s["hi"] - s["lo"] > precision
        return F.struct(
            F.when(go & above, mid).otherwise(s["lo"]).alias("lo"), F.when(go & ~above, mid).otherwise(s["hi"]).alias("hi")
        )

    start = F.struct(F.lit(0.0).alias("lo"), (_c(slow) * 10).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda s: s["hi"])


def anticipation(minutes) -> Column:
    """Weight of an event still to come: 1 within the hour, falling to 0.05 at two days."""
    m = _c(minutes)
    return (
        F.when(m <= 60, F.lit(1.0))
        .when(m <= 360, 1.0 - 0.4 * (m - 60) / 300)
        .when(m <= 1440, 0.6 - 0.4 * (m - 360) / 1080)
        .when(m <= 2880, 0.2 - 0.15 * (m - 1440) / 1440)
        .otherwise(0.05)
    )


def surprise_z(actual, forecast, sigma) -> Column:
    return F.when(_c(sigma) <= 0, F.lit(0.0)).otherwise((_c(actual) - _c(forecast)) / F.when(_c(sigma) > 0, _c(sigma)))


def surprise_class(z) -> Column:
    z = _c(z)
    return (
        F.when(z > 2, "LARGE_POSITIVE").when(z > 1, "POSITIVE").when(z < -2, "LARGE_NEGATIVE").when(z < -1, "NEGATIVE").otherwise("INLINE")
    )


def surprise_percent(actual, forecast) -> Column:
    return F.when(_c(forecast) == 0, F.lit(0.0)).otherwise(F.abs(F.try_divide(_c(actual) - _c(forecast), _c(forecast))) * 100)


def expected_magnitude(confidence) -> Column:
    return F.when(_c(confidence) >= 0.95, 2.0).when(_c(confidence) >= 0.68, 1.0).otherwise(0.5)


def is_central_bank(event_type) -> Column:
    return F.upper(_c(event_type)).rlike("|".join(pm.BANK_WORDS))


def is_cross_type(event_type) -> Column:
    """Types whose relevance also holds for pairs without the event's country."""
    return _c(event_type).isin(pm.CROSS_TYPES) | _c(event_type).rlike("^[A-Z]{2}_")
