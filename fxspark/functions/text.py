"""Text, identifier and JSON helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight major currency codes, the URL namespace of RFC 4122, length limits
MAJOR_CURRENCIES = ["USD", "EUR", "JPY", "GBP", "AUD", "CAD", "CHF", "NZD"]
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
PROMPT_CHARS = 8000
STORED_CHARS = 50000
CHUNK_CHARS = 2000
CHUNK_STEP = 1800
CHUNK_MIN_CHARS = 100

# every character Python's str.strip removes
_BLANK = r"[\s\x1c-\x1f\x85   -     　]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(_c(c), f"^{_BLANK}+|{_BLANK}+$", "")


def json_body(text) -> Column:
    """The JSON text inside a model answer, NULL if there is none.

    Reasoning blocks are removed; a fenced block wins over the first braces; the shortest braces win
    if they parse, else the longest.
    """
    clean = strip(F.regexp_replace(_c(text), r"(?is)<think>.*?</think>", ""))
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    fenced = F.nullif(strip(F.regexp_extract(clean, fence, 1)), F.lit(""))
    short = F.nullif(F.regexp_extract(clean, r"(?s)\{.*?\}", 0), F.lit(""))
    long = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    braces = F.when(F.try_parse_json(short).isNotNull(), short).otherwise(long)
    bare = F.when(clean.startswith("{"), clean)
    return F.when(clean.rlike(fence), fenced).otherwise(F.coalesce(braces, bare))


def json_float(json, name: str) -> Column:
    """Number at the top level of a JSON text; missing or invalid reads 0.0."""
    return F.coalesce(F.get_json_object(_c(json), f"$.{name}").try_cast("double"), F.lit(0.0))


def json_text(json, name: str) -> Column:
    """Text at the top level of a JSON text; missing reads ''."""
    return F.coalesce(F.get_json_object(_c(json), f"$.{name}"), F.lit(""))


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(c)))


def score_columns(json, fields: list[str]) -> dict[str, Column]:
    """One float column per score field of the answer schema."""
    return {f: json_float(json, f) for f in fields}


def currency_code(c) -> Column:
    return F.upper(strip(F.coalesce(_c(c), F.lit(""))))


def is_major_currency(c) -> Column:
    """True when the text names at least one of the eight codes."""
    return currency_code(c).rlike("|".join(MAJOR_CURRENCIES))


def primary_currency(c) -> Column:
    return F.when(is_major_currency(c), F.substring(currency_code(c), 1, 16))


def symbols_or_default(symbols, default: list[str]) -> Column:
    return F.when(F.size(_c(symbols)) > 0, _c(symbols)).otherwise(F.array(*map(F.lit, default)))


def uuid5_url(url) -> Column:
    """Name-based identifier of a URL, equal to ``uuid.uuid5(uuid.NAMESPACE_URL, url)``."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(_c(url), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def content_hash(c) -> Column:
    """64-bit identity hash of a text."""
    return F.xxhash64(_c(c))


def prompt_text(c) -> Column:
    return F.when(F.length(_c(c)) > PROMPT_CHARS, F.concat(F.substring(_c(c), 1, PROMPT_CHARS), F.lit("..."))).otherwise(_c(c))


def stored_text(c) -> Column:
    return F.substring(_c(c), 1, STORED_CHARS)


def chunks(text) -> Column:
    """Overlapping chunks of a text, blank-trimmed, short ones left out."""
    t = _c(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t), F.lit(CHUNK_STEP))).otherwise(
        F.array().cast("array<int>")
    )
    parts = F.transform(starts, lambda s: strip(F.substr(t, s, F.lit(CHUNK_CHARS))))
    return F.filter(parts, lambda p: F.length(p) > CHUNK_MIN_CHARS)


def experiment_text(**parts: Column) -> Column:
    """Labelled parts joined for embedding; NULL parts are left out."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in parts.items()))


def pair_key(c) -> Column:
    """EUR/USD, EUR_USD and eurusd become EURUSD."""
    return F.upper(F.regexp_replace(_c(c), "[/_]", ""))


def split_pair(c) -> tuple[Column, Column]:
    key = pair_key(c)
    ok = F.length(key) == 6
    return F.when(ok, F.substring(key, 1, 3)), F.when(ok, F.substring(key, 4, 3))


def dataset_parts(c) -> dict[str, Column]:
    """MODEL_PAIR_TIMEFRAME or PAIR_TIMEFRAME to its parts; the pair becomes AAA_BBB."""
    bits = F.split(_c(c), "_")
    n = F.size(bits)
    code = F.upper(F.try_element_at(bits, F.lit(-2)))
    pair = F.when(F.length(code) == 6, F.concat_ws("_", F.substring(code, 1, 3), F.substring(code, 4, 3)))
    return {
        "model_type": F.when((n >= 3) & pair.isNotNull(), F.array_join(F.slice(bits, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")),
        "pair": F.when(n == 2, F.coalesce(pair, code)).when(n >= 3, pair),
        "timeframe": F.when((n == 2) | ((n >= 3) & pair.isNotNull()), F.upper(F.try_element_at(bits, F.lit(-1)))),
    }


def host(url) -> Column:
    return F.lower(F.try_parse_url(_c(url), F.lit("HOST")))


def two_places(x) -> Column:
    """A number with two decimals, rounded by its exact binary value, without thousands separators."""
    return F.regexp_replace(F.format_number(_c(x), 2), ",", "")
