"""Fixed parameter tables, and the same tables as DataFrames that callers may override."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Relevance of each event type for USDJPY, EURUSD, GBPUSD, AUDUSD
PAIRS = ["USDJPY", "EURUSD", "GBPUSD", "AUDUSD"]
RELEVANCE = {
    "FOMC": (0.98, 0.95, 0.90, 0.75),
    "NFP": (0.95, 0.90, 0.85, 0.60),
    "CPI": (0.90, 0.88, 0.82, 0.55),
    "GDP": (0.85, 0.80, 0.75, 0.55),
    "UNEMPLOYMENT": (0.80, 0.75, 0.70, 0.50),
    "RETAIL_SALES": (0.75, 0.70, 0.65, 0.45),
    "ECB": (0.50, 0.95, 0.55, 0.40),
    "EU_CPI": (0.35, 0.90, 0.50, 0.30),
    "EU_GDP": (0.30, 0.85, 0.45, 0.30),
    "BOE": (0.30, 0.45, 0.95, 0.25),
    "UK_CPI": (0.25, 0.40, 0.88, 0.20),
    "UK_GDP": (0.20, 0.35, 0.82, 0.18),
    "RBA": (0.20, 0.15, 0.15, 0.95),
    "AU_CPI": (0.15, 0.12, 0.12, 0.88),
    "AU_GDP": (0.15, 0.10, 0.10, 0.85),
    "CN_PMI": (0.35, 0.25, 0.20, 0.80),
    "JP_CPI": (0.85, 0.30, 0.25, 0.20),
    "BOJ": (0.95, 0.35, 0.30, 0.25),
    "PCE": (0.90, 0.85, 0.80, 0.55),
    "PERSONAL_SPENDING": (0.75, 0.70, 0.65, 0.45),
    "CONSUMER_CONFIDENCE": (0.70, 0.65, 0.60, 0.40),
    "DURABLE_GOODS": (0.78, 0.72, 0.68, 0.45),
    "ISM_PMI": (0.82, 0.78, 0.72, 0.50),
    "PPI": (0.78, 0.75, 0.70, 0.48),
    "TRADE_BALANCE": (0.72, 0.68, 0.60, 0.55),
    "HOUSING": (0.60, 0.55, 0.50, 0.35),
    "JOBLESS_CLAIMS": (0.72, 0.68, 0.62, 0.42),
    "TANKAN": (0.82, 0.30, 0.25, 0.20),
}

# Event name (or part of it) -> event type, first hit wins
EVENT_NAMES = [
    ("fomc", "FOMC"),
    ("federal open market committee", "FOMC"),
    ("fed rate decision", "FOMC"),
    ("non-farm payrolls", "NFP"),
    ("nonfarm payrolls", "NFP"),
    ("total nonfarm payroll", "NFP"),
    ("nfp", "NFP"),
    ("consumer price index", "CPI"),
    ("cpi", "CPI"),
    ("inflation rate", "CPI"),
    ("core cpi", "CPI"),
    ("gross domestic product", "GDP"),
    ("gdp", "GDP"),
    ("gdp growth rate", "GDP"),
    ("unemployment rate", "UNEMPLOYMENT"),
    ("retail sales", "RETAIL_SALES"),
    ("advance retail sales", "RETAIL_SALES"),
    ("ecb", "ECB"),
    ("european central bank", "ECB"),
    ("boe", "BOE"),
    ("bank of england", "BOE"),
    ("rba", "RBA"),
    ("reserve bank of australia", "RBA"),
    ("boj", "BOJ"),
    ("bank of japan", "BOJ"),
    ("china pmi", "CN_PMI"),
    ("cn pmi", "CN_PMI"),
    ("pce price index", "PCE"),
    ("core pce", "PCE"),
    ("personal consumption expenditures", "PCE"),
    ("personal spending", "PERSONAL_SPENDING"),
    ("personal income", "PERSONAL_SPENDING"),
    ("consumer confidence", "CONSUMER_CONFIDENCE"),
    ("consumer sentiment", "CONSUMER_CONFIDENCE"),
    ("durable goods", "DURABLE_GOODS"),
    ("durable goods orders", "DURABLE_GOODS"),
    ("ism manufacturing", "ISM_PMI"),
    ("ism services", "ISM_PMI"),
    ("producer price index", "PPI"),
    ("ppi", "PPI"),
    ("trade balance", "TRADE_BALANCE"),
    ("housing starts", "HOUSING"),
    ("building permits", "HOUSING"),
    ("tankan", "TANKAN"),
    ("initial jobless claims", "JOBLESS_CLAIMS"),
    ("jobless claims", "JOBLESS_CLAIMS"),
]

# Country -> event type of its rate decision, and of its manufacturing PMI
CENTRAL_BANK = {
    "US": "FOMC", "EU": "ECB", "DE": "ECB", "FR": "ECB", "IT": "ECB", "ES": "ECB", "NL": "ECB", "BE": "ECB", "AT": "ECB",
    "FI": "ECB", "IE": "ECB", "PT": "ECB", "GR": "ECB", "GB": "BOE", "UK": "BOE", "JP": "BOJ", "AU": "RBA", "NZ": "RBNZ",
    "CA": "BOC", "CH": "SNB", "CN": "PBOC",
}
COUNTRY_PMI = {"CN": "CN_PMI", "US": "ISM_PMI"}

# Event types that count across countries, and words marking a central-bank event
CROSS_TYPES = ["FOMC", "ECB", "BOE", "BOJ", "RBA", "RBNZ", "BOC", "SNB", "PBOC"]
BANK_WORDS = ["FOMC", "ECB", "BOE", "RBA", "BOJ", "FED"]

# Half-lives in minutes (fast, slow) and weight of the fast part
DECAY = {
    "FOMC": (10.0, 240.0, 0.40),
    "NFP": (5.0, 60.0, 0.60),
    "CPI": (5.0, 90.0, 0.55),
    "GDP": (5.0, 60.0, 0.55),
    "ECB": (10.0, 180.0, 0.40),
    "BOE": (10.0, 180.0, 0.40),
    "RBA": (10.0, 120.0, 0.40),
    "BOJ": (10.0, 240.0, 0.40),
}
DECAY_DEFAULT = (5.0, 60.0, 0.50)

# Countries and central banks of each pair
PAIR_COUNTRIES = {
    "USDJPY": ["US", "JP"],
    "EURUSD": ["US", "EU", "DE", "FR", "IT", "ES"],
    "GBPUSD": ["US", "GB", "UK"],
    "AUDUSD": ["US", "AU", "CN"],
}
PAIR_BANKS = {
    "USDJPY": ["Fed", "BOJ", "FOMC"],
    "EURUSD": ["Fed", "ECB", "FOMC"],
    "GBPUSD": ["Fed", "BOE", "FOMC"],
    "AUDUSD": ["Fed", "RBA", "FOMC"],
}

# Weight of each impact level, and the rules that raise a level to High
IMPACT_WEIGHT = {"High": 1.0, "Medium": 0.6, "Low": 0.3, "None": 0.1}
HIGH_IMPACT = [
    ("US", r"core pce|pce price index"),
    ("US", r"personal spending|personal income"),
    ("US", r"durable goods"),
    ("JP", r"core cpi|(?<!\w)cpi(?!\w)"),
    ("JP", r"boj|tankan|gdp"),
    ("DE", r"consumer confidence"),
]

# Title words ignored when two events are compared
TITLE_WORDS = ["president", "governor", "chairman", "chair", "vice", "deputy", "member"]

# Deal dimensions with weight and inversion, and their names in sentences
DIMENSIONS = {
    "market": (1.0, False), "team": (1.2, False), "product": (1.0, False), "traction": (1.5, False),
    "syndication_fit": (1.5, False), "risk_regulatory": (0.8, True), "japan_fit": (1.0, False),
}
DIMENSION_LABELS = {
    "market": "market attractiveness", "team": "team quality", "product": "product/moat", "traction": "traction",
    "syndication_fit": "syndication fit", "risk_regulatory": "low regulatory risk", "japan_fit": "Japan/Tokyo fit",
}


def frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small literal table whose size the optimizer knows."""
    cells = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))
    return spark.range(1).select(F.inline(cells))


def relevance_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, ["event_type", "pair", "relevance"], [(e, p, v) for e, vs in RELEVANCE.items() for p, v in zip(PAIRS, vs)])


def decay_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, ["event_type", "fast_halflife", "slow_halflife", "alpha"], [(e, *v) for e, v in DECAY.items()])


def pair_countries_frame(spark: SparkSession) -> DataFrame:
    return frame(spark, ["pair", "country"], [(p, c) for p, cs in PAIR_COUNTRIES.items() for c in cs])
