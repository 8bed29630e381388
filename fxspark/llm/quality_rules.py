"""Quality rules as a bitmask ledger (SQL functions only).

``ledger`` evaluates every rule once per document and stores the measurements and one integer with a bit for each
failed rule. ``verdicts`` applies a versioned policy, which is a mask over those bits, and ``ablations`` counts what
each rule alone decides, both without another look at a text.

Null or empty text: no words, all counts 0, the rule ``few_words`` fails. A repeated row gives a repeated ledger row.
Columns of the input beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import WORD_GAP, texts

SPAN = 8  # words of a window in the repetition measure

#: Name and condition of each rule over the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Rules that count in each version of the policy.
POLICIES: dict[str, int] = {"v1": BASE, "v2": BASE | BIT["symbols"] | BIT["capitals"] | BIT["word_length"]}
CURRENT = "v2"


def _gone(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _windows(n: Column) -> Column:
    """Hashes of all windows of SPAN words; no window in a shorter text."""
    at = lambda i: [F.get("wh", i + k) for k in range(SPAN)]
    return F.when(n >= SPAN, F.transform(F.sequence(F.lit(0), n - SPAN), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>"))


def _covered() -> Column:
    """Words inside windows whose hash occurs more than once: equal hashes meet in sorted order."""
    near = lambda i, d: F.get("sorted", i + d)["h"]
    twice = F.filter("sorted", lambda x, i: ((i > 0) & (near(i, -1) == x["h"])) | (near(i, 1) == x["h"]).eqNullSafe(True))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    first = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("total"))
    step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(SPAN), i - a["last"])).alias("total"))
    return F.aggregate(starts, first, step, lambda a: a["total"])


def measure(docs: DataFrame) -> DataFrame:
    """Measurements per document: words, their code points, symbols, capitals, lines, repeated lines and words."""
    t = F.col("text")
    words = texts(docs).select("doc_id", "text", F.filter(F.split(t, WORD_GAP), lambda w: w != "").alias("w"))
    hashed = words.select(
        "doc_id", F.size("w").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("wh"),
        F.length(_gone(t, " \t\n\x0b\f\r")).alias("word_chars"), (F.length(t) - F.length(_gone(t, "#*$%&|<>"))).alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("n_capitals"),
        F.transform(F.filter(F.split(t, "\n"), lambda x: _gone(x, " \t\x0b\f\r") != ""), lambda x: F.xxhash64(x)).alias("lines"))
    spans = hashed.withColumn("h", _windows(F.col("n_words")))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    # only texts with a repeated window are sorted
    pairs = F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = spans.withColumn("sorted", pairs)
    repeated = F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(_covered())
    return ordered.select("doc_id", *[F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_capitals")],
                          F.size("lines").cast("long").alias("n_lines"),
                          (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                          repeated.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``: bit i is set where rule i fails."""
    bits = F.lit(0)
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)))
    return measure(docs).withColumn("failed", bits)


def passes(policy: str = CURRENT) -> Column:
    """True where no rule of the policy has failed."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def verdicts(ledgers: DataFrame, policy: str = CURRENT) -> DataFrame:
    return ledgers.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy))


def ablations(ledgers: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: failures, and documents that only this rule keeps out.

    The documents collapse to one count per bit pattern (at most 2^rules) before anything is compared.
    """
    mask = POLICIES[policy]
    patterns = ledgers.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(BIT[k]).alias("bit")) for k, _ in RULES if BIT[k] & mask])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def filtered(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, with their own columns; each row is judged by its own text, so no join is needed."""
    own = docs.columns
    packed = docs.select(F.struct(*own).alias("doc_id"), "text")  # the whole row travels as the identifier
    # a filter would be pushed below the measurements and repeat them, a generator is not
    kept = F.filter(F.array("doc_id"), lambda _: passes(policy))
    return ledger(packed).select(F.explode(kept).alias("row")).select("row.*")
