"""Fill-in-the-middle transformation by a pattern of counted units.

A unit is one code point. ``regexp_count`` gives how many a text has; two draws from a hash of doc_id give the cuts a <= b, and
each row gets a pattern of its own, ``(unit{a}+)(unit{b-a}+)(unit*+)``. Its groups are prefix, middle and suffix, so one match
per text builds the output. The counts are possessive: the match never steps back, and its work is linear in the text.

A null text is an empty one. Texts that are empty or hold one of the marks stay plain, so that an output can always be taken
apart again. A null doc_id draws as the empty name; equal doc_ids draw alike, and each row is cut on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"(?s:.)"
RUN = 4096  # units are counted in runs of so many, so that no row holds an entry for each of its units
SEED = 1
CUT_PERCENT, SPM_PERCENT = 90, 20

#: Where the groups 1 to 3 (prefix, middle, suffix) go, and patterns that take an output apart again.
FORWARD = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
BACK = {"psm": (rf"\A{PREFIX}({UNIT}*?){SUFFIX}({UNIT}*?){MIDDLE}({UNIT}*+)\z", "$1$3$2"),
        "spm": (rf"\A{SUFFIX}({UNIT}*?){PREFIX}({UNIT}*?){MIDDLE}({UNIT}*+)\z", "$2$3$1")}


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def replaced(text: Column, pattern: str | Column, by: str | Column) -> Column:
    """``regexp_replace`` with a pattern and a replacement of each row's own."""
    return F.call_function("regexp_replace", text, _text(pattern), _text(by))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, text, n, form (plain, psm or spm), a and b (where prefix and middle end; null if plain), output."""
    h1, h2, h3, h4 = (F.col(f"h{i}") for i in range(1, 5))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    runs = F.regexp_count("text", F.lit(f"{UNIT}{{{RUN}}}+"))
    rest = F.substring(F.col("text"), F.col("runs") * RUN + 1, F.lit(RUN))
    cut = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    rows = (
        texts(docs)
        .withColumn("runs", runs)
        .withColumn("n", (F.col("runs") * RUN + F.regexp_count(rest, F.lit(UNIT))).cast("long"))
        .withColumns({f"h{i + 1}": h for i, h in enumerate(draws(F.col("doc_id"), seed))})
        .withColumn("form", F.when((F.col("n") == 0) | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
        .withColumn("x", h1 % (F.col("n") + 1))
        .withColumn("y", h2 % (F.col("n") + 1))
        .select("doc_id", "text", "n", "form", cut(F.least("x", "y")).alias("a"), cut(F.greatest("x", "y")).alias("b"))
    )
    pattern = F.format_string(rf"\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)({UNIT}*+)\z", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "spm", FORWARD["spm"]).otherwise(FORWARD["psm"])
    return rows.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(replaced(F.col("text"), pattern, order)))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made of; only output and form are read."""
    by_form = F.when(form == "plain", output)
    for name, (pattern, order) in BACK.items():
        by_form = by_form.when(form == name, replaced(output, pattern, order))
    return by_form
