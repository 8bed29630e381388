"""Tool calls of conversations: linked, ordered, checked and serialised (DataFrame and SQL functions only).

``link`` joins calls and results by conversation and identifier, ``levels`` orders the calls topologically (a call stands one
level above the call whose result it follows), ``errors`` checks arguments against the tools' schemas, and ``records`` writes
one canonical JSON text per call: keys in order, no blanks.

Rows that share an identifier are one call (the earliest turn, then the least arguments) with their number in ``copies``; results
likewise. Calls without a result and results without a call stay, marked by ``state``. Calls and results without conversation or
identifier cannot be linked: each row stays as ``no id`` (a result has no turn, errors or copies of a call). Arguments that are no JSON object fail with ``not an object``. A parent that
does not exist ends the chain; calls on or behind a cycle get no level. Other columns stay behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fxspark.llm.common import stored

KEY = ["conv_id", "call_id"]

#: Types of JSON schemas, as the types of parsed values.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


# ---- checks

def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _property(v: Column, name: str, rule: dict, required: bool) -> list[Column]:
    value = F.variant_get(v, f"$['{name}']", "variant")
    kind = _kind(value)
    missing = value.isNull()
    out = [F.when(missing, F.lit(f"{name} is missing"))] if required else []
    right = F.lit(True)
    if "type" in rule:
        right = kind.isin(*TYPES[rule["type"]])
        out.append(F.when(~missing & ~right, F.lit(f"{name} is not of type {rule['type']}")))
    typed = ~missing & right
    if "minLength" in rule or "maxLength" in rule:
        n = F.length(F.try_variant_get(v, f"$['{name}']", "string"))
        out.append(F.when(typed & ((n < rule.get("minLength", 0)) | (n > rule.get("maxLength", 1 << 30))), F.lit(f"{name} has a wrong length")))
    if "minimum" in rule or "maximum" in rule:
        x = F.try_variant_get(v, f"$['{name}']", "double")
        out.append(F.when(typed & ((x < rule.get("minimum", float("-inf"))) | (x > rule.get("maximum", float("inf")))), F.lit(f"{name} is out of range")))
    if "enum" in rule:
        out.append(F.when(typed & ~F.try_variant_get(v, f"$['{name}']", "string").isin(*rule["enum"]), F.lit(f"{name} is none of the choices")))
    return out


def errors(name: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """Messages of a call's failed checks, in the schema's order."""
    none = F.array().cast("array<string>")
    out = F.when(~name.isin(*schemas) | name.isNull(), F.array(F.lit("unknown tool")))
    out = out.when(parsed.isNull() | (_kind(parsed) != "OBJECT"), F.array(F.lit("not an object")))
    for tool, schema in schemas.items():
        found = [c for p, rule in schema.get("properties", {}).items() for c in _property(parsed, p, rule, p in schema.get("required", []))]
        if schema.get("additionalProperties") is False:
            keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string, variant>"))
            extra = F.array_except(keys, F.array(*[F.lit(p) for p in schema.get("properties", {})]).cast("array<string>"))
            found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown arguments: "), F.array_join(F.array_sort(extra), ", "))))
        out = out.when(name == tool, F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none)
    return F.coalesce(out, none)


# ---- links and order

def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, turn, name, arguments, parent_id) with results (conv_id, call_id, turn, content)."""
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.filter(whole).groupBy(*KEY).agg(F.min(F.struct("turn", "arguments", "name", "parent_id")).alias("c"), F.count("*").alias("copies"))
    answer = results.filter(whole).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"))
    both = first.hint("shuffle_hash").join(answer, KEY, "full")
    state = F.when(F.col("c").isNull(), "no call").when(F.col("r").isNull(), "no result").otherwise("linked")
    linked = both.select(*KEY, "c.turn", "c.name", "c.arguments", "c.parent_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"),
                         F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), state.alias("state"))
    loose = calls.filter(~whole).select(*KEY, "turn", "name", "arguments", "parent_id", F.lit(None).cast("long").alias("result_turn"),
                                        F.lit(None).cast("string").alias("result"), F.lit(1).cast("long").alias("copies"), F.lit("no id").alias("state"))
    lost = results.filter(~whole).select(*KEY, F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("name", "arguments", "parent_id")],
                                         F.col("turn").alias("result_turn"), F.col("content").alias("result"), F.lit(0).cast("long").alias("copies"), F.lit("no id").alias("state"))
    return linked.unionByName(loose).unionByName(lost)


def levels(linked: DataFrame) -> DataFrame:
    """conv_id, call_id and ``level`` of every call with an identifier, by pointer jumping: each round doubles the distance known.

    Long chains take as many rounds as their length has binary digits, and each round joins by call, not by conversation.
    """
    calls = linked.filter(F.col("state").isin("linked", "no result"))
    own = stored(calls.select(*KEY, "parent_id"), "calls")
    n = own.count()
    ids = own.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"))
    known = own.join(ids, (F.col("conv_id") == F.col("c")) & (F.col("parent_id") == F.col("p")), "left")
    now = known.select(*KEY, F.col("p").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("level"))
    for _ in range(n.bit_length() + 1):
        now = stored(now, "levels")
        if now.filter("up is not null").isEmpty():
            break
        above = now.select(F.col("conv_id").alias("c"), F.col("call_id").alias("p"), F.col("up").alias("next"), F.col("level").alias("more"))
        joined = now.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("p")), "left")
        now = joined.select(*KEY, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))  # a pointer is left only on cycles


def records(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call: state, level, errors and the canonical JSON ``record``."""
    linked = stored(link(calls, results), "linked")
    placed = linked.join(levels(linked), KEY, "left")
    parsed = placed.withColumn("parsed", F.try_parse_json("arguments"))
    checked = parsed.withColumn("errors", F.when(F.col("copies") > 0, errors(F.col("name"), F.col("parsed"), schemas)))
    body = F.struct(F.col("parsed").alias("arguments"), F.col("call_id"), F.col("level"), F.col("name"), F.col("parent_id"), F.col("result"))
    return checked.select(*KEY, "turn", "result_turn", "state", "copies", "level", "errors", F.to_json(body).alias("record"))


# ---- plain conversations

#: A question is a call of this tool.
SCHEMAS = {"answer": {"required": ["prompt", "turn"], "additionalProperties": False,
                      "properties": {"prompt": {"type": "string", "minLength": 20, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn is a call, the assistant's turn after it the result.

    A call follows the result that stands just before it. Turns of other roles (system, null) are neither. Identifiers are built from turn numbers, so no conversation has
    to be gathered in one place.
    """
    named = lambda t: F.concat(F.lit("call-"), t.cast("string"))
    t = F.col("turn")
    user, assistant = turns.filter("role = 'user'"), turns.filter("role = 'assistant'")
    arguments = F.to_json(F.struct(t.alias("turn"), F.coalesce("text", F.lit("")).alias("prompt")))
    calls = user.select("conv_id", named(t).alias("call_id"), "turn", F.lit("answer").alias("name"), arguments.alias("arguments"), F.when(t >= 2, named(t - 2)).alias("parent_id"))
    results = assistant.select("conv_id", named(t - 1).alias("call_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    return calls, results
