"""Regime states: changes, durations, relabelling, transition matrices, forecasts, macro joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import same_keys
from .series import Series


def changes_and_durations(s: Series, state: str = "state") -> Series:
    """Change flag (0 on the first row) and length of the current run so far."""
    rl = s.rolling(1)
    rl.add({"_p": rl.lag(state)})
    rl.add({"regime_change": F.coalesce((F.col(state) != F.col("_p")).cast("int"), F.lit(0))})
    s = rl.series()
    starts = F.when(F.col("_p").isNull() | (F.col("regime_change") == 1), F.col("_rn"))
    s = s.scan({"_start": ("last", starts)})
    s = s.with_columns({"regime_duration": F.col("_rn") - F.col("_start") + 1})
    return Series(s.df.drop("_p", "_start"), s.keys, s.order, s.bucket)


def daily_statistics(states: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return states.groupBy(*keys, "state", F.to_date(ts).alias("date")).agg(
        F.count("*").alias("n"), F.avg("ret").alias("avg_return"), F.stddev_pop("ret").alias("return_std"),
        F.avg("confidence").alias("avg_confidence"), F.avg("regime_duration").alias("avg_duration"))


def emission_parameters(states: DataFrame, keys: list[str], n_states: int) -> DataFrame:
    """Mean and population deviation of the return per state; states never seen have zeros."""
    got = states.groupBy(*keys, "state").agg(F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"))
    every = states.select(*keys).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    return same_keys(every, got, [*keys, "state"], "left").na.fill(0.0, ["mean_return", "volatility"])


def relabel(states: DataFrame, keys: list[str], state: str = "state", ret: str = "ret", probabilities: str | None = None) -> DataFrame:
    """States renumbered by ascending mean return, equal means in old order.

    ``probabilities``, an array by state, follows; states that a key never takes stay behind the others in old order.
    """
    m = states.groupBy(*keys, state).agg(F.avg(ret).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_m", state)  # one row per state
    names = m.select(*keys, state, (F.row_number().over(w) - 1).alias("_new"))
    out = same_keys(states, names, [*keys, state])
    if probabilities:
        order = names.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_new", state))), lambda x: x[state]).alias("_order"))
        p = F.col(probabilities)
        taken = F.transform("_order", lambda i: F.get(p, i.cast("int")))
        rest = F.filter(p, lambda _, i: ~F.array_contains("_order", i.cast(dict(names.dtypes)[state])))
        out = same_keys(out, order, keys).withColumn(probabilities, F.concat(taken, rest)).drop("_order")
    return out.withColumn(state, F.col("_new")).drop("_new")


def transitions(s: Series, n_states: int, state: str = "state") -> DataFrame:
    """Long transition matrix per series: every (from, to) with count and row-normalised probability."""
    rl = s.rolling(1)
    rl.add({"from_state": rl.lag(state)})
    keys = list(s.keys)
    counts = rl.done().filter(F.col("from_state").isNotNull()).groupBy(*keys, "from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    ids = F.sequence(F.lit(0), F.lit(n_states - 1))
    every = s.df.select(*keys).distinct().withColumn("from_state", F.explode(ids)).withColumn("to_state", F.explode(ids))
    full = same_keys(every, counts, [*keys, "from_state", "to_state"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*keys, "from_state"))  # n_states rows
    return full.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def matrix_form(long: DataFrame, keys: list[str]) -> DataFrame:
    """Array of arrays, rows and columns in label order; a matrix has n_states squared entries."""
    rows = long.groupBy(*keys, "from_state").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("to_state", "p"))), lambda x: x["p"]).alias("_row"))
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("from_state", "_row"))), lambda x: x["_row"]).alias("transition_matrix"))


def forecast(start: Column, matrix: Column, steps: int, cap: int | None = None) -> Column:
    """Distribution after some bars; ``cap``, if given, ends the horizon."""
    n = F.size(start)
    step = lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.aggregate(
        F.zip_with(v, matrix, lambda a, row: a * row[j]), F.lit(0.0), lambda acc, x: acc + x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps if cap is None else min(steps, cap))), start, lambda v, _: step(v))


def matrix_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute difference of two long matrices."""
    cells = [*keys, "from_state", "to_state"]
    j = same_keys(a.select(*cells, F.col("p").alias("_a")), b.select(*cells, F.col("p").alias("_b")), cells)
    return j.groupBy(*keys).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_abs_diff"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], bucket: Mapping[str, Column], exact_then_fill: bool = False) -> DataFrame:
    """Latest right row at or before each left row.

    Both sides run as one series with the right side first at equal times, and the last values are carried
    forward by a block scan; no join on a range. ``exact_then_fill`` keeps only right rows that meet a left
    row of the same time before carrying forward.
    """
    r = right.select(*keys, ts, *values)
    if exact_then_fill:
        r = same_keys(r, left.select(*keys, ts).distinct(), [*keys, ts], "left_semi")
    both = left.withColumn("_side", F.lit(1)).unionByName(
        r.withColumnsRenamed({v: f"_r_{v}" for v in values}).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    s = Series.of(both, keys, [ts, "_side"], bucket)
    s = s.scan({v: ("last", F.when(F.col("_side") == 0, F.col(f"_r_{v}"))) for v in values})
    return s.result().filter("_side = 1").drop("_side", *(f"_r_{v}" for v in values))


def growth(s: Series, value: str, n: int = 12) -> DataFrame:
    """Change of a level series against ``n`` rows before."""
    rl = s.rolling(n)
    rl.add({f"{value}_growth": F.try_divide(F.col(value), rl.lag(value, n)) - 1})
    return rl.done()
