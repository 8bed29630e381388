"""Ordered series split into bounded blocks.

A plain ``Window.partitionBy(symbol)`` puts a whole series into one task. When one symbol
holds a large share of all rows that task decides the run time of the job. The classes here
cut every series into blocks of bounded size and express

* running values (sum, count, max, last non-null, next non-null) as a scan inside each block plus
  a carry taken from a table with one row per block,
* exponential averages as affine maps of blocks, chained over the same table, and
* rolling windows of at most ``lookback`` rows by copying the tail of each block into the next one,

so the number of tasks follows the number of rows, not the number of keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)
BLOCK_ROWS = 4096
LIFT = 600.0  # weights inside a block span at most exp(LIFT)
STRETCH = 300.0  # a sum along the blocks reaches back by exp(-STRETCH) at least


@dataclass(frozen=True)
class Series:
    """Rows of one or many series with their order and an order-preserving bucket.

    ``bucket`` names columns that grow with ``order`` and bound the rows of one (key, bucket):
    for bars the calendar day (at most 1440 minutes), for numbered rows ``id div 4096``.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    bucket: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, keys, order, bucket: Mapping[str, Column]) -> "Series":
        keys = tuple(keys)
        if not keys:
            df, keys = df.withColumn("_all", F.lit(0)), ("_all",)
        return cls(df.withColumns(dict(bucket)), keys, tuple(order), tuple(bucket))

    @classmethod
    def by_day(cls, df: DataFrame, keys, ts: str = "ts") -> "Series":
        """Series whose (key, ts) is unique at minute grain or coarser."""
        return cls.of(df, keys, [ts], {"_day": F.to_date(ts)})

    @classmethod
    def by_month(cls, df: DataFrame, keys, ts: str) -> "Series":
        """Series whose (key, ts) is unique at hour grain or coarser."""
        return cls.of(df, keys, [ts], {"_month": F.date_trunc("month", F.col(ts).cast("timestamp"))})

    @classmethod
    def by_id(cls, df: DataFrame, keys, id_col: str) -> "Series":
        """Series ordered by a unique whole number."""
        return cls.of(df, keys, [id_col], {"_slab": F.floor(F.col(id_col) / BLOCK_ROWS)})

    def with_columns(self, cols: Mapping[str, Column]) -> "Series":
        return replace(self, df=self.df.withColumns(dict(cols)))

    def result(self) -> DataFrame:
        return self.df.drop("_part", *self.bucket, *(k for k in self.keys if k == "_all"))

    def parted(self) -> "Series":
        """With ``_part``, one value per key and bucket. It stays, so that scans and averages share one shuffle.

        A struct of NULLs equals itself, so rows without a key or a time keep their block.
        """
        if "_part" in self.df.columns:
            return self
        return replace(self, df=self.df.withColumn("_part", F.struct(*self.keys, *self.bucket)))

    # -- running values ----------------------------------------------------------------

    def scan(self, specs: Mapping[str, tuple[str, Column]]) -> "Series":
        """Add running values; each spec is ``name: (kind, expression)``.

        Kinds: ``sum``, ``count`` (rows where the expression is not NULL), ``max``, ``min``,
        ``last`` (latest non-null so far) and ``next`` (nearest non-null at or after the row).
        """
        df = self.parted().df.withColumns({f"_x_{n}": e for n, (_, e) in specs.items()})
        place = F.struct(*self.order)

        totals, carries = [], []
        by_block = Window.partitionBy(*(f"_part.{k}" for k in self.keys)).orderBy(*(f"_part.{b}" for b in self.bucket))
        before = by_block.rowsBetween(Window.unboundedPreceding, -1)
        after = by_block.rowsBetween(1, Window.unboundedFollowing)
        for n, (kind, _) in specs.items():
            x, t = F.col(f"_x_{n}"), f"_t_{n}"
            seen = F.when(x.isNotNull(), place)
            total, carry = {
                "sum": (F.sum(x), F.sum(t).over(before)),
                "count": (F.count(x), F.sum(t).over(before)),
                "max": (F.max(x), F.max(t).over(before)),
                "min": (F.min(x), F.min(t).over(before)),
                "last": (F.max_by(x, seen), F.last(t, ignorenulls=True).over(before)),
                "next": (F.min_by(x, seen), F.first(t, ignorenulls=True).over(after)),
            }[kind]
            totals.append(total.alias(t))
            carries.append(carry.alias(f"_c_{n}"))
        blocks = df.groupBy("_part").agg(*totals).select("_part", *carries)

        inside = Window.partitionBy("_part").orderBy(*self.order)
        run = inside.rowsBetween(*ALL_BEFORE)
        rest = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        joined = df.join(blocks, "_part")
        local = {}
        for n, (kind, _) in specs.items():
            x = F.col(f"_x_{n}")
            local[f"_l_{n}"] = {
                "sum": F.sum(x).over(run),
                "count": F.count(x).over(run),
                "max": F.max(x).over(run),
                "min": F.min(x).over(run),
                "last": F.last(x, ignorenulls=True).over(run),
                "next": F.first(x, ignorenulls=True).over(rest),
            }[kind]
        joined = joined.withColumns(local)
        out = {}
        for n, (kind, _) in specs.items():
            here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
            both = here.isNotNull() & carry.isNotNull()
            out[n] = {
                "sum": F.when(both, here + carry).otherwise(F.coalesce(here, carry)),
                "count": here + F.coalesce(carry, F.lit(0)),
                # structs have no greatest/least, so the comparison is spelled out
                "max": F.when(both & (carry > here), carry).otherwise(F.coalesce(here, carry)),
                "min": F.when(both & (carry < here), carry).otherwise(F.coalesce(here, carry)),
                "last": F.coalesce(here, carry),
                "next": F.coalesce(here, carry),
            }[kind]
        helpers = [f"{p}{n}" for n in specs for p in ("_x_", "_l_", "_c_")]
        return replace(self, df=joined.withColumns(out).drop(*helpers))

    def number(self, name: str = "_rn") -> "Series":
        """Dense row number from 1 along each series."""
        return self.scan({name: ("count", F.lit(1))})

    # -- rolling windows ---------------------------------------------------------------

    def rolling(self, lookback: int, block: int | None = None, numbered: bool = False) -> "Rolling":
        """Blocks of ``block`` rows, each preceded by a copy of the ``lookback`` rows before it."""
        s = self if numbered else self.number()
        block = block or max(BLOCK_ROWS, 4 * lookback)
        if lookback > block:
            raise ValueError("lookback must not exceed the block size")
        own = F.floor((F.col("_rn") - 1) / block)
        pos = (F.col("_rn") - 1) % block
        df = s.df.withColumn("_own", own).withColumn(
            "_blk",
            F.explode(
                F.when(pos >= block - lookback, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
            ),
        )
        return Rolling(df, s.keys, s.bucket, s)

    # -- exponential averages ----------------------------------------------------------

    def ema(self, specs: Mapping[str, tuple[str, int, bool]]) -> "Series":
        """Exponential averages; each spec is ``name: (column, span, adjust)``.

        A NULL keeps the average and ages the values before it by one more row, as in pandas; before the first value there is
        none. Inside a block (a bucket, or the part of it whose weights stay within a double) the average is a sum of lifted
        values; a block as a whole is an affine map of the average in front of it. :func:`_chained` runs the maps of all
        averages along the blocks, and their results come back to the rows by one join.
        """
        s = self.parted()
        x = lambda c: F.col(c).cast("double")
        moving = {n: (c, 1.0 - 2.0 / (span + 1.0), adjust) for n, (c, span, adjust) in specs.items() if span > 1}
        if not moving:
            return s.with_columns({n: F.col(c) for n, (c, _, _) in specs.items()})
        block = math.floor(LIFT / -math.log(min(q for _, q, _ in moving.values())))
        row = F.row_number().over(Window.partitionBy("_part").orderBy(*s.order)) - 1
        df = s.df.withColumn("_ei", row).withColumns({"_sub": F.floor(F.col("_ei") / block), "_ei": (F.col("_ei") % block).cast("double")})
        w = Window.partitionBy("_part", "_sub").orderBy(*s.order)
        run, before = w.rowsBetween(*ALL_BEFORE), w.rowsBetween(Window.unboundedPreceding, -1)
        plain = dict.fromkeys(c for c, _, adjust in moving.values() if not adjust)
        at = {c: F.when(F.col(c).isNotNull(), F.col("_ei")) for c in plain}
        total = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0.0))
        fall = {n: F.pow(F.lit(q), F.col("_ei")) for n, (_, q, _) in moving.items()}
        # what a block makes of its own rows alone
        df = df.withColumns({f"_s_{c}": F.last(at[c], ignorenulls=True).over(before) for c in plain} | {f"_f_{c}": F.first(at[c], ignorenulls=True).over(run) for c in plain})
        factor, local, last = {}, {}, [F.count("*").alias("_rows")]
        for c in plain:
            last += [F.min_by(x(c), at[c]).alias(f"_tx_{c}"), F.min(at[c]).alias(f"_tf_{c}"), F.max(at[c]).alias(f"_tr_{c}")]
        for n, (c, q, adjust) in moving.items():
            if adjust:
                lift = F.pow(F.lit(1.0 / q), F.col("_ei"))
                local |= {f"_n_{n}": total(x(c) * lift) * fall[n], f"_d_{n}": total(F.when(F.col(c).isNotNull(), lift)) * fall[n]}
            else:
                u = F.pow(F.lit(q), F.col("_ei") - F.col(f"_s_{c}"))
                inner = F.col(c).isNotNull() & F.col(f"_s_{c}").isNotNull()
                factor[f"_a_{n}"] = F.when(inner, F.ln(u / (u + (1 - q))))
                factor[f"_u_{n}"] = F.when(inner, x(c) * ((1 - q) / (u + (1 - q))))
                local |= {f"_l_{n}": total(f"_a_{n}"), f"_m_{n}": F.col(f"_u_{n}")}
        df = df.withColumns(factor).withColumns(local)
        df = df.withColumns({f"_m_{n}": F.exp(f"_l_{n}") * total(F.col(f"_m_{n}") * F.exp(-F.col(f"_l_{n}"))) for n, (_, _, adjust) in moving.items() if not adjust})
        # one pass makes them: the maps of the blocks and the rows below both read what is stored
        df = kept(df.drop(*factor, *(f"_s_{c}" for c in plain)), "averages")
        carries = _chained(df.groupBy("_part", "_sub").agg(*last, *(F.max_by(c, "_ei").alias(f"_t{c}") for c in local)), s.keys, s.bucket, moving)
        carried = lambda state, what: F.get(f"_carry_{state}", F.col("_sub").cast("int"))[what]
        full = {}
        for n, (c, q, adjust) in moving.items():
            if adjust:
                sides = [F.col(f"_{k}_{n}") + carried(f"{k}_{n}", "y") * fall[n] * q for k in "nd"]
                full[n] = F.when(sides[1] > 0, sides[0] / sides[1])
            else:
                inside = F.exp(f"_l_{n}") * carried(f"y_{n}", "first") + F.col(f"_m_{n}")
                full[n] = F.when(F.col(f"_f_{c}").isNull(), carried(f"y_{n}", "y")).otherwise(inside)
        helpers = ["_sub", "_ei", *(f"_f_{c}" for c in plain), *local, *(c for c in carries.columns if c != "_part")]
        res = df.join(carries, "_part").withColumns(full).drop(*helpers)
        return replace(s, df=res.withColumns({n: F.col(c) for n, (c, span, _) in specs.items() if span <= 1}))


def _chained(blocks: DataFrame, keys: tuple[str, ...], bucket: tuple[str, ...], moving: Mapping[str, tuple[str, float, bool]]) -> DataFrame:
    """For each bucket and state an array over its blocks: the average in front of the block and that at its first value.

    Each block maps a state y to ``exp(-d) y + b``. With D, the sum of d so far, the state in front of a block is the sum over the
    blocks before it of ``b exp(-(D_here - D_there))``. To stay within doubles the sum is taken in stretches of D: a stretch also holds
    a copy of the one before it, and what lies further back weighs less than exp(-``STRETCH``). All states are rows of one table, so
    that the number of windows does not depend on how many averages there are. A window sees a row for each block of a series.
    """
    of, when = [f"_k_{k}" for k in keys], [*(f"_b_{b}" for b in bucket), "_sub"]
    df = blocks.withColumns({f"_k_{k}": F.col(f"_part.{k}") for k in keys} | {f"_b_{b}": F.col(f"_part.{b}") for b in bucket})
    earlier = Window.partitionBy(*of).orderBy(*when).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_n0", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    plain = dict.fromkeys(c for c, _, adjust in moving.values() if not adjust)
    if plain:
        df = df.withColumns({f"_g_{c}": F.last(F.col("_n0") + F.col(f"_tr_{c}"), ignorenulls=True).over(earlier) for c in plain})
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    states = []
    for n, (c, q, adjust) in moving.items():
        if adjust:
            states += [(f"{k}_{n}", F.col("_rows") * -math.log(q), F.col(f"_t_{k}_{n}"), none, none, F.lit(True)) for k in "nd"]
            continue
        u = F.pow(F.lit(q), F.col("_n0") + F.col(f"_tf_{c}") - F.col(f"_g_{c}"))  # the first value is so many rows behind the last one before
        share, first, grown = u / (u + (1 - q)), F.col(f"_tx_{c}"), F.exp(f"_t_l_{n}")
        old, any_ = F.col(f"_g_{c}").isNotNull(), F.col(f"_tf_{c}").isNotNull()
        d = F.when(any_ & old, -F.col(f"_t_l_{n}") - F.ln(share)).otherwise(zero)
        b = F.when(any_, grown * first * F.when(old, 1 - share).otherwise(1.0) + F.col(f"_t_m_{n}")).otherwise(zero)
        states.append((f"y_{n}", d, b, F.when(any_ & old, share), first, old))
    each = [F.struct(F.lit(name).alias("state"), d.alias("d"), b.alias("b"), a.alias("a"), x.alias("x"), known.alias("known")) for name, d, b, a, x, known in states]
    # the state in front of a block comes from the rows before it
    by_state = Window.partitionBy(*of, "state").orderBy(*when)
    long = df.select("_part", *of, *when, F.inline(F.array(*each)))
    long = long.withColumns({"at": F.coalesce(F.sum("d").over(by_state.rowsBetween(Window.unboundedPreceding, -1)), zero), "b": F.coalesce(F.lag("b").over(by_state), zero)})
    long = long.withColumn("own", F.floor(F.col("at") / STRETCH)).withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    inside = Window.partitionBy(*of, "state", "stretch").orderBy(*when).rowsBetween(*ALL_BEFORE)
    rise = F.col("at") - (F.col("stretch") - 1) * STRETCH
    long = long.withColumn("y", F.sum(F.col("b") * F.exp(rise)).over(inside) * F.exp(-rise)).filter("stretch = own")
    y = F.when(F.col("known"), F.col("y"))
    found = F.struct("_sub", y.alias("y"), F.when(F.col("a").isNull(), F.col("x")).otherwise(F.col("a") * y + (1 - F.col("a")) * F.col("x")).alias("first"))
    return long.groupBy("_part").agg(*(F.array_sort(F.collect_list(F.when(F.col("state") == name, found))).alias(f"_carry_{name}") for name, *_ in states))


@dataclass
class Rolling:
    """Blocks with copied tails; ``add`` columns over ``w``, then ``done``."""

    df: DataFrame
    keys: tuple[str, ...]
    bucket: tuple[str, ...]
    source: Series = field(repr=False)
    waiting: dict[str, Column] = field(default_factory=dict)

    @property
    def w(self):
        return Window.partitionBy(*self.keys, "_blk").orderBy("_rn")

    def rows(self, n: int, end: int = 0):
        """Frame of ``n`` rows ending ``end`` rows before (negative) or at the current one."""
        return self.w.rowsBetween(end - n + 1, end)

    def full(self, agg: Callable[[str], Column], col: str, n: int, end: int = 0) -> Column:
        """``agg`` of a column over ``n`` rows, NULL unless all of them have a value."""
        frame = self.rows(n, end)
        return F.when(F.count(col).over(frame) == n, agg(col).over(frame))

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def prev(self, name: str) -> Column:
        """Value of a column on the row before, shared by all users; :meth:`flush` adds it."""
        self.waiting[f"_prev_{name}"] = self.lag(name)
        return F.col(f"_prev_{name}")

    def flush(self) -> "Rolling":
        """Add what waits, all at once."""
        cols, self.waiting = self.waiting, {}
        return self.add(cols) if cols else self

    def add(self, cols: Mapping[str, Column]) -> "Rolling":
        self.df = self.df.withColumns(dict(cols))
        return self

    def done(self) -> DataFrame:
        return self.series().result().drop("_rn")

    def series(self) -> Series:
        """Back to one copy of every row, still numbered by ``_rn``."""
        df = self.df.filter(F.col("_own") == F.col("_blk")).drop("_own", "_blk", *(c for c in self.df.columns if c.startswith("_prev_")))
        return replace(self.source, df=df)
