"""Ordered scans over keys of any size.

Many operators walk a key's rows in order: previous row, running sum, last
value seen. A plain window puts a whole key into one task. Here a key above a
row limit is cut into consecutive slices of its order. Windows run per slice,
and the few per-slice totals (one row per slice) carry the state across.
Keys below the limit keep the plain window plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.sizing import require_table, staged

# Rows of one key in one task. A walk may hold its probes as well and sorts and buffers them, some 400 bytes a row.
ROWS_PER_TASK = 500_000
# Bounds and carries are one row per slice, so this bounds what is broadcast.
MAX_SLICES = 65_536
SAMPLES_PER_SLICE = 8

SLICE = "__slice"
HOT = "__hot"
BOUNDS = "__bounds"


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [l.eqNullSafe(r) for l, r in zip(left, right)])


@dataclass(frozen=True)
class Slicer:
    """Slice bounds of the hot keys of one (keys, order) pair."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    bounds: DataFrame | None
    total: int
    largest: int
    limit: int
    most_bounds: int = 0

    @classmethod
    def plan(
        cls, df: DataFrame, keys: list[str], order: list[str], rows_per_task: int | None = None, hot_above: int = 0,
    ) -> Slicer:
        """Count rows per key; for keys above the limit, sample slice bounds.

        Keys of up to ``hot_above`` rows are not cut either, whatever the limit.

        ``order`` must identify a row within its key, else equal rows can not
        be separated.
        """
        require_table(df)
        counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
        row = counts.agg(F.sum("__n").alias("total"), F.max("__n").alias("largest")).first()
        total, largest = row["total"] or 0, row["largest"] or 0
        limit = max(rows_per_task or ROWS_PER_TASK, total // MAX_SLICES)
        if largest <= max(limit, hot_above):
            return cls(tuple(keys), tuple(order), None, total, largest, limit)

        # Hot keys: at most total / limit <= MAX_SLICES rows.
        hot = counts.filter(F.col("__n") > max(limit, hot_above))
        hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
        step = max(1, limit // SAMPLES_PER_SLICE)
        thin = limit // step
        sample = df.filter(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).join(
            F.broadcast(hot), _same([F.col(k) for k in keys], [F.col(f"__h_{k}") for k in keys]), "left_semi"
        )
        # Expected sample of one key: SAMPLES_PER_SLICE * MAX_SLICES structs at most.
        listed = sample.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("__s"))
        bounds = listed.select(
            *[F.col(k).alias(f"__b_{k}") for k in keys],
            F.expr(f"filter(__s, (x, i) -> i % {thin} = {thin - 1})").alias(BOUNDS),
        )
        bounds = staged(bounds)
        most = bounds.agg(F.max(F.size(BOUNDS)).alias("n")).first()["n"] or 0
        return cls(tuple(keys), tuple(order), bounds, total, largest, limit, most)

    @property
    def hot(self) -> bool:
        return self.bounds is not None

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the slice number and the hot mark; rows of other keys get -1."""
        if self.bounds is None:
            return df
        joined = df.join(
            F.broadcast(self.bounds),
            _same([F.col(k) for k in self.keys], [F.col(f"__b_{k}") for k in self.keys]),
            "left",
        )
        # Binary search, one plain projection per step: how many bounds are <= here.
        joined = joined.withColumns(
            {HOT: F.col(BOUNDS).isNotNull(), "__here": F.struct(*self.order), "__at": F.lit(0)}
        )
        for power in reversed(range(self.most_bounds.bit_length())):
            step = 1 << power
            passed = F.get(F.col(BOUNDS), F.col("__at") + (step - 1)) <= F.col("__here")
            joined = joined.withColumn("__at", F.when(passed, F.col("__at") + step).otherwise(F.col("__at")))
        # Filters use HOT: pushed below the steps, a test of SLICE would repeat them all.
        number = F.when(F.col(HOT), F.col("__at")).otherwise(-1)
        return joined.withColumn(SLICE, number).drop(BOUNDS, "__here", "__at", *[f"__b_{k}" for k in self.keys])


@dataclass(frozen=True)
class OrderedScan:
    """A DataFrame walked in order within its keys.

    Each method returns a new scan with more columns. ``descending`` walks the
    same slices from the end.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool
    descending: bool = False

    @classmethod
    def open(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        slicer: Slicer | None = None,
        rows_per_task: int | None = None,
    ) -> OrderedScan:
        slicer = slicer or Slicer.plan(df, keys, order, rows_per_task)
        return cls(slicer.attach(df), tuple(keys), tuple(order), slicer.hot)

    def reversed(self) -> OrderedScan:
        return replace(self, descending=not self.descending)

    def with_df(self, df: DataFrame) -> OrderedScan:
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE, HOT)

    def _direction(self, names) -> list[Column]:
        return [F.col(n).desc() if self.descending else F.col(n).asc() for n in names]

    @property
    def window(self):
        part = [*self.keys, SLICE] if self.sliced else list(self.keys)
        return Window.partitionBy(*part).orderBy(*self._direction(self.order))

    @property
    def _running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _with_carry(self, totals: dict[str, Column], across) -> DataFrame:
        """Join, per name, the state carried in from the slices before a hot row's own.

        ``totals`` are aggregates of one slice; ``across`` combines those of the
        slices before. There is one row per slice and at most 2 * MAX_SLICES
        slices, so the carry table is broadcast.
        """
        hot = self.df.filter(F.col(HOT))
        per_slice = hot.groupBy(*self.keys, SLICE).agg(*[a.alias(f"__v_{n}") for n, a in totals.items()])
        walk = Window.partitionBy(*self.keys).orderBy(*self._direction([SLICE]))
        carry = per_slice.select(
            *[F.col(k).alias(f"__c_{k}") for k in self.keys],
            F.col(SLICE).alias("__c_slice"),
            *[across(f"__v_{n}", walk).alias(f"__carry_{n}") for n in totals],
        )
        match = _same(
            [F.col(k) for k in self.keys] + [F.col(SLICE)],
            [F.col(f"__c_{k}") for k in self.keys] + [F.col("__c_slice")],
        )
        joined = self.df.join(F.broadcast(staged(carry)), match, "left")
        return joined.drop("__c_slice", *[f"__c_{k}" for k in self.keys])

    def _latest(self, value: Column, when: Column) -> Column:
        pick = F.min_by if self.descending else F.max_by
        return pick(F.when(when, value), F.when(when, F.struct(*self.order)))

    def _finish(self, df: DataFrame, values: dict[str, Column], carried) -> OrderedScan:
        df = df.withColumns({n: v for n, v in values.items()})
        return self.with_df(df.drop(*[f"__carry_{n}" for n in carried]))

    def lag(self, **exprs: Column) -> OrderedScan:
        """Values of the previous row; null on a key's first row."""
        if not self.sliced:
            return self.with_df(self.df.withColumns({n: F.lag(e).over(self.window) for n, e in exprs.items()}))
        packed = F.struct(*[e.alias(n) for n, e in exprs.items()])
        df = self._with_carry(
            {"lag": self._latest(packed, F.lit(True))}, lambda v, walk: F.lag(v).over(walk)
        )
        df = df.withColumn("__lag", F.coalesce(F.lag(packed).over(self.window), F.col("__carry_lag")))
        scan = self._finish(df, {n: F.col("__lag").getField(n) for n in exprs}, ["lag"])
        return scan.with_df(scan.df.drop("__lag"))

    def running_sum(self, **exprs: Column) -> OrderedScan:
        """Inclusive running sums (rows, not ties)."""
        local = {n: F.sum(e).over(self._running) for n, e in exprs.items()}
        if not self.sliced:
            return self.with_df(self.df.withColumns(local))
        df = self._with_carry(
            {n: F.sum(e) for n, e in exprs.items()},
            lambda v, walk: F.sum(v).over(walk.rowsBetween(Window.unboundedPreceding, -1)),
        )
        return self._finish(
            df, {n: v + F.coalesce(F.col(f"__carry_{n}"), F.lit(0)) for n, v in local.items()}, exprs
        )

    def last(self, **exprs: Column) -> OrderedScan:
        """The last non-null value up to and including each row."""
        local = {n: F.last(e, ignorenulls=True).over(self._running) for n, e in exprs.items()}
        if not self.sliced:
            return self.with_df(self.df.withColumns(local))
        df = self._with_carry(
            {n: self._latest(e, e.isNotNull()) for n, e in exprs.items()},
            lambda v, walk: F.last(v, ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1)),
        )
        return self._finish(df, {n: F.coalesce(v, F.col(f"__carry_{n}")) for n, v in local.items()}, exprs)

    def number(self, name: str) -> OrderedScan:
        """Row number from 1 within the key."""
        if not self.sliced:
            return self.with_df(self.df.withColumn(name, F.row_number().over(self.window).cast("long")))
        return self.running_sum(**{name: F.lit(1).cast("long")})
