"""Anchored windows: the shared kernel of suppression, rate control and anchored counts.

Walking a key's rows in time order, the first row opens a window; the next
window opens at the first row at least ``width`` after the previous opening
(``strict``: more than ``width`` after). The opening times are the *leaders*.

Leaders depend only on a key's times, so they are found on (key, time) alone:

* keys of up to ``FOLD_ROWS`` rows: rows closer than ``width`` to their
  session's start can not open a window, the rest are folded in order on the JVM;
* larger keys that still fit one task: a sorted Arrow scan with constant state,
  for the fold copies its list at each opening, which grows with the square;
* hot keys: every time points at the first time one ``width`` later, and
  pointer doubling marks the chain in about log2(windows) distributed joins.

Leaders of a key are at least ``width`` apart, so a grid cell of that length
holds one at most, and a row's window opened in its own cell or the one before.
Rows therefore meet their window in an equi-join on (key, cell). If the leaders
are few they are broadcast and the wide rows are not shuffled at all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import field, floor_div, micros
from tidelog.plans.ordered import HOT, ROWS_PER_TASK, SLICE, OrderedScan, Slicer
from tidelog.plans.sizing import maybe_broadcast, require_table, staged

FOLD_ROWS = 4_096

# Distinct times of a key that the Arrow scan sorts in one task, some 100 bytes each.
SCAN_ROWS = 4_000_000

# Spark prunes row_number() <= n per task before the shuffle up to this n.
GROUP_LIMIT = 1000

TIME = "__t"
KIND = "__kind"
WIDTH = "__width"
WINDOW_START = "__window_start"

ORDER = [TIME, KIND]


def _match(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def anchored_windows(
    df: DataFrame,
    keys: list[str],
    ts: str,
    width_us: int | Column,
    *,
    strict: bool = False,
    origin_us: int | None = None,
    rows_per_task: int | None = None,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Add ``__t`` and ``__window_start`` (microseconds) to each row that has a time.

    ``width_us`` may be a column that is constant within a key. ``origin_us``
    opens the first window of each key at that time instead of at its first row;
    no row may be earlier.
    """
    require_table(df)
    if isinstance(width_us, int):
        if width_us <= 0:
            raise ValueError("window must be positive")
        width_us = F.lit(width_us)
    width = (width_us + 1 if strict else width_us).cast("long")
    time = micros(ts)
    if origin_us is not None:
        early = F.raise_error(F.lit("anchored windows: a row is earlier than the origin")).cast("long")
        time = F.when(time < origin_us, early).otherwise(time)
    base = df.filter(field(ts).isNotNull()).withColumns({TIME: time, WIDTH: width})

    opened = staged(leaders(base.select(*keys, TIME, WIDTH), keys, origin_us, rows_per_task, fold_rows))
    # Each leader serves its own cell and, as the one before, the next cell.
    cell = floor_div(F.col(TIME), F.col(WIDTH))
    served = opened.select(
        *[F.col(k).alias(f"__w_{k}") for k in keys],
        F.explode(F.array(
            F.struct(cell.alias("cell"), F.col(TIME).alias("here"), F.lit(None).cast("long").alias("before")),
            F.struct((cell + 1).alias("cell"), F.lit(None).cast("long").alias("here"), F.col(TIME).alias("before")),
        )).alias("s"),
    )
    cells = served.groupBy(*[f"__w_{k}" for k in keys], F.col("s.cell").alias("__w_cell")).agg(
        F.max("s.here").alias("__here"), F.max("s.before").alias("__before")
    )
    joined = base.withColumn("__cell", cell).join(
        maybe_broadcast(cells), (F.col("__cell") == F.col("__w_cell")) & _match(keys, "__w_")
    )
    start = F.when(F.col("__here") <= F.col(TIME), F.col("__here")).otherwise(F.col("__before"))
    return joined.withColumn(WINDOW_START, start).drop(
        "__cell", "__w_cell", "__here", "__before", WIDTH, *[f"__w_{k}" for k in keys]
    )


def first_in_windows(
    windows: DataFrame, keys: list[str], row_id: str, limit: Column | int, largest_limit: int,
    *, from_origin: bool = False, rows_per_task: int | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each anchored window; ``largest_limit`` bounds ``limit``."""
    if largest_limit == 1 and not from_origin:
        # Only rows at the opening time can be first, so the rest go before the shuffle.
        windows = windows.filter(F.col(TIME) == F.col(WINDOW_START))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    part = [*keys, WINDOW_START]
    if largest_limit <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.col(TIME), field(row_id)))
        ranked = windows.withColumn("__position", rank)
    else:
        scan = OrderedScan.open(
            windows.withColumn("__id", field(row_id)), part, [TIME, "__id"], rows_per_task=rows_per_task
        )
        ranked = scan.number("__position").result().drop("__id")
    kept = ranked.filter((F.col("__position") <= largest_limit) & (F.col("__position") <= limit))
    return kept.drop("__position")


def leaders(times: DataFrame, keys, origin_us=None, rows_per_task=None, fold_rows=FOLD_ROWS) -> DataFrame:
    """The rows ``keys, __t, __width`` that open a window; one each."""
    if origin_us is not None:
        start = times.select(*keys, WIDTH).distinct().withColumn(TIME, F.lit(origin_us).cast("long"))
        times = times.unionByName(start)
    limit = min(fold_rows, rows_per_task or fold_rows)
    large = times.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    large = staged(large.select(*[F.col(k).alias(f"__l_{k}") for k in keys]))
    if large.isEmpty():
        return _fold(times, keys)
    # Only the keys above the limit leave the JVM.
    chosen = maybe_broadcast(large)
    small = _fold(times.join(chosen, _match(keys, "__l_"), "left_anti"), keys)

    # Equal times of a key count once; (key, time) spreads a hot key evenly.
    times = staged(times.join(chosen, _match(keys, "__l_"), "left_semi").distinct().withColumn(KIND, F.lit(1)))
    slicer = Slicer.plan(times, keys, ORDER, rows_per_task or ROWS_PER_TASK, 0 if rows_per_task else SCAN_ROWS)
    if not slicer.hot:
        return small.unionByName(_arrow_scan(times, keys))
    placed = staged(slicer.attach(times))
    cold = _arrow_scan(placed.filter(~F.col(HOT)), keys)
    return small.unionByName(cold).unionByName(_double(placed.filter(F.col(HOT)), keys, slicer))


def _fold(times: DataFrame, keys: list[str]) -> DataFrame:
    walk = Window.partitionBy(*keys).orderBy(TIME)
    running = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col(TIME) - F.lag(TIME).over(walk)
    start = F.when(gap.isNull() | (gap >= F.col(WIDTH)), F.col(TIME))
    marked = times.withColumn("__break", start).withColumn(
        "__start", F.last("__break", ignorenulls=True).over(running)
    )
    candidate = F.when(F.col(TIME) - F.col("__start") >= F.col(WIDTH), F.col(TIME))
    listed = marked.groupBy(*keys, WIDTH, "__start").agg(F.sort_array(F.collect_set(candidate)).alias("__later"))
    chain = F.aggregate(
        "__later",
        F.array("__start"),
        lambda acc, x: F.when(x - F.element_at(acc, -1) >= F.col(WIDTH), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return listed.select(*keys, F.explode(chain).alias(TIME), WIDTH)


def _arrow_scan(times: DataFrame, keys: list[str]) -> DataFrame:
    """Sequential scan of each key's sorted times; state is one key and one time."""
    out = times.select(*keys, TIME, WIDTH)

    def walk(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def changes(column):
            """Where a value differs from the one before it; nulls are equal."""
            here, before = column.slice(1), column.slice(0, len(column) - 1)
            differs = pc.fill_null(pc.not_equal(here, before), False)
            return pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)

        current, limit = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(k) for k in keys]
            at, width = batch.column(TIME).to_numpy(), batch.column(WIDTH).to_numpy()
            cuts = np.flatnonzero(np.logical_or.reduce([changes(c) for c in columns])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            picked = []
            for lo, hi in zip(edges, edges[1:]):
                name = tuple(c[lo].as_py() for c in columns)
                if name != current:
                    current, limit = name, at[lo]
                i = lo + int(np.searchsorted(at[lo:hi], limit))
                while i < hi:
                    picked.append(i)
                    limit = at[i] + width[i]
                    i = lo + int(np.searchsorted(at[lo:hi], limit))
            yield batch.take(pa.array(picked, pa.int64()))

    ordered = out.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, TIME)
    return ordered.mapInArrow(walk, out.schema)


def _double(placed: DataFrame, keys: list[str], slicer: Slicer) -> DataFrame:
    """Leaders of hot keys by pointer doubling over their distinct times."""
    scan = OrderedScan(placed, tuple(keys), tuple(ORDER), True).lag(__prev=F.col(TIME))
    gap = F.col(TIME) - F.col("__prev")
    scan = scan.with_df(scan.df.withColumn("__first", gap.isNull() | (gap >= F.col(WIDTH))))
    scan = scan.last(__start=F.when(F.col("__first"), F.col(TIME)))
    nodes = staged(scan.df.select(*keys, TIME, WIDTH, KIND, SLICE, HOT, "__first", "__start"))

    # A session of this many widths has at most one window more than that.
    steps = floor_div(F.col(TIME) - F.col("__start"), F.col(WIDTH))
    rounds = math.ceil(math.log2((nodes.agg(F.max(steps).alias("m")).first()["m"] or 0) + 1))
    reached = nodes.filter("__first").select(*keys, TIME, WIDTH)
    if rounds == 0:
        return reached

    # Each time probes for the first time >= itself + width; probes sort before
    # nodes of the same time, so a walk from the end has just seen that node.
    probes = slicer.attach(
        nodes.select(*keys, (F.col(TIME) + F.col(WIDTH)).alias(TIME), WIDTH, F.lit(0).alias(KIND))
    )
    both = probes.withColumn("__first", F.lit(None).cast("boolean")).unionByName(nodes.drop("__start"))
    seen = OrderedScan(both, tuple(keys), tuple(ORDER), True, descending=True).last(
        __next=F.when(F.col(KIND) == 1, F.struct(F.col(TIME).alias("t"), F.col("__first").alias("first")))
    )
    # A session's first time is a leader anyway, so no pointer needs to reach it.
    pointers = staged(
        seen.df.filter((F.col(KIND) == 0) & ~F.col("__next.first")).select(
            *keys, (F.col(TIME) - F.col(WIDTH)).alias("__node"), F.col("__next.t").alias("__to")
        )
    )
    for step in range(rounds):
        hop = _follow(reached.withColumnRenamed(TIME, "__at"), pointers, keys)
        reached = staged(reached.unionByName(hop.select(*keys, F.col("__to").alias(TIME), WIDTH)).distinct())
        if step + 1 < rounds:
            ahead = pointers.select(*keys, F.col("__node").alias("__from"), F.col("__to").alias("__at"))
            jumped = _follow(ahead, pointers, keys)
            pointers = staged(jumped.select(*keys, F.col("__from").alias("__node"), "__to"))
    return reached


def _follow(left: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Move ``__at`` along one pointer; one match at most."""
    table = pointers.select(*[F.col(k).alias(f"__p_{k}") for k in keys], "__node", "__to")
    match = (F.col("__at") == F.col("__node")) & _match(keys, "__p_")
    return left.join(table, match).drop("__node", *[f"__p_{k}" for k in keys])
