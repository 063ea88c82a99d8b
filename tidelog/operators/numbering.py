"""Numbering, batching and bounded retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import field, floor_div, micros
from tidelog.operators.suppress import by_source, parse_scoped, scope_key
from tidelog.plans.anchored import GROUP_LIMIT
from tidelog.plans.ordered import OrderedScan
from tidelog.specs import Spec, positive_window, require


@dataclass(frozen=True)
class SequenceRule(Spec):
    field: str = "seq"
    start: int = 1

    def __post_init__(self):
        if not self.field:
            object.__setattr__(self, "field", "seq")
        if not self.start:
            object.__setattr__(self, "start", 1)


def sequence(
    df: DataFrame, rules, *, per_source: str | None = None, ts: str = "ts", row_id: str = "id",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Number rows in arrival order from ``start``.

    Sources with an own rule count for themselves; all others share the
    default rule's counter, or have one each if ``per_source`` names the source
    column. Sources without a rule and rows without a time get no number.
    """
    scoped = parse_scoped(rules, SequenceRule.parse)
    all_rules = [r for r in (scoped.default, *scoped.by_source.values()) if r is not None]
    require(bool(all_rules), "sequence: at least one rule is required")
    key = field(per_source) if per_source else scope_key(scoped)
    rows = df.withColumns({"__k0": key, "__k1": field(ts).isNull(), "__t": micros(ts), "__id": field(row_id)})
    scan = OrderedScan.open(rows, ["__k0", "__k1"], ["__t", "__id"], rows_per_task=rows_per_task).number("__n")
    value = F.when(~F.col("__k1"), F.col("__n") + by_source(scoped, lambda r: F.lit(r.start)) - 1)
    out = scan.result()
    for name in dict.fromkeys(r.field for r in all_rules):
        writes = by_source(scoped, lambda r: F.lit(r is not None and r.field == name))
        before = field(name).cast("long") if name in df.columns else F.lit(None).cast("long")
        out = out.withColumn(name, F.when(writes, value.cast("long")).otherwise(before))
    return out.drop("__k0", "__k1", "__t", "__id", "__n")


def assign_batches(
    df: DataFrame, max_size: int = 100, interval=5, *, origin: Column | None = None, scope: str | None = None,
    ts: str = "ts", row_id: str = "id", rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``tick`` and ``batch``: batches end at ``max_size`` rows and at each interval.

    Ticks count from ``origin`` (the epoch by default).
    """
    require(max_size >= 1, "batch: max_size must be >= 1")
    step = positive_window(interval)
    start = micros(origin) if origin is not None else F.lit(0).cast("long")
    keys = [scope] if scope else []
    rows = df.withColumns({"__t": micros(ts), "__id": field(row_id)})
    rows = rows.withColumn("tick", floor_div(F.col("__t") - start, F.lit(step)))
    scan = OrderedScan.open(rows, [*keys, "tick"], ["__t", "__id"], rows_per_task=rows_per_task).number("__n")
    batch = floor_div(F.col("__n") - 1, F.lit(max_size).cast("long"))
    return scan.result().withColumn("batch", batch).drop("__t", "__id", "__n")


def batches(df: DataFrame, max_size: int = 100, interval=5, *, scope: str | None = None, **options) -> DataFrame:
    """One row per batch with its size."""
    keys = [scope] if scope else []
    assigned = assign_batches(df, max_size, interval, scope=scope, **options)
    return assigned.groupBy(*keys, "tick", "batch").agg(F.count("*").alias("n_rows"))


def retain_bounded(
    df: DataFrame, capacity: int, *, drop_new: bool = False, source: str = "source", ts: str = "ts",
    row_id: str = "id", rows_per_task: int | None = None,
) -> DataFrame:
    """The first (``drop_new``) or last ``capacity`` rows of each source."""
    require(capacity > 0, "buffer: capacity must be > 0")
    if capacity <= GROUP_LIMIT:
        order = [field(ts), field(row_id)] if drop_new else [field(ts).desc(), field(row_id).desc()]
        rank = F.row_number().over(Window.partitionBy(field(source)).orderBy(*order))
        return df.withColumn("__n", rank).filter(F.col("__n") <= capacity).drop("__n")
    rows = df.withColumns({"__t": micros(ts), "__id": field(row_id)})
    scan = OrderedScan.open(rows, [source], ["__t", "__id"], rows_per_task=rows_per_task)
    scan = (scan if drop_new else scan.reversed()).number("__n")
    return scan.result().filter(F.col("__n") <= capacity).drop("__t", "__id", "__n")


def retention_counts(df: DataFrame, capacity: int, *, source: str = "source") -> DataFrame:
    """``kept`` and ``dropped`` rows per source."""
    require(capacity > 0, "buffer: capacity must be > 0")
    n = F.count("*")
    return df.groupBy(field(source).alias(source)).agg(
        F.least(n, F.lit(capacity)).alias("kept"), F.greatest(n - capacity, F.lit(0)).alias("dropped")
    )
