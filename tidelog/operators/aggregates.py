"""Windowed aggregation: anchored, aligned, sliding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field, from_micros, micros
from tidelog.operators.suppress import parse_scoped
from tidelog.plans.anchored import WINDOW_START, anchored_windows
from tidelog.plans.ordered import OrderedScan
from tidelog.plans.sizing import staged
from tidelog.specs import Scoped, Spec, parse_all, positive_window, require

OPS = ("count", "sum", "min", "max")


@dataclass(frozen=True)
class AggregateRule(Spec):
    field: str
    op: str
    window: str | float

    def __post_init__(self):
        require(bool(self.field), "aggregate: field name must not be empty")
        require(self.op in OPS, f"aggregate: unknown op {self.op!r}")
        positive_window(self.window)


def number(df: DataFrame, name: str) -> Column:
    """The field as a number; missing or not numeric counts as 0."""
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.NumericType):
        return F.lit(0.0)
    return F.coalesce(field(name).cast("double"), F.lit(0.0))


def _aggregate(df: DataFrame, rule: AggregateRule) -> Column:
    if rule.op == "count":
        return F.count("*").cast("double")
    return getattr(F, rule.op)(number(df, rule.field))


def anchored_agg(
    df: DataFrame, rules, *, source: str = "source", ts: str = "ts", rows_per_task: int | None = None
) -> DataFrame:
    """``source, field, op, window_start, width_us, value`` of every anchored window.

    ``rules``: a list, or a :class:`Scoped` of lists. Rules with the same window
    share one pass.
    """
    scoped = parse_scoped(rules, lambda r: parse_all(AggregateRule, r))
    widths = sorted(
        {positive_window(r.window) for part in (scoped.default or (), *scoped.by_source.values()) for r in part}
    )
    results = []
    for width in widths:
        cells: dict[tuple[str, str], list[str | None]] = {}
        for name, part in [(None, scoped.default or ()), *scoped.by_source.items()]:
            for rule in part:
                if positive_window(rule.window) == width:
                    cells.setdefault((rule.field, rule.op), []).append(name)
        rows = df.filter(governed(scoped, {n for names in cells.values() for n in names}))
        windows = anchored_windows(rows, [source], ts, width, strict=True, rows_per_task=rows_per_task)
        rule_list = [AggregateRule(f, o, width / 1e6) for f, o in cells]
        # count, sum, min and max combine before the shuffle, so a hot window stays cheap.
        totals = windows.groupBy(source, WINDOW_START).agg(
            *[_aggregate(df, r).alias(f"__a{i}") for i, r in enumerate(rule_list)]
        )
        listed = F.array(
            *[
                F.struct(
                    F.lit(r.field).alias("field"),
                    F.lit(r.op).alias("op"),
                    F.col(f"__a{i}").alias("value"),
                    governed(scoped, set(names)).alias("on"),
                )
                for i, (r, names) in enumerate(zip(rule_list, cells.values()))
            ]
        )
        long = totals.select(field(source), F.col(WINDOW_START), F.explode(listed).alias("c")).filter("c.on")
        results.append(
            long.select(
                field(source), "c.field", "c.op",
                from_micros(WINDOW_START, df.schema[ts].dataType.simpleString()).alias("window_start"),
                (F.lit(width).cast("long")).alias("width_us"), "c.value",
            )
        )
    require(bool(results), "aggregate: at least one rule is required")
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def governed(scoped: Scoped, names: set) -> Column:
    """Rows whose source is one of ``names``; None stands for all without own rules."""
    own = [n for n in names if n is not None]
    listed = F.coalesce(field(scoped.source).isin(own), F.lit(False)) if own else F.lit(False)
    if None not in names:
        return listed
    if not scoped.by_source:
        return F.lit(True)
    others = ~F.coalesce(field(scoped.source).isin(list(scoped.by_source)), F.lit(False))
    return others | listed


def snapshot(
    df: DataFrame, rules, at: Column | str, *, source: str = "source", ts: str = "ts", rows_per_task: int | None = None
) -> DataFrame:
    """Value of each (source, field, op) at a time: of its latest window as far as it had come, 0 once expired.

    Later records don't count, so this is taken from the records and not from
    closed windows.
    """
    moment = micros(F.lit(at).cast("timestamp") if isinstance(at, str) else at)
    windows = anchored_agg(df.filter(micros(ts) <= moment), rules, source=source, ts=ts, rows_per_task=rows_per_task)
    latest = windows.withColumn("__w", micros("window_start")).groupBy(source, "field", "op").agg(
        F.max_by(F.struct("value", "__w", "width_us"), "__w").alias("w")
    )
    live = moment - F.col("w.__w") <= F.col("w.width_us")
    return latest.select(source, "field", "op", F.when(live, F.col("w.value")).otherwise(0.0).alias("value"))


def tumbling_agg(
    df: DataFrame, aggs: dict[str, tuple[str, str]], window, *, source: str = "source", ts: str = "ts",
) -> DataFrame:
    """Aggregates per source and clock-aligned window; ``aggs`` maps name to (op, field).

    Works on streams too (give the input a watermark).
    """
    width = positive_window(window)
    columns = []
    for name, (op, on) in aggs.items():
        require(op in OPS, f"aggregate: unknown op {op!r}")
        columns.append((F.count("*") if op == "count" else getattr(F, op)(number(df, on))).alias(name))
    grouped = df.groupBy(F.window(field(ts), f"{width} microseconds"), field(source)).agg(*columns)
    return grouped.select(source, F.col("window.start").alias("window_start"), *aggs)


def _slots(rows: DataFrame, keys: list[str], total: Column, window, buckets: int, ts: str, like: str) -> DataFrame:
    """Sliding totals from slot totals: rows are reduced to slots first, and only
    slots are copied into the ``buckets`` windows that cover them."""
    width = positive_window(window)
    require(buckets >= 1, "buckets must be >= 1")
    require(width % buckets == 0, "the window must divide into buckets")
    step = width // buckets
    at = micros(ts)
    slot = (at - F.pmod(at, F.lit(step))).alias("__slot")
    per_slot = rows.groupBy(*keys, slot).agg(total.alias("__n"))
    starts = F.sequence(F.col("__slot") - width + step, F.col("__slot"), F.lit(step).cast("long"))
    spread = per_slot.select(*keys, F.explode(starts).alias("__w"), "__n")
    summed = spread.groupBy(*keys, "__w").agg(F.sum("__n").alias("n"))
    return summed.select(
        from_micros("__w", like).alias("window_start"), from_micros(F.col("__w") + width, like).alias("window_end"),
        *keys, "n",
    )


def value_frequency(
    df: DataFrame, column: str, window="1m", buckets: int = 6, *, ts: str = "ts", dest: str = "value",
) -> DataFrame:
    """Rows per value of a string field in each sliding window; missing counts as empty text."""
    require(bool(column), "value_frequency: field must not be empty")
    text = column in df.columns and isinstance(df.schema[column].dataType, T.StringType)
    value = F.coalesce(field(column), F.lit("")) if text else F.lit("")
    rows = df.select(value.alias(dest), field(ts).alias(ts))
    return _slots(rows, [dest], F.count("*"), window, buckets, ts, df.schema[ts].dataType.simpleString())


def sliding_count(
    df: DataFrame, window, buckets: int, *, ts: str = "ts", n: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """Sum of ``n`` (or rows) in each sliding window, per ``keys`` if given."""
    total = F.sum(field(n)) if n else F.count("*")
    return _slots(df, list(keys or []), total, window, buckets, ts, df.schema[ts].dataType.simpleString())


def trailing_totals(
    df: DataFrame, window, *, value: str | None = None, keys: list[str] | None = None, ts: str = "ts", scale: int = 6,
    count: str = "count", total: str = "total", rows_per_task: int | None = None,
) -> DataFrame:
    """Each row with the ``count`` of its key's rows in the window that ends at it, and the ``total`` of ``value`` over them.

    The window of a row at t is (t - window, t]; rows of equal time see each
    other. Sums are exact: fractions count to ``scale`` decimal places. Missing
    values count as 0; a row without a time gets nulls and counts nowhere.

    One walk over (key, time): a key's times are reduced to one row each, and
    every time asks for the running sums one window earlier with a probe row in
    the same order. A key of any size, or no key at all, is walked in slices.
    """
    width = positive_window(window)
    names = list(keys or [])
    parts = [f"__k{i}" for i in range(max(1, len(names)))]
    keyed = {p: field(k) for p, k in zip(parts, names)} or {parts[0]: F.lit(0)}
    whole = value is None or isinstance(df.schema[value].dataType, T.IntegralType)
    number = F.lit(0) if value is None else F.coalesce(field(value), F.lit(0))
    rows = df.withColumns({**keyed, "__t": micros(ts), "__v": number.cast(f"decimal(38,{0 if whole else scale})")})

    timed = rows.filter("__t IS NOT NULL")
    # Rows of one time are combined before the shuffle.
    times = staged(timed.groupBy(*parts, "__t").agg(F.count("*").alias("c"), F.sum("__v").alias("v")))
    nothing = F.lit(0).cast(times.schema["v"].dataType)
    probes = times.select(*parts, (F.col("__t") - width).alias("__t"), F.lit(1).alias("__probe"), F.col("__t").alias("__asked"), F.lit(0).cast("long").alias("c"), nothing.alias("v"))
    both = times.select(*parts, "__t", F.lit(0).alias("__probe"), F.col("__t").alias("__asked"), "c", "v").unionByName(probes)
    scan = OrderedScan.open(both, parts, ["__t", "__probe", "__asked"], rows_per_task=rows_per_task)
    walked = scan.running_sum(__c=F.col("c"), __s=F.col("v")).result()

    def gained(name: str) -> Column:
        here, before = (F.max(F.when(F.col("__probe") == probe, F.col(name))) for probe in (0, 1))
        return here - before

    kind = "long" if whole else df.schema[value].dataType.simpleString()
    totals = walked.groupBy(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)], "__asked").agg(
        gained("__c").alias("__count"), gained("__s").cast(kind).alias("__total")
    )
    match = F.col("__t") == F.col("__asked")
    for i, p in enumerate(parts):
        match = match & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    out = timed.join(totals, match).unionByName(rows.filter("__t IS NULL"), allowMissingColumns=True)
    kept = [field(c) for c in df.columns if c not in (count, total)]
    found = [F.col("__count").alias(count)] + ([F.col("__total").alias(total)] if value is not None else [])
    return out.select(*kept, *found)
