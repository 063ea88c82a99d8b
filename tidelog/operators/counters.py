"""Counters, their reports, alerts and status roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import field, from_micros, micros
from tidelog.functions.patterns import java_pattern, search
from tidelog.operators.suppress import parse_scoped
from tidelog.plans.anchored import anchored_windows, first_in_windows
from tidelog.plans.ordered import OrderedScan
from tidelog.specs import Spec, duration_us, parse_all, positive_window, require


def stage_counters(df: DataFrame, name: str | Column, n: str | Column | None = None) -> DataFrame:
    """``name, value``: the sum of ``n`` (or the rows) per counter."""
    label = field(name) if isinstance(name, str) else name
    amount = F.lit(1) if n is None else field(n) if isinstance(n, str) else n
    return df.groupBy(label.alias("name")).agg(F.sum(amount.cast("long")).alias("value"))


def observed(df: DataFrame, name: str, conditions: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """Count rows (and rows per condition) while ``df`` is written, without another pass."""
    watch = Observation(name)
    counts = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(k) for k, c in (conditions or {}).items()]
    return df.observe(watch, F.count("*").alias("rows"), *counts), watch


def counter_report(
    df: DataFrame, name: str | Column, interval, *, ts: str = "ts", n: str | Column | None = None
) -> DataFrame:
    """``tick, name, value``: the running total of every counter known by then, at the end of each interval.

    A counter is listed from the interval of its first row to the interval of
    the last row of all, also where it stood still. Rows reduce to one per
    (name, tick) before the running sum; rows without a time don't count.
    """
    step = positive_window(interval)
    label = field(name) if isinstance(name, str) else name
    amount = F.lit(1) if n is None else field(n) if isinstance(n, str) else n
    at = micros(ts)
    tick = at - F.pmod(at, F.lit(step)) + step
    timed = df.filter(field(ts).isNotNull())
    per_tick = timed.groupBy(label.alias("name"), tick.alias("__tick")).agg(F.sum(amount.cast("long")).alias("__n"))
    end = F.broadcast(timed.agg(F.max(tick).alias("__end")))  # one row
    walk = Window.partitionBy("name").orderBy("__tick")
    grown = per_tick.join(end).select(
        "name", "__tick",
        F.sum("__n").over(walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("value"),
        F.coalesce(F.lead("__tick").over(walk) - step, F.col("__end")).alias("__until"),
    )
    like = df.schema[ts].dataType.simpleString()
    listed = grown.withColumn("__at", F.explode(F.sequence("__tick", "__until", F.lit(step))))
    return listed.select(from_micros("__at", like).alias("tick"), "name", "value")


@dataclass(frozen=True)
class AlertRule(Spec):
    """Fires at ``threshold`` and again only after ``cooldown``."""

    counter: str
    threshold: int
    cooldown: str | float = 0

    def __post_init__(self):
        require(bool(self.counter), "alert: counter must not be empty")
        require(self.threshold > 0, "alert: threshold must be > 0")
        duration_us(self.cooldown)


def threshold_alerts(
    report: DataFrame, rules, *, ts: str = "tick", name: str = "name", value: str = "value",
    rows_per_task: int | None = None,
) -> DataFrame:
    """The report rows at which a rule fires; counters without a rule never do.

    One rule per counter; rules of one counter share its cooldown, so the
    caller gives each counter once.
    """
    rules = parse_all(AlertRule, rules, needed=True)
    require(len({r.counter for r in rules}) == len(rules), "alert: one rule per counter")
    threshold = cooldown = None
    for rule in rules:
        hit, low, cool = field(name) == rule.counter, F.lit(rule.threshold), F.lit(duration_us(rule.cooldown))
        threshold = F.when(hit, low) if threshold is None else threshold.when(hit, low)
        # No cooldown: every later evaluation may fire.
        cool = F.greatest(cool, F.lit(1))
        cooldown = F.when(hit, cool) if cooldown is None else cooldown.when(hit, cool)
    columns = [field(c) for c in report.columns]
    high = report.filter(field(value) >= threshold).withColumn("__k0", field(name))
    fired = anchored_windows(high, ["__k0"], ts, cooldown, rows_per_task=rows_per_task)
    return first_in_windows(fired, ["__k0"], name, 1, 1).select(*columns)


@dataclass(frozen=True)
class MatchRule(Spec):
    """Counts records whose ``field`` matches; fires at ``threshold`` (``repeat``: each multiple)."""

    field: str
    pattern: str
    threshold: int
    repeat: bool = False

    def __post_init__(self):
        require(bool(self.field), "alert: field must not be empty")
        require(self.threshold > 0, "alert: threshold must be > 0")
        java_pattern(self.pattern)


def rule_hits(df: DataFrame, rules) -> DataFrame:
    """A row for each rule that a record matches, with ``__hit``: the rule's number, threshold and ``repeat``."""
    scoped = parse_scoped(rules, lambda r: parse_all(MatchRule, r))
    checks, number = [], 0
    for name, part in [(None, scoped.default or ()), *scoped.by_source.items()]:
        own = field(scoped.source).isin(list(scoped.by_source)) if scoped.by_source else F.lit(False)
        here = ~F.coalesce(own, F.lit(False)) if name is None else field(scoped.source) == name
        for rule in part:
            text = field(rule.field).cast("string") if rule.field in df.columns else F.lit(None).cast("string")
            hit = here & search(text, rule.pattern)
            checks.append(
                F.when(hit, F.struct(F.lit(number).alias("rule"), F.lit(rule.threshold).alias("threshold"), F.lit(rule.repeat).alias("repeat")))
            )
            number += 1
    require(bool(checks), "alert: at least one rule is required")
    return df.withColumn("__hit", F.explode(F.array_compact(F.array(*checks))))


def fires(at: Column) -> Column:
    """Whether the rule in ``__hit`` fires at its ``at``-th match."""
    limit = F.col("__hit.threshold")
    return F.when(F.col("__hit.repeat"), at % limit == 0).otherwise(at == limit)


def match_alerts(
    df: DataFrame, rules, *, source: str = "source", ts: str = "ts", row_id: str = "id",
    rows_per_task: int | None = None,
) -> DataFrame:
    """The records at which a source's rule fires, with ``rule`` number and ``count``.

    Only matching records are walked; a record that matches several rules is
    walked once per rule.
    """
    hits = rule_hits(df, rules).withColumns({"rule": F.col("__hit.rule"), "__t": micros(ts), "__id": field(row_id)})
    scan = OrderedScan.open(hits, [source, "rule"], ["__t", "__id"], rows_per_task=rows_per_task).number("count")
    return scan.result().filter(fires(F.col("count"))).drop("__hit", "__t", "__id")


def status_rollup(
    df: DataFrame, *, component: str = "component", status: str = "status", message: str = "message", ts: str = "ts"
) -> DataFrame:
    """Latest status and message per component, with the overall status on each row.

    The overall status is ``degraded`` if any component is. One row per
    component is left before the overall status is formed.
    """
    # Status and message of one record: of several at the last time, the greatest of both.
    record = F.struct(field(status).alias("status"), field(message).alias("message"))
    latest = (
        df.groupBy(field(component).alias("component")).agg(F.max_by(record, F.struct(field(ts), record)).alias("r"))
        .select("component", "r.status", "r.message")
    )
    overall = latest.agg(
        F.when(F.coalesce(F.bool_or(F.col("status") == "degraded"), F.lit(False)), "degraded").otherwise("ok").alias("overall")
    )
    return latest.withColumn("overall", overall.scalar())


def overall_status(df: DataFrame, **names: str) -> DataFrame:
    """One row with the overall status; ``ok`` without components."""
    latest = status_rollup(df, **names).select("status")
    bad = F.coalesce(F.bool_or(F.col("status") == "degraded"), F.lit(False))
    return latest.agg(F.when(bad, "degraded").otherwise("ok").alias("status"), F.count("*").alias("components"))
