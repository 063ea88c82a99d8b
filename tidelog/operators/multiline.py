"""Assembling multi-line records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import field, floor_div, micros
from tidelog.functions.patterns import java_pattern, search
from tidelog.plans.ordered import OrderedScan
from tidelog.specs import Scoped, Spec, duration_us, require


@dataclass(frozen=True)
class MultilineRule(Spec):
    """Exactly one of the patterns; ``max_lines`` and ``timeout`` of 0 mean none."""

    start_pattern: str = ""
    continue_pattern: str = ""
    max_lines: int = 0
    timeout: str | float = 0
    field: str = "message"

    def __post_init__(self):
        require(bool(self.start_pattern or self.continue_pattern), "multiline: a pattern must be set")
        require(not (self.start_pattern and self.continue_pattern), "multiline: the patterns exclude each other")
        require(self.max_lines >= 0, "multiline: max_lines must be >= 0")
        java_pattern(self.start_pattern or self.continue_pattern)
        duration_us(self.timeout)
        if not self.field:
            object.__setattr__(self, "field", "message")

    def opens(self, line: Column) -> Column:
        return search(line, self.start_pattern) if self.start_pattern else ~search(line, self.continue_pattern)


def _by_source(scoped: Scoped, value) -> Column:
    """``value(rule)`` of each source's rule; lines of sources without a rule stand alone."""
    cases = None
    for source, rule in scoped.by_source.items():
        hit = field(scoped.source) == source
        cases = F.when(hit, value(rule)) if cases is None else cases.when(hit, value(rule))
    default = value(scoped.default)
    return default if cases is None else cases.otherwise(default)


def parse_rules(rules, source: str) -> Scoped:
    """Rules as given, parsed; ``source`` is the column that scopes them."""
    given = Scoped.of(rules)
    own = {s: MultilineRule.parse(r) for s, r in given.by_source.items()}
    return Scoped(MultilineRule.parse(given.default) if given.default is not None else None, own, source)


def rule_columns(scoped: Scoped, line: Column) -> tuple[Column, Column, Column]:
    """Whether a line opens a record, and its rule's most lines and timeout (0: none)."""
    opens = _by_source(scoped, lambda r: F.lit(True) if r is None else F.coalesce(r.opens(line), F.lit(False)))
    most = _by_source(scoped, lambda r: F.lit(r.max_lines if r and r.max_lines else 0).cast("long"))
    return opens, most, _by_source(scoped, lambda r: F.lit(duration_us(r.timeout) if r else 0).cast("long"))


def text_columns(scoped: Scoped, text: Column) -> list[Column]:
    """The record's text under the name its source's rule gives; null under the other rules' names."""
    names = list(dict.fromkeys(r.field for r in (scoped.default, *scoped.by_source.values()) if r is not None)) or ["message"]
    # Lines of sources without a rule go where the first rule's do.
    goes = _by_source(scoped, lambda r: F.lit(names[0] if r is None else r.field))
    return [F.when(goes == name, text).alias(name) for name in names]


def assemble_multiline(
    df: DataFrame, rules, *, source: str = "source", ts: str | None = "ts", row_id: str = "id",
    line: str = "line", rows_per_task: int | None = None,
) -> DataFrame:
    """One row per assembled record: source, first time and id, line count, text.

    Lines of a source are taken in (time, id) order, or in id order without a
    time column. Lines of sources without a rule, and lines without a time,
    stand alone. Each source's text goes to its own rule's field.
    """
    scoped = parse_rules(rules, source)
    at = micros(ts) if ts else F.lit(0).cast("long")
    rows = df.select(
        field(source).alias(source),
        at.isNull().alias("__untimed"),
        at.alias("__t"),
        field(row_id).alias("__id"),
        *([field(ts).alias("__ts")] if ts else []),
        field(line).alias("__line"),
    )
    opens, size, timeout = rule_columns(scoped, F.col("__line"))
    rows = rows.withColumns({"__opens": opens | F.col("__untimed")})

    keys = [source, "__untimed"]
    scan = OrderedScan.open(rows, keys, ["__t", "__id"], rows_per_task=rows_per_task)
    if any(duration_us(r.timeout) for r in (scoped.default, *scoped.by_source.values()) if r is not None):
        scan = scan.lag(__prev=F.col("__t"))
        late = (timeout > 0) & (F.col("__t") - F.col("__prev") >= timeout)
        opened = F.col("__opens") | F.coalesce(late, F.lit(False))
    else:
        opened = F.col("__opens")
    # Segment number, and the row's place in its segment.
    scan = scan.running_sum(__seg=opened.cast("long"), __n=F.lit(1).cast("long"))
    scan = scan.last(__first=F.when(opened, F.col("__n")))
    place = F.col("__n") - F.coalesce("__first", F.lit(1))
    chunk = F.when(size > 0, floor_div(place, F.greatest(size, F.lit(1).cast("long")))).otherwise(0)
    grouped = scan.result().withColumn("__chunk", chunk).groupBy(*keys, "__seg", "__chunk")
    parts = F.sort_array(F.collect_list(F.struct("__t", "__id", "__line")))
    joined = grouped.agg(
        *([F.min("__ts").alias(ts)] if ts else []),
        parts.alias("__parts"),
    )
    return joined.select(
        field(source),
        *([field(ts)] if ts else []),
        F.col("__parts")[0]["__id"].alias(row_id),
        F.size("__parts").cast("long").alias("n_lines"),
        *text_columns(scoped, F.array_join(F.col("__parts.__line"), "\n")),
    )
