"""Routing records to named sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import field
from tidelog.functions.patterns import java_pattern, search
from tidelog.specs import Spec, parse_all, require


@dataclass(frozen=True)
class RouteRule(Spec):
    """Matches on the source and, if set, on a field; then sends to ``sinks``."""

    sinks: tuple[str, ...] | list[str]
    source_pattern: str = ""
    field: str = ""
    field_pattern: str = ""

    def __post_init__(self):
        require(bool(self.sinks), "router: a rule needs sinks")
        require(bool(self.source_pattern or self.field), "router: a rule needs a source or a field")
        java_pattern(self.source_pattern)
        java_pattern(self.field_pattern)


def route_sinks(
    df: DataFrame, rules, default: list[str] | None = None, sinks: list[str] | None = None, *, source: str = "source"
) -> Column:
    """The sink names of each row: the first matching rule's, else the default's.

    Without a default all declared ``sinks`` get the row.
    """
    rules = parse_all(RouteRule, rules)
    declared = list(sinks or dict.fromkeys(s for r in rules for s in r.sinks))
    rest = F.array(*[F.lit(s) for s in (default or declared)]).cast("array<string>")
    cases = None
    for rule in rules:
        hit = F.lit(True)
        if rule.source_pattern:
            hit = search(F.coalesce(field(source).cast("string"), F.lit("")), rule.source_pattern)
        if rule.field and rule.field_pattern:
            value = field(rule.field).cast("string") if rule.field in df.columns else F.lit("")
            hit = hit & search(F.coalesce(value, F.lit("")), rule.field_pattern)
        to = F.array(*[F.lit(s) for s in rule.sinks])
        cases = F.when(hit, to) if cases is None else cases.when(hit, to)
    return rest if cases is None else cases.otherwise(rest)


def route(df: DataFrame, rules, default: list[str] | None = None, sinks: list[str] | None = None, *,
          source: str = "source", dest: str = "sink") -> DataFrame:
    """One row per record and sink it goes to."""
    return df.withColumn(dest, F.explode(route_sinks(df, rules, default, sinks, source=source)))
