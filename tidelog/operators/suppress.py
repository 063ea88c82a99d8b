"""Stateful filters: repeats, rates, ceilings. All rest on anchored windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field
from tidelog.plans.anchored import anchored_windows, first_in_windows
from tidelog.specs import Scoped, Spec, positive_window, require

DEFAULT_SCOPE = "__default__"


@dataclass(frozen=True)
class DedupeRule(Spec):
    """Rows with equal ``fields`` within ``window`` of the last kept one are dropped."""

    fields: tuple[str, ...] | list[str]
    window: str | float

    def __post_init__(self):
        require(bool(self.fields) and all(self.fields), "dedupe: at least one field is required")
        positive_window(self.window)


@dataclass(frozen=True)
class KeyRule(Spec):
    """Debounce and uniq: one key field."""

    field: str
    window: str | float

    def __post_init__(self):
        require(bool(self.field), "field must not be empty")
        positive_window(self.window)


@dataclass(frozen=True)
class LimitRule(Spec):
    """At most ``limit`` rows per ``window``."""

    limit: int
    window: str | float

    def __post_init__(self):
        require(self.limit > 0, "limit must be > 0")
        positive_window(self.window)


def by_source(scoped: Scoped, value) -> Column:
    """``value(rule)`` of the rule that governs each row, as one CASE."""
    cases = None
    for source, rule in scoped.by_source.items():
        hit, chosen = field(scoped.source) == source, value(rule)
        cases = F.when(hit, chosen) if cases is None else cases.when(hit, chosen)
    if scoped.default is None:
        return cases
    return value(scoped.default) if cases is None else cases.otherwise(value(scoped.default))


def scope_key(scoped: Scoped) -> Column:
    """The source where it has its own rule, else one shared default scope."""
    if not scoped.by_source:
        return F.lit(DEFAULT_SCOPE)
    own = F.coalesce(field(scoped.source).isin(list(scoped.by_source)), F.lit(False))
    return F.when(own, field(scoped.source)).otherwise(F.lit(DEFAULT_SCOPE))


def parse_scoped(rules, parse) -> Scoped:
    given = Scoped.of(rules)
    default = None if given.default is None else parse(given.default)
    return Scoped(default, {s: parse(r) for s, r in given.by_source.items()}, given.source)


def _suppress(
    df: DataFrame, scoped: Scoped, keys: dict[str, Column], limit, *, ts: str, row_id: str,
    free: Column | None = None, strict: bool = False, origin_us: int | None = None, rows_per_task: int | None = None,
) -> DataFrame:
    """Keep the first ``limit(rule)`` rows of each anchored window.

    All rules run in one pass: the window width and the limit are columns, and
    the scope is part of the key. ``free`` rows, sources without a rule and rows
    without a time are kept as they are.
    """
    columns = [field(c) for c in df.columns]
    present = [r for r in (scoped.default, *scoped.by_source.values()) if r is not None]
    if not present:
        return df
    # A row without a time can not be placed, so nothing suppresses it.
    unplaced = field(ts).isNull()
    free = unplaced if free is None else free | unplaced
    if scoped.default is None:
        free = free | ~F.coalesce(field(scoped.source).isin(list(scoped.by_source)), F.lit(False))
    rows = df.filter(~free)
    width = by_source(scoped, lambda r: F.lit(positive_window(r.window)))
    rows = rows.withColumns({**keys, "__limit": by_source(scoped, lambda r: F.lit(limit(r)))})
    windows = anchored_windows(
        rows, list(keys), ts, width, strict=strict, origin_us=origin_us, rows_per_task=rows_per_task
    )
    kept = first_in_windows(
        windows, list(keys), row_id, F.col("__limit"), max(limit(r) for r in present),
        from_origin=origin_us is not None, rows_per_task=rows_per_task,
    )
    return kept.select(*columns).unionByName(df.filter(free))


def _text_or(df: DataFrame, name: str, missing: str) -> Column:
    value = field(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(value, F.lit(missing))


def dedupe_keys(df: DataFrame, scoped: Scoped) -> dict[str, Column]:
    """The key columns of a dedupe: field texts, padded where rules differ in length."""
    present = [r for r in (scoped.default, *scoped.by_source.values()) if r is not None]

    def value(i: int):
        # Sources without a rule are set aside before the key is used.
        return lambda r: _text_or(df, r.fields[i], "") if r is not None and i < len(r.fields) else F.lit("")

    keys = {f"__k{i}": by_source(scoped, value(i)) for i in range(max((len(r.fields) for r in present), default=0))}
    return {**keys, "__scope": scope_key(scoped)} if scoped.by_source else keys


def debounce_keys(df: DataFrame, scoped: Scoped) -> dict[str, Column]:
    keys = {"__k0": by_source(scoped, lambda r: _text_or(df, r.field, "<nil>"))}
    return {**keys, "__scope": scope_key(scoped)} if scoped.by_source else keys


def dedupe(df: DataFrame, rules, *, ts: str = "ts", row_id: str = "id", rows_per_task: int | None = None) -> DataFrame:
    """Keep a row if its field values were not kept within the window before it.

    A missing field counts as empty text. Dropped rows do not extend the window.
    Sources under the default rule share its state.
    """
    scoped = parse_scoped(rules, DedupeRule.parse)
    keys = dedupe_keys(df, scoped)
    return _suppress(df, scoped, keys, lambda r: 1, ts=ts, row_id=row_id, rows_per_task=rows_per_task)


def debounce(df: DataFrame, rules, *, ts: str = "ts", row_id: str = "id", rows_per_task: int | None = None) -> DataFrame:
    """Like :func:`dedupe` on one field; rows without it share one key."""
    scoped = parse_scoped(rules, KeyRule.parse)
    keys = debounce_keys(df, scoped)
    return _suppress(df, scoped, keys, lambda r: 1, ts=ts, row_id=row_id, rows_per_task=rows_per_task)


def uniq(df: DataFrame, rule, *, ts: str = "ts", row_id: str = "id", rows_per_task: int | None = None) -> DataFrame:
    """Like :func:`dedupe` on one string field; rows without it are always kept."""
    rule = KeyRule.parse(rule)
    if rule.field not in df.columns or not isinstance(df.schema[rule.field].dataType, T.StringType):
        return df
    value = field(rule.field)
    return _suppress(
        df, Scoped(rule), {"__k0": value}, lambda r: 1, free=value.isNull(),
        ts=ts, row_id=row_id, rows_per_task=rows_per_task,
    )


def rate_limit(
    df: DataFrame, rules, *, source: str = "source", ts: str = "ts", row_id: str = "id",
    rows_per_task: int | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each source's window; state is per source.

    A new window opens at the first row later than the end of the last one.
    """
    scoped = parse_scoped(rules, LimitRule.parse)
    return _suppress(
        df, scoped, {"__k0": field(source)}, lambda r: r.limit,
        ts=ts, row_id=row_id, strict=True, rows_per_task=rows_per_task,
    )


def ceiling(
    df: DataFrame, rules, *, ts: str = "ts", row_id: str = "id", origin_us: int | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each window; all sources under the default rule share it.

    ``origin_us`` is when the first window opens (at the first row if not given).
    """
    scoped = parse_scoped(rules, LimitRule.parse)
    return _suppress(
        df, scoped, {"__k0": scope_key(scoped)}, lambda r: r.limit,
        ts=ts, row_id=row_id, origin_us=origin_us, rows_per_task=rows_per_task,
    )


def distinct_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """Dedupe with an endless window, any one row per key."""
    return df.dropDuplicates(fields)


def first_records(df: DataFrame, fields: list[str], *, ts: str = "ts", row_id: str = "id") -> DataFrame:
    """Dedupe with an endless window: the earliest row of each key.

    An aggregate, so the rows of a hot key are reduced before the shuffle.
    """
    keys = [F.coalesce(field(f).cast("string"), F.lit("")).alias(f"__k{i}") for i, f in enumerate(fields)]
    row = F.struct(*[field(c) for c in df.columns])
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(field(ts), field(row_id))).alias("__row"))
    return first.select("__row.*")
