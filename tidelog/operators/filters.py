"""Filters and validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field, trim_space
from tidelog.functions.patterns import java_pattern, search
from tidelog.operators.env import Env, apply_rules
from tidelog.specs import Scoped, Spec, parse_all, require


@dataclass(frozen=True)
class FilterRule(Spec):
    field: str
    pattern: str
    invert: bool = False

    def __post_init__(self):
        java_pattern(self.pattern)


def filter_condition(df: DataFrame, rules, fields: str | None = None) -> Column:
    """All rules as one condition. ``fields``: a map column looked into as well."""
    tests = [F.lit(True)]
    for rule in parse_all(FilterRule, rules):
        if rule.field in df.columns:
            value = field(rule.field).cast("string")
        elif fields is not None:
            value = F.try_element_at(field(fields), F.lit(rule.field))
        else:
            value = F.lit(None).cast("string")
        hit = search(trim_space(F.coalesce(value, F.lit(""))), rule.pattern)
        tests.append(~hit if rule.invert else hit)
    return reduce(lambda a, b: a & b, tests)


def filter_rules(df: DataFrame, rules, fields: str | None = None) -> DataFrame:
    """Rows that pass every rule; a missing field is searched as empty text."""
    return df.filter(filter_condition(df, rules, fields))


# Schema type names; the last two are other names of "number".
TYPE_NAMES = ("string", "number", "bool", "int", "float")


@dataclass(frozen=True)
class FieldRule(Spec):
    name: str
    type: str
    required: bool = False

    def __post_init__(self):
        require(self.type in TYPE_NAMES, f"schema: unknown field type {self.type!r} for field {self.name!r}")
        require(bool(self.name.strip()), "schema: field name must not be empty")


def _type_ok(dtype: T.DataType, kind: str) -> bool:
    if kind == "string":
        return isinstance(dtype, T.StringType)
    if kind == "bool":
        return isinstance(dtype, T.BooleanType)
    return isinstance(dtype, T.NumericType)


# How a variant names the types of its values.
_VARIANT_TYPES = {"string": ["STRING"], "bool": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"]}


def _validate(env: Env, rules) -> None:
    messages = []
    for rule in parse_all(FieldRule, rules):
        kind = "number" if rule.type in ("int", "float") else rule.type
        value, dtype = env.get(rule.name), env.types.get(rule.name)
        missing = F.lit(True) if value is None else value.isNull()
        if rule.required:
            messages.append(F.when(missing, F.lit(f'schema: required field "{rule.name}" is missing')))
        if value is None:
            continue
        wrong = F.lit(f'schema: field "{rule.name}" must be a {kind}')
        if isinstance(dtype, T.VariantType):
            held = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
            messages.append(F.when(~missing & ~held.isin([*_VARIANT_TYPES[kind], "VOID"]), wrong))
        elif not _type_ok(dtype, kind):
            messages.append(F.when(~missing, wrong))
    first = F.coalesce(*messages) if messages else F.lit(None).cast("string")
    before = env.columns["_error"] if "_error" in env else None
    env.put("_error", first if before is None else F.coalesce(before, first))


def validate_schema(df: DataFrame, rules) -> DataFrame:
    """Add ``_error``: the first violation in declared order, else null."""
    return apply_rules(df, _validate, rules)


def split_valid(df: DataFrame, error: str = "_error") -> tuple[DataFrame, DataFrame]:
    """The good rows (without the error column) and the rejects."""
    return df.filter(field(error).isNull()).drop(error), df.filter(field(error).isNotNull())


def _rate_by_source(rates: float | Scoped) -> Column:
    scoped = Scoped.of(rates)
    default = 1.0 if scoped.default is None else scoped.default
    for rate in (default, *scoped.by_source.values()):
        require(0 < rate <= 1, "sampling: rate must be in (0, 1]")
    cases = None
    for source, rate in scoped.by_source.items():
        hit, value = field(scoped.source) == source, F.lit(float(rate))
        cases = F.when(hit, value) if cases is None else cases.when(hit, value)
    return F.lit(float(default)) if cases is None else cases.otherwise(F.lit(float(default)))


def sample(df: DataFrame, row_id: str, rates: float | Scoped = 1.0) -> DataFrame:
    """Keep each row with its source's probability, chosen by a hash of ``row_id``.

    The same row is always kept or always dropped, whatever the partitioning.
    """
    head = F.substring(F.md5(field(row_id).cast("string")), 1, 8)
    unit = F.conv(head, 16, 10).cast("double") / F.lit(float(2**32))
    return df.filter(unit < _rate_by_source(rates))


def sample_random(df: DataFrame, rates: float | Scoped = 1.0, seed: int = 0) -> DataFrame:
    """Keep each row with its source's probability, by Spark's generator."""
    return df.filter(F.rand(seed) < _rate_by_source(rates))
