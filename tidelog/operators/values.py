"""Value operators: cast, case, trim, cut, time, redaction, classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import cut_bytes, trim_space
from tidelog.functions.layouts import RFC3339, format_time, parse_any
from tidelog.functions.patterns import java_pattern, replace_all, search
from tidelog.operators.env import Env, apply_rules
from tidelog.specs import Spec, parse_all, require

# The texts read as booleans.
TRUE_TEXTS = ["1", "t", "T", "TRUE", "true", "True"]
FALSE_TEXTS = ["0", "f", "F", "FALSE", "false", "False"]

INT_PATTERN = r"^[+-]?[0-9]+$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX_PATTERN = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$"
SPECIAL_PATTERN = r"^([+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


@dataclass(frozen=True)
class CastRule(Spec):
    """``keep_raw`` keeps the text that could not be read, as ``<field>_raw``."""

    field: str
    type: str
    dest: str = ""
    keep_raw: bool = False

    def __post_init__(self):
        require(bool(self.field), "cast: field must not be empty")
        require(self.type in ("string", "int", "float", "bool"), f"cast: unknown type {self.type!r}")


def read_float(text: Column) -> Column:
    """Decimal and hexadecimal numbers, infinities and NaN; a number too large for the type does not read."""
    number = text.try_cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    # Most texts are decimal, so that is asked first.
    return F.when(search(text, DECIMAL_PATTERN) | search(text, HEX_PATTERN), finite).when(search(text, SPECIAL_PATTERN), number)


def read_int(text: Column) -> Column:
    whole = F.when(search(text, INT_PATTERN), text.try_cast("bigint"))
    number = read_float(text)
    # Doubles next to the type's bounds: -2^63 is one, 2^63 is past the end.
    fits = (number >= float(-(2**63))) & (number < float(2**63))
    return F.coalesce(whole, F.when(fits, number.try_cast("bigint")))


def read_bool(text: Column) -> Column:
    return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)


_READERS = {
    "string": (lambda s: s, T.StringType()),
    "int": (read_int, T.LongType()),
    "float": (read_float, T.DoubleType()),
    "bool": (read_bool, T.BooleanType()),
}


def _cast(env: Env, rules) -> None:
    for rule in parse_all(CastRule, rules, needed=True):
        if rule.field not in env:
            continue
        read, dtype = _READERS[rule.type]
        text = env.columns[rule.field].cast("string")
        value = read(text)
        if rule.type != "string":
            failed = F.when(
                text.isNotNull() & value.isNull(),
                F.concat(F.lit(f"cast: field {rule.field} is not {rule.type}: "), text),
            )
            before = env.columns["_error"] if "_error" in env else F.lit(None).cast("string")
            env.put("_error", F.coalesce(before, failed))
            if rule.keep_raw and not rule.dest:
                env.put(f"{rule.field}_raw", F.when(value.isNull(), text))
        env.put(rule.dest or rule.field, value, dtype)


def cast(df: DataFrame, rules) -> DataFrame:
    """Typed columns; a text that does not read gives null and an ``_error``."""
    return apply_rules(df, _cast, rules)


@dataclass(frozen=True)
class NormalizeRule(Spec):
    field: str
    op: str

    def __post_init__(self):
        require(bool(self.field), "normalize: empty field name")
        require(self.op in ("lowercase", "uppercase", "trim_space"), f"normalize: unknown op {self.op!r}")


_NORMALIZERS = {"lowercase": F.lower, "uppercase": F.upper, "trim_space": trim_space}


def _normalize(env: Env, rules) -> None:
    for rule in parse_all(NormalizeRule, rules):
        text = env.text(rule.field)
        if text is not None:
            env.put(rule.field, _NORMALIZERS[rule.op](text))


def normalize(df: DataFrame, rules) -> DataFrame:
    """Case and white space of string fields; a source's rules run after the default ones."""
    return apply_rules(df, _normalize, rules, layered="after")


@dataclass(frozen=True)
class TruncateRule(Spec):
    field: str
    max_len: int
    suffix: str = ""

    def __post_init__(self):
        require(bool(self.field), "truncate: field must not be empty")
        require(self.max_len > 0, "truncate: max_len must be > 0")


def _truncate(env: Env, rules) -> None:
    for rule in parse_all(TruncateRule, rules, needed=True):
        text = env.text(rule.field)
        if text is not None:
            short = F.concat(cut_bytes(text, rule.max_len), F.lit(rule.suffix))
            env.put(rule.field, F.when(F.octet_length(text) > rule.max_len, short).otherwise(text))


def truncate(df: DataFrame, rules) -> DataFrame:
    """Cut texts above ``max_len`` bytes, between characters, and add ``suffix``."""
    return apply_rules(df, _truncate, rules)


@dataclass(frozen=True)
class TimestampRule(Spec):
    field: str
    layouts: tuple[str, ...] | list[str]
    output_field: str = ""
    output_layout: str = RFC3339

    def __post_init__(self):
        require(bool(self.field), "timestamp: field must not be empty")
        require(bool(self.layouts), "timestamp: at least one layout is required")


def _timestamp(env: Env, rules) -> None:
    for rule in parse_all(TimestampRule, rules, needed=True):
        text = env.text(rule.field)
        if text is None:
            continue
        dest = rule.output_field or rule.field
        value = format_time(parse_any(text, list(rule.layouts)), rule.output_layout or RFC3339)
        if env.text(dest) is not None:
            value = F.coalesce(value, env.columns[dest])
        env.put(dest, value)


def normalize_timestamp(df: DataFrame, rules) -> DataFrame:
    """Rewrite time texts to one UTC layout; a text no layout reads stays."""
    return apply_rules(df, _timestamp, rules)


@dataclass(frozen=True)
class RedactRule(Spec):
    """``style="stars"`` replaces a match by stars of the placeholder's length."""

    field: str
    pattern: str = ""
    placeholder: str = "***"
    style: str = "placeholder"

    def __post_init__(self):
        require(bool(self.field.strip()), "redact: field must not be empty")
        require(self.style in ("placeholder", "stars"), f"redact: unknown style {self.style!r}")
        if not self.placeholder:
            object.__setattr__(self, "placeholder", "***")
        if self.pattern:
            java_pattern(self.pattern)


def _redact(env: Env, rules) -> None:
    for rule in parse_all(RedactRule, rules):
        if rule.field not in env:
            continue
        value = env.columns[rule.field]
        if rule.pattern:
            cover = "*" * len(rule.placeholder) if rule.style == "stars" else rule.placeholder
            env.put(rule.field, replace_all(value.cast("string"), rule.pattern, cover, template=False))
        else:
            env.put(rule.field, F.when(value.isNotNull(), F.lit(rule.placeholder)))


def redact(df: DataFrame, rules) -> DataFrame:
    """Cover whole fields or every match in them; absent fields stay absent."""
    return apply_rules(df, _redact, rules)


@dataclass(frozen=True)
class MaskRule(RedactRule):
    pass


def _mask(env: Env, rules) -> None:
    for rule in parse_all(MaskRule, rules):
        if rule.field not in env:
            continue
        value = env.columns[rule.field]
        if rule.pattern:
            env.put(rule.field, replace_all(value.cast("string"), rule.pattern, rule.placeholder))
        else:
            env.put(rule.field, F.when(value.isNotNull(), F.lit(rule.placeholder)))


def mask(df: DataFrame, rules) -> DataFrame:
    """Like :func:`redact` on values of any type; the placeholder may name groups."""
    return apply_rules(df, _mask, rules)


@dataclass(frozen=True)
class ClassifyRule(Spec):
    field: str
    pattern: str
    label: str
    dest: str = "category"

    def __post_init__(self):
        require(bool(self.field), "classify: field must not be empty")
        require(bool(self.label), "classify: label must not be empty")
        java_pattern(self.pattern)
        if not self.dest:
            object.__setattr__(self, "dest", "category")


def _classify(env: Env, rules) -> None:
    rules = [r for r in parse_all(ClassifyRule, rules, needed=True)]
    tests = [
        (rule, search(env.text(rule.field), rule.pattern)) for rule in rules if env.text(rule.field) is not None
    ]
    for dest in dict.fromkeys(rule.dest for rule in rules):
        before = env.columns[dest].cast("string") if dest in env else F.lit(None).cast("string")
        # Rules of other destinations are listed too: the first match ends the search.
        cases = None
        for rule, hit in tests:
            label = F.lit(rule.label) if rule.dest == dest else before
            cases = F.when(hit, label) if cases is None else cases.when(hit, label)
        env.put(dest, before if cases is None else cases.otherwise(before))


def classify(df: DataFrame, rules) -> DataFrame:
    """The label of the first matching rule, into that rule's ``dest``."""
    return apply_rules(df, _classify, rules)
