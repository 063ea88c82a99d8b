"""Rendering records as text: JSON, plain text, logfmt.

Each renderer takes a record map or declared columns; keys are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.columns import field, trim_space
from tidelog.functions.layouts import format_time
from tidelog.specs import require

FORMATS = ("json", "text", "logfmt")

# What the text layout prints before the other fields.
LEADING = ("time", "level", "message")


def as_text(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return format_time(field(name).cast("timestamp"))
    return field(name).cast("string")


def sorted_entries(record: Column) -> Column:
    return F.array_sort(F.map_entries(record))


def json_of_map(record: Column) -> Column:
    return F.to_json(F.map_from_entries(sorted_entries(record)))


def json_of_columns(df: DataFrame, names: list[str] | None = None) -> Column:
    return F.to_json(F.struct(*[field(n).alias(n) for n in sorted(names or df.columns)]))


def _text(time: Column, level: Column, message: Column, extras: Column) -> Column:
    """``extras`` is an array of texts; the three leading parts print even if empty."""
    empty = F.lit("")
    lead = F.array(F.coalesce(time, empty), F.coalesce(F.upper(level), empty), F.coalesce(message, empty))
    return trim_space(F.array_join(F.concat(lead, extras), " "))


def text_of_map(record: Column) -> Column:
    parts = [F.try_element_at(record, F.lit(n)) for n in LEADING]
    rest = F.filter(sorted_entries(record), lambda e: ~e["key"].isin(list(LEADING)))
    return _text(*parts, F.transform(rest, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<nil>")))))


def text_of_columns(df: DataFrame, names: list[str] | None = None) -> Column:
    """Null columns count as missing."""
    names = names or df.columns
    parts = [as_text(df, n) if n in names else F.lit(None).cast("string") for n in LEADING]
    rest = [
        F.when(field(n).isNotNull(), F.concat(F.lit(f"{n}="), as_text(df, n)))
        for n in sorted(names)
        if n not in LEADING
    ]
    return _text(*parts, F.array_compact(F.array(*rest)) if rest else F.array().cast("array<string>"))


def quoted_value(value: Column) -> Column:
    escaped = value
    # Escapes inside double quotes; the backslash comes first.
    for raw, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(escape))
    return F.when(F.rlike(value, F.lit("[ \t\n]")), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def logfmt_of_map(record: Column) -> Column:
    def pair(entry: Column) -> Column:
        return F.concat(entry["key"], F.lit("="), quoted_value(F.coalesce(entry["value"], F.lit("<nil>"))))

    return F.array_join(F.transform(sorted_entries(record), pair), " ")


def logfmt_of_columns(df: DataFrame, names: list[str] | None = None) -> Column:
    """Null columns count as missing."""
    pairs = [
        F.when(field(n).isNotNull(), F.concat(F.lit(f"{n}="), quoted_value(as_text(df, n))))
        for n in sorted(names or df.columns)
    ]
    return F.concat_ws(" ", *pairs)


_OF_MAP = {"json": json_of_map, "text": text_of_map, "logfmt": logfmt_of_map}
_OF_COLUMNS = {"json": json_of_columns, "text": text_of_columns, "logfmt": logfmt_of_columns}


def render(
    df: DataFrame, style: str, names: list[str] | None = None, fields: str | None = None, dest: str = "line"
) -> DataFrame:
    """Add ``dest``: the record (a map column ``fields``, or columns) as one line."""
    style = style.lower()
    require(style in FORMATS, f"format: unknown format {style!r}")
    value = _OF_MAP[style](field(fields)) if fields else _OF_COLUMNS[style](df, names)
    return df.withColumn(dest, value)
