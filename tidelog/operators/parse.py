"""Parsing text lines into ``map<string,string>`` records.

Parsers are column expressions. A line that does not parse gives a null map;
:func:`parse_lines` turns that into an ``_error``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import field, let, words
from tidelog.functions.layouts import format_time
from tidelog.specs import Scoped, require

FORMATS = ("json", "logfmt")

# Fixed value: words in which double quotes protect white space.
_QUOTED_WORDS = r'((?:[^\s"]|"(?:[^"\\]|\\.)*"?)+)'


def parse_json(line: Column) -> Column:
    """A JSON object as a map of texts; integers keep all digits, nested values are JSON.

    Strict: nothing may follow the object, quotes are double, NaN is no
    number. The last of equal keys wins.
    """
    # A reader stops at the end of the first value. Within an object and within an array
    # between them, whatever follows the line's object breaks one or the other.
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    held = F.from_json(F.concat(F.lit('{"x":'), line, F.lit("}")), "x map<string,string>", strict)["x"]
    alone = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    return F.when(alone, let(held, lambda m: F.map_from_entries(F.map_entries(m))))


def _pairs(tokens: Column) -> Column:
    """The ``key=value`` words as entries, quotes around values removed."""
    with_equals = F.filter(tokens, lambda w: F.contains(w, F.lit("=")))

    def pair(word: Column) -> Column:
        return F.struct(
            F.substring_index(word, "=", 1).alias("key"),
            F.btrim(F.substring(word, F.instr(word, "=") + 1, F.length(word)), F.lit('"')).alias("value"),
        )

    return F.transform(with_equals, pair)


def parse_logfmt(line: Column, quoted: bool = False) -> Column:
    """``key=value`` words; the first bare word is ``msg`` unless a ``msg=`` came before.

    The last of equal keys wins. ``quoted`` lets quotes protect blanks.
    """

    def record(tokens: Column) -> Column:
        bare = F.get(F.filter(tokens, lambda w: ~F.contains(w, F.lit("="))), 0)
        # A bare word only counts while there is no msg, so it goes first: any
        # msg=... then wins, wherever it stands.
        head = F.array_compact(
            F.array(F.when(bare.isNotNull(), F.struct(F.lit("msg").alias("key"), bare.alias("value"))))
        )
        return F.when(F.size(tokens) > 0, F.map_from_entries(F.concat(head, _pairs(tokens))))

    return let(F.regexp_extract_all(line, F.lit(_QUOTED_WORDS), 1) if quoted else words(line), record)


def extract_kv(line: Column) -> Column:
    """``key=value`` words plus the whole line as ``_raw``; bare words are ignored."""
    raw = F.array(F.struct(F.lit("_raw").alias("key"), line.alias("value")))
    return F.map_from_entries(F.concat(raw, _pairs(words(line))))


def add_time(record: Column, ingest: Column) -> Column:
    """``time`` from the ingest timestamp where the record has none."""
    stamp = F.create_map(F.lit("time"), format_time(ingest))
    return F.when(F.map_contains_key(record, "time"), record).otherwise(F.map_concat(record, stamp))


@dataclass(frozen=True)
class ParserChoice:
    """Checked parser name; any case is accepted."""

    name: str = "json"

    def __post_init__(self):
        require(self.name.lower() in FORMATS, f"parse: unsupported format {self.name!r}")

    def column(self, line: Column, quoted: bool) -> Column:
        return parse_json(line) if self.name.lower() == "json" else parse_logfmt(line, quoted)


def parse_lines(
    df: DataFrame, parser: str | Scoped = "json", line: str = "line", ingest: str | None = None,
    dest: str = "fields", quoted: bool = False,
) -> DataFrame:
    """Parse ``line`` with the source's parser into ``dest``; failures go to ``_error``."""
    scoped = Scoped.of(parser)
    text = field(line)
    default = ParserChoice(scoped.default or "json")
    cases = None
    for source, name in scoped.by_source.items():
        hit, value = field(scoped.source) == source, ParserChoice(name).column(text, quoted)
        cases = F.when(hit, value) if cases is None else cases.when(hit, value)
    record = default.column(text, quoted) if cases is None else cases.otherwise(default.column(text, quoted))
    out = df.withColumn(dest, record)
    if ingest:
        out = out.withColumn(dest, add_time(field(dest), field(ingest).cast("timestamp")))
    return out.withColumn("_error", F.when(field(dest).isNull(), F.lit("parse: line does not parse")))


def promote(df: DataFrame, names: list[str], fields: str = "fields", prefix: str = "") -> DataFrame:
    """Entries of a record map as columns; a missing entry is null."""
    return df.withColumns({prefix + n: F.try_element_at(field(fields), F.lit(n)) for n in names})

