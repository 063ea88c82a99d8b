"""Time layouts written as the reference time Mon Jan 2 15:04:05 MST 2006."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout elements and their datetime pattern letters.
ELEMENTS = {
    "January": "MMMM",
    "Jan": "MMM",
    "Monday": "EEEE",
    "Mon": "EEE",
    "MST": "z",
    "2006": "yyyy",
    "Z07:00": "XXX",
    "Z0700": "XX",
    "-07:00": "xxx",
    "-0700": "xx",
    "-07": "x",
    "01": "MM",
    "02": "dd",
    "03": "hh",
    "04": "mm",
    "05": "ss",
    "06": "yy",
    "15": "HH",
    "PM": "a",
    "_2": "d",
    "1": "M",
    "2": "d",
    "3": "h",
    "4": "m",
    "5": "s",
}

RFC3339 = "2006-01-02T15:04:05Z07:00"

_ELEMENT = re.compile(r"[.,][09]+(?!\d)|" + "|".join(re.escape(e) for e in ELEMENTS))


def datetime_pattern(layout: str, parsing: bool = False) -> str:
    """The datetime pattern of a layout; text between elements is quoted."""
    out, at = [], 0

    def literal(text: str) -> str:
        return "".join(f"'{w}'" if w.isalpha() else w for w in re.findall(r"[A-Za-z]+|[^A-Za-z]", text.replace("'", "''")))

    for match in _ELEMENT.finditer(layout):
        out.append(literal(layout[at : match.start()]))
        piece = match.group()
        if piece in ELEMENTS:
            out.append(ELEMENTS[piece])
            if parsing and ELEMENTS[piece] == "ss" and not re.match(r"[.,][09]", layout[match.end() :]):
                # A fraction after the seconds is accepted even if not laid out.
                out.append("[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")
        else:
            out.append(piece[0] + "S" * (len(piece) - 1))
        at = match.end()
    return "".join([*out, literal(layout[at:])])


def parse_any(text: Column, layouts: list[str]) -> Column:
    """The first layout that reads ``text``, as TIMESTAMP; null if none does."""
    tries = [F.try_to_timestamp(text, F.lit(datetime_pattern(layout, parsing=True))) for layout in layouts]
    return F.coalesce(*tries)


def format_time(ts: Column, layout: str = RFC3339) -> Column:
    return F.date_format(ts, datetime_pattern(layout))
