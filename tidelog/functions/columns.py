"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters, and the same as regex class content.
SPACES = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"\t-\r \x{85}\p{Z}"


def field(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column (either kind)."""
    column = field(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def from_micros(us: str | Column, like: str = "timestamp") -> Column:
    """The timestamp at ``us`` microseconds, as ``like`` type."""
    return F.timestamp_micros(us).cast(like)


def floor_div(value: Column, step: Column) -> Column:
    """Whole-number division, rounded down, without a detour through doubles."""
    return F.call_function("div", value - F.pmod(value, step), step)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_space(text: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Split at runs of white space, without empty words."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def cut_bytes(text: Column, size: int) -> Column:
    """The longest prefix of at most ``size`` bytes that ends between characters."""
    raw = F.encode(text, "utf-8")

    def inside(position: int) -> Column:
        # 80..BF are the bytes that continue a character.
        return F.hex(F.substring(raw, position, 1)).between("80", "BF")

    keep = F.lit(max(size - 3, 0))
    for back in (2, 1, 0):
        if size - back >= 0:
            keep = F.when(~inside(size - back + 1), F.lit(size - back)).otherwise(keep)
    return F.substring(raw, F.lit(1), keep).cast("string")
