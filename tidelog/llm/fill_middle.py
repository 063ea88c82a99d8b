"""Fill-in-the-middle examples: each text cut at two ranks that an indexable skip list resolves to code points."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import text_or_empty

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CODE_POINT = "(?s:.)"

# One boundary in this many of a lane is in the lane above.
FAN = 4

# Text sent back to Spark at once; a longer text goes alone.
BATCH_BYTES = 32 << 20


class Towers:
    """Which boundaries stand in which lane, the same for every text: a boundary's height comes from its rank's hash.

    Lane 0 holds all boundaries and is not stored. For each lane above:
    ``ranks``, its boundaries in order, and ``down``, where each stands in the
    lane below. Grows to the longest text seen, by half of its length in
    numbers over all lanes.
    """

    def __init__(self):
        self.size, self.ranks, self.down = 0, [], []

    def upto(self, n: int) -> None:
        if n < self.size:
            return
        self.size = 1 << (n + 1).bit_length()
        x = np.arange(self.size, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        self.ranks, self.down = [], []
        below = np.arange(self.size)
        while len(below) > 1:
            x //= np.uint64(1 if not self.ranks else FAN)
            up = x % np.uint64(FAN) == 0
            up[0] = True  # the head stands in every lane
            if up.all():
                break
            self.down.append(np.flatnonzero(up))
            below, x = below[up], x[up]
            self.ranks.append(below)


class SkipList:
    """The units of one text under express lanes; a link carries how many units and how many code points it spans."""

    def __init__(self, n: int, ends: np.ndarray | None, towers: Towers):
        """``ends`` are the code points before each of the ``n + 1`` boundaries; None where a unit is a code point."""
        self.n, self.ends = n, ends
        towers.upto(n)
        self.lanes = []
        for ranks, down in zip(towers.ranks, towers.down):
            count = int(np.searchsorted(ranks, n, "right"))
            if count < 2:
                break
            units = np.diff(ranks[:count])
            chars = units if ends is None else np.diff(ends[ranks[:count]])
            self.lanes.append((units, chars, down))

    def find(self, rank: int) -> int:
        """The code points before the boundary of this rank."""
        if not 0 <= rank <= self.n:
            raise IndexError("skip list: no such rank")
        at = units = chars = 0
        for unit_width, char_width, down in reversed(self.lanes):
            while at < len(unit_width) and units + unit_width[at] <= rank:
                units += int(unit_width[at])
                chars += int(char_width[at])
                at += 1
            at = int(down[at])
        while units < rank:
            chars += 1 if self.ends is None else int(self.ends[units + 1] - self.ends[units])
            units += 1
        return chars


def boundaries(text: str, unit: re.Pattern) -> np.ndarray:
    """Code points before each boundary: matches from left to right are units, and so is each code point outside of them."""
    ends, at = [0], 0
    for found in unit.finditer(text):
        if found.end() > found.start():
            ends.extend(range(at + 1, found.start() + 1))
            ends.append(at := found.end())
    ends.extend(range(at + 1, len(text) + 1))
    return np.array(ends, np.int64)


def cutter(unit: str, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the results to batches whose first ``width`` columns are the input's and the last four text, form and two draws."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        towers, pattern = Towers(), None if unit == CODE_POINT else re.compile(unit)
        for batch in batches:
            texts, forms, first, second = batch.columns[-4:]
            rows, start, held = ([], [], [], []), 0, 0
            for i in range(batch.num_rows):
                text, form = texts[i].as_py(), forms[i].as_py()
                ends = None if pattern is None else boundaries(text, pattern)
                n = len(text) if ends is None else len(ends) - 1
                a = b = None
                output = text
                if form != "plain":
                    ranks = sorted(draw[i].as_py() % (n + 1) for draw in (first, second))
                    units = SkipList(n, ends, towers)
                    a, b = map(units.find, ranks)
                    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
                    output = suffix + prefix + middle if form == "spm" else prefix + suffix + middle
                for column, value in zip(rows, (n, a, None if a is None else b - a, output)):
                    column.append(value)
                held += 4 * len(output)
                if held > BATCH_BYTES or i + 1 == batch.num_rows:
                    new = [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                    kept = [c.slice(start, i + 1 - start) for c in batch.columns[:width]]
                    form_column = forms.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*kept, new[0], form_column, *new[1:]], [*batch.schema.names[:width], *RESULT])
                    rows, start, held = ([], [], [], []), i + 1, 0

    return cut


# The columns added, with their types.
RESULT = {"__n": "long", "__form": "string", "__prefix_chars": "long", "__middle_chars": "long", "__output": "string"}


def draws(seed: int, id_column: str) -> list[Column]:
    """Four numbers below 2**32 that depend on the seed and the row's id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, *, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = CODE_POINT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with ``__n``, ``__form``, ``__prefix_chars``, ``__middle_chars`` and ``__output``.

    A text of n units is cut at two ranks drawn from 0 to n: prefix, middle and
    suffix, put out as prefix, suffix, middle (``psm``) or suffix, prefix,
    middle (``spm``, for ``spm`` in a hundred), each behind its sentinel. A
    ``unit`` is a match of that pattern, or a code point that no match covers;
    a code point each if none is given. The draws come from ``seed`` and the
    id, so a repeated run gives the same examples.

    ``plain``, the text as it is, are (100 - ``rate``) in a hundred, empty
    texts, and texts that hold a sentinel, as they could not be restored. A null
    text is empty. A null id draws as the empty id. Rows of one id draw alike,
    repeated rows give the same example each. Texts of any length are cut whole;
    a skip list takes about half a text's length in numbers. Other columns pass
    unchanged; a column named as one of the results is an error.
    """
    clash = set(RESULT) & set(docs.columns)
    if clash:
        raise ValueError(f"fill_in_middle: columns named as its results: {sorted(clash)}")
    at = docs.columns.index(text_column)
    text = text_or_empty(f"c{at}")
    one, two, three, four = draws(seed, f"c{docs.columns.index(id_column)}")
    sentinel = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | sentinel | (three % 100 >= rate), "plain").when(four % 100 < spm, "spm").otherwise("psm")
    # Arrow functions take no dots in names, so the input's columns travel by number.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = rows.select("*", text.alias("__text"), form.alias("__form"), one.alias("__one"), two.alias("__two"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(cutter(unit, len(docs.columns)), schema).toDF(*docs.columns, *RESULT)


def restore(output: Column, form: Column) -> Column:
    """The text that an example was made from. Each sentinel is in an example once, unless it is plain."""

    def between(after: str, before: str) -> Column:
        return F.substring_index(F.substring_index(output, before, 1), after, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
