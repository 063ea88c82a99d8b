"""Benchmark decontamination by templates.

Numbers, quantities, units and names become typed placeholders, so that a
benchmark question with other numbers or names has the same template. Windows
of template tokens of documents and items meet by hash; the meetings of one
alignment must then fill the slots consistently: what stands for one thing in
the item stands for one thing in the document. Of an alignment that doesn't,
the longest run of windows that does counts. Windows also meet by their words
alone, without regard to case, so verbatim copies need no plain words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop_rows, row_key, table, text_or_empty
from tidelog.plans.sizing import maybe_broadcast

WINDOW = 10
LEAST_TOKENS = 3  # items with fewer tokens can't be told from chance and match nothing
# Templates with fewer plain words than this share say too little, for their slots could be anything: such windows meet by their words only.
LITERAL = 0.5

# A torn alignment's run of fewer windows may be free of conflict only because it holds one mention of each thing.
LEAST_RUN = 3

# Up to this many different window hashes of the benchmark travel to each task; beyond, windows are joined by a shuffle.
CARRIED = 2_000_000

# Names of units.
UNITS = frozenset(
    """% ° °c °f k mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms
    t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gal gallon gallons ms s sec second
    seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz v volt volts a amp amps w
    watt watts kw kwh j joule joules n newton newtons pa kpa mol kb mb gb tb byte bytes bit bits cent cents dollar dollars euro euros
    pence usd eur gbp percent degree degrees""".split()
)
NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*")
QUANTITY = re.compile(r"(?:[$€£¥][0-9][0-9.,]*[kmb]?|[0-9][0-9.,]*([^\W\d_]+|[%°][cf]?))")

LINE_END = "\u2029"  # stands for a line's end among a text's words
SPLIT_OFF = "!\"#&'()*,./:;<=>?@[\\]^_`{|}~–—…«»“”‘’„¿¡" + LINE_END

SIGNS = "%$€£¥°+-~"  # part of numbers, not of words

LITERAL_KIND, NAME, NUMBER_KIND, UNIT, QUANTITY_KIND = range(5)
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def kind_of(core: str) -> int:
    """The kind of a lower-case token by itself; whether it is a name depends on its place."""
    if core in UNITS and len(core) > 1 or core in "%°":
        return UNIT
    first = core[0]
    if first.isdigit() or first in "+-$€£¥":
        if NUMBER.fullmatch(core):
            return NUMBER_KIND
        if (found := QUANTITY.fullmatch(core)) and (found[1] is None or found[1] in UNITS):
            return QUANTITY_KIND
    return LITERAL_KIND


class Tokens(NamedTuple):
    """The tokens of a batch of texts."""

    kinds: np.ndarray
    fillers: np.ndarray  # hashes of their lower-case words
    opening: np.ndarray  # capitalised plain words that open a sentence: they may be names or not
    owner: np.ndarray  # the text of each
    offsets: np.ndarray  # of the texts


def tokens_of(texts: pa.Array) -> Tokens:
    """A token is a word less punctuation at its ends; words that are all punctuation are none.

    A capitalised plain word is a name unless it opens a text or a line or
    follows ``.``, ``!``, ``?`` or ``:``.
    """
    texts = pc.fill_null(texts, "")
    for end in "\n\r":
        texts = pc.replace_substring(texts, end, f" {LINE_END} ")
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    cores = pc.utf8_trim(words, characters=SPLIT_OFF)
    cores = pc.if_else(pc.utf8_is_alpha(pc.utf8_slice_codeunits(cores, 0, 1)), pc.utf8_rtrim(cores, characters=SPLIT_OFF + SIGNS), cores)
    lower = pc.utf8_lower(cores).to_numpy(zero_copy_only=False)
    capital = pc.utf8_is_upper(pc.utf8_slice_codeunits(cores, 0, 1)).to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(words, f"[.!?:{LINE_END}][\"')\\]»”’]*$").to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(cores, "^[0-9+$€£¥%°-]").to_numpy(zero_copy_only=False)
    filler = np.fromiter(map(xxhash.xxh64_intdigest, lower), U, len(lower))
    kind = np.fromiter((kind_of(w) if (o or w in UNITS) and w else LITERAL_KIND for w, o in zip(lower, odd.tolist())), np.int64, len(lower))
    real = pc.binary_length(cores).to_numpy(zero_copy_only=False) > 0
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(real[at])
    owner = np.repeat(np.arange(len(n)), n)[keep]
    ended = np.concatenate([[0], np.cumsum(ends[at])])[keep]  # sentence ends before each token
    kinds, fillers = kind[at[keep]], filler[at[keep]]
    opens = np.ones(len(keep), bool)
    opens[1:] = (ended[1:] != ended[:-1]) | (owner[1:] != owner[:-1])
    proper = (kinds == LITERAL_KIND) & capital[at[keep]]
    kinds[proper & ~opens] = NAME
    return Tokens(kinds, fillers, proper & opens, owner, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64))


def windows(tokens: Tokens, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """All windows within one text, in up to three forms: length, hashes, where each starts, all tokens' kinds in that form, whether by words alone.

    As a template with enough plain words; if of full length, also with the
    words that open sentences taken for names; and by its words alone, where
    every token is plain.
    """
    if not lengths:
        return
    named = np.where(tokens.opening, NAME, tokens.kinds)
    forms = [(tokens.kinds, LITERAL, GOLDEN), (named, LITERAL, GOLDEN), (np.zeros_like(tokens.kinds), 0.0, U(0xD1B54A32D192ED03))]
    opened = np.concatenate([[0], np.cumsum(tokens.opening)])
    for kinds, share, seed in forms:
        token = np.where(kinds == LITERAL_KIND, tokens.fillers, mix(kinds.astype(U) * GOLDEN))
        plain = np.concatenate([[0], np.cumsum(kinds == LITERAL_KIND)])
        h = np.full(len(token), seed, U)
        for length in range(1, max(lengths) + 1):
            n = len(token) - length + 1
            if n <= 0:
                break
            h = mix(h[:n] * GOLDEN + token[length - 1 :])
            if length not in lengths or (kinds is named and length < WINDOW):
                continue
            fits = (tokens.owner[:n] == tokens.owner[length - 1 :]) & (plain[length:] - plain[:-length] >= length * share)
            if kinds is named:
                fits &= opened[length:] > opened[:-length]
            at = np.flatnonzero(fits)
            yield length, mix(h[at] ^ U(length)), at, kinds, share == 0


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the items; an item shorter than a window is one window of its own length."""
    for batch in batches:
        tokens = tokens_of(batch.column("text"))
        sizes = np.diff(tokens.offsets)
        for length, h, at, kinds, words in windows(tokens, sorted({min(WINDOW, n) for n in sizes.tolist() if n >= LEAST_TOKENS})):
            row = tokens.owner[at]
            own = np.minimum(sizes[row], WINDOW) == length
            h, at, row = h[own], at[own], row[own]
            yield from out(batch.column("id").take(pa.array(row)), None, h, at, tokens.offsets[row], length, kinds, tokens.fillers, words)


def out(ids: pa.Array, keys: pa.Array | None, h, at, place, length, kinds, fillers, words) -> Iterator[pa.RecordBatch]:
    if not len(h):
        return
    cells = at[:, None] + np.arange(length)
    ends = pa.array(np.arange(0, (len(h) + 1) * length, length), pa.int32())
    columns = {"id": ids} | ({"key": keys} if keys is not None else {})
    columns |= {
        "hash": pa.array(h.view(np.int64)),
        "place": pa.array(at - place),
        "words": pa.repeat(words, len(h)),
        "kinds": pa.ListArray.from_arrays(ends, pa.array(kinds[cells].reshape(-1).astype(np.int32))),
        "fillers": pa.ListArray.from_arrays(ends, pa.array(fillers[cells].reshape(-1).view(np.int64))),
    }
    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


WINDOW_SCHEMA = "hash long, place long, words boolean, kinds array<int>, fillers array<long>"


def document_windows(lengths: list[int], wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of documents: those with a hash in ``wanted`` (sorted), or all."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            bits = np.zeros(1 << 22, bool)  # most hashes are ruled out by one look
            bits[(wanted & U((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            tokens = tokens_of(batch.column("text"))
            for length, h, at, kinds, words in windows(tokens, lengths):
                if wanted is not None:
                    some = np.flatnonzero(bits[(h & U((1 << 22) - 1)).astype(np.int64)])
                    some = some[wanted[np.minimum(np.searchsorted(wanted, h[some]), len(wanted) - 1)] == h[some]] if len(wanted) else some[:0]
                    h, at = h[some], at[some]
                row = tokens.owner[at]
                take = pa.array(row)
                yield from out(batch.column("id").take(take), batch.column("key").take(take), h, at, tokens.offsets[row], length, kinds, tokens.fillers, words)

    return find


def consistent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one window of one alignment: its slots as (item's kind and filler, document's filler) pairs, and whether one differs."""
    for batch in batches:
        kinds = batch.column("kinds")
        flat, ends = kinds.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(kinds).to_numpy())])
        theirs, ours = (batch.column(c).flatten().to_numpy() for c in ("item_fillers", "fillers"))
        slot = flat != LITERAL_KIND
        some = len(ends) > 1
        counts = np.add.reduceat(slot, ends[:-1], dtype=np.int64) if some else np.empty(0, np.int64)
        differs = np.logical_or.reduceat(theirs != ours, ends[:-1]) if some else np.empty(0, bool)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        keys = mix(theirs.view(U)[slot] ^ (flat[slot].astype(U) * GOLDEN)).view(np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(keys), pa.array(ours[slot])], ["of", "to"])
        names = ["id", "key", "item_id", "shift", "place", "words"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(differs), pa.ListArray.from_arrays(offsets, pairs)], [*names, "d", "slots"]
        )


def longest_run(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one alignment in one document's text: the longest run of its windows that fills the slots consistently.

    ``windows`` of it, and whether a slot differs from the item's there. The
    rows are one window each, so there are no more than the text has tokens.
    """
    rows = rows.sort_values("place")
    slots = [[(s["of"], s["to"]) for s in some] for some in rows["slots"]]
    differs = np.concatenate([[0], np.cumsum(rows["d"])])
    best, start, held = (0, False), 0, {}  # held: each slot's filler and how many of the run's windows have it
    for end, pairs in enumerate(slots):
        own = dict(pairs)
        if len(own) < len(set(pairs)):  # the window contradicts itself
            start, held = end + 1, {}
            continue
        while any(of in held and held[of][0] != to for of, to in own.items()):
            for of in dict(slots[start]):
                held[of][1] -= 1
                if not held[of][1]:
                    del held[of]
            start += 1
        for of, to in own.items():
            held.setdefault(of, [to, 0])[1] += 1
        best = max(best, (end + 1 - start, bool(differs[end + 1] == differs[start])))
    n, same = best
    found = rows[["id", "key", "item_id", "shift"]].iloc[: int(n >= LEAST_RUN)]
    return found.assign(windows=n, reworded=not same)


RUN_SCHEMA = "id long, key long, item_id long, shift long, windows long, reworded boolean"
RUN_COLUMNS = ("id", "key", "item_id", "shift", "windows", "reworded")


def contaminated(docs: DataFrame, benchmark: DataFrame, carried: int = CARRIED) -> DataFrame:
    """A row per document and item that meet: ``__id``, ``__key`` of the row, ``item_id``, ``windows``, ``reworded``.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``; null texts have no windows, null ids stay null. ``windows``
    counts the windows of the best alignment: all, if its slots are filled
    consistently; else those filled as in the item or, if there are none, those
    of its longest consistent run, of three windows at least. ``reworded`` says
    whether a slot differs among them. Rows equal in id and text count once. Items of fewer than
    three tokens match nothing, shorter ones than a window only as a whole.
    Texts of any length are tokenised whole; a task holds one batch of them.
    """
    items = table(benchmark.select(F.col("item_id").cast("long").alias("id"), text_or_empty().alias("text")).mapInArrow(item_windows, f"id long, {WINDOW_SCHEMA}"), "items")
    lengths = [r[0] for r in items.select(F.size("kinds")).distinct().collect()]  # at most the window's length
    hashes = items.select("hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), text_or_empty().alias("text"))
    few = hashes.limit(carried + 1).count() <= carried
    wanted = np.sort(np.array([r[0] for r in hashes.collect()], np.int64).view(U)) if few else None
    found = rows.mapInArrow(document_windows(sorted(lengths), wanted), f"id long, key long, {WINDOW_SCHEMA}")
    found = table(found if few else found.join(hashes, "hash", "left_semi"), "meetings")
    right = maybe_broadcast(items.select(F.col("id").alias("item_id"), "hash", F.col("place").alias("item_place"), F.col("kinds").alias("item_kinds"), F.col("fillers").alias("item_fillers")))
    met = found.join(right, "hash").filter((F.col("kinds") == F.col("item_kinds")) & (~F.col("words") | (F.col("fillers") == F.col("item_fillers"))))
    met = met.withColumn("shift", F.col("place") - F.col("item_place"))
    slots = met.select("id", "key", "item_id", "shift", "place", "words", "kinds", "fillers", "item_fillers").mapInArrow(
        consistent, "id long, key long, item_id long, shift long, place long, words boolean, d boolean, slots array<struct<of:long,to:long>>"
    )
    alignment = ["id", "key", "item_id", "shift"]
    # A window may meet in several forms: that of the fewest slots counts, by words alone only if there is no other.
    one = slots.groupBy(*alignment, "place").agg(F.min_by("slots", F.struct("words", F.size("slots"))).alias("slots"), F.max("d").alias("d"))
    counted = table(one, "slots")
    sizes = counted.groupBy(*alignment).agg(F.count("*").alias("windows"), F.max("d").alias("reworded"), F.count_if(~F.col("d")).alias("same"))
    filled = counted.select(*alignment, F.explode("slots").alias("s")).groupBy(*alignment, "s.of").agg(F.min("s.to").alias("least"), F.max("s.to").alias("most"))
    torn = filled.filter("least <> most").select(*alignment).distinct().withColumn("torn", F.lit(True))
    judged = table(null_safe_left(sizes, torn, alignment), "judged")
    whole = judged.filter("torn IS NULL").select(*RUN_COLUMNS)
    same = judged.filter("torn AND same > 0").select(*alignment, F.col("same").alias("windows"), F.lit(False).alias("reworded"))
    open_ = judged.filter("torn AND same = 0").select(*alignment, "torn")
    runs = null_safe_left(counted, open_, alignment).filter("torn").drop("torn").groupBy(*alignment).applyInPandas(longest_run, RUN_SCHEMA)
    best = F.max_by(F.struct("windows", "reworded"), F.struct("windows", ~F.col("reworded"), F.col("shift")))
    every = whole.unionByName(same).unionByName(runs)
    return every.groupBy("id", "key", "item_id").agg(best.alias("b")).select(F.col("id").alias("__id"), F.col("key").alias("__key"), "item_id", "b.windows", "b.reworded")


def null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    met = left[keys[0]].eqNullSafe(renamed[f"__r_{keys[0]}"])
    for k in keys[1:]:
        met = met & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, met, "left").drop(*[f"__r_{k}" for k in keys])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item, re-parameterised ones included."""
    return drop_rows(docs, table(contaminated(docs, benchmark), "contaminated"))
