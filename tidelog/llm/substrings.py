"""Substring deduplication: passages of 35 and more words that occur again are found by seed and extension.

Seeds are winnowed anchors: of every 28 neighbouring 8-word hashes the least,
so any two equal runs of 35 words have the same anchor at the same place. An
anchor's stretch is all the text that its windows reach, to both sides.
Occurrences with equal stretches are one class, however many they are; only
stretches that differ are extended step by step, by comparing the windows
that reach d words to the left and the rest to the right for each d. Repeated
windows that overlap join into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import row_key, table, text_or_empty, word_hashes
from tidelog.plans.sizing import maybe_broadcast

LENGTH = 35  # words of a repeat
SEED = 8  # words of an anchor
REACH = LENGTH - SEED + 1  # neighbouring seeds in one window

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = U(pow(int(BASE), -1, 1 << 64))
LOW = U(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class Runs:
    """Hashes of any runs of one text's words, from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(words) * powers(BASE, n), dtype=U)])
        self.back = powers(INVERSE, n + 1)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(U))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one text: anchor hash, stretch hash, first window, windows."""
    runs = Runs(words)
    seeds = runs.hash(np.arange(len(words) - SEED + 1), SEED)
    # Upper half: the seed's order; lower half: its place, so that of equal seeds the last is least.
    ranked = (seeds & ~LOW) | (LOW - np.arange(len(seeds)).astype(U))
    least, span = ranked, 1
    while span < REACH:  # least of the REACH seeds from each place on
        step = min(span, REACH - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = (LOW - (least & LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    at = place[first]
    stretch = mix(runs.hash(first, count + LENGTH - 1) + (at - first).astype(U) * BASE)
    return seeds[at], stretch, first, count


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("words")
        offsets, words = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(U)
        found, rows = [], []
        for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
            found.append(anchors(words[offsets[i] : offsets[i + 1]]))
            rows.append(np.full(len(found[-1][0]), i))
        if found:
            anchor, stretch, first, count = (np.concatenate(f) for f in zip(*found))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("key").take(take), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["id", "key", "anchor", "stretch", "first", "count"],
            )


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the stretches asked for: a hash for each extension of the anchor to left and right."""
    for batch in batches:
        column = batch.column("words")
        offsets, words = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(U)
        for i, stretches in enumerate(batch.column("stretches").to_pylist()):
            runs = Runs(words[offsets[i] : offsets[i + 1]])
            first = np.array([s["first"] for s in stretches], np.int64)
            count = np.array([s["count"] for s in stretches], np.int64)
            start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            anchor = np.repeat(np.array([s["anchor"] for s in stretches], np.int64), count)
            n = len(start)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.full(n, i))), batch.column("key").take(pa.array(np.full(n, i))), pa.array(anchor), pa.array(runs.hash(start, LENGTH).view(np.int64)), pa.array(start.astype(np.int32))],
                ["id", "key", "anchor", "window", "first"],
            )


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats of each row: its repeated windows, joined where they touch, as [start, end, start, end, ...]."""
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            flat: list[int] = []
            for span in sorted((s["first"], s["first"] + s["count"] + LENGTH - 1) for s in spans):
                if flat and span[0] <= flat[-1]:
                    flat[-1] = max(flat[-1], span[1])
                else:
                    flat += span
            merged.append(flat)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(merged, pa.list_(pa.int32()))], ["id", "key", "repeats"])


def repeats(docs: DataFrame) -> DataFrame:
    """Per row with repeats: ``__id``, ``__key`` and ``__repeats``, the word spans of its maximal repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), text_or_empty().alias("text"))
    seeds = table(rows.select("id", "key", word_hashes(F.col("text")).alias("words")).mapInArrow(find_anchors, "id long, key long, anchor long, stretch long, first int, count int"), "anchors")
    classes = seeds.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "first", "count")).alias("one"))
    shared = table(classes, "classes")
    anchors_shared = shared.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1").select("anchor")
    whole = shared.filter("n > 1").select("anchor", "stretch")
    # Occurrences of equal stretches: all their windows are repeated.
    spans = seeds.join(whole, ["anchor", "stretch"], "left_semi").select("id", "key", "first", "count")
    # One occurrence of each of several stretches about one anchor is extended.
    asked = shared.join(anchors_shared, "anchor", "left_semi").select("anchor", "one.*")
    asked = table(asked.groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "first", "count")).alias("stretches")), "asked")
    small = maybe_broadcast(asked.withColumnsRenamed({"id": "r_id", "key": "r_key"}))
    met = rows.join(small, (F.col("key") == F.col("r_key")) & F.col("id").eqNullSafe(F.col("r_id"))).select("id", "key", word_hashes(F.col("text")).alias("words"), "stretches")
    # Rows equal in id and text are met several times: each place counts once here, their classes have them already.
    steps = table(met.mapInArrow(extend, "id long, key long, anchor long, window long, first int"), "windows").distinct()
    again = steps.groupBy("anchor", "window").count().filter("count > 1").select("anchor", "window")
    stepped = steps.join(again, ["anchor", "window"], "left_semi").select("id", "key", "first", F.lit(1).alias("count"))
    grouped = spans.union(stepped).groupBy("id", "key").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    return grouped.mapInArrow(merge_spans, "id long, key long, repeats array<int>").withColumnsRenamed({"id": "__id", "key": "__key", "repeats": "__repeats"})


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts less their repeats: counts of words and the kept words joined by spaces."""
    for batch in batches:
        lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
        words, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        real = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0) if len(words) else np.empty(0, bool)
        counts, gone, kept = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            own = words.slice(ends[i], ends[i + 1] - ends[i]).filter(pa.array(real[ends[i] : ends[i + 1]]))
            keep = np.ones(len(own), bool)
            for a, b in zip(spans[::2], spans[1::2]) if spans else ():
                keep[a:b] = False
            counts.append(len(own))
            gone.append(int((~keep).sum()))
            kept.append(" ".join(own.filter(pa.array(keep)).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``n_removed`` and the ``text`` of its kept words.

    Removed is each word within a run of 35 words that also starts elsewhere,
    in the same document or another; all occurrences go. Words are runs of
    anything but ASCII white space. A null or empty text has no words. Rows
    equal in id and text are different rows and repeat each other.
    """
    found = maybe_broadcast(table(repeats(docs), "repeats"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("__k"))
    met = rows.join(found, (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return met.select("doc_id", F.col("text").cast("string").alias("text"), F.col("__repeats").alias("spans")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, text string")
