"""Near duplicates: BagMinHash signatures of word-shingle bags, banded, verified by exact bag overlap, grouped.

A text's bag holds its runs of five lower-cased words with their counts (all
its words as one run if it has fewer). The signature estimates the weighted
Jaccard similarity of bags without bias. Documents that share a band are
candidates; candidates are linked if their bags overlap by 0.8 or more; classes
are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, drop_rows, row_key, table, text_or_empty, word_hashes
from tidelog.plans.sizing import maybe_broadcast

SHINGLE = 5
BANDS, ROWS = 25, 5  # a pair at 0.8 shares a band with probability 0.99995
SLOTS = BANDS * ROWS
# Similarity 0.8: overlap / (a + b - overlap) >= 4/5.
LIKE, LIKE_OF = 4, 5

CELL_NODES, CELL_ELEMENTS = 256, 2_000_000  # of one block; a cell compares two
CELL_COLUMNS = 4_096
BLOCK_WORDS = 500_000  # words of so many documents are in a worker's arrays at a time

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def exponential(h: np.ndarray) -> np.ndarray:
    return -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of a block, and each shingle's text."""
    n = np.diff(offsets)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(offsets[:-1], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(SHINGLE, n)[owner]
    padded = np.concatenate([words, np.zeros(SHINGLE, U)])
    out = length.astype(U)
    for i in range(SHINGLE):
        out = mix(out * GOLDEN + np.where(i < length, padded[first + i], U(0)))
    return out, owner


def bags(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: hash, text, count."""
    hashes, owner = shingles(words, offsets)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def points_within(x: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points up to time ``limit`` of each element's Poisson processes: element, slot, time.

    An element of weight w owns the levels (0, 1], (1, 2], ..., (w - 1, w]; each
    level is a process of rate one per slot. Levels hang in dyadic trees over
    (0, 1], (1, 2], (2, 4], (4, 8], ...; a node's state is the first point of
    all levels below it. Splitting a node hands that point to one half, by a
    coin of the element and node, and draws the other half's first point after
    it (the process has no memory). So what a tree produces depends on the
    element alone, the weight only says which levels count, and a node whose
    first point is past the limit is dropped with all below it.
    """
    element, start, size = [], [], []
    octave = 1
    every = np.arange(len(x))
    element.append(every), start.append(np.zeros(len(x), np.int64)), size.append(np.ones(len(x), np.int64))
    while len(every := every[count[every] > octave]):
        element.append(every)
        start.append(np.full(len(every), octave, np.int64))
        size.append(np.full(len(every), octave, np.int64))
        octave *= 2
    element, start, size = map(np.concatenate, (element, start, size))

    def seed(element, start, size, step):
        return mix(mix(x[element] ^ (start.astype(U) * GOLDEN)) + (size.astype(U) << U(32)) + step.astype(U))

    step = np.zeros(len(element), np.int64)
    h = seed(element, start, size, step)
    time, slot = exponential(h) / (SLOTS * size), mix(h + GOLDEN) % U(SLOTS)
    found = []
    while True:
        live = (time <= limit[element]) & (start < count[element])
        element, start, size, step, time, slot = (v[live] for v in (element, start, size, step, time, slot))
        if not len(element):
            break
        leaf = size == 1
        found.append((element[leaf], slot[leaf], time[leaf]))
        # A level's next point.
        e, s, z, k = element[leaf], start[leaf], size[leaf], step[leaf] + 1
        h = seed(e, s, z, k)
        after = (e, s, z, k, time[leaf] + exponential(h) / SLOTS, mix(h + GOLDEN) % U(SLOTS))
        # The halves of a node: the one hit keeps the point, the other draws its own.
        e, s, z, t, p = (v[~leaf] for v in (element, start, size, time, slot))
        half = z // 2
        right = (mix(seed(e, s, z, np.zeros(len(e), np.int64)) ^ GOLDEN) & U(1)).astype(np.int64)
        hit = (e, s + right * half, half, np.zeros(len(e), np.int64), t, p)
        other = s + (1 - right) * half
        h = seed(e, other, half, np.zeros(len(e), np.int64))
        missed = (e, other, half, np.zeros(len(e), np.int64), t + exponential(h) / (SLOTS * half), mix(h + GOLDEN) % U(SLOTS))
        element, start, size, step, time, slot = (np.concatenate(v) for v in zip(after, hit, missed))
    if not found:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0)
    return tuple(np.concatenate(v) for v in zip(*found))


def signatures(x: np.ndarray, owner: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """The least point of each slot for each text (rows; infinite for texts without shingles).

    Points are drawn up to a time by which all slots are likely hit; texts
    with an empty slot are drawn again to twice that time, so the limit never
    shows in the result.
    """
    least = np.full((texts, SLOTS), np.inf)
    weight = np.bincount(owner, count, texts)
    limit = (np.log(SLOTS) + 5) / np.maximum(weight, 1)
    open_texts = weight > 0
    while open_texts.any():
        some = np.flatnonzero(open_texts[owner])
        element, slot, time = points_within(x[some], count[some], limit[owner[some]])
        np.minimum.at(least.reshape(-1), owner[some][element] * SLOTS + slot.astype(np.int64), time)
        open_texts &= np.isinf(least).any(axis=1)
        limit *= 2
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    bits = least.view(U).reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U), bits.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * GOLDEN + bits[:, :, i])
    return key


def block_ranges(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[start] >= BLOCK_WORDS:
            yield start, i
            start = i
    if start < len(offsets) - 1:
        yield start, len(offsets) - 1


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(U), offsets


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, offsets = words_of(batch.column("words"))
        for a, b in block_ranges(offsets):
            own, at = words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            x, owner, count = bags(own, at)
            keys = band_keys(signatures(x, owner, count, b - a))
            total = np.bincount(owner, count, b - a).astype(np.int64)
            place = (np.arange(len(own)) - np.repeat(at[:-1], np.diff(at))).astype(U)
            sums = []
            for salt in (1, 2):  # 128 bits of the sequence of words
                mixed = np.concatenate([[U(0)], np.cumsum(mix(own * U(2 * salt + 1) + mix(place + U(salt))))])
                sums.append(mix((mixed[at[1:]] - mixed[at[:-1]]) + np.diff(at).astype(U) * GOLDEN).view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(sums[0]), pa.array(sums[1]), pa.array(total), bands],
                ["id", "key", "node", "check", "size", "bands"],
            )


def expand_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags as sets: the i-th copy of a shingle is an element of its own."""
    for batch in batches:
        words, offsets = words_of(batch.column("words"))
        for a, b in block_ranges(offsets):
            x, owner, count = bags(words[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            elements = mix(np.repeat(x, count) + copy.astype(U) * GOLDEN).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, count, b - a))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(elements))], ["node", "bag"])


def words_column():
    return word_hashes(F.lower(text_or_empty()))


def similar_size(a: Column, b: Column) -> Column:
    """A necessary condition: bags of similarity 0.8 differ in size by no more."""
    return F.least(a, b) * LIKE_OF >= F.greatest(a, b) * LIKE


def compare_cell(key: tuple, cell: pa.Table) -> pa.Table:
    """All pairs of one cell by counts of common elements; a spanning forest of those that are links."""
    nodes, blocks = cell["node"].to_numpy(), cell["block"].to_numpy()
    lists = cell["bag"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    element, times = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    common = np.bincount(times, minlength=len(element)) > 1
    owner, column = owner[common[times]], (np.cumsum(common) - 1)[times[common[times]]]
    overlap = np.zeros((len(nodes), len(nodes)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(common.sum()), CELL_COLUMNS):
        at, to = np.searchsorted(column, [first, first + CELL_COLUMNS])
        part = np.zeros((len(nodes), CELL_COLUMNS), np.float32)
        part[owner[at:to], column[at:to] - first] = 1
        overlap += part @ part.T
    like = overlap * (LIKE + LIKE_OF) >= LIKE * (sizes[:, None] + sizes[None, :])
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    one = key[1].as_py() == key[2].as_py()
    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(like, 1)))):
        if (one or blocks[i] != blocks[j]) and (x := find(i)) != (y := find(j)):
            root[x] = y
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def link_candidates(members: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among nodes that share buckets (``bucket``, ``node``, ``size``); their components are those of all links.

    First each bucket's least node is compared with the bucket's others, which
    settles most groups of near copies in one linear step. What buckets tie
    together but links don't yet is a cluster: its nodes are dealt into
    blocks of bounded size, and each pair of blocks is a cell whose task
    compares all pairs at once and returns a spanning forest. So every
    candidate pair is compared, but none is ever a row.
    """
    centres = members.groupBy("bucket").agg(F.min_by(F.struct("node", "size"), "node").alias("c"))
    stars = table(members.join(centres, "bucket").filter("node <> c.node").select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.size").alias("size_a"), F.col("size").alias("size_b")).distinct(), "stars")
    clusters = table(components(stars.select("a", "b")).withColumnRenamed("component", "cluster"), "clusters")
    wanted = texts.join(clusters.select("node"), "node", "left_semi").select("node", F.col("id").alias("__id"), F.col("key").alias("__key"))
    rows = docs.select("doc_id", "text").join(maybe_broadcast(table(wanted, "wanted")), (row_key() == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    # Rows equal in id and text give equal bags: one is enough.
    found = table(rows.select("node", words_column().alias("words")).mapInArrow(expand_bags, "node long, bag array<long>").dropDuplicates(["node"]), "bags")
    near = stars.filter(similar_size(F.col("size_a"), F.col("size_b"))).select("a", "b")
    both = near.join(found.withColumnRenamed("node", "b"), "b").join(found.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    links = table(both.filter(F.size(F.array_intersect("bag", "bag_a")) * (LIKE + LIKE_OF) >= LIKE * (F.size("bag") + F.size("bag_a"))).select("a", "b"), "links")
    parts = clusters.join(components(links), "node", "left").withColumn("part", F.coalesce("component", "node"))
    open_ = parts.groupBy("cluster").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n")).filter("x < y").select("cluster", "n")
    placed = clusters.join(open_, "cluster").join(found, "node")
    weights = table(placed.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum(F.size("bag")) / CELL_ELEMENTS)).cast("int").alias("blocks")), "blocks")
    dealt = placed.join(weights, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.select("cluster", "node", "block", "bag", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "bag")
    return links.union(cells.groupBy("cluster", "i", "j").applyInArrow(compare_cell, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): ``__id``, ``__key`` of the row, ``class_id``, ``class_key``, ``class_size``, ``first``.

    ``class_id`` is the least document id of the class (null if it has none),
    ``class_key`` tells apart classes where one id has several texts;
    ``first`` marks one row of each class: the least id, then the least key
    (nulls last). Texts equal word by word, ignoring case and white space,
    are always one class; so are all texts without words, null ones included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), words_column().alias("words"))
    signed = table(rows.mapInArrow(sign, "id long, key long, node long, check long, size long, bands array<long>"), "signed")
    texts = table(signed.filter("size > 0").groupBy("node").agg(F.min_by(F.struct("id", "key", "size", "bands"), F.struct(F.col("id").isNull(), "id", "key")).alias("r")).select("node", "r.*"), "texts")
    buckets = texts.select("node", "size", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = table(buckets.join(shared, "bucket", "left_semi").select("bucket", "node", "size"), "members")
    links = link_candidates(members, texts, docs)
    placed = signed.select("id", "key", "node").join(components(links), "node", "left").withColumn("part", F.coalesce("component", "node"))
    order = F.struct(F.col("id").isNull(), "id", "key")
    classes = placed.groupBy("part").agg(F.min(order).alias("least"), F.count("*").alias("class_size"))
    return placed.join(classes, "part").select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("least.id").alias("class_id"), F.col("least.key").alias("class_key"), "class_size",
        (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key"))).alias("first"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; rows equal in id and text stay or go together, of those that stay one is kept."""
    classes = table(near_duplicates(docs), "classes")
    kept = drop_rows(docs, classes.filter("NOT first").select("__id", "__key"))
    return kept.dropDuplicates(["doc_id", "text"]) if classes.filter("first").groupBy("__id", "__key").count().filter("count > 1").limit(1).count() else kept
