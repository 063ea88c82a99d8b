"""Near duplicates by SimHash: fingerprints of word shingles, compared as vertical bit planes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import components, lookup, table, text_or_empty

U = np.uint64

SHINGLE = 4
SEED = 42
RADIUS = 4

# Bytes of a text that are split into words at once.
SEGMENT = 1 << 20

# A bucket of more nodes than this is split into blocks of about half as many.
BLOCK = 4_096

# Blocks are compared strip against strip, so that each is sent on once a strip, not once a block.
STRIP = 16

# Groups up to this size are compared together, each node with the k-th after it; larger ones node against block.
SHIFTED = 96

# Nodes of small groups taken together, and queries compared with a block at once.
CHUNK, QUERIES = 1 << 17, 256

# Planes counted before the first look for blocks to abandon, and between two looks.
FIRST_LOOK, LOOK = 18, 6

GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, a segment at a time."""
    import xxhash

    digest, held, at, whole = xxhash.xxh64_intdigest, [], 0, True
    while at < len(data) or whole:
        gap = GAP.search(data, at + SEGMENT)
        end = gap.start() if gap else len(data)
        words = held + data[at:end].split()
        at = end if end > at else at + 1
        if at < len(data) and len(words) < SHINGLE:
            held = words
            continue
        line = b" ".join(words)
        if len(words) < SHINGLE:
            if whole and words:
                yield np.array([digest(line, SEED)], U)
            return
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], U)
        held, whole = words[1 - SHINGLE :], False


def fingerprint(data: bytes) -> int:
    """The majority of each bit over a text's shingles, repeats included; zero without words."""
    total, bits = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(data):
        total += len(hashes)
        for a in range(0, len(hashes), 1 << 16):
            own = hashes[a : a + (1 << 16)]
            bits += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.int64)[0])


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.ascii_lower(batch.column("text")).cast(pa.binary())
        found = [fingerprint(t.as_py()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "node"])


# --- bit planes


def planes_of(nodes: np.ndarray) -> np.ndarray:
    """The nodes turned upright: row b holds bit b of all of them, 64 to a word."""
    padded = np.zeros(-(-len(nodes) // 64) * 64, U)
    padded[: len(nodes)] = nodes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U)


def near(difference: Callable[[int, np.ndarray | None], np.ndarray], planes: list[int], live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes differ in at most ``radius`` planes: numbers of the words with any, and their lanes.

    ``difference(b, some)`` are the lanes that differ in plane b, 64 to a word,
    for all words or for ``some``; lanes not ``live`` don't count. Each lane
    has a counter, its bits in words of their own, that overflows when the
    radius is passed. Three planes at a time go through a carry-save adder.
    Words in which all lanes have overflowed are abandoned.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    full = ~U(0)
    counter = [np.full(live.shape, full if start >> i & 1 else U(0)) for i in range(width)]
    over, some, done = ~live, None, 0

    def add(carries: list[np.ndarray], over: np.ndarray) -> np.ndarray:
        """Add words of weight one, then of weight two, to the counters."""
        ones, twos = carries
        low = counter[0] & ones
        counter[0] = counter[0] ^ ones
        if twos is None:
            carry = low
        elif width == 1:
            return over | low | twos
        else:
            mixed = counter[1] ^ twos
            carry = (counter[1] & twos) | (mixed & low)
            counter[1] = mixed ^ low
        for i in range(1 if twos is None else 2, width):
            carry, counter[i] = counter[i] & carry, counter[i] ^ carry
        return over | carry

    for i in range(0, len(planes), 3):
        taken = [difference(b, some) for b in planes[i : i + 3]]
        if len(taken) == 3:
            x, y, z = taken
            mixed = x ^ y
            over = add([mixed ^ z, (x & y) | (mixed & z)], over)
        else:
            for one in taken:
                over = add([one, None], over)
        done += len(taken)
        if done >= FIRST_LOOK and (done - FIRST_LOOK) % LOOK < 3:
            kept = np.flatnonzero(over.reshape(-1) != full)
            if len(kept) < over.size:
                some = kept if some is None else some[kept]
                over, counter = over.reshape(-1)[kept], [c.reshape(-1)[kept] for c in counter]
            if not len(kept):
                break
    lanes = ~over.reshape(-1)
    some = np.arange(len(lanes)) if some is None else some
    hit = lanes != 0
    return some[hit], lanes[hit]


def lanes_of(words: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set lanes as pairs: number of the word, lane within it."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return words[row], lane


class Forest:
    """Keeps of links only those that join what was apart."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.root[max(a, b)] = min(a, b)
        return True


def free_planes(kind: int, radius: int) -> list[int]:
    """The planes outside of the two parts that a bucket of this kind has in common."""
    ranges = parts(radius)
    first, second = list(combinations(range(len(ranges)), 2))[kind]
    return [b for i, (low, size) in enumerate(ranges) if i not in (first, second) for b in range(low, low + size)]


def small_groups(nodes: np.ndarray, group: np.ndarray, planes: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within groups of consecutive nodes: all nodes against the next ones, then against the second next, ..."""
    n = len(nodes)
    ends = np.searchsorted(group, group, "right")
    after = ends - np.arange(n) - 1  # nodes of the same group behind each
    upright = planes_of(nodes)
    upright = np.concatenate([upright, np.zeros((64, 3), U)], axis=1)
    found = []
    for k in range(1, int(after.max(initial=0)) + 1):
        valid = np.zeros(-(-n // 64) * 64, bool)
        valid[:n] = after >= k
        live = np.packbits(valid, bitorder="little").view(U)
        at = np.flatnonzero(live)
        skip, shift = k // 64, U(k % 64)

        def difference(b: int, some: np.ndarray | None) -> np.ndarray:
            here = at if some is None else at[some]
            plane = upright[b]
            moved = plane[here + skip] >> shift
            if shift:
                moved = moved | (plane[here + skip + 1] << (U(64) - shift))
            return plane[here] ^ moved

        word, lane = lanes_of(*near(difference, planes, live[at], radius))
        first = at[word] * 64 + lane
        found.append((first, first + k))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*found))


def block_pairs(
    asked: np.ndarray, block: np.ndarray, upright: np.ndarray, planes: list[int], radius: int, *, same: bool
) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``asked`` with any, its number and those of the near nodes of a block; only later ones if it is the ``same`` block."""
    n = len(block)
    real = np.zeros(upright.shape[1] * 64, bool)
    real[:n] = True
    for a in range(0, len(asked), QUERIES):
        own = asked[a : a + QUERIES]
        first = a // 64 if same else 0
        columns = upright[:, first:]
        live = np.packbits(real[first * 64 :], bitorder="little").view(U)
        live = np.broadcast_to(live, (len(own), len(live))).copy()
        if same:
            place = np.arange(first * 64, len(real))
            later = place[None, :] > (a + np.arange(len(own)))[:, None]
            live &= np.packbits(later, axis=1, bitorder="little").view(U)
        width = live.shape[1]

        def difference(b: int, some: np.ndarray | None) -> np.ndarray:
            spread = np.where(own >> U(b) & U(1), ~U(0), U(0))
            if some is None:
                return columns[b][None, :] ^ spread[:, None]
            return columns[b][some % width] ^ spread[some // width]

        word, lane = lanes_of(*near(difference, planes, live, radius))
        row, place = word // width, (first + word % width) * 64 + lane
        for i in np.unique(row):
            yield a + int(i), place[row == i]


def links_of(forest: Forest, asked: list[int], block: list[int], pairs: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    for i, places in pairs:
        for j in places.tolist():
            if forest.join(asked[i], block[j]):
                yield asked[i], block[j]


def link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compare_within(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links within each block of partitions sorted by bucket and block: for each block a spanning forest."""

    def compare(bucket: np.ndarray, block: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(nodes), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        kind = (bucket[new] >> 32).astype(int)
        words = nodes.view(U)
        for one in np.unique(kind):
            planes = free_planes(int(one), radius)
            small = np.flatnonzero(((size <= SHIFTED) & (kind == one))[group])
            first, second = small_groups(words[small], group[small], planes, radius)
            forest, links = Forest(), []
            # Groups of one kind share no node, so one forest serves them all.
            for a, b in zip(nodes[small[first]].tolist(), nodes[small[second]].tolist()):
                if forest.join(a, b):
                    links.append((a, b))
            yield link_batch(links)
        starts = np.flatnonzero(new)
        for g in np.flatnonzero(size > SHIFTED):
            own = words[starts[g] : starts[g] + size[g]]
            named = own.view(np.int64).tolist()
            pairs = block_pairs(own, own, planes_of(own), free_planes(int(kind[g]), radius), radius, same=True)
            yield link_batch(list(links_of(Forest(), named, named, pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("bucket", "block", "node")])
            rows += batch.num_rows
            if rows >= CHUNK:
                bucket, block, nodes = map(np.concatenate, zip(*held))
                # The last group may go on in the next batch.
                cut = int(np.argmax((bucket == bucket[-1]) & (block == block[-1])))
                yield from compare(bucket[:cut], block[:cut], nodes[:cut]) if cut else ()
                held, rows = [[bucket[cut:], block[cut:], nodes[cut:]]], rows - cut
        if rows:
            yield from compare(*map(np.concatenate, zip(*held)))

    return run


def pack_blocks(table_: pa.Table) -> pa.Table:
    """One block's nodes as one row, with their bit planes and components."""
    table_ = table_.sort_by("node")
    nodes, part = (table_.column(c).to_numpy() for c in ("node", "part"))
    upright = planes_of(nodes.view(U)).view(np.int64).reshape(-1)
    row = {"bucket": [table_["bucket"][0].as_py()], "block": [table_["block"][0].as_py()], "splits": [table_["splits"][0].as_py()]}
    row |= {"low": [int(part.min())], "high": [int(part.max())], "nodes": [nodes], "parts": [part], "planes": [upright]}
    return pa.table(row, schema=PACKED_ARROW)


PACKED = "bucket long, block int, splits int, low long, high long, nodes array<long>, parts array<long>, planes array<long>"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int32()), ("splits", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("nodes", "parts", "planes")]
)


def compare_strips(radius: int) -> Callable[[pa.Table], pa.Table]:
    """Links between blocks of two strips of a bucket. Blocks that are one component together are passed over."""

    def compare(table_: pa.Table) -> pa.Table:
        table_ = table_.sort_by("block")
        forest, links = Forest(), []
        blocks = []
        for i in range(table_.num_rows):
            nodes, part, upright = (table_[c].chunk(0)[i].values.to_numpy() if table_[c].num_chunks == 1 else np.array(table_[c][i].as_py(), np.int64) for c in ("nodes", "parts", "planes"))
            blocks.append((table_["block"][i].as_py(), nodes.view(U), part, upright.view(U).reshape(64, -1)))
        p, q = table_["p"][0].as_py(), table_["q"][0].as_py()
        planes = free_planes(table_["bucket"][0].as_py() >> 32, radius)
        strip = lambda block: block // STRIP
        for x, own, own_part, _ in blocks:
            for y, other, part, upright in blocks:
                if x >= y or (p < 0 and x != 0) or (p >= 0 and (strip(x), strip(y)) != (p, q)):
                    continue
                roots = {forest.find(r) for r in np.unique(np.concatenate([own_part, part])).tolist()}
                if len(roots) == 1:
                    continue
                for i, places in block_pairs(own, other, upright, planes, radius, same=False):
                    a = int(own_part[i])
                    for j in places[part[places] != a].tolist():
                        if forest.join(a, int(part[j])):
                            links.append((int(own.view(np.int64)[i]), int(other.view(np.int64)[j])))
        return pa.Table.from_batches([link_batch(links)])

    return compare


# --- the plan


def parts(radius: int) -> list[tuple[int, int]]:
    """The 64 bits cut into ``radius + 2`` parts (first bit, length): two near fingerprints agree in two parts at least."""
    count = radius + 2
    ends = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def bucket_keys(node: Column, radius: int) -> Column:
    """One bucket for each two parts: which two, and what they hold."""
    held = [F.shiftrightunsigned(node, low).bitwiseAND(F.lit((1 << size) - 1)) for low, size in parts(radius)]
    keys = []
    for kind, (i, j) in enumerate(combinations(range(len(held)), 2)):
        keys.append(F.lit(kind << 32).cast("long") + F.shiftleft(held[i], parts(radius)[j][1]) + held[j])
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (``a``, ``b``) between fingerprints (``node``, distinct) whose components are those of all links of the radius.

    Fingerprints share a bucket if they agree in two of ``radius + 2`` parts.
    A bucket is compared whole up to ``BLOCK`` nodes. A larger one is dealt
    over blocks by hash: each block is compared within itself, then with its
    bucket's first block, and, as far as these have not made its nodes one
    component, with all others, strip by strip. Each task returns a spanning
    forest, so no pairs of a group are ever listed.
    """
    if not 1 <= radius <= 14:
        raise ValueError("simhash: the radius must be between 1 and 14")
    members = nodes.select(F.explode(bucket_keys(F.col("node"), radius)).alias("bucket"), "node")
    sizes = table(members.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") * F.when(F.col("count") > BLOCK, 2 / BLOCK).otherwise(0)).cast("int").alias("splits")), "sizes")
    split = F.when(F.col("splits") > 1, F.pmod(F.xxhash64("node"), F.col("splits"))).otherwise(0).cast("int")
    dealt = table(lookup(members, sizes, "bucket", "inner").select("bucket", "splits", split.alias("block"), "node"), "dealt")
    sorted_ = dealt.select("bucket", "block", "node").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    found = table(sorted_.mapInArrow(compare_within(radius), "a long, b long").distinct(), "links")

    for whole in (False, True):
        # First each block against its bucket's first, then all that is still apart.
        hot = dealt.filter("splits > 1")
        if hot.isEmpty():
            return found
        known = components(found)
        placed = hot.join(known, "node", "left").withColumn("part", F.coalesce("component", "node"))
        packed = table(placed.select("bucket", "block", "splits", "node", "part").groupBy("bucket", "block").applyInArrow(pack_blocks, PACKED), "blocks")
        apart = packed.groupBy("bucket").agg(F.min("low").alias("x"), F.max("high").alias("y")).filter("x < y").select("bucket")
        packed = table(packed.join(apart, "bucket", "left_semi"), "blocks")
        strip = F.floor(F.col("block") / STRIP).cast("int")
        strips = F.sequence(F.lit(0), F.floor((F.col("splits") - 1) / STRIP).cast("int"))
        if whole:
            cells = packed.withColumn("other", F.explode(strips)).withColumns({"p": F.least(strip, "other"), "q": F.greatest(strip, "other")})
        else:
            cells = packed.withColumn("q", F.explode(F.when(F.col("block") == 0, strips).otherwise(F.array(strip)))).withColumn("p", F.lit(-1))
        cells = cells.select("bucket", "p", "q", "block", "nodes", "parts", "planes")
        new = cells.groupBy("bucket", "p", "q").applyInArrow(compare_strips(radius), "a long, b long")
        found = table(found.unionByName(new).distinct(), "links")
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``fingerprint`` (64 bits as a long) and ``component_id``.

    A text is lower-cased in A-Z and cut into words at ASCII white space; its
    shingles are runs of four words, repeats included, or all of its words if
    there are fewer. A bit of its fingerprint is set if it is in over half of
    the shingles' hashes. Texts whose fingerprints differ in at most ``radius``
    bits are linked; ``component_id`` is the least ``doc_id`` that links lead
    to, its own included.

    A null, empty or blank text has fingerprint zero and is linked like any
    other. Repeated rows come out as often as they come in. A null id is never
    the least one; a component of null ids alone has none. Texts of any length
    are read whole, a segment at a time. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    signed = table(rows.mapInArrow(fingerprints, "id long, node long"), "fingerprints")
    nodes = table(signed.groupBy("node").agg(F.min("id").alias("least")), "nodes")
    known = components(links(nodes.select("node"), radius))
    named = table(nodes.join(known, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part")), "named")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    info = table(lookup(named.select("node", "part"), least, "part").select("node", "component_id"), "components")
    return lookup(signed, info, "node").select(F.col("id").alias("doc_id"), F.col("node").alias("fingerprint"), "component_id")
