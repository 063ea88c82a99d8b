"""Exact BM25 top-k: an inverted index per shard with block maxima, pruned, merged by global statistics.

Each task indexes its documents in shards of bounded size and runs all queries
on a shard before it drops it. Documents lie in blocks of similar content and
length; a term's best weight in a block bounds what the block can add, and
blocks that can't reach a floor of the k-th score are left out. The queries and
their terms are tables in the shared folder that tasks stream, so neither is
replicated.

Scores are sums of whole numbers (each term's weight times 2^16, rounded), so
they don't depend on order, shard or pruning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import filesystem, row_key, shared_path, table, text_or_empty

TOP = 10
K1, B = 1.2, 0.75
SCALE = 65_536
SHARD_WORDS = 10_000_000
SHARD_DOCS = 65_536  # a posting has 16 bits for its document
TASK_CHARS = 48_000_000  # of text, for each task: most of a shard's words
BLOCK = 2_048  # documents
DENSE = 400  # a posting of one query costs as much as so many products of a matrix
CELLS = 40_000_000  # of a shard's matrices
SHORT = 48  # postings: a list under this is copied with others, not by itself
QUERIES = 256  # run on a shard at a time
STEP = 1 << 18  # postings weighed at a time
EXACT = 2.0**32  # sums from which the numbers in postings' last bits would tell
SAMPLE = 10  # one of so many documents is searched first, for floors


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


class Rows:
    """Documents that wait for a shard: the different terms of each, by number in their batch's list of terms, and how often they occur."""

    def __init__(self):
        self.ids, self.keys, self.parts, self.lengths, self.words = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows with ``id``, ``key`` and ``terms`` in order."""
        self.ids += batch.column("id").to_pylist()
        self.keys += batch.column("key").to_pylist()
        words, ends = batch.column("terms").flatten().to_numpy(), batch.column("terms").offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        new = np.ones(len(words) + 1, bool)
        new[1:-1] = words[1:] != words[:-1]
        new[ends] = True
        at = np.flatnonzero(new)
        known, number = np.unique(words[at[:-1]], return_inverse=True)
        tf = np.diff(at)
        self.parts.append((known, number.astype(np.int32), tf.astype(np.min_scalar_type(tf.max(initial=0))), np.diff(np.searchsorted(at, ends))))
        self.lengths.append(np.diff(ends))
        self.words += len(words)


class Shard:
    """Points (a term's weight in a document, rounded) by term; per term and block of documents the best.

    Terms that many documents of a block and many queries share are columns of the
    block's dense matrix, elsewhere they have postings. Sums of postings are exact, those
    of columns approximate; exact ones are then made for the few documents that can be
    among the best.
    """

    def __init__(self, rows: Rows, mean_length: float, asked: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], queries: int):
        """``asked`` has the terms of all ``queries`` with their idf and number of queries, in any order; other terms are left out."""
        lengths = np.concatenate(rows.lengths)
        docs = len(lengths)
        self.terms = np.unique(np.concatenate([known for known, _, _, _ in rows.parts]))
        size = len(self.terms)
        bits = size.bit_length() + 2
        self.shift, self.half = 64 - bits, 1 << bits - 1
        self.first = np.searchsorted(self.terms, np.arange(-self.half, self.half) << self.shift).astype(np.int32)
        self.terms = np.append(self.terms, np.iinfo(np.int64).max)
        idf, users = np.zeros(size), np.zeros(size, np.int64)
        for some, weight, n in asked:
            at, here = self.find(some)
            idf[at[here]], users[at[here]] = weight[here], n[here]
        norm, done, total = K1 * (1 - B + B * lengths / mean_length), 0, sum(len(number) for _, number, _, _ in rows.parts)
        term, doc, points = np.empty(total, np.int32), np.empty(total, np.uint16), np.empty(total, np.float32)
        commonest, total = np.zeros(docs, np.int64), 0
        while rows.parts:
            known, number, tf, counts = rows.parts.pop(0)
            number = np.searchsorted(self.terms[:size], known).astype(np.int32)[number]
            owner = np.repeat(np.arange(done, done + len(counts), dtype=np.int32), counts)
            rising = np.argsort(tf, kind="stable")
            commonest[owner[rising]] = number[rising]
            kept = users[number] > 0
            number, owner, tf = number[kept], owner[kept], tf[kept].astype(np.float64)
            here = slice(total, total + len(number))
            term[here], doc[here] = number, owner
            points[here] = np.floor(idf[number] * (tf * (K1 + 1) / (tf + norm[owner])) * SCALE + 0.5)
            done, total = done + len(counts), total + len(number)
        term, doc, points = term[:total], doc[:total], points[:total]
        # Documents with the same commonest term lie together, short ones first: that makes bounds tight and columns full.
        order = np.lexsort((lengths, commonest))
        place = np.empty(docs, np.uint16)
        place[order] = np.arange(docs)
        self.ids, self.keys = [rows.ids[i] for i in order], [rows.keys[i] for i in order]
        self.edges = np.arange(0, docs, BLOCK)
        np.take(place, doc, out=doc, mode="clip")
        rest = self.gather(term, doc, points, np.diff(np.append(self.edges, docs)), users * (DENSE / max(queries, 1)))
        term, doc, points = term[:rest].copy(), doc[:rest].copy(), points[:rest].copy()
        self.start = np.zeros(size + 2, np.int64)
        np.cumsum(np.bincount(term, minlength=size), out=self.start[1:-1])
        self.start[-1] = self.start[-2]
        # The document's number lies in the last bits of its points as a double: whole numbers below 2^23 leave them free.
        if size < 1 << 24:
            # One array holds all, is sorted and then changed in its place.
            self.postings = term.astype(np.int64)
            del term
            self.postings <<= 16
            self.postings |= doc
            self.postings <<= 23
            self.postings |= points.astype(np.int32)
            del doc, points
            self.postings.sort()
            for a in range(0, len(self.postings), STEP):
                some = self.postings[a : a + STEP]
                some[:] = (some & (1 << 23) - 1).astype(np.float64).view(np.int64) | some >> 23 & 0xFFFF
        else:
            order = np.argsort(term)
            self.postings = points[order].astype(np.float64).view(np.int64) | doc[order]
        self.room = np.empty((QUERIES, docs))

    def gather(self, term: np.ndarray, doc: np.ndarray, points: np.ndarray, sizes: np.ndarray, gain: np.ndarray) -> int:
        """Make the matrices; ``gain`` is what a product saves by term and document that has it. All else is moved to the front; tells how much that is."""
        often = np.flatnonzero(np.bincount(term, minlength=len(gain)) * gain >= sizes.min())
        blocks, number = len(sizes), np.full(len(gain), -1, np.int64)
        number[often] = np.arange(len(often))
        steps = [slice(a, a + STEP) for a in range(0, len(term), STEP)]
        count = np.zeros(len(often) * blocks, np.int64)
        for step in steps:
            here = np.flatnonzero(number[term[step]] >= 0)
            count += np.bincount(number[term[step][here]] * blocks + doc[step][here] // BLOCK, minlength=len(count))
        worth, least = count.reshape(-1, blocks) * gain[often, None] / sizes, 1.0
        while ((worth >= least) * sizes).sum() > CELLS:
            least *= 1.25
        dense = worth >= least
        # The first cell of each block's matrix, and of a term's column in it; a document's is as far on as it lies in the block.
        own = [np.flatnonzero(dense[:, k]) for k in range(blocks)]
        first = np.append(0, np.cumsum([len(x) * n for x, n in zip(own, sizes)])).astype(np.int64)
        place = np.full((len(often), blocks), -1, np.int64)
        for k in range(blocks):
            place[own[k], k] = first[k] + np.arange(len(own[k])) * sizes[k] - self.edges[k]
        cells, dense = np.zeros(first[-1], np.float32), dense.ravel()
        rest = 0
        for step in steps:
            t, d, p = term[step], doc[step], points[step]
            cell = number[t] * blocks + d // BLOCK
            inside = number[t] >= 0
            inside[inside] = dense[cell[inside]]
            cells[place.ravel()[cell[inside]] + d[inside]] = p[inside]
            t, d, p = t[~inside], d[~inside], p[~inside]
            here = slice(rest, rest + len(t))
            term[here], doc[here], points[here] = t, d, p
            rest = here.stop
        some = np.flatnonzero(dense.reshape(-1, blocks).any(axis=1))
        self.column = np.full(len(gain) + 1, -1)
        self.column[often[some]] = np.arange(len(some))
        self.best, self.matrices = np.zeros((len(some), blocks), np.float32), []
        for k in range(blocks):
            matrix, columns = cells[first[k] : first[k + 1]].reshape(len(own[k]), sizes[k]), self.column[often[own[k]]]
            self.matrices.append((columns, matrix))
            self.best[columns, k] = matrix.max(axis=1)
        return rest

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of terms, and which of them are here. Hashes are spread evenly, so their first bits lead to their place or just before it."""
        at = self.first[(wanted >> self.shift) + self.half]
        while (before := self.terms[at] < wanted).any():
            at = at + before
        return at, (self.terms[at] == wanted) & (at < len(self.terms) - 1)

    def search(self, offsets: np.ndarray, wanted: np.ndarray, floors: np.ndarray) -> Iterator[list[tuple]]:
        """For each query the best ``TOP`` of its documents that are not below its floor, as (-score, no id, id, key, place)."""
        docs, queries = len(self.ids), len(floors)
        at, here = self.find(wanted)
        owner, at = np.repeat(np.arange(queries), np.diff(offsets))[here], at[here]
        column = self.column[at]
        dense = column >= 0
        asked = np.zeros((queries, len(self.best)), np.float32)
        asked[owner[dense], column[dense]] = 1
        sums, most = self.sums(queries, owner, at)
        floors = np.maximum(floors, 1).astype(np.float64)
        bounds = asked @ self.best
        # What single precision can be off by, with room.
        slack = 2 + bounds * (asked.sum(axis=1) * 2.0**-22)[:, None]
        bounds = bounds + most + slack
        found: list[list[tuple]] = [[] for _ in range(queries)]
        for k, (columns, matrix) in enumerate(self.matrices):
            # Blocks that can't reach the floor are left out.
            some = np.flatnonzero(bounds[:, k] >= floors)
            if not len(some):
                continue
            mine = asked[np.ix_(some, columns)]
            rough = mine @ matrix
            edge, n = self.edges[k], matrix.shape[1]
            for i in np.flatnonzero(rough.max(axis=1) + most[some, k] + slack[some, k] >= floors[some]).tolist():
                q = some[i]
                scores = rough[i] + sums[q, edge : edge + n]
                off = slack[q, k]
                if scores.max() + off < floors[q]:
                    continue
                good = np.flatnonzero(scores + off >= floors[q])
                if len(good) > TOP:
                    good = good[scores[good] + off >= np.partition(scores[good], len(good) - TOP)[len(good) - TOP]]
                exact = np.rint(sums[q, edge + good]) + matrix[np.ix_(np.flatnonzero(mine[i]), good)].sum(axis=0, dtype=np.float64)
                for d, s in zip((edge + good).tolist(), exact.tolist()):
                    if s >= floors[q]:
                        found[q].append((-int(s), self.ids[d] is None, self.ids[d] or 0, self.keys[d], d))
                if len(found[q]) >= TOP:
                    found[q] = sorted(found[q])[:TOP]
                    floors[q] = max(floors[q], -found[q][-1][0])
        yield from map(sorted, found)

    def sums(self, queries: int, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points by query and document, as far as they are in postings (off by less than 0.1), and the most in each block. ``owner``, ``at``: the queries' terms."""
        start, count = self.start[at], self.start[at + 1] - self.start[at]
        short, long = (count > 0) & (count < SHORT), np.flatnonzero(count >= SHORT)
        few = self.postings[ranges(start[short], count[short])]
        to = np.append(0, np.cumsum(np.bincount(owner[short], count[short], queries))).astype(int).tolist()
        own = np.searchsorted(owner[long], np.arange(queries + 1)).tolist()
        begin, end = start[long].tolist(), (start[long] + count[long]).tolist()
        sums, most, postings = self.room[:queries], np.empty((queries, len(self.edges))), self.postings
        for q in range(queries):
            lists = [postings[a:b] for a, b in zip(begin[own[q] : own[q + 1]], end[own[q] : own[q + 1]])]
            met = np.concatenate([few[to[q] : to[q + 1]], *lists])
            place = met & 0xFFFF
            total = np.bincount(place, met.view(np.float64), len(self.ids))
            most[q] = np.maximum.reduceat(total, self.edges)
            if most[q].max() >= EXACT:
                total = np.bincount(place, (met - place).view(np.float64), len(self.ids))
            sums[q] = total
        return sums, most


def give_back() -> None:
    """Have freed arrays of 1 MB and more returned to the system. Else malloc keeps those smaller than the largest that was freed."""
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


def searcher(queries: str, n_queries: int, lexicon: str, mean_length: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Index the documents of a partition shard by shard and run the table of queries on each."""

    def stored(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
        """A table's rows, so many at a time, however they lie in files."""
        from pyarrow import dataset

        fs, path = filesystem(uri)
        waiting: list[pa.RecordBatch] = []
        for batch in dataset.dataset(path, format="parquet", filesystem=fs, ignore_prefixes=["_", "."]).to_batches(batch_size=rows, batch_readahead=1, fragment_readahead=1):
            while batch.num_rows:
                waiting.append(batch.slice(0, rows - sum(b.num_rows for b in waiting)))
                batch = batch.slice(waiting[-1].num_rows)
                if sum(b.num_rows for b in waiting) == rows:
                    yield pa.concat_batches(waiting)
                    waiting = []
        if waiting:
            yield pa.concat_batches(waiting)

    def run(rows: Rows) -> Iterator[pa.RecordBatch]:
        shard = Shard(rows, mean_length, ([batch.column(c).to_numpy() for c in ("term", "idf", "users")] for batch in stored(lexicon, STEP)), n_queries)
        for batch in stored(queries, QUERIES):
            offsets = batch.column("terms").offsets.to_numpy().astype(np.int64)
            wanted = batch.column("terms").values.to_numpy()[offsets[0] : offsets[-1]]
            found = shard.search(offsets - offsets[0], wanted, batch.column("floor").to_numpy())
            out = [(query, key, shard.ids[d], k, -s) for query, key, best in zip(batch.column("query_id").to_pylist(), batch.column("query_key").to_pylist(), found) for s, _, _, k, d in best]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "query_key", "doc_id", "doc_key", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rows = Rows()
        for whole in batches:
            for a in range(0, whole.num_rows, SHARD_DOCS):
                batch = whole.slice(a, SHARD_DOCS)
                if rows.ids and len(rows.ids) + batch.num_rows > SHARD_DOCS:
                    yield from run(rows)
                    rows = Rows()
                rows.add(batch)
                if rows.words >= SHARD_WORDS:
                    yield from run(rows)
                    rows = Rows()
        if rows.ids:
            yield from run(rows)

    return search


def indexed(docs: DataFrame) -> DataFrame:
    """``terms``: hashes in order, as often as they occur."""
    hashes = F.transform(terms(text_or_empty()), lambda w: F.xxhash64(w))
    return docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"), F.sort_array(hashes).alias("terms"))


def best(found: DataFrame) -> DataFrame:
    by = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc_key")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP)


def top_documents(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``TOP`` rows of ``docs`` for each row of ``queries`` (both ``doc_id``, ``text``) by BM25.

    A query is the set of its text's terms. Returns ``query_id``, ``rank``
    (from 1), ``doc_id``, ``score``. Ties go to the lower document id (null
    last), then to a hash of the text; rows without a common term are no
    result, so queries without terms have none. Terms are told apart by 64-bit
    hashes. Repeated rows are rows of their own; queries equal in id and text
    are one query.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # A shard for each task, of equal sizes, and as many tasks as fill all cores.
    tasks = lambda share: -(-(-(-share // TASK_CHARS)) // cores) * cores or cores
    chars = docs.agg(F.coalesce(F.sum(F.length(text_or_empty())), F.lit(0))).first()[0]
    rows = table(indexed(docs.coalesce(tasks(chars))).withColumn("n", F.size("terms")), "terms")
    sizes = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    mean_length = max(sizes["words"] / max(sizes["docs"], 1), 1e-9)
    asked = indexed(queries).dropDuplicates(["id", "key"])
    stored = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query_key"), F.array_distinct("terms").alias("terms"), F.lit(0).cast("long").alias("floor"))
    path = shared_path(spark, "queries")
    stored.write.parquet(path)
    stored = spark.read.schema(stored.schema).parquet(path)
    users = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("users"))
    frequency = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(sizes["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    lexicon, n_queries = shared_path(spark, "lexicon"), stored.count()
    users.join(frequency, "term").select("term", idf.alias("idf"), "users").write.parquet(lexicon)
    schema = "query_id long, query_key long, doc_id long, doc_key long, score long"
    # The k-th score among some documents is a floor for the search of all: first among a hundredth,
    # then among a tenth. So a shard returns only what beats many documents already.
    sampled = lambda n: rows.filter(F.pmod("key", F.lit(n)) == 0).repartition(tasks(chars // n))
    for some in (sampled(SAMPLE * SAMPLE), sampled(SAMPLE), rows):
        found = best(some.select("id", "key", "terms").mapInArrow(searcher(path, n_queries, lexicon, mean_length), schema))
        if some is rows:
            return found.select("query_id", "rank", "doc_id", "score")
        kth = found.filter(F.col("rank") == TOP).select(F.col("query_id").alias("q"), F.col("query_key").alias("k"), F.col("score").alias("kth"))
        path = shared_path(spark, "queries")
        joined = stored.join(kth, stored["query_id"].eqNullSafe(kth["q"]) & (stored["query_key"] == kth["k"]), "left")
        joined.select("query_id", "query_key", "terms", F.greatest("kth", "floor").alias("floor")).write.parquet(path)
        stored = spark.read.schema(stored.schema).parquet(path)
