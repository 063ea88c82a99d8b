"""Token ids in files: one zstandard frame per document with a shared dictionary, an offset index, any document in one read.

A shard is: the magic, the width of an id in bytes, the SHA-256 of the
dictionary; the documents' frames; the index (id, offset, tokens, 8 bytes
each, little endian; a null id is the least integer); then the index's offset,
the number of documents, and the magic again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import filesystem, shared_path, table, text_or_empty
from tidelog.llm.word_ids import WordIds, folds, worker_cache

MAGIC = b"TIDEIDS1"
HEAD = "<8sB32s"
FOOT = "<QQ8s"
NULL_ID = -(2**63)

END_ID = 2
SAMPLE_DOCS = 500  # the dictionary is trained on this many documents, those of the least hashes
SAMPLE_CHARS = 100_000  # longer ones are left out of that sample
DICTIONARY_BYTES = 32_768
LEVEL = 3
SHARD_DOCS = 50_000
SHARD_BYTES = 256 << 20

WORDS_PER_TEXT = 500  # words of letters that the library gets as one text

# Words that are one piece under the pre-tokenizer's pattern in word_ids, of ASCII and Latin-1 letters.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

SHARDS = "part int, place int, file string, docs long, tokens long"


def library_encoder(tokenizer_file: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    with open(tokenizer_file, encoding="utf-8") as file:
        suffix = json.load(file)["model"].get("end_of_word_suffix")
    known_pattern = folds(tokenizer_file)
    joins = known_pattern and bool(suffix)
    if joins:
        closes = np.zeros(tokenizer.get_vocab_size(), bool)
        closes[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def encoded(texts):
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, counts.sum()), counts

    def resolve(words):
        """Words of letters are one piece each, so many go as one text: the token with the suffix ends a word."""
        alone = np.fromiter((joins and LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        ids, counts = encoded([w for w, a in zip(words, alone.tolist()) if not a])
        if not alone.any():
            return ids, counts
        joined, _ = encoded([" ".join(some) for some in batched((w for w, a in zip(words, alone.tolist()) if a), WORDS_PER_TEXT)])
        ends = np.flatnonzero(closes[joined]) + 1
        if len(ends) != alone.sum():
            raise ValueError(f"{tokenizer_file}: tokens don't end words as its pattern says")
        each = np.empty(len(words), np.int64)
        each[alone], each[~alone] = np.diff(ends, prepend=0), counts
        ordered, inside = np.empty(each.sum(), np.uint32), np.repeat(alone, each)
        ordered[inside], ordered[~inside] = joined, ids
        return ordered, each

    return WordIds(resolve, known_pattern)


def id_type(width: int) -> np.dtype:
    return np.dtype("<u2" if width == 2 else "<u4")


def train_dictionary(docs: DataFrame, tokenizer_file: str, width: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample; empty if there is too little to train on."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("h"), text_or_empty().alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    last = keyed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if last is None:
        return b""
    texts = [r["text"] for r in keyed.filter(F.col("h") <= last).limit(2 * SAMPLE_DOCS).collect()]
    ids, offsets = library_encoder(tokenizer_file).encode(pa.array(texts, pa.string()))
    samples = [ids[a:b].astype(id_type(width)).tobytes() for a, b in zip(offsets, offsets[1:]) if b - a >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def zstd_dict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def writer(folder: str, tokenizer_file: str, dictionary: bytes, width: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode sorted documents into shards of this task attempt alone; returns a row per shard.

    A lost or repeated attempt leaves a file that no row names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        encoder = worker_cache(("library", tokenizer_file), lambda: library_encoder(tokenizer_file))
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstd_dict(dictionary))
        out, index, file, at, tokens = None, [], "", 0, 0

        def closed() -> pa.RecordBatch:
            out.write(np.array(index, "<i8").tobytes())
            out.write(struct.pack(FOOT, at, len(index), MAGIC))
            out.close()
            row = [part, place, file, len(index), tokens]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                ["part", "place", "file", "docs", "tokens"],
            )

        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if out is None:
                    file, index, tokens = f"{uuid.uuid4().hex}.ids", [], 0
                    out = fs.open_output_stream(f"{root}/{file}", compression=None)
                    out.write(struct.pack(HEAD, MAGIC, width, hashlib.sha256(dictionary).digest()))
                    at = struct.calcsize(HEAD)
                frame = packer.compress(np.append(ids[a:b], np.uint32(end_id)).astype(id_type(width)).tobytes())
                out.write(frame)
                index.append((NULL_ID if doc_id is None else doc_id, at, b - a + 1))
                at, tokens = at + len(frame), tokens + b - a + 1
                if len(index) >= SHARD_DOCS or at >= SHARD_BYTES:
                    yield closed()
                    out, place = None, place + 1
        if out is not None:
            yield closed()

    return write


class Shard:
    """One shard opened for reading."""

    def __init__(self, source, dictionary: bytes):
        self.source = source
        size = source.size()
        magic, width, digest = struct.unpack(HEAD, source.read_at(struct.calcsize(HEAD), 0))
        self.end, docs, tail = struct.unpack(FOOT, source.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.type = id_type(width)
        self.index = np.frombuffer(source.read_at(docs * 24, self.end), "<i8").reshape(-1, 3)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstd_dict(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        """The ids of document ``i`` by one short read."""
        start = int(self.index[i, 1])
        stop = int(self.index[i + 1, 1]) if i + 1 < len(self.index) else self.end
        data = self.unpacker.decompress(self.source.read_at(stop - start, start))
        return np.frombuffer(data, self.type)


def reader(folder: str, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        names, types = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as source:
                    shard = Shard(source, dictionary)
                    for first in range(0, len(shard), 10_000):
                        rows = []
                        for i in range(first, min(first + 10_000, len(shard))):
                            ids = shard.ids(i)
                            doc_id = int(shard.index[i, 0])
                            rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return read


def write_ids(docs: DataFrame, folder: str, tokenizer_file: str, dictionary: bytes, width: int, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) as shards in ascending id order; returns the shards, in order of ``part``, ``place``.

    A null text counts as empty and gives the end id alone. Null ids come
    first. Rows with equal ids are ordered by a hash of their texts, so that
    one id can't fill a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return table(ordered.mapInArrow(writer(folder, tokenizer_file, dictionary, width, end_id), SHARDS), "shards")


def read_ids(shards: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Read all shards: per document its id, the ids before it, its ids and their CRC-32."""
    # A row per file of up to 256 MB: few by construction.
    files, start = [], 0
    for row in shards.orderBy("part", "place").collect():
        files.append((row["file"], start))
        start += row["tokens"]
    spark = shards.sparkSession
    listed = spark.createDataFrame(files, "file string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(reader(folder, dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, width: int | None = None) -> DataFrame:
    """Encode, write and read back whole ``docs``."""
    if width is None:
        from tokenizers import Tokenizer

        width = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 65_536 else 4
    folder = shared_path(docs.sparkSession, "ids")
    dictionary = train_dictionary(docs, tokenizer_file, width)
    return read_ids(write_ids(docs, folder, tokenizer_file, dictionary, width, end_id), folder, dictionary)
