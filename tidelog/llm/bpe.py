"""BPE encoding and decoding: frequent words from a memory-mapped transducer, all others by exact merges.

The vocabulary file is one of the ``tokenizers`` library. Its own normalizer and
pre-tokenizer cut words into pieces; ids come from :class:`Lexicon` or from
:class:`Merger`. Holds for vocabularies that never join text across ASCII white
space, have no decoder and no unknown token.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_GAP, filesystem, shared_path, table, text_or_empty
from tidelog.llm.lexicon import Lexicon, compile_lexicon
from tidelog.llm.word_ids import WordIds, folds, worker_cache

# The lexicon holds up to this many of the corpus's most frequent words; it bounds the file, not the result.
LEXICON_WORDS = 100_000
OTHER_WORDS = 50_000  # that a worker remembers besides those of the lexicon
KEPT_PIECES = 100_000  # merged pieces a worker remembers
PIECE_ROWS = 250  # documents encoded at once
SHORT_PIECE = 100  # letters; in longer pieces merges are found by a heap, and they are not remembered


# What the vocabulary's pre-tokenizer makes of words of printable ASCII and Latin-1 letters, lower case.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00e0-\u00f6\u00f8-\u00ff\u00df]+|[0-9]|[^\\sa-z0-9\u00e0-\u00f6\u00f8-\u00ff\u00df]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Merger:
    """Exact BPE: of all adjacent pairs, the leftmost of the least rank merges, until none can."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.vocab = vocab
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        # Of the library only the steps before its model are used; the model's tables would be held twice.
        steps = {"model": model | {"vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None, "decoder": None}
        library = Tokenizer.from_str(json.dumps(spec | steps))
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain = folds(tokenizer_file)
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        """The ids of one pre-token, in byte letters."""
        if len(piece) > SHORT_PIECE:
            return self.merge(piece)
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KEPT_PIECES:
                self.known.clear()
            found = self.known[piece] = self.merge(piece)
        return found

    def merge(self, piece: str) -> list[int]:
        vocab, ranks = self.vocab, self.ranks
        ids = [vocab[c] for c in piece[:-1]] + [vocab[piece[-1] + self.suffix]]
        if len(ids) > SHORT_PIECE:
            return self.merge_long(ids)
        none = len(self.merged)
        rank = [ranks.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while rank and (least := min(rank)) < none:
            at = rank.index(least)
            ids[at : at + 2] = [self.merged[least]]
            del rank[at]
            if at > 0:
                rank[at - 1] = ranks.get(ids[at - 1] << 32 | ids[at], none)
            if at < len(rank):
                rank[at] = ranks.get(ids[at] << 32 | ids[at + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of (rank, place) over linked symbols: n log n for a piece of n letters."""
        ranks, merged, end = self.ranks, self.merged, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i in range(end - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            # An entry holds only while its place still starts the pair of that rank.
            if ids[at] < 0 or right == end or ranks.get(ids[at] << 32 | ids[right]) != rank:
                continue
            ids[at], ids[right] = merged[rank], -1
            after[at] = beyond = after[right]
            if beyond < end:
                before[beyond] = at
                if (r := ranks.get(ids[at] << 32 | ids[beyond])) is not None:
                    heapq.heappush(heap, (r, at))
            if (left := before[at]) >= 0 and (r := ranks.get(ids[left] << 32 | ids[at])) is not None:
                heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def pieces(self, part: str) -> list[str]:
        """Pre-tokens of a word without special tokens: by the library's own steps, or for plain words by the same pattern."""
        if self.plain and PLAIN.fullmatch(part):
            found = PIECES.findall(part.lower())
            return found if part.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in found]
        return [p for p, _ in self.cut(self.normalize(part))]

    def word(self, word: str) -> list[int]:
        """The ids of a text without white space, special tokens in it included."""
        ids: list[int] = []
        for part in self.special_pattern.split(word) if self.special_pattern else [word]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pieces(part):
                    ids += self.piece(piece)
        return ids


def encoder(name: str, tokenizer_file: str) -> tuple[Merger, WordIds]:
    """This worker's merger and encoder with the lexicon of that name."""
    from pyspark import SparkFiles

    merger = worker_cache(("merger", tokenizer_file), lambda: Merger(tokenizer_file))
    lexicon = Lexicon(SparkFiles.get(name))

    def resolve(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ranks = lexicon.ranks([w.encode() for w in words])
        found = [merger.word(w) if r < 0 else lexicon.ids_of(r) for w, r in zip(words, ranks.tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, counts.sum()), counts

    def lasting(words: Sequence[str]) -> np.ndarray:
        return lexicon.ranks([w.encode() for w in words]) >= 0

    return merger, worker_cache(("lexicon", name, tokenizer_file), lambda: WordIds(resolve, merger.plain, lasting, LEXICON_WORDS + OTHER_WORDS))


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, of those that occur twice or more, in the form that is looked up."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty()), WORD_GAP)).alias("word"))
    words = words.select(F.rtrim("word", F.lit(".,")).alias("word")).filter("word <> ''")
    counts = table(words.groupBy("word").count().filter("count > 1"), "words")
    # The least count that leaves no more than ``limit`` words, from how many words have each count.
    least, total = None, 0
    for count, n in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        total += n
        if total > limit:
            break
        least = count
    return [] if least is None else [r["word"] for r in counts.filter(F.col("count") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer_file: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs`` and hand the file to every executor; returns its name there."""
    merger = Merger(tokenizer_file)
    data = compile_lexicon([(w.encode(), merger.word(w)) for w in frequent_words(docs, limit)])
    uri = shared_path(docs.sparkSession, "lexicon")
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)
    docs.sparkSession.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``PIECE_ROWS``: words, slots and places of all words of a piece are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def coder(name: str, tokenizer_file: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, coded = encoder(name, tokenizer_file)
        token = merger.tokens.__getitem__
        for batch in pieces(batches):
            ids, offsets = coded.encode(batch.column("text"))
            raw, counts, id_hashes, text_hashes = ids.astype("<u4"), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                counts.append(b - a)
                id_hashes.append(hashlib.sha256(raw[a:b]).hexdigest())
                text_hashes.append(hashlib.sha256(" ".join(map(token, raw[a:b].tolist())).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return code


def encode(docs: DataFrame, tokenizer_file: str, lexicon: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``docs``; a null text has none."""
    lexicon = lexicon or build_lexicon(docs, tokenizer_file)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coded = encoder(lexicon, tokenizer_file)
        for batch in pieces(batches):
            ids, offsets = coded.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(code, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``: the tokens joined by spaces, as the library does without a decoder."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = Merger(tokenizer_file).tokens.__getitem__
        for batch in batches:
            texts = [" ".join(map(token, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(code, "doc_id long, text string")


def code_documents(docs: DataFrame, tokenizer_file: str, lexicon: str | None = None) -> DataFrame:
    """Encode and decode every row of ``docs`` (``doc_id``, ``text``): the digests of its ids and of the decoded text.

    A null text counts as empty: no ids, and the digest of nothing. Repeated
    rows and null ids give a row each.
    """
    lexicon = lexicon or build_lexicon(docs, tokenizer_file)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(coder(lexicon, tokenizer_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
