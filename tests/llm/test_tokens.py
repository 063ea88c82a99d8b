"""Ids against the library, shards, the lexicon."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import bpe, lexicon, token_store, word_ids
from tidelog.llm.common import shared_path
from tidelog.llm.queries import QUERIES, read, tokenizer_file

SF = "/root/testdata/sf0.001"

LIBRARY = Tokenizer.from_file(tokenizer_file())
MERGER = bpe.Merger(tokenizer_file())

texts = st.text(st.one_of(st.sampled_from("aeT ,.'s\n\t ́éÀß½Σ漢🙂0<|"), st.characters(exclude_categories=["Cs"])), max_size=30) | st.sampled_from(["<|endoftext|>", "a<|startoftext|>b.", "don't.,", "x..", "A,B."])


def own_encoder(path):
    def resolve(words):
        found = [list(known.ids_of(r)) if r >= 0 else MERGER.word(w) for w, r in zip(words, known.ranks([w.encode() for w in words]))]
        return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)

    known = lexicon.Lexicon(path)
    return word_ids.WordIds(resolve, MERGER.plain)


@pytest.fixture(scope="module")
def lexicon_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "words"
    words = ["the", "then", "there", "other", "mother", "and", "é", "don't", "0"]
    path.write_bytes(lexicon.compile_lexicon([(w.encode(), MERGER.word(w)) for w in words]))
    return str(path)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6))
def test_ids_equal_the_librarys(lexicon_file, some):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in some]
    for encoder in (own_encoder(lexicon_file), token_store.library_encoder(tokenizer_file())):
        ids, offsets = encoder.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(max_size=6)))
def test_lexicon_ranks(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("l") / "x"
    path.write_bytes(lexicon.compile_lexicon([(w, [i]) for i, w in enumerate(sorted(words))]))
    known = lexicon.Lexicon(str(path))
    asked = [*sorted(words), *others]
    assert known.ranks(asked).tolist() == [sorted(words).index(w) if w in words else -1 for w in asked]


def test_lexicon_is_minimal():
    builder = lexicon.Builder()
    for word in sorted(a + b for a in (b"x", b"y", b"z") for b in (b"ing", b"ed", b"s")):
        builder.add(word)
    assert len(builder.arrays()[3]) == 6  # start, one state after any first letter, i-n, n-g, e-d, end


def expected(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in rows]


@pytest.mark.parametrize("which", ["table", "odd"])
def test_store_round_trip(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else read(spark, SF, "documents")
    got = sorted(map(tuple, token_store.round_trip(docs, tokenizer_file()).collect()), key=lambda r: r[1])
    want = expected(docs)
    crc = lambda ids: zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((i is not None, i or 0, len(ids) + 1, crc(ids)) for i, ids in want)
    assert [r[0] for r in got] == [i for i, _ in want]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]


def test_one_document_is_one_short_read(spark, odd_docs):
    folder = shared_path(spark, "ids")
    shards = token_store.write_ids(odd_docs, folder, tokenizer_file(), b"", 2)
    fs, root = token_store.filesystem(folder)
    row = max(shards.collect(), key=lambda r: r["docs"])
    with fs.open_input_file(f"{root}/{row['file']}") as source:
        shard = token_store.Shard(source, b"")
        at = len(shard) - 1
        assert len(shard.ids(at)) == shard.index[at, 2] and shard.ids(at)[-1] == 2
        with pytest.raises(ValueError, match="another dictionary"):
            token_store.Shard(source, b"other")


@pytest.mark.parametrize("which", ["table", "odd"])
def test_bpe_digests(spark, odd_docs, which):
    docs = odd_docs if which == "odd" else read(spark, SF, "documents")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids, skip_special_tokens=False).encode())) for i, ids in expected(docs)]
    assert sorted(map(tuple, bpe.code_documents(docs, tokenizer_file()).collect()), key=repr) == sorted(want, key=repr)


def test_encode_then_decode(spark, odd_docs):
    encoded = bpe.encode(odd_docs, tokenizer_file())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in bpe.decode(encoded, tokenizer_file()).collect())
    assert got == sorted((i is None, i or 0, LIBRARY.decode(ids, skip_special_tokens=False)) for i, ids in expected(odd_docs))


def test_queries_cover_every_document(spark):
    n = read(spark, SF, "documents").count()
    assert QUERIES["op2_token_ids"](spark, SF).count() == QUERIES["op9_bpe"](spark, SF).count() == n


def test_long_pieces_merge_as_in_the_library():
    """Runs of letters past the heap's threshold, and one of a million letters in time."""
    rng = random.Random(3)
    for alphabet in ("ab", "acgt", "etaoinshrdlu", "aé漢ü"):
        for length in (bpe.SHORT_PIECE - 1, bpe.SHORT_PIECE, bpe.SHORT_PIECE + 1, 500, 3_000):
            word = "".join(rng.choices(alphabet, k=length))
            assert MERGER.word(word) == LIBRARY.encode(word, add_special_tokens=False).ids
    started = time.monotonic()
    assert len(MERGER.word("".join(rng.choices("acgt", k=1_000_000)))) > 100_000
    assert time.monotonic() - started < 60


def test_words_that_last_outlive_the_others():
    """A full memory of words lets those of the lexicon stay and drops the rest; the ids are the same."""
    import numpy as np
    import pyarrow as pa

    from tidelog.llm.word_ids import WordIds

    asked = []

    def resolve(words):
        asked.extend(words)
        spelled = [list(w.encode()) for w in words]
        return np.array([b for s in spelled for b in s], np.uint32), np.array([len(s) for s in spelled], np.int64)

    def lasting(words):
        return np.array([w.startswith("often") for w in words])

    coded = WordIds(resolve, False, lasting, kept=30)
    for n in range(40):
        texts = [f"often{k} rare{n}x{k} often{k + 1}" for k in range(7)] + ["", None]
        ids, offsets = coded.encode(pa.array(texts))
        assert [bytes(ids[a:b].astype(np.uint8).tolist()).decode() for a, b in zip(offsets, offsets[1:])] == [(t or "").replace(" ", "") for t in texts]
        assert len(coded.slots) <= 30 and len(coded.ids) <= coded.counts.sum()
    assert sorted(w for w in asked if w.startswith("often")) == [f"often{k}" for k in range(8)]


def test_encoded_in_pieces():
    import pyarrow as pa

    from tidelog.llm import bpe

    batch = pa.RecordBatch.from_arrays([pa.array(range(1_001))], ["doc_id"])
    parts = list(bpe.pieces(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= bpe.PIECE_ROWS and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(1_001))
