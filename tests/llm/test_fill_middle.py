"""Skip list against plain slicing, examples against brute force, round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import fill_middle
from tidelog.llm.fill_middle import SkipList, Towers, boundaries, fill_in_middle, restore

TOWERS = Towers()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=400), st.data())
def test_ranks_resolve_to_code_points(widths, data):
    ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)]).astype(np.int64)
    listed = SkipList(len(widths), ends, TOWERS)
    for rank in data.draw(st.lists(st.integers(0, len(widths)), max_size=8)):
        assert listed.find(rank) == ends[rank]
    assert [listed.find(0), listed.find(len(widths))] == [0, ends[-1]]
    with pytest.raises(IndexError):
        listed.find(len(widths) + 1)


def test_steps_stay_few():
    """A lookup walks a few links a lane, not the text."""
    n = 1_000_000
    listed = SkipList(n, None, TOWERS)
    assert 8 <= len(listed.lanes) <= 14
    for units, chars, _ in listed.lanes:
        assert (units == chars).all() and units.sum() <= n
    rng = np.random.default_rng(1)
    assert all(listed.find(int(r)) == r for r in rng.integers(0, n + 1, 200))
    thinned = [len(a[0]) / len(b[0]) for a, b in zip(listed.lanes, listed.lanes[1:]) if len(b[0]) > 200]
    assert all(3 < t < 5.5 for t in thinned)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n漢🙂é", max_size=60))
def test_boundaries_cover_the_text(text):
    ends = boundaries(text, re.compile(r"\w+"))
    parts = [text[a:b] for a, b in zip(ends, ends[1:])]
    assert "".join(parts) == text and all(p for p in parts)
    assert [p for p in parts if re.fullmatch(r"\w+", p)] == re.findall(r"\w+", text)


def example(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or three % 100 >= rate:
        return len(text), "plain", None, None, text
    a, b = sorted((one % (len(text) + 1), two % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if four % 100 < spm:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def made(df):
    return [(r["doc_id"], r["text"], (r["__n"], r["__form"], r["__prefix_chars"], r["__middle_chars"], r["__output"]), r["back"]) for r in df.withColumn("back", restore(F.col("__output"), F.col("__form"))).collect()]


def test_odd_rows(spark, odd_docs):
    extra = spark.createDataFrame([(300 + i, t, None, None, None, "k", i, i, "w") for i, t in enumerate(["a<S>b", "<", "<P", "<M>", "a<", "🙂" * 70_000, "<P" * 50, "S>" * 9, "\x00\n"])], odd_docs.schema)
    docs = odd_docs.unionByName(extra).withColumn("n", F.lit("clash")).withColumn("form", F.lit(1)).withColumn("a.b", F.lit(2))
    out = fill_in_middle(docs, rate=100)
    assert out.columns == docs.columns + list(fill_middle.RESULT)
    rows = made(out)
    assert len(rows) == docs.count()
    for doc_id, text, got, back in rows:
        assert got == example(doc_id, text, rate=100) and back == (text or "")
    assert {r[2][1] for r in rows} == {"plain", "psm", "spm"}


def test_results_that_clash_are_an_error(spark):
    with pytest.raises(ValueError, match="__n"):
        fill_in_middle(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, __n long"))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for doc_id, text, got, back in made(fill_in_middle(docs)):
        assert got == example(doc_id, text) and back == text


def test_units_are_never_split(spark):
    docs = spark.createDataFrame([(i, "one two  three, four\nfive" * (i + 1)) for i in range(40)], "doc_id long, text string")
    rows = made(fill_in_middle(docs, unit=r"[a-z]+", rate=100))
    for _, text, (n, form, a, m, _), back in rows:
        ends = boundaries(text, re.compile("[a-z]+")).tolist()
        assert n == len(ends) - 1 and a in ends and a + m in ends and back == text


def test_batches_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 100)
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(200)], "doc_id long, text string").coalesce(1)
    for doc_id, text, got, back in made(fill_in_middle(docs)):
        assert got == example(doc_id, text) and back == text
