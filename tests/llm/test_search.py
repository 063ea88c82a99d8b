"""BM25 search against plain scoring, however rows are dealt over tasks, shards, matrices and postings."""

import math
import random
from collections import Counter

import pytest

from tidelog.llm import search


def corpus(seed, n):
    """Texts of few and many words from two vocabularies with very common and very rare words, some alike, some without any."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"{'ab'[i % 3 == 0]}{min(int(rng.paretovariate(0.7)), 900)}" for _ in range(rng.choice([0, 1, 3, 12, 40, 150]))]
        rows.append((i, " ".join(words) if i % 17 else None))
    rows += [(n + i, rows[i][1]) for i in range(0, n, 9)] + [(None, rows[1][1]), rows[2], rows[2]]
    return rows


def scored(docs, queries):
    """The best of each query by every document's score: (query id, score) in order."""
    bags = [Counter((text or "").split()) for _, text in docs]
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q, text in set(queries):
        wanted, found = set((text or "").split()), []
        for (d, _), bag in zip(docs, bags):
            norm = 1.2 * (1 - 0.75 + 0.75 * sum(bag.values()) / mean)
            score = sum(math.floor(idf[w] * (bag[w] * 2.2 / (bag[w] + norm)) * 65_536 + 0.5) for w in wanted if w in bag)
            found += [(-score, d is None, d or 0, d)] if score else []
        out += [(q, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:10], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [
    {},
    {"BLOCK": 32, "SHORT": 4, "QUERIES": 7, "STEP": 100},
    {"BLOCK": 16, "DENSE": 1e9, "STEP": 64, "SHARD_WORDS": 3_000},
    {"BLOCK": 64, "DENSE": 0, "SHARD_DOCS": 50, "EXACT": 0.0},
    {"BLOCK": 32, "DENSE": 1e9, "CELLS": 500},
])
def test_every_document_scored(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(search, name, value)
    rows = corpus(1, 400)
    queries = [r for r in rows if r[0] is None or r[0] % 7 == 0]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    got = search.top_documents(frame(rows).repartition(3), frame(queries)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == scored(rows, queries)


def test_all_queries_run_on_few_shards(spark, monkeypatch):
    """A shard for each small partition of the input would cost as much as one that fills a task."""
    shards, made = spark.sparkContext.accumulator(0), search.searcher

    def counted(*args):
        run = made(*args)

        def rows(batches):
            for i, batch in enumerate(run(b for b in [*batches] if shards.add(b.num_rows > 0) is None)):
                yield batch

        return rows

    monkeypatch.setattr(search, "searcher", counted)
    docs = spark.createDataFrame(corpus(2, 600), "doc_id long, text string").repartition(60)
    assert search.top_documents(docs, docs.filter("doc_id % 50 = 0")).count() > 0
    # The last search is one of three.
    assert shards.value <= 3 * spark.sparkContext.defaultParallelism
