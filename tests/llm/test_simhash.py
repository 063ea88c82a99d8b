"""Fingerprints, bit-sliced distances and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import simhash
from tidelog.llm.queries import QUERIES

U = np.uint64


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    distinct = np.array(sorted(set(prints)), U)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, one in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ one) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    place = {int(p): find(i) for i, p in enumerate(distinct)}
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[place[p]] = min(i, least.get(place[p], i))
    return [least.get(place[p]) for p in prints]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\x0b 漢\n", max_size=80))
def test_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    assert simhash.fingerprint(lowered) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("segment", [1, 7, 40])
def test_segments_leave_the_fingerprint_alone(monkeypatch, segment):
    monkeypatch.setattr(simhash, "SEGMENT", segment)
    rng = random.Random(segment)
    for n in (0, 1, 3, 4, 5, 60):
        text = "  ".join("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(n)) + " " * (n % 3)
        assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 7, 8, 14])
@pytest.mark.parametrize("same", [True, False])
def test_block_pairs_equal_popcounts(radius, same):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 9, dtype=U)
    nodes = np.unique(base[rng.integers(0, 9, 330)] ^ (U(1) << rng.integers(0, 64, 330, dtype=U)) ^ (U(3) >> rng.integers(0, 3, 330, dtype=U)))
    asked = nodes if same else np.concatenate([base, rng.integers(0, 2**64, 300, dtype=U)])
    got = {(i, int(j)) for i, places in simhash.block_pairs(asked, nodes, simhash.planes_of(nodes), list(range(64)), radius, same=same) for j in places}
    far = np.bitwise_count(asked[:, None] ^ nodes[None, :])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= radius)) if not same or j > i}
    assert got == want and want


def test_small_groups_equal_popcounts():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 90, 60)
    group = np.repeat(np.arange(60), sizes)
    nodes = rng.integers(0, 2**64, 60, dtype=U)[group] ^ (U(1) << rng.integers(0, 64, len(group), dtype=U)) ^ (U(7) << rng.integers(0, 64, len(group), dtype=U))
    first, second = simhash.small_groups(nodes, group, list(range(64)), 4)
    far = np.bitwise_count(nodes[:, None] ^ nodes[None, :])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero((far <= 4) & (group[:, None] == group[None, :]))) if j > i}
    assert set(zip(first.tolist(), second.tolist())) == want and len(first) == len(want) > 100


def test_near_pairs_share_a_bucket(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        rows += [(2 * i, x - 2**63), (2 * i + 1, y - 2**63)]
    got = {}
    keyed = spark.createDataFrame(rows, "i long, node long").select("i", simhash.bucket_keys(simhash.F.col("node"), 4).alias("k"))
    for r in keyed.collect():
        assert len(r["k"]) == len(set(r["k"])) == 15
        got[r["i"]] = set(r["k"])
    assert all(got[2 * i] & got[2 * i + 1] for i in range(300))


@pytest.mark.parametrize("block, strip, shifted", [(4096, 16, 96), (8, 2, 96), (8, 16, 2), (40, 1, 5)])
def test_components_of_chains_and_dense_groups(spark, monkeypatch, block, strip, shifted):
    """Chains, groups that share buckets without being linked, and groups far larger than a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "STRIP", strip)
    monkeypatch.setattr(simhash, "SHIFTED", shifted)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = random.Random(block)
    nodes = {0, 2**64 - 1}
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(25):  # a chain
            nodes.add(x)
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(120):  # a dense group, and others that only share its upper bits
            nodes.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            nodes.add(x ^ rng.getrandbits(40))
    nodes = sorted(nodes)
    signed = [n - 2**64 if n >= 2**63 else n for n in nodes]
    found = simhash.links(spark.createDataFrame([(n,) for n in signed], "node long"))
    for a, b in found.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    known = {r["node"]: r["component"] for r in simhash.components(found).collect()}
    order = {n: i for i, n in enumerate(signed)}
    got = {}
    for i, n in enumerate(signed):
        got.setdefault(known.get(n, n), []).append(i)
    least = [min(got[known.get(n, n)]) for n in signed]
    assert least == plain_components(range(len(nodes)), nodes) and order


def check(docs, got):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], (f"{p:016x}" for p in prints), plain_components([r["doc_id"] for r in rows], prints)), key=repr)
    assert sorted(got, key=repr) == want


def test_query_equals_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        got = [tuple(r) for r in QUERIES["op12_simhash"](spark, f"/root/testdata/{sf}").collect()]
        check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), got)


def test_odd_rows(spark, odd_docs):
    got = [(r["doc_id"], f"{r['fingerprint'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()]
    check(odd_docs, got)
    alone = odd_docs.filter("doc_id IS NULL AND text IS NULL")
    assert [tuple(r) for r in simhash.near_duplicates(alone).collect()] == [(None, 0, None)]
