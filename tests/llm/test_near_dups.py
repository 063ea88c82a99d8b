"""Near duplicates against brute force; signatures against the weighted Jaccard similarity."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import common, near_dups, templates
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def bag(text):
    words = [w for w in (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").split() if w]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def classes_of(texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a == b == Counter() or 9 * (a & b).total() >= 4 * (a.total() + b.total()) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def partition(labels):
    groups = {}
    for i, label in enumerate(labels):
        groups.setdefault(label, []).append(i)
    return sorted(groups.values())


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    n, trials = 200, 300
    a = rng.integers(1, 12, n)
    b = a.copy()
    b[:80] = rng.integers(1, 40, 80)
    x = rng.integers(0, 2**63, (trials, n)).astype(np.uint64)
    least = near_dups.signatures(np.concatenate([x, x], 1).reshape(-1), np.repeat(np.arange(2 * trials), n), np.tile(np.concatenate([a, b]), trials), 2 * trials)
    same = (least[0::2] == least[1::2]).mean(axis=1)
    assert abs(same.mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 4 * same.std() / trials**0.5


def test_limit_does_not_show_in_a_signature():
    x, count = np.arange(1, 4, dtype=np.uint64) * near_dups.GOLDEN, np.array([1, 70, 3])
    least = near_dups.signatures(x, np.zeros(3, np.int64), count, 1)
    element, slot, time = near_dups.points_within(x, count, np.full(3, 1.0))
    want = np.full(near_dups.SLOTS, np.inf)
    np.minimum.at(want, slot.astype(int), time)
    assert (least[0] == want).all()


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op1_near_dups"](spark, SF).collect()}
    want = classes_of([r["text"] for r in docs])
    assert [got[r["doc_id"]] for r in docs] == [docs[w]["doc_id"] for w in want]


def test_odd_rows(spark, odd_docs):
    rows = odd_docs.withColumn("k", common.row_key()).collect()
    got = {(r["__id"], r["__key"]): (r["class_id"], r["class_key"]) for r in near_dups.near_duplicates(odd_docs).collect()}
    labels = classes_of([r["text"] for r in rows])
    assert partition([got[r["doc_id"], r["k"]] for r in rows]) == partition(labels)
    kept = near_dups.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(labels))


def test_chain_and_large_group(spark):
    """A chain links its ends; a large group of near copies of one text is one class; clean texts stay alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(300)]
    chain, now = [], list(base)
    for step in range(6):
        chain.append(" ".join(now))
        now[step * 40 : step * 40 + 3] = [word() for _ in range(3)]
    group = []
    other = [word() for _ in range(200)]
    for _ in range(120):
        copy = list(other)
        copy[rng.randrange(200)] = word()
        group.append(" ".join(copy))
    clean = [" ".join(word() for _ in range(100)) for _ in range(20)]
    texts = chain + group + clean
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["__id"]: r["class_id"] for r in near_dups.near_duplicates(docs).collect()}
    assert partition([got[i] for i in range(len(texts))]) == partition(classes_of(texts))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_link_finds_components_of_all_links(spark):
    """Buckets whose centre is like nobody still give up the links of the rest."""
    rng = random.Random(5)
    members = sorted({(rng.randrange(6), rng.randrange(40)) for _ in range(150)})
    near = {frozenset(p) for p in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if p[0] != p[1]}
    links = spark.createDataFrame([(min(p), max(p)) for p in near], "x long, y long")
    verify = lambda pairs: pairs.join(links, ((pairs["a"] == links["x"]) & (pairs["b"] == links["y"])) | ((pairs["a"] == links["y"]) & (pairs["b"] == links["x"])), "left_semi")
    found = common.link(spark.createDataFrame([(b, n, 0) for b, n in members], "bucket long, node long, mark long"), lambda a, b: a == b, verify)
    shared = [(x, y) for b, x in members for c, y in members if b == c and x < y and frozenset((x, y)) in near]
    expect = common.components(spark.createDataFrame(shared, "a long, b long"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(common.components(found)) == order(expect)


@pytest.mark.parametrize("carried", [templates.CARRIED, 0])
def test_templates(spark, carried):
    item = "John Smith bought 5 kg of apples in the market and then sold 3 kg to Mary for 7 dollars each day"
    bench = spark.createDataFrame([(1, item, "x"), (2, "short item here", "x"), (3, None, None), (None, "another item with no id but with quite a few plain words", "x"), (4, "too short", "x"), (5, "5 kg and 5 kg of apples are as much as 5 kg and 5 kg of pears", "x")], "item_id long, text string, id string")
    rows = [
        (1, "Intro words. " + item.replace("5", "8").replace("3", "2").replace("Mary", "Anna") + ". More"),
        (2, "x " + item),
        (3, "a short item here, yes"),
        (4, None),
        (None, "Short item here"),
        (5, "nothing to see at all in this one of the best"),
        (6, ""),
        (7, "too short"),
        (8, "another item with no id but with quite a few plain words " * 3),
        (9, "7 kg and 7 kg of apples are as much as 7 kg and 7 kg of pears"),
        (10, "7 kg and 8 kg of apples are as much as 9 kg and 6 kg of pears"),
        (11, item.lower().replace(" of ", " for ")),
        (2, "x " + item),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, hash string")
    got = {(r["__id"], r["item_id"]): (r["windows"], r["reworded"]) for r in templates.contaminated(docs, bench, carried).collect()}
    assert got.keys() == {(1, 1), (2, 1), (3, 2), (None, 2), (8, None), (9, 5), (11, 1)}  # (11, 1): after the other word
    assert got[1, 1][1] and not got[2, 1][1] and got[9, 5][1] and not got[8, None][1]
    left = templates.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 10]


def test_templates_find_planted_items(spark):
    """Every document that holds an item word by word is found, and only items that it holds in part."""
    tokens = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()]
    items = {r["item_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    runs = {i: {tuple(t[k : k + 10]) for k in range(len(t) - 9)} for i, t in items.items()}
    want = {(d, i) for d, t in docs.items() for i, r in runs.items() if r & {tuple(t[k : k + 10]) for k in range(len(t) - 9)}}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    assert want and got == want


def test_one_changed_mention_does_not_hide_a_copy(spark):
    item = "when Smith came to the river he saw a boat with a red sail and a man who sold fish to the people there and then Smith went home again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Smith went", "Smyth went")), (2, item.replace("Smith", "Jones")), (3, "nothing of it")], "doc_id long, text string")
    got = {r["__id"]: (r["windows"], r["reworded"]) for r in templates.contaminated(docs, bench).collect()}
    assert got.keys() == {1, 2} and got[1][0] >= 10 and not got[1][1] and got[2][1]


@pytest.mark.parametrize("carried", [templates.CARRIED, 0])
def test_copies_in_any_case_and_place(spark, carried):
    """Verbatim, lower, upper and title copies, after a heading, of short items and of such as are all names or numbers."""
    items = {
        1: "Anna Berg, Carl Dahl, Eva Falk, Gustav Holm, Ida Jansson, Karl Lund and Maria Nilsson",
        2: "What is the largest lake?",
        3: "12 km, 30 kg, 7 %, 3.5 m, 1999, 2004, 88, 90 and 14 V",
        4: "Every morning the baker at Hill Street takes 40 loaves from the oven and gives 12 of them to his neighbour",
    }
    made = [
        lambda t: "Question 12\n" + t,
        lambda t: "some words before it " + t + " and after it",
        lambda t: "Page Three\r\n" + t.lower(),
        lambda t: "Heading Of It " + t.upper(),
        lambda t: "so it goes " + t.title(),
    ]
    docs = [(10 * i + k, f(t)) for i, t in items.items() for k, f in enumerate(made)] + [(90, "What is the largest river?"), (91, "nothing\nof it")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, carried).collect()
    assert {(r["__id"], r["item_id"], r["reworded"]) for r in rows} == {(10 * i + k, i, False) for i in items for k in range(len(made))}


def test_one_slip_in_a_reworded_copy(spark):
    """Other names throughout and one slipped mention: the windows before it are found; slips everywhere are not."""
    item = "Smith sold 5 boats to Brown and Brown gave 5 nets to Smith before Smith left Brown alone"
    other = item.replace("Smith", "Jones").replace("Brown", "Green").replace("5", "8")
    slipped = other[: other.rindex("Green")] + "Grean alone"
    names = iter("Abel Bach Cook Dunn Ekman Frost Glad Hart Iles".split())
    torn = " ".join(next(names) if w in ("Smith", "Brown") else w for w in item.split())
    docs = spark.createDataFrame([(1, "then " + other), (2, "then " + slipped), (3, "then " + torn), (4, None)], "doc_id long, text string")
    got = {r["__id"]: (r["windows"], r["reworded"]) for r in templates.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (9, True), 2: (7, True)}


def plain_hits(docs, items, window=10):
    """All windows of every text compared with all of every item, token by token, by the rules as stated."""

    def tokens(text):
        found, opens = [], True
        for w in re.sub("[\n\r]", " \u2029 ", text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").split(" "):
            core = w.strip(templates.SPLIT_OFF)
            core = core.rstrip(templates.SPLIT_OFF + templates.SIGNS) if core[:1].isalpha() else core
            if core:
                low = core.lower()
                kind = templates.kind_of(low)
                found.append((low, kind, kind == 0 and core[0].isupper(), opens))
                opens = False
            opens = opens or re.search("[.!?:\u2029][\"')\\]»”’]*$", w) is not None
        return found

    def forms(some):
        words = [t[0] for t in some]
        out = [[0] * len(some)]
        for named in (False, True)[: 2 if len(some) == window else 1]:
            kinds = [templates.NAME if t[2] and (named or not t[3]) else t[1] for t in some]
            if 2 * kinds.count(0) >= len(some):
                out.append(kinds)
        return [(kinds, words) for kinds in out]

    def meeting(a, b):
        """The slots of two windows that meet, with the fewest slots; None if they don't."""
        met = [[(k, x, y) for k, x, y in zip(ka, wa, wb) if k] for ka, wa in forms(a)[1:] for kb, wb in forms(b)[1:] if ka == kb and all(k or x == y for k, x, y in zip(ka, wa, wb))]
        return set(min(met, key=len)) if met else set() if forms(a)[0] == forms(b)[0] else None

    def fits(slots):
        return len({s[:2] for s in slots}) == len(slots)

    hits, texts, asked = set(), {i: tokens(t) for i, t in docs.items()}, {i: tokens(t) for i, t in items.items()}
    for d, t in texts.items():
        for i, u in asked.items():
            n, shifts = min(window, len(u)), {}
            for p in range(len(t) - n + 1 if len(u) >= 3 else 0):
                for q in range(len(u) - n + 1):
                    if (slots := meeting(u[q : q + n], t[p : p + n])) is not None:
                        shifts.setdefault(p - q, []).append((slots, all(x[0] == y[0] for x, y in zip(u[q : q + n], t[p : p + n]))))
            for met in shifts.values():
                some = [s for s, _ in met]
                runs = (some[a : a + 3] for a in range(len(some) - 2))
                if fits(set().union(*some)) or any(same for _, same in met) or any(fits(set().union(*r)) for r in runs):
                    hits.add((d, i))
    return hits


def test_templates_equal_brute_force(spark, odd_docs):
    rng = random.Random(5)
    words = "the of Anna Bob Carl 5 7 12 kg saw a gave to and. Then: it was in Rome, $30 8km big with from by on".split()
    items = {i: " ".join(rng.choices(words, k=rng.choice([2, 3, 5, 9, 10, 14, 25, 40]))) for i in range(12)}
    docs = {}
    for d in range(120):
        text = items[rng.randrange(12)].split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        style = rng.choice([str, str.lower, str.upper, str.title])
        docs[d] = style(rng.choice(["", "Some Heading\n", "well "]) + " ".join(text) + rng.choice(["", ".\nmore of it"]))
    docs |= {100: None, 101: "", 102: " \n\r "}
    made = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (None, None)], "item_id long, text string")
    got = {(r["__id"], r["item_id"]) for r in templates.contaminated(made, bench).collect()}
    want = plain_hits(docs, items)
    assert len(want) > 30 and got == want
    odd = templates.contaminated(odd_docs, bench)
    assert odd.columns == ["__id", "__key", "item_id", "windows", "reworded"] and odd.count() >= 0
    assert templates.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
