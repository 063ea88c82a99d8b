"""Odd rows (nulls, empty and long texts, ties, repeats, clashing columns) through URL filters, substrings and archives, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import substrings, url_filter, warc


def test_repeated_passages(spark, odd_docs):
    """Every window of 35 words counted over all rows, one by one."""
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in odd_docs.collect()]
    seen = Counter(tuple(words[i : i + 35]) for _, words in rows for i in range(len(words) - 34))
    want = []
    for doc_id, words in rows:
        gone = set()
        for i in range(len(words) - 34):
            if seen[tuple(words[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.remove_repeats(odd_docs).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order) and any(r[2] for r in want)


PAGES = [
    (1, "HTTP://News.Example.com/en/a?q#f", "é" * 50, 1),
    (2, "http://example.com/en/", "é" * 50, 2),
    (2, "http://example.com/en/", "é" * 50, 2),
    (3, "http://www.example.com/en/x", "b" * 99, 3),
    (4, "no scheme", "b" * 99, 4),
    (5, None, None, None),
    (None, "ftp://Host.NET/es/b://c", "", 6),
    (None, "http://", "n" * 200, 7),
    (None, "http://x.fr?path/", "n" * 200, 8),
    (6, "http://fakeexample.com/en/", "long " * 400_000, 9),
    (7, "http://a.fr/", "long " * 400_000, 9),
    (8, "http://net/fr/", "é" * 50, 0),
]


def odd_pages(spark):
    return spark.createDataFrame([(*r, "d", 0, "k") for r in PAGES], "page_id long, url string, html string, n int, digest string, position int, host string")


def test_archives(spark):
    payloads = [(p, (h or "").encode()) for p, _, h, _ in PAGES]
    groups = defaultdict(list)
    for p, data in payloads:
        groups[data].append(p)
    want = []
    for p, data in payloads:
        ids = [i for i in groups[data] if i is not None]
        first = min(ids) if ids and len(data) >= 100 and len(groups[data]) > 1 else None
        refers = first if first is not None and p != first else None
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    rows = warc.archive(odd_pages(spark)).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(want, key=order)
    assert sorted(r["capture_order"] for r in rows) == list(range(min(r["capture_order"] for r in rows), min(r["capture_order"] for r in rows) + len(PAGES)))


def test_rules_on_odd_urls(spark):
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (8, None)], "page_id long, good int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(odd_pages(spark), labels).collect()]
    want = []
    for p, url, _, _ in PAGES:
        met = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in met[1]) if met else ""
        path = met[2] if met else ""
        fit = [(h + q, v) for (h, q), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(q)]
        want.append((p, host, path, *max(fit, key=lambda f: len(f[0]), default=(None, None))))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:3])
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:4] == w[:4] and (g[4] == w[4] if w[3] else g[4] in ("allow", "block"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=8), max_size=9))
def test_loser_tree_is_a_sort(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
