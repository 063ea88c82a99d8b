"""Line deduplication and the language model against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import line_dedup, quality
from tidelog.llm.common import prepare

SF = "/root/testdata/sf0.001"


def norm(line):
    """A line's lower-case words of letters; its other words if it has no letters."""
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()) or line.lower().split())


def similar(keys):
    """All pairs (places in ``keys``) of edit similarity 0.9 and more, in words if one has over LONG_WORDS."""
    con = duckdb.connect()
    long = {i for i, k in enumerate(keys) if len(k.split()) > line_dedup.LONG_WORDS}
    rows = pa.table({"i": range(len(keys)), "k": keys, "long": [i in long for i in range(len(keys))]})
    con.register("rows", rows)
    pairs = con.execute(
        "SELECT x.i, y.i FROM rows x JOIN rows y ON x.i < y.i AND NOT x.long AND NOT y.long "
        "AND abs(length(x.k) - length(y.k)) <= floor(greatest(length(x.k), length(y.k)) * 0.1 + 1e-6) "
        "AND levenshtein(x.k, y.k) <= floor(greatest(length(x.k), length(y.k)) * 0.1 + 1e-6)"
    ).fetchall()
    for i in long:
        for j in range(len(keys)):
            if j < i or j not in long:
                names = {}
                a, b = ("".join(chr(0x100 + names.setdefault(w, len(names))) for w in keys[n].split()) for n in (i, j))
                most = math.floor(max(len(a), len(b)) * 0.1 + 1e-6)
                if i != j and abs(len(a) - len(b)) <= most and con.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= most:
                    pairs.append((i, j))
    return pairs


def brute_lines(rows):
    """Places of removed lines by edit similarity alone; rows are (row number, id, text)."""
    places = defaultdict(list)
    for n, i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if key := norm(line):
                places[key].append((i is None, i or 0, n, k))
    keys = list(places)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar(keys):
        root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, key in enumerate(keys):
        groups[find(i)] += places[key]
    return {(n, k) for g in groups.values() for _, _, n, k in sorted(g)[1:]}




def test_lines_against_edit_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_lines([(i, i, t) for i, t in texts.items()])
    out = line_dedup.deduplicate_lines(docs)
    # Links that the blocks miss leave groups finer: fewer lines go, never others.
    assert sum(r["__n_removed"] for r in out.collect()) >= 0.95 * len(want) > 0
    for r in out.collect():
        lines = (texts[r["doc_id"]] or "").split("\n")
        must_stay = [line for k, line in enumerate(lines) if (r["doc_id"], k) not in want]
        kept = iter((r["text"] or "").split("\n"))
        assert not must_stay or all(line in kept for line in must_stay), r["doc_id"]


def test_recall_of_changed_lines(spark):
    """One and two letters changed, put in or left out, anywhere in real lines of ten words and more, and one in shorter ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = sorted({line for r in docs.collect() for line in (r["text"] or "").split("\n") if 24 <= len(norm(line)) < 5_000})
    rng = random.Random(7)

    def changed(line, times):
        letters = list(line)
        for i in rng.sample([i for i, c in enumerate(letters) if c.isascii() and c.isalpha()], times):
            letters[i] = rng.choice([rng.choice("bdgkmpt"), "", letters[i] + "x"])
        return "".join(letters)

    for times, least, words in ((1, 0.97, 0), (2, 0.97, 10)):
        pairs = [(line, changed(line, times)) for line in lines if len(norm(line).split()) >= words]
        pairs = [p for p in pairs if norm(p[0]) != norm(p[1])]
        # Each pair is a corpus of two documents within one: ids 2n and 2n + 1.
        df = spark.createDataFrame([(2 * n + k, p[k]) for n, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
        found = {r["doc_id"] for r in line_dedup.deduplicate_lines(df).filter("__n_removed > 0").collect()}
        assert sum(2 * n + 1 in found for n in range(len(pairs))) >= least * len(pairs) > 100


def test_fuzzy_lines(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    texts = {
        1: "Keep this first line of text\n" + long,
        2: "keep THIS first line, of text!\n" + long.replace("wordba ", "wordbz "),
        3: "Page 3 of 9\nPage 4 of 9 now\nAnd so.\nAnd so.",
        4: "page 77 of 1 now\n\n\n" + " ".join(reversed(long.split())),
        5: None,
        6: "",
    }
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, node string, line int")
    out = line_dedup.deduplicate_lines(docs)
    got = {r["doc_id"]: (r["text"], r["__n_lines"], r["__n_removed"]) for r in out.collect()}
    assert out.columns[:4] == docs.columns
    assert got[1] == (texts[1], 2, 0)
    assert got[2] == ("", 2, 2)
    assert got[3] == ("Page 3 of 9\nPage 4 of 9 now\nAnd so.", 4, 1)
    assert got[4] == ("\n\n" + texts[4].split("\n")[3], 4, 1)
    assert got[5] == (None, 0, 0) and got[6] == ("", 1, 0)


def test_short_lines_and_other_scripts(spark):
    chinese = "这个网站使用网络信标来提供更好的服务请阅读我们的隐私政策"
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(505)]
    rows = [
        (1, f"OK then\n2024-01-01 10:00\n{chinese}\nab 1\ncat sat\nａｂ ｃ\n" + " ".join(words)),
        (2, f"ok, THEN\n2024-01-01 10:00\n{chinese[:9]}们{chinese[10:]}\nac 2\ncats at\nａｂ ｄ\n" + " ".join(words[:495])),
        (3, "2024-01-01 10:01\n \n \n---\n---"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Of lines under ten letters only equal ones go; 505 words and the first 495 of them are alike.
    assert got[1] == rows[0][1] and got[2] == "ac 2\ncats at\nａｂ ｄ"
    # One of 16 characters differs; blank lines stay, a repeated rule goes.
    assert got[3] == " \n \n---"


def test_lines_without_any(spark):
    for rows in ([], [(1, None), (None, ""), (2, " \n\t")]):
        out = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r["text"] or "", r["__n_removed"]) for r in out.collect()) == sorted((t or "", 0) for _, t in rows)


def test_wide_simhash_equals_narrow(spark):
    q = spark.range(1).select(F.array(*[F.xxhash64(F.lit(f"w{i * i % 37}")) for i in range(63)]).alias("q"))
    a, b = q.select(F.expr(line_dedup.NARROW), F.expr(line_dedup.WIDE)).first()
    hashes = [xxhash.xxh64_intdigest(f"w{i * i % 37}".encode(), seed=42) for i in range(63)]
    assert a == b == sum(1 << k for k in range(64) if k % 8 < 4 and 2 * sum(h >> k & 1 for h in hashes) > 63)


def test_open_buckets_are_compared_in_cells(spark, monkeypatch):
    """Lines with an equal end that are else unlike: all ties of parts are found, and no pair of lines becomes a row."""
    rng = random.Random(5)

    def word():
        return "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))

    end = " ".join(word() for _ in range(20))
    lines = []
    for _ in range(300):
        lines.append(f"{' '.join(word() for _ in range(16))} {end}")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(60)
            lines.append(lines[-1][:k] + "z" + lines[-1][k + 1 :])
    norms = spark.createDataFrame([(i, t, len(t.split()), None) for i, t in enumerate(lines)], "node long, norm string, n int, symbols string")
    open_ = norms.select(F.lit(1).cast("long").alias("bucket"), "node", F.col("node").alias("part"))
    monkeypatch.setattr(line_dedup, "CELL_LINES", 16)
    got = {(r["b"], r["a"]) for r in line_dedup.compared(open_, norms).collect()}
    assert got == set(similar(lines)) and len(got) > 200
    # The whole query goes that way, and verifies no more pairs than a few for each line.
    seen = []
    verified, compared = line_dedup.verified, line_dedup.compared
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, norms: seen.append(pairs.count()) or verified(pairs, norms))
    monkeypatch.setattr(line_dedup, "compared", lambda open_, norms: seen.append(0) or compared(open_, norms))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    out = {r["doc_id"] for r in line_dedup.deduplicate_lines(docs).filter("__n_removed > 0").collect()}
    assert 0 in seen and sum(seen) < 20 * len(lines)
    want = {n for n, _ in brute_lines([(i, i, t) for i, t in enumerate(lines)])}
    assert out <= want and len(out) > 0.9 * len(want)


def test_odd_lines(spark, odd_docs):
    out = line_dedup.deduplicate_lines(odd_docs)
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    kept = {r["id"]: r for r in out.collect()}
    assert kept[3]["text"] is None and kept[4]["text"] == "" and kept[0]["text"] == kept[1]["text"]
    assert kept[12]["text"] == "Page 3 of 9"  # the passage stays in row 0
    assert kept[6]["text"] == odd_docs.filter("id = 6").first()["text"] and kept[7]["text"] == ""  # one of two long lines that differ in three words


def brute_perplexity(train, text):
    """Interpolated modified Kneser-Ney over characters, by recursion."""
    n = quality.ORDER
    counts = {k: Counter() for k in range(1, n + 1)}
    for t in train:
        padded = quality.START * (n - 1) + t
        for i in range(n - 1, len(padded)):
            counts[n][padded[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    d, totals, kinds = {}, {}, {}
    for k in range(1, n + 1):
        c = Counter(counts[k].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        d[k] = {i: min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.0), float(i)) if c[1] and c[i] and c[i + 1] else quality.FALLBACK[i] for i in (1, 2, 3)}
        totals[k], kinds[k] = Counter(), defaultdict(Counter)
        for gram, m in counts[k].items():
            totals[k][gram[:-1]] += m
            kinds[k][gram[:-1]][min(m, 3)] += 1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        context, m = gram[:-1], counts[k][gram]
        if not totals[k][context]:
            return p(gram[1:])
        weight = sum(d[k][i] * kinds[k][context][i] for i in (1, 2, 3)) / totals[k][context]
        return (m - d[k][min(m, 3)] if m else 0) / totals[k][context] + weight * p(gram[1:])

    padded = quality.START * (n - 1) + text
    logs = [math.log(p(padded[i - n + 1 : i + 1])) for i in range(n - 1, len(padded))]
    return round(math.exp(-sum(logs) / len(logs)), 4) if logs else None


def test_perplexity_equals_brute_force(spark):
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()}
    train = [i for i in docs if i % 3]
    table = spark.createDataFrame([(i, *docs[i]) for i in docs], "doc_id long, text string, lang string")
    model = quality.train(table.filter("doc_id % 3 <> 0"))
    got = {r["doc_id"]: r["__perplexity"] for r in quality.perplexity(table, model).collect()}
    for lang in {v[1] for v in docs.values()}:
        own = [docs[i][0] for i in train if docs[i][1] == lang]
        for i in [i for i in docs if docs[i][1] == lang][:6]:
            assert got[i] == pytest.approx(brute_perplexity(own, docs[i][0]), abs=2e-4)


def test_many_characters_take_the_other_way(spark, monkeypatch):
    text = "".join(chr(0x4E00 + i) for i in range(200)) + "abcabc🙂"
    docs = spark.createDataFrame([(1, text, "zh"), (2, "abc" + text[50:90], "zh")], "doc_id long, text string, lang string")
    want = [quality.distinct_grams([text])[0].to_pylist(), quality.perplexities([text], *_logs(text)).tolist()]
    monkeypatch.setattr(quality.Grams, "keys", _overflow)
    assert [quality.distinct_grams([text])[0].to_pylist(), quality.perplexities([text], *_logs(text)).tolist()] == want
    assert docs.count() == 2


def _overflow(self, points):
    raise OverflowError


def _logs(text):
    grams, counts = quality.distinct_grams([text])
    return grams, -1.0 - counts / 7


def test_odd_quality(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0, 9), (5, 1, 0, 9), (6, 1, 0, 9), (6, 0, 0, 9), (None, 1, None, 9), (50, 1, None, 9)], "doc_id long, quality int, toxic int, n int")
    out = quality.classify(odd_docs, labels)
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert not any(rows[i]["__keep"] for i in (3, 4, 9))  # null and empty texts
    assert rows[10]["__keep"] and rows[10]["__perplexity"] is None  # a language without a model
    assert all(r["__keep"] is not None for r in rows.values())


def test_held_out_accuracy(spark):
    """On data that set neither counts nor thresholds: most bad texts go, nearly all good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    prepare(spark)
    seen = labels.filter("doc_id % 2 = 0")
    judged = quality.classify(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("__keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in judged}
    assert kept[1] > 0.85 and kept[0] < 0.4, kept


def test_held_out_toxic_and_junk_go(spark):
    """A few bad words in a long text and words said over and over are found; good texts, toxic ones apart, stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    prepare(spark)
    judged = quality.classify(docs, labels.filter("doc_id % 2 = 0"))
    rows = {r["doc_id"]: (r["__keep"], r["lang"]) for r in judged.select("doc_id", "__keep", "lang").collect()}
    kept = defaultdict(list)
    for r in labels.filter("doc_id % 2 = 1").collect():
        keep, lang = rows[r["doc_id"]]
        kept["junk" if r["quality"] == 0 else "good" if not r["toxic"] else f"toxic {lang}"].append(keep)
    share = {k: sum(v) / len(v) for k, v in kept.items()}
    assert share["good"] > 0.95 and share["junk"] < 0.3 and share["toxic en"] < 0.1, share
    assert not any(rows[i][0] for i in (499, 679, 730, 763))


def test_measures_find_bad_runs():
    text = "the cat and the dog sat on the mat by the door. " * 3
    grams, counts = quality.distinct_grams([text, "Orre " * 100, text + "zq"])
    logs = np.log(counts / counts.sum())
    repeats, worst, mean = quality.measures([text, "Orre " * 100, text + "zq", ""], grams, logs)
    assert repeats[1] > 0.95 > repeats[0] and worst[2] > worst[0] and mean[0] == quality.perplexities([text], grams, logs)[0]
    assert np.isnan([repeats[3], worst[3], mean[3]]).all()


def test_texts_are_stored_once(spark, tmp_path, monkeypatch):
    """Chunks of any size score alike; their files hold the texts, and neither tables nor shuffles move them again."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("01 ", k=8_000)) if i % 7 else None, "en" if i % 3 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.train(docs.filter("doc_id < 20 AND lang = 'en'"))
    monkeypatch.setattr("tidelog.llm.common.ensure_checkpoint_dir", lambda _: f"file://{tmp_path}")
    found = {}
    for chars in (12_000_000, 20_000):
        monkeypatch.setattr(quality, "CHUNK_CHARS", chars)
        scored = quality.perplexity(docs, model)
        found[chars] = sorted((r["doc_id"], r["text"], r["__some"], *[r[m] for m in quality.MEASURES]) for r in scored.collect())
        assert "Cogroup" not in scored._jdf.queryExecution().toString()
    assert found[20_000] == found[12_000_000] and [r[:2] for r in found[20_000]] == [r[:2] for r in rows]
    assert all((r[-1] is None) == (text is None or lang == "de") for r, (_, text, lang) in zip(found[20_000], rows))
    sizes = {name: sum(p.stat().st_size for p in tmp_path.glob(f"{name}-*/**/*") if p.is_file()) for name in ("chunks", "dealt")}
    assert sizes["chunks"] > 10 * sizes["dealt"] > 0
