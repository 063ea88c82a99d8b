"""Ordered scans and anchored windows against plain-Python walks, hot keys included."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.plans import sizing
from tidelog.plans.anchored import WINDOW_START, anchored_windows, first_in_windows
from tidelog.plans.ordered import OrderedScan, Slicer

SCHEMA = "k string, t long, id long, v long"


def make_rows(seed, n=240, span=4000, hot=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        # a burst of equal times in the hot key
        t = 1000 if rng.random() < 0.15 else rng.randrange(span)
        rows.append((key, t, i, rng.choice([None, 1, 2, 3])))
    return rows


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("limit", [None, 7, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_scan_matches_walk(spark, seed, limit):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    scan = OrderedScan.open(df, ["k"], ["t", "id"], rows_per_task=limit)
    assert scan.sliced == (limit is not None)
    scan = scan.lag(pt=F.col("t"), pv=F.col("v")).running_sum(s=F.coalesce("v", F.lit(0))).last(lv=F.col("v"))
    scan = scan.number("rn").reversed().last(nv=F.col("v")).lag(nt=F.col("t"))
    got = {r["id"]: (r["pt"], r["pv"], r["s"], r["lv"], r["rn"], r["nv"], r["nt"]) for r in scan.result().collect()}
    want = {}
    for group in by_key(rows).values():
        total, last = 0, None
        for i, (_, t, rid, v) in enumerate(group):
            total += v or 0
            last = v if v is not None else last
            prev = group[i - 1] if i else (None, None, None, None)
            ahead = next((g[3] for g in group[i:] if g[3] is not None), None)
            nt = group[i + 1][1] if i + 1 < len(group) else None
            want[rid] = (prev[1], prev[3], total, last, i + 1, ahead, nt)
    assert got == want


def test_slices_are_balanced(spark):
    df = spark.range(2000).select(F.lit("x").alias("k"), F.lit(5).alias("t"), F.col("id"))
    slicer = Slicer.plan(df, ["k"], ["t", "id"], rows_per_task=100)
    sizes = [r["count"] for r in slicer.attach(df).groupBy("__slice").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) > 10 and max(sizes) < 400


def walk_windows(rows, width, strict, origin=None):
    out = {}
    for group in by_key(rows).values():
        start, pos = origin, 0
        for _, t, rid, _ in group:
            if start is None or (t - start > width if strict else t - start >= width):
                start, pos = t, 0
            pos += 1
            out[rid] = (start, pos)
    return out


@pytest.mark.parametrize("mode", ["fold", "arrow", "hot", "some_hot"])
@pytest.mark.parametrize("width,strict", [(50, True), (700, False), (3, False)])
def test_anchored_matches_walk(spark, mode, width, strict):
    rows = make_rows(width)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t")).repartition(3)
    options = {"fold": {}, "arrow": {"fold_rows": 0}, "hot": {"rows_per_task": 6}, "some_hot": {"rows_per_task": 60}}
    windows = anchored_windows(df, ["k"], "ts", width, strict=strict, **options[mode])
    want = walk_windows(rows, width, strict)
    assert {r["id"]: r[WINDOW_START] for r in windows.collect()} == {i: start for i, (start, _) in want.items()}
    for limit, largest in ((1, 1), (2, 2), (5, 5000)) if mode == "fold" else ():
        kept = first_in_windows(windows, ["k"], "id", limit, largest, rows_per_task=20)
        assert sorted(r["id"] for r in kept.collect()) == sorted(i for i, (_, pos) in want.items() if pos <= limit)


@pytest.mark.parametrize("limit", [None, 30])
def test_anchored_origin(spark, limit):
    rows = make_rows(9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t"))
    windows = anchored_windows(df, ["k"], "ts", 333, origin_us=-100, rows_per_task=limit)
    want = walk_windows(rows, 333, False, origin=-100)
    assert {r["id"]: r[WINDOW_START] for r in windows.collect()} == {i: start for i, (start, _) in want.items()}
    kept = first_in_windows(windows, ["k"], "id", 1, 1, from_origin=True)
    assert sorted(r["id"] for r in kept.collect()) == sorted(i for i, (_, pos) in want.items() if pos == 1)


def test_unbroadcast_windows(spark, monkeypatch):
    from tidelog.plans import anchored

    monkeypatch.setattr(anchored, "maybe_broadcast", lambda df: df.hint("merge"))
    rows = make_rows(77)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t"))
    got = {r["id"]: r[WINDOW_START] for r in anchored_windows(df, ["k"], "ts", 77).collect()}
    assert got == {i: start for i, (start, _) in walk_windows(rows, 77, False).items()}


def test_tables_too_large_to_broadcast_are_shuffled(spark):
    """Spark takes an exploded table for a small one and would broadcast it by itself."""
    big = sizing.staged(spark.range(2000).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x")))
    rows = spark.range(3000).select(F.col("id").alias("k"))
    joined = rows.join(sizing.maybe_broadcast(big, max_rows=100), "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 2000 * 21
    assert "Broadcast" in rows.join(sizing.maybe_broadcast(big), "k")._jdf.queryExecution().executedPlan().toString()


def test_long_keys_are_walked_in_slices_of_bounded_rows(spark):
    """a key of some million rows was one task."""
    rows = spark.range(1_200_000).select(F.lit("all").alias("k"), F.col("id").alias("t"))
    slicer = Slicer.plan(rows, ["k"], ["t"])
    assert slicer.hot
    sizes = [r["n"] for r in slicer.attach(rows).groupBy("__slice").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1_200_000 and max(sizes) <= 700_000
    assert not Slicer.plan(rows, ["k"], ["t"], hot_above=2_000_000).hot
