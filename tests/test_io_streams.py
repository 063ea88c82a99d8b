"""Sources, sinks, composition; streams equal tables, in several batches and out of order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import aggregates, multiline, numbering, pairs, suppress
from tidelog.plans.flow import Flow, run_flow, run_stage
from tidelog.sources import readers, sinks
from tidelog.specs import Scoped
from tidelog.streaming import closing, native, state, stepped

T0 = datetime(2024, 1, 1)
SCHEMA = "source string, ts timestamp, id long, k string, value double, line string"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events in three files, in time order per file but shuffled within; some have no time."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("events")
    rows = []
    for i in range(240):
        source = rng.choice(["L", "R", "L2"])
        rows.append((source, T0 + timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(5)), i, rng.choice(["x", "x", "y", None]), float(rng.randrange(9)), rng.choice(["S a", " b", "c\td"])))
    rows.sort(key=lambda r: r[1])
    rows = [(r[0], None, *r[2:]) if r[2] % 19 == 0 else r for r in rows]
    for n in range(3):
        chunk = rows[n * 80 : n * 80 + 80]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"), timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    table = spark.createDataFrame(rows, SCHEMA).persist()
    return str(folder / "in"), table


def closable(spark, files, tmp_path):
    return closing.closable(readers.stream_records(spark, "json", files[0], SCHEMA, max_files=1), str(tmp_path / "closing"))


def run(spark, files, tmp_path, build):
    out = build(closable(spark, files, tmp_path))
    closing.ingest_to_end(out, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "closing"))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def stepped_run(spark, files, tmp_path, start):
    """``start(stream, path, checkpoint)`` to the end."""
    for _ in range(2):
        start(closable(spark, files, tmp_path), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        closing.close(spark, str(tmp_path / "closing"))
    return spark.read.parquet(str(tmp_path / "out")).drop("batch")


def same(got, want, columns):
    rows = [sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (got, want)]
    assert rows[0] == rows[1] and rows[0]


LIMITS = Scoped({"limit": 2, "window": "5m"}, {"R": {"limit": 1, "window": "90s"}})
SUPPRESSION = {
    "dedupe": ({"fields": ["source", "k"], "window": "90s"}, {}),
    "debounce": ({"field": "k", "window": "3m"}, {}),
    "uniq": ({"field": "k", "window": "30s"}, {}),
    "rate_limit": (LIMITS, {}),
}


@pytest.mark.parametrize("name", SUPPRESSION)
def test_stream_suppression(spark, files, tmp_path, name):
    rules, options = SUPPRESSION[name]
    got = run(spark, files, tmp_path, lambda s: getattr(state, name)(s, rules, **options))
    same(got, getattr(suppress, name)(files[1], rules, **options), ["source", "ts", "id", "k", "value", "line"])


@pytest.mark.parametrize("rules", [{"start": 5}, Scoped({"field": "n"}, {"R": {"field": "m", "start": 100}}), Scoped(None, {"R": {}})])
def test_stream_sequence(spark, files, tmp_path, rules):
    got = run(spark, files, tmp_path, lambda s: state.sequence(s, rules, per_source="source"))
    want = numbering.sequence(files[1], rules, per_source="source")
    assert want.filter("ts IS NULL").count() > 5 and got.columns == want.columns
    same(got, want, want.columns)


@pytest.mark.parametrize("rules", [{"start": 5}, Scoped({"field": "n"}, {"R": {"field": "m", "start": 100}})])
@pytest.mark.parametrize("limit", [None, 30])
def test_stream_sequence_shared(spark, files, tmp_path, rules, limit):
    start = lambda s, path, checkpoint: stepped.start_sequence(s, rules, path, checkpoint, delay="2m", rows_per_task=limit)
    want = numbering.sequence(files[1], rules)
    same(stepped_run(spark, files, tmp_path, start), want, want.columns)


@pytest.mark.parametrize("rules, origin", [({"limit": 3, "window": "5m"}, None), ({"limit": 4, "window": "7m"}, 1704066600000000), (Scoped({"limit": 2, "window": "4m"}, {"R": {"limit": 1, "window": "90s"}}), None), (Scoped(None, {"R": {"limit": 1, "window": "40m"}}), None)])
def test_stream_ceiling_shared(spark, files, tmp_path, rules, origin):
    start = lambda s, path, checkpoint: stepped.start_ceiling(s, rules, path, checkpoint, origin_us=origin)
    same(stepped_run(spark, files, tmp_path, start), suppress.ceiling(files[1], rules, origin_us=origin), files[1].columns)


@pytest.mark.parametrize("unmatched", [False, True])
def test_stream_nearest(spark, files, tmp_path, unmatched):
    start = lambda s, path, checkpoint: stepped.start_nearest(s, F.col("source") == "L", "k", "2m", path, checkpoint, keep_unmatched=unmatched, delay="30s")
    timed = files[1].filter("ts IS NOT NULL")
    want = pairs.nearest_join(timed.filter("source = 'L'"), timed.filter("source <> 'L'"), "k", "2m", keep_unmatched=unmatched)
    same(stepped_run(spark, files, tmp_path, start), want, want.columns)


def test_a_batch_run_again_starts_from_the_one_before(spark, files, tmp_path, monkeypatch):
    """The step fails after its output is written, once in each batch: nothing comes out twice."""
    failed = set()
    write = stepped.Steps.write

    def breaking(self, batch, name, df):
        if name == "carry" and batch not in failed:
            failed.add(batch)
            raise OSError("lost")
        return write(self, batch, name, df)

    monkeypatch.setattr(stepped.Steps, "write", breaking)
    for attempt in range(9):
        query = stepped.start_sequence(closable(spark, files, tmp_path), {"start": 1}, str(tmp_path / "out"), str(tmp_path / "state"))
        try:
            query.awaitTermination()
        except Exception:
            continue
        if closing.closed(spark, str(tmp_path / "closing")):
            break
        closing.close(spark, str(tmp_path / "closing"))
    assert len(failed) == 4
    same(spark.read.parquet(str(tmp_path / "out")), numbering.sequence(files[1], {"start": 1}), ["source", "id", "seq"])
    assert len(stepped.Steps(spark, str(tmp_path / "state")).batches()) == 2


MULTILINE = [
    {"start_pattern": "^S", "max_lines": 3, "timeout": "40s"},
    {"continue_pattern": "^ ", "timeout": "1m"},
    {"start_pattern": "^S"},
    Scoped({"start_pattern": "^S", "field": "text"}, {"R": {"continue_pattern": "^ ", "timeout": "2m", "field": "body"}, "L2": {"start_pattern": "^c", "max_lines": 2, "field": "text"}}),
    Scoped(None, {"R": {"start_pattern": "^S", "field": "body"}}),
]


@pytest.mark.parametrize("rule", MULTILINE)
def test_stream_multiline(spark, files, tmp_path, rule):
    got = run(spark, files, tmp_path, lambda s: state.assemble_multiline(s, rule))
    want = multiline.assemble_multiline(files[1], rule)
    assert got.columns == want.columns
    same(got, want, want.columns)


def test_multiline_text_goes_to_the_rules_own_field(files):
    out = multiline.assemble_multiline(files[1], MULTILINE[3])
    assert out.filter("source = 'R' AND (body IS NULL OR text IS NOT NULL)").count() == 0
    assert out.filter("source <> 'R' AND (body IS NOT NULL OR text IS NULL)").count() == 0
    assert {(r["n_lines"], r["id"] % 19) for r in out.filter("ts IS NULL").collect()} == {(1, 0)}


def test_stream_pairs(spark, files, tmp_path):
    rule = {"left_source": "L", "right_source": "R", "key_field": "k", "window": "30s"}
    build = lambda s: state.pair_join(s, rule).select(F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id"), F.col("left.ts").alias("left_ts"))
    same(run(spark, files, tmp_path, build), pairs.pair_join(files[1], rule), ["left_id", "right_id", "left_ts"])


def test_stream_anchored(spark, files, tmp_path):
    got = run(spark, files, tmp_path, lambda s: state.anchored_totals(s, "value", "4m"))
    rules = [{"field": "value", "op": "sum", "window": "4m"}]
    want = aggregates.anchored_agg(files[1], rules).withColumnRenamed("value", "sum")
    same(got, want, ["source", "window_start", "sum"])


def test_stream_anchored_rules(spark, files, tmp_path):
    rules = Scoped(
        [{"field": "value", "op": op, "window": "4m"} for op in ("count", "sum", "min", "max")] + [{"field": "id", "op": "max", "window": "9m"}, {"field": "line", "op": "sum", "window": "9m"}],
        {"R": [{"field": "value", "op": "min", "window": "9m"}], "L2": []},
    )
    got = run(spark, files, tmp_path, lambda s: state.anchored_agg(s, rules))
    want = aggregates.anchored_agg(files[1], rules)
    assert got.columns == want.columns
    same(got, want, want.columns)


def test_stream_alerts(spark, files, tmp_path):
    from tidelog.operators import counters

    table = files[1].filter("ts IS NOT NULL")
    rules = [{"counter": "L", "threshold": 20, "cooldown": "10m"}, {"counter": "R", "threshold": 50}]
    stream = lambda where: readers.stream_records(spark, "json", files[0], SCHEMA, max_files=1)
    out = state.threshold_alerts(stream(tmp_path), rules, "1m", name="source")
    sinks.resume_ingest(out, str(tmp_path / "a"), str(tmp_path / "sa"))
    want = counters.threshold_alerts(counters.counter_report(table, "source", "1m"), rules)
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "a"))
    # Alerts go on for as long as time does, so this stream is not closed: all ticks the watermark has passed.
    reached = table.agg(F.max("ts")).first()[0]
    same(got, want.filter(F.col("tick") <= F.lit(reached)), ["tick", "name", "value"])
    rules = Scoped([{"field": "line", "pattern": "S a|c", "threshold": 20, "repeat": True}, {"field": "k", "pattern": "y", "threshold": 5}], {"R": [{"field": "line", "pattern": "b", "threshold": 3}]})
    got = run(spark, files, tmp_path / "b", lambda s: state.match_alerts(s, rules))
    want = counters.match_alerts(table, rules)
    same(got, want, ["source", "id", "rule", "count"])


def test_a_closed_stream_takes_no_more(spark, files, tmp_path):
    build = lambda s: state.sequence(s, per_source="source")
    got = run(spark, files, tmp_path, build).count()
    # Closing again changes nothing; going on as if it were open fails.
    assert run(spark, files, tmp_path, build).count() == got
    with pytest.raises(ValueError, match="closed"):
        closing.ingest(build(closable(spark, files, tmp_path)), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "closing"))


class Held:
    """State handles in memory, with a count of rows written."""

    def __init__(self):
        self.written = 0
        self.maps, self.values, self.timers = {}, {}, []

    def getMapState(self, name, *_):
        held, outer = self.maps.setdefault(name, {}), self

        class Map:
            def updateValue(self, key, value):
                outer.written += len(value[0])
                held[key] = value

            getValue, removeKey = held.__getitem__, held.pop

        return Map()

    def getValueState(self, name, *_):
        held = self.values

        class Value:
            exists = lambda self: name in held
            get = lambda self: held[name]
            clear = lambda self: held.pop(name, None)

            def update(self, value):
                held[name] = value

        return Value()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def walked(n, steps):
    """Rows and rows written when n rows come in ``steps`` batches, each held for a fifth of the whole time."""
    rng = random.Random(n)
    held = Held()
    walk = state.Number()
    walk.init(held)
    rows = [(i * 10**9 // n, f"{i:09d}") for i in range(n)]
    out, per = [], n // steps
    for s in range(steps + steps // 5 + 2):
        batch = rows[s * per : s * per + per]
        rng.shuffle(batch)
        now = (s - steps // 5) * (10**6 // steps)
        list(walk.handleInputRows(("k",), iter([{"t": t, "id": i, "tag": "1", "row": i} for t, i in batch]), Clock(max(now, 0))))
        held.timers[:] = [t for t in held.timers if t > now]
        out += [r["row"] for r in walk.handleExpiredTimer(("k",), Clock(now), None)]
    assert out == [i for _, i in rows] and not held.maps["runs"] and "index" not in held.values
    return held.written


def test_held_rows_are_written_about_once():
    """Ten times the rows, ten times the work; a row isn't written again at each timer."""
    few, many = walked(20_000, 40), walked(200_000, 40)
    assert few < 2.5 * 20_000 and many < 1.3 * 200_000
    assert walked(20_000, 400) < 4 * 20_000


def test_output_of_a_key_leaves_in_small_chunks():
    """Spark's worker gathers all that a key puts out, which was each row as it is."""

    class Absent(Held):
        """As on Spark, a value that isn't there reads as None."""

        def getValueState(self, name, *_):
            value = super().getValueState(name)
            value.get = lambda: self.values.get(name)
            return value

    walk = state.Chunked(state.Number(), ["seq", "row"])
    walk.init(Absent())
    rows = [{"t": i, "id": f"{i:09d}", "tag": "1", "row": f'{{"id": {i}, "source": "error", "props": "some text"}}'} for i in range(20_000)]
    assert not list(walk.handleInputRows(("k",), iter(rows), Clock(0)))
    chunks = [r["chunk"] for r in walk.handleExpiredTimer(("k",), Clock(10**6), None)]
    assert [x for c in chunks for x in state._spread(c)] == [(i + 1, r["row"]) for i, r in enumerate(rows)]
    assert len(chunks) == 5 and sum(map(len, chunks)) < 20_000 * 20


def test_small_keys_share_a_visit():
    """a visit of the state store per key and batch took most of the time of streams of many small keys."""
    import pyarrow as pa

    class Absent(Held):
        def getValueState(self, name, *_):
            value = super().getValueState(name)
            value.get = lambda: self.values.get(name)
            return value

    def runs(rows):
        columns = ["bucket", "t", "id", "key", "tag", "row"]
        whole = pa.RecordBatch.from_pylist([dict(zip(columns, (0, t, f"{t:09d}", f"k{t % 700}", "1", str(t)))) for t in rows])
        return [r for b in state._packed_runs(iter([whole.slice(0, 999), whole.slice(999)])) for r in b.to_pylist()]

    held = Absent()
    walk = state.Packed(state.Number(), ["seq", "row"])
    walk.init(held)
    rows = list(range(1_000, 8_000))
    random.Random(1).shuffle(rows)
    out = []
    for part, now in ((rows[:5_000], 4), (rows[5_000:], 10)):
        assert not list(walk.handleInputRows((0,), iter(runs([t for t in part if t > 4_000 or now == 4])), Clock(0)))
        # Seven hundred keys, each row of another one: ten runs hold them.
        assert len(held.maps["runs"]) <= 20
        out += [r for c in walk.handleExpiredTimer((0,), Clock(now), None) for r in state._spread(c["chunk"])]
    came = sorted(rows[:5_000] + [t for t in rows[5_000:] if t > 4_000])
    seen = {}
    want = [(seen.setdefault(t % 700, []).append(t) or len(seen[t % 700]), str(t)) for t in came]
    assert out == want and not held.maps["runs"] and "index" not in held.values
    # A run with rows before those walked loses them alone.
    list(walk.handleInputRows((0,), iter(runs([9_999, 10_000, 10_001])), Clock(10)))
    assert [r[1] for c in walk.handleExpiredTimer((0,), Clock(20), None) for r in state._spread(c["chunk"])] == ["10001"]


def test_stream_per_batch(spark, files, tmp_path):
    from tidelog.operators import lookup

    ranges = spark.createDataFrame([(16909060, 16909060, "here")], "start long, end long, name string")
    stream = readers.stream_records(spark, "json", files[0], SCHEMA).withColumn("ip", F.lit("1.2.3.4"))
    build = lambda rows: lookup.geo_enrich(rows, ranges, "ip", "geo").select("id", F.col("geo")["name"].alias("name"))
    native.start_per_batch(stream, build, lambda out: out.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("name = 'here'").count() == 240


def test_start_batches(spark, files, tmp_path):
    stream = readers.stream_records(spark, "json", files[0], SCHEMA)
    query = sinks.start_batches(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "state"), max_size=50, interval="1 second")
    query.processAllAvailable()
    query.stop()
    sizes = [r["count"] for r in spark.read.schema("id long").json(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 240 and max(sizes) <= 50


def test_stream_native(spark, files, tmp_path):
    timed = files[1].filter("ts IS NOT NULL")
    got = run(spark, files, tmp_path, lambda s: native.tumbling_totals(s, "value", "10m", delay="5 minutes"))
    want = aggregates.tumbling_agg(timed, {"sum": ("sum", "value"), "count": ("count", "value")}, "10m")
    same(got, want, ["source", "window_start", "sum", "count"])
    counts = run(spark, files, tmp_path / "b", lambda s: native.sliding_counts(s, "10m", 2, delay="5 minutes"))
    same(counts, aggregates.sliding_count(timed, "10m", 2), ["window_start", "window_end", "n"])


def test_late_rows_are_dropped(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = readers.stream_records(spark, "json", str(tmp_path / "in"), SCHEMA)
        out = state.sequence(stream, per_source="source")
        sinks.resume_ingest(out, str(tmp_path / "out"), str(tmp_path / "state"))
        return {r["id"]: r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    row = lambda minute, i: ("a", T0 + timedelta(minutes=minute), i, "k", 0.0, "")
    # The watermark itself has passed: row 9 is out, a row of its time would be late.
    assert put([row(2, 2), row(1, 1), row(9, 9)]) == {1: 1, 2: 2, 9: 3}
    # 3 comes too late and is gone; numbering goes on after the restart.
    assert put([row(3, 3), row(20, 20)]) == {1: 1, 2: 2, 9: 3, 20: 4}


def test_ordered_operators_reject_streams(spark, files):
    stream = readers.stream_records(spark, "json", files[0], SCHEMA)
    with pytest.raises(ValueError):
        suppress.dedupe(stream, {"fields": ["k"], "window": "1s"})
    with pytest.raises(ValueError):
        state.dedupe(files[1], {"fields": ["k"], "window": "1s"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("warn", "disk full", "2024-06-01T12:00:00Z"), (None, None, None)], "level string, message string, time string")
    stamped = df.withColumn("at", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    sinks.write_text(stamped, str(tmp_path / "t"), ingest="at")
    assert sorted(r["line"] for r in readers.read_lines(spark, str(tmp_path / "t")).collect()) == [
        "2024-01-15T12:00:00Z\t\t", "2024-06-01T12:00:00Z\twarn\tdisk full"]
    entry = spark.sql("SELECT 'app.log' AS source, 'hello world' AS line, timestamp'2024-01-15 12:00:00' AS timestamp")
    assert sinks.entry_lines(entry).first()[0] == "[2024-01-15T12:00:00Z] app.log: hello world"
    assert '"source":"app.log"' in sinks.entry_lines(entry, "json").first()[0]
    with pytest.raises(ValueError):
        sinks.entry_lines(entry, "xml")


def test_fan_out(spark, tmp_path):
    df = spark.range(3)

    def broken(_):
        raise OSError("no disk")

    with pytest.raises(RuntimeError, match="bad: no disk"):
        sinks.fan_out(df, {"bad": broken, "good": sinks.json_sink(str(tmp_path / "g"))})
    assert spark.read.schema("id long").json(str(tmp_path / "g")).count() == 3
    with pytest.raises(OSError):
        sinks.fan_out(df, {"bad": broken, "never": sinks.json_sink(str(tmp_path / "n"))}, stop_at_error=True)
    assert not (tmp_path / "n").exists()
    routed = df.withColumn("sink", F.when(F.col("id") > 0, "a").otherwise("b"))
    sinks.route_to(routed, {n: sinks.json_sink(str(tmp_path / n)) for n in "ab"})
    assert spark.read.schema("id long").json(str(tmp_path / "a")).count() == 2


def test_fan_out_of_a_stream_goes_on_where_it_failed(spark, files, tmp_path):
    """Sinks that finished a batch don't get it again; a folder sink that failed within one shows nothing of it."""
    taken, failed = [], set()

    def broken(df, where):
        df.limit(1).write.json(where)
        if where not in failed:
            failed.add(where)
            raise OSError("no disk")
        df.write.mode("overwrite").json(where)

    plain = lambda df: taken.extend(r["id"] for r in df.collect())
    stream = readers.stream_records(spark, "json", files[0], SCHEMA, max_files=1).select("id")
    seen = []
    for _ in range(9):
        query = sinks.start_fan_out(stream, {"plain": plain, "folders": sinks.BatchFolders(str(tmp_path / "b"), broken)}, str(tmp_path / "state"))
        try:
            query.awaitTermination()
            break
        except Exception:
            seen.append(len([p for p in (tmp_path / "b").glob("batch=*")]) if (tmp_path / "b").exists() else 0)
    assert seen == [0, 1, 2] and len(failed) == 3
    assert sorted(taken) == list(range(240))
    assert sorted(r["id"] for r in spark.read.schema("id long").json(str(tmp_path / "b")).collect()) == list(range(240))


def test_readers(spark, tmp_path):
    (tmp_path / "one.log").write_text("a\nb\n")
    (tmp_path / "two.log").write_text("c")
    lines, errors = readers.read_many(spark, {"one": str(tmp_path / "one*.log"), "two": [str(tmp_path / "two.log"), str(tmp_path / "gone")], "none": "/no/such/*"})
    assert sorted((r["source"], r["line"]) for r in lines.collect()) == [("one", "a"), ("one", "b"), ("two", "c")]
    assert set(errors) == {str(tmp_path / "gone"), "/no/such/*"}
    assert readers.read_lines(spark, str(tmp_path / "one.log"), since="2999-01-01T00:00:00").count() == 0
    assert readers.read_lines(spark, str(tmp_path)).first()["source"].startswith("file:")
    with pytest.raises(ValueError):
        readers.read_records(spark, "json", str(tmp_path))
    nothing, _ = readers.read_many(spark, {"x": "/no/such/*"})
    assert nothing.count() == 0


def test_flow(spark, tmp_path):
    df = spark.createDataFrame([("user=bob level=error",), ("user=al level=info",), ("plain",)], "line string")
    kept = []
    run_flow(df, [{"field": "level", "pattern": "^error$"}], lambda out: kept.extend(r["line"] for r in out.collect()))
    assert kept == ["user=bob level=error"]
    run_flow(df, [{"field": "_raw", "pattern": "plain"}], lambda out: kept.extend(r["line"] for r in out.collect()))
    run_flow(df, [], lambda out: kept.append(out.count()))
    assert kept == ["user=bob level=error", "plain", 3]
    flow = Flow([{"op": "parse", "parser": "logfmt"}, {"op": "promote", "names": ["user"]}, lambda d: d.filter("user is not null")])
    assert flow(df).count() == 2
    with pytest.raises(ValueError):
        Flow([{"op": "nope"}])
    with pytest.raises(RuntimeError, match=r"sink \[app\]"):
        run_stage(df, "app", lambda _: 1 / 0)
