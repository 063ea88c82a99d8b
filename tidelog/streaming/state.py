"""Stateful operators on streams, in event time.

Each keyed operator holds a key's rows until the watermark passes them, then
walks them in (time, id) order with a few values of state. So the result on a
finished stream equals the table operator's result up to the watermark,
whatever the arrival order, and the table operator's result in full once the
stream is closed (``streaming.closing``). State that can no longer matter is
dropped by event-time timers.

Keys are dealt into a fixed number of buckets, which are what Spark groups by:
each visit of a group costs a dozen calls to the state store, so a visit per
small key would cost more than its rows. Rows are sorted and packed into runs
before the shuffle, by the tasks that read them, and are held as they come. A
timer opens only the runs that the watermark has reached, so each row is
written and read about once however long it is held.

A key's rows of one micro-batch are walked in one task; ``maxFilesPerTrigger``
or ``maxBytesPerTrigger`` on the source bounds them. Operators whose rows all
share one key have a form in ``streaming.stepped``.
"""

from __future__ import annotations

import heapq
import pickle
import sys
import zlib
from collections.abc import Iterator
from itertools import count, islice

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.functions.columns import field, micros
from tidelog.functions.patterns import search
from tidelog.operators.suppress import (
    DedupeRule,
    KeyRule,
    LimitRule,
    by_source,
    debounce_keys,
    dedupe_keys,
    parse_scoped,
    scope_key,
)
from tidelog.specs import Scoped, duration_us, parse_all, positive_window, require
from tidelog.streaming.closing import end_time, unclosed

# Processors travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How whole rows travel through state without losing microseconds.
PACK = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Rows of a run of held rows. A run that the watermark is within is written anew, so this bounds that.
RUN_ROWS = 512

# Rows of a batch that are sorted at once.
SORTED_ROWS = 65_536

# Groups that keys are dealt into. Fixed for the life of a stream's checkpoint.
BUCKETS = 1_024

# Output rows that leave a processor as one compressed chunk.
CHUNK_ROWS = 4_096

RUN_SCHEMA = "times array<long>, rows binary"  # of a run that came packed, its first and last time
# Just before the watermark of a closed stream: what has no timeout ends here.
LAST_US = 253_000_000_000_000_000

INDEX_SCHEMA = "runs array<struct<run:long,low:long>>, next long"


def _id_text(df: DataFrame, row_id: str) -> Column:
    """The id as text that sorts like the id."""
    value = field(row_id)
    if isinstance(df.schema[row_id].dataType, T.IntegralType):
        number = value.cast("long")
        # Shift negative numbers below the others, then pad.
        return F.concat(F.when(number < 0, "0").otherwise("1"), F.lpad(
            F.when(number < 0, number + 9223372036854775807).otherwise(number).cast("string"), 19, "0"))
    return value.cast("string")


def _squeezed(rows: list[tuple]) -> bytes:
    return zlib.compress(pickle.dumps(rows), 1)


def _spread(chunk: bytes) -> list[tuple]:
    return pickle.loads(zlib.decompress(chunk))


class OneTrip:
    """A state handle whose values are asked for once: ``exists`` fetches what ``get`` then returns."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.getMapState, self.listTimers, self.registerTimer = handle.getMapState, handle.listTimers, handle.registerTimer

    def getValueState(self, *declared):
        held = self.handle.getValueState(*declared)

        class Value:
            update, clear = held.update, held.clear

            def exists(self) -> bool:
                self.fetched = held.get()
                return self.fetched is not None

            def get(self):
                return self.fetched

        return Value()


class Chunked(StatefulProcessor):
    """A processor whose output leaves in compressed chunks of rows.

    Spark's Python worker gathers all that a key, or all timers of a task, put
    out before it sends any of it on, so plain rows would fill its memory.
    """

    def __init__(self, processor: StatefulProcessor, names: list[str]):
        self.processor, self.names = processor, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processor.init(OneTrip(handle))

    def _chunks(self, rows: Iterator[Row]) -> Iterator[Row]:
        plain = (tuple(r[n] for n in self.names) for r in rows)
        while chunk := list(islice(plain, CHUNK_ROWS)):
            yield Row(chunk=_squeezed(chunk))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._chunks(self.processor.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._chunks(self.processor.handleExpiredTimer(key, timerValues, expiredTimerInfo))


class Packed(Chunked):
    """As :class:`Chunked`, for a bucket of keys whose rows come in runs (``low``, ``high``, ``run``)."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.processor.hold_packed(rows, timerValues.getCurrentWatermarkInMs())
        return iter(())


def _packed_runs(batches):
    """Rows (``bucket, t, id, key, tag, row``) as sorted runs: ``bucket``, first and last time, and the rows, compressed."""
    import pyarrow as pa

    def runs(held):
        rows = pa.Table.from_batches(held).sort_by([("bucket", "ascending"), ("t", "ascending"), ("id", "ascending")])
        buckets = rows["bucket"].to_pylist()
        plain = list(zip(*(rows[c].to_pylist() for c in ("t", "id", "key", "tag", "row"))))
        out, start = [], 0
        for i in range(1, len(plain) + 1):
            if i == len(plain) or buckets[i] != buckets[start] or i - start == RUN_ROWS:
                out.append((buckets[start], plain[start][0], plain[i - 1][0], _squeezed(plain[start:i])))
                start = i
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "low", "high", "run"])

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= SORTED_ROWS:
            yield runs(held)
            held, n = [], 0
    if n:
        yield runs(held)


def _unchunked(out: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows within chunks."""

    def read(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), names)], schema=names)

        rows: list[tuple] = []
        for chunks in batches:
            for chunk in chunks.column(0):
                rows += _spread(chunk.as_py())
                if len(rows) >= CHUNK_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return out.mapInArrow(read, schema)


def keyed_stream(
    df: DataFrame, key: Column, ts: str, row_id: str, delay: str, processor: StatefulProcessor, schema: str,
    tag: Column | None = None,
) -> DataFrame:
    """Run a processor per key over packed rows (``t, id, tag, row``)."""
    require(df.isStreaming, "a stream is needed; the table operators take tables")
    packed = df.select(
        F.coalesce(key.cast("string"), F.lit("<nil>")).alias("key"),
        (field(ts) >= end_time(df.schema[ts].dataType.simpleString())).alias("closing"),
        micros(ts).alias("t"),
        _id_text(df, row_id).alias("id"),
        (F.lit("") if tag is None else tag.cast("string")).alias("tag"),
        F.to_json(F.struct(*[field(c) for c in df.columns]), PACK).alias("row"),
    )
    # A row without a time is in no order. The closing row moves the watermark and ends there; it shares a run with no other.
    bucket = F.when(F.col("closing"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    dealt = packed.filter("t is not null").select(bucket.alias("bucket"), "t", "id", "key", "tag", "row")
    runs = dealt.mapInArrow(_packed_runs, "bucket int, low long, high long, run binary").withColumn("event_time", F.timestamp_micros("high"))
    watched = unclosed(runs.withWatermark("event_time", delay), "event_time")
    parsed = T.StructType.fromDDL(schema)
    out = watched.groupBy("bucket").transformWithState(
        statefulProcessor=Packed(processor, parsed.names), outputStructType="chunk binary", outputMode="Append", timeMode="EventTime"
    )
    # Chunks of a few large keys leave from a few tasks; all tasks unpack them.
    return _unchunked(out.repartition(df.sparkSession.sparkContext.defaultParallelism), parsed)


def held_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a stateful stream holds after its last batch, as a table: ``state`` (open windows, counters; a row per key) or ``index`` (rows not yet due; a row per bucket)."""
    held = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    if name != "state":
        return held
    one = held.select(F.explode("value.open").alias("value"))
    return one.select(F.struct("value.key").alias("key"), F.col("value").dropFields("key").alias("value"))


def unpack(out: DataFrame, schema: T.StructType, packed: str = "row", dest: str = "__row") -> DataFrame:
    return out.withColumn(dest, F.from_json(field(packed), schema, PACK)).drop(packed)


class OrderedProcessor(StatefulProcessor):
    """Buffers rows of one or many keys and hands them to ``step`` in order once the watermark passes.

    ``step(state, rows)`` yields output rows and returns nothing; ``state`` is a
    list of plain values it may change. ``closes(state)`` is the time (in
    microseconds) at which ``expire(state)`` should run if no row came before.
    """

    state_schema = "a long"

    def empty(self) -> list:
        raise NotImplementedError

    def step(self, key: str, state: list, row: tuple) -> Iterator[Row]:
        raise NotImplementedError

    def closes(self, state: list) -> int | None:
        return None

    def expire(self, key: str, state: list) -> Iterator[Row]:
        return iter(())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run long", RUN_SCHEMA)
        self.index = handle.getValueState("index", INDEX_SCHEMA)
        self.state = handle.getValueState("state", f"open array<struct<key string, {self.state_schema}>>")
        self.walked = handle.getValueState("walked", "t long")

    def _wake(self, at_us: int, watermark_ms: int) -> None:
        at = max(-(-at_us // 1000), watermark_ms + 1, 1)
        # Timers up to the watermark fire in this batch and are no use later.
        if not any(watermark_ms < known <= at for known in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def _held(self) -> tuple[list[tuple[int, int]], int]:
        """The runs, each with its first time, and the next run's number."""
        if not self.index.exists():
            return [], 0
        runs, number = self.index.get()
        return [(r[0], r[1]) for r in runs or []], number

    def _hold(self, rows: list[tuple], runs: list[tuple[int, int]], number: int) -> int:
        """Write sorted rows as runs and list them."""
        for i in range(0, len(rows), RUN_ROWS):
            run = rows[i : i + RUN_ROWS]
            self.runs.updateValue((number,), ([r[0] for r in run], _squeezed(run)))
            runs.append((number, rows[i][0]))
            number += 1
        return number

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        runs, number = self._held()
        packed = ((r["t"], r["id"], key[0], r["tag"], r["row"]) for r in rows)
        while batch := sorted(islice(packed, SORTED_ROWS)):
            number = self._hold(batch, runs, number)
            first = batch[0][0] if first is None else min(first, batch[0][0])
        if first is not None:
            self.index.update((runs, number))
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def hold_packed(self, rows: Iterator[Row], watermark_ms: int) -> None:
        """Hold runs as they come. Spark drops a run whose last row is late; rows before those walked by now are dropped here."""
        runs, number = self._held()
        known = len(runs)
        walked = self.walked.get()[0] if self.walked.exists() else None
        for r in rows:
            if walked is not None and r["low"] <= walked:
                number = self._hold([row for row in _spread(r["run"]) if row[0] > walked], runs, number)
            else:
                self.runs.updateValue((number,), ([r["low"], r["high"]], r["run"]))
                runs.append((number, r["low"]))
                number += 1
        if len(runs) > known:
            self.index.update((runs, number))
            self._wake(min(low for _, low in runs[known:]), watermark_ms)

    def _take(self, ready: list[tuple[int, int]], limit: int, later: list[tuple]) -> Iterator[tuple]:
        """Rows up to ``limit`` of the ``ready`` runs in order; a run is read when its first row may be due."""
        waiting = sorted(ready, key=lambda r: r[1], reverse=True)
        heap: list = []
        order = count()
        while waiting or heap:
            if waiting and (not heap or waiting[-1][1] <= heap[0][0][0]):
                run = (waiting.pop()[0],)
                rows = _spread(self.runs.getValue(run)[1])
                self.runs.removeKey(run)
                later.extend(r for r in rows if r[0] > limit)
                rest = iter([r for r in rows if r[0] <= limit])
            else:
                row, _, rest = heapq.heappop(heap)
                yield row
            following = next(rest, None)
            if following is not None:
                heapq.heappush(heap, (following, next(order), rest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        limit = watermark * 1000
        runs, number = self._held()
        ready = [r for r in runs if r[1] <= limit]
        runs = [r for r in runs if r[1] > limit]
        later: list[tuple] = []
        held = {name: state for name, *state in self.state.get()[0]} if self.state.exists() else {}
        for t, rid, name, tag, row in self._take(ready, limit, later):
            state = held.get(name)
            if state is None:
                state = held[name] = self.empty()
            yield from self.step(name, state, (t, rid, tag, row))
        wakes = []
        for name, state in held.items():
            due = self.closes(state)
            while due is not None and due <= limit:
                yield from self.expire(name, state)
                due = self.closes(state)
            if due is not None:
                wakes.append(due)
        if ready:
            number = self._hold(sorted(later), runs, number)
            if runs:
                self.index.update((runs, number))
            else:
                self.index.clear()
        nothing = self.empty()
        if open_ := [(name, *state) for name, state in held.items() if state != nothing]:
            self.state.update((open_,))
        else:
            self.state.clear()
        self.walked.update((limit,))
        wakes += [low for _, low in runs]
        if wakes:
            self._wake(min(wakes), watermark)


class KeepFirst(OrderedProcessor):
    """Dedupe, debounce, uniq, rate limit, ceiling: the first rows of anchored windows.

    ``tag`` of a row is its rule's width and limit. State: window start, rows
    seen in it, width. Dropped once the window has passed, since the next row
    then opens a new one anyway.
    """

    state_schema = "start long, seen long, width long"

    def __init__(self, origin: int | None = None):
        self.origin = origin

    def empty(self):
        return [None, 0, None]

    def step(self, key, state, row):
        width, limit = (int(part) for part in row[2].split(","))
        if state[0] is None and self.origin is not None and row[0] - self.origin < width:
            state[:] = [self.origin, 0, width]
        if state[0] is None or row[0] - state[0] >= width:
            state[:] = [row[0], 0, width]
        state[1] += 1
        if state[1] <= limit:
            yield Row(row=row[3])

    def closes(self, state):
        return None if state[0] is None else state[0] + state[2]

    def expire(self, key, state):
        state[:] = self.empty()
        return iter(())


class Number(OrderedProcessor):
    """Sequence numbers per key. ``tag`` of a row is the number its key starts from."""

    state_schema = "next long"

    def empty(self):
        return [None]

    def step(self, key, state, row):
        number = int(row[2]) if state[0] is None else state[0]
        state[0] = number + 1
        yield Row(seq=number, row=row[3])


class Assemble(OrderedProcessor):
    """Multi-line records. State: the open record's first time and id, last time, timeout, lines.

    ``tag`` of a row has "1" where its line opens a record, its rule's most
    lines and its timeout; ``row`` is the line.
    """

    state_schema = "first long, id string, last long, timeout long, lines array<string>"

    def empty(self):
        return [None, None, None, None, []]

    def _emit(self, key, state):
        first, rid, _, _, lines = state
        state[:] = self.empty()
        yield Row(source=key, t=first, id=rid, n_lines=len(lines), lines=lines)

    def step(self, key, state, row):
        t, rid, tag, line = row
        opens, most, timeout = (int(part) for part in tag.split(","))
        late = timeout and state[2] is not None and t - state[2] >= timeout
        if state[4] and (opens or late or (most and len(state[4]) >= most)):
            yield from self._emit(key, state)
        if not state[4]:
            state[:] = [t, rid, None, timeout, []]
        state[2] = t
        state[4].append(line)

    def closes(self, state):
        if not state[4]:
            return None
        return state[2] + state[3] if state[3] else LAST_US

    def expire(self, key, state):
        return self._emit(key, state)


class Pair(OrderedProcessor):
    """One-to-one pairs. State: the waiting record's side, time and row."""

    state_schema = "side string, t long, row string"

    def __init__(self, width: int):
        self.width = width

    def empty(self):
        return [None, None, None]

    def step(self, key, state, row):
        t, _, side, packed = row
        waiting, since, other = state
        if waiting is not None and waiting != side and t - since <= self.width:
            state[:] = self.empty()
            yield Row(left=packed if side == "left" else other, right=other if side == "left" else packed)
        else:
            state[:] = [side, t, packed]

    def closes(self, state):
        return None if state[0] is None else state[1] + self.width + 1

    def expire(self, key, state):
        state[:] = self.empty()
        return iter(())


class AnchoredTotals(OrderedProcessor):
    """Anchored count, sum, min, max of several numbers. ``tag`` of a row is its window's width and the numbers as text.

    A window is emitted when it closes.
    """

    state_schema = "start long, width long, n long, totals array<double>, lows array<double>, highs array<double>"

    def empty(self):
        return [None, None, 0, [], [], []]

    def _emit(self, key, state):
        start, _, n, totals, lows, highs = state
        state[:] = self.empty()
        yield Row(key=key, t=start, n=n, totals=totals, lows=lows, highs=highs)

    def step(self, key, state, row):
        width, *values = row[2].split(",")
        width, values = int(width), [float(v) for v in values]
        if state[0] is not None and row[0] - state[0] > width:
            yield from self._emit(key, state)
        if state[0] is None:
            state[:] = [row[0], width, 1, values, values, values]
        else:
            start, _, n, totals, lows, highs = state
            state[:] = [start, width, n + 1, [a + b for a, b in zip(totals, values)], [*map(min, lows, values)], [*map(max, highs, values)]]

    def closes(self, state):
        return None if state[0] is None else state[0] + state[1] + 1

    def expire(self, key, state):
        return self._emit(key, state)


class CounterAlerts(OrderedProcessor):
    """Threshold alerts. ``tag`` of a row is the amount added to its counter.

    State: running total, the next tick at which to look, last fire. A counter
    is looked at when a tick in which it grew ends, and once it has reached
    its threshold whenever its cooldown is over, grown or not.
    """

    state_schema = "total long, tick long, fired long"

    def __init__(self, interval: int, rules: dict[str, tuple[int, int]]):
        self.interval, self.rules = interval, rules

    def empty(self):
        return [0, None, None]

    def _evaluate(self, key, state):
        total, tick, fired = state
        threshold, cooldown = self.rules[key]
        state[1] = None
        if total < threshold:
            return
        if fired is None or tick - fired >= cooldown:
            state[2] = fired = tick
            yield Row(name=key, t=tick, value=total)
        state[1] = max(tick + self.interval, -(-(fired + cooldown) // self.interval) * self.interval)

    def step(self, key, state, row):
        tick = row[0] - row[0] % self.interval + self.interval
        while state[1] is not None and state[1] < tick:
            yield from self._evaluate(key, state)
        state[0] += int(row[2])
        state[1] = tick if state[1] is None else state[1]

    def closes(self, state):
        return state[1]

    def expire(self, key, state):
        return self._evaluate(key, state)


def _kept(
    df: DataFrame, scoped: Scoped, keys: dict[str, Column], limit, *, ts: str, row_id: str, delay: str,
    strict: bool = False, origin_us: int | None = None, free: Column | None = None,
) -> DataFrame:
    """The stream form of suppression; ``free`` rows, sources without a rule and rows without a time pass at once."""
    unplaced = field(ts).isNull()
    free = unplaced if free is None else free | unplaced
    if scoped.default is None:
        if not scoped.by_source:
            return unclosed(df, ts)
        free = free | ~F.coalesce(field(scoped.source).isin(list(scoped.by_source)), F.lit(False))
    # The closing row has no fields, so it may look free; it must reach the watermark.
    closing = field(ts) >= end_time(df.schema[ts].dataType.simpleString())
    rows = df.filter(~free | closing)
    tag = F.concat_ws(
        ",",
        by_source(scoped, lambda r: F.lit(positive_window(r.window) + (1 if strict else 0))),
        by_source(scoped, lambda r: F.lit(limit(r))),
    )
    key = F.to_json(F.array(*[k.cast("string") for k in keys.values()]))
    out = keyed_stream(rows, key, ts, row_id, delay, KeepFirst(origin_us), "row string", tag=tag)
    kept = unpack(out, df.schema).select("__row.*")
    return kept.unionByName(unclosed(df, ts).filter(free))


def dedupe(df: DataFrame, rules, *, ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.suppress.dedupe``."""
    scoped = parse_scoped(rules, DedupeRule.parse)
    return _kept(df, scoped, dedupe_keys(df, scoped), lambda r: 1, ts=ts, row_id=row_id, delay=delay)


def debounce(df: DataFrame, rules, *, ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.suppress.debounce``; rows without the field share a key."""
    scoped = parse_scoped(rules, KeyRule.parse)
    return _kept(df, scoped, debounce_keys(df, scoped), lambda r: 1, ts=ts, row_id=row_id, delay=delay)


def uniq(df: DataFrame, rule, *, ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.suppress.uniq``; rows without the field pass at once."""
    rule = KeyRule.parse(rule)
    if rule.field not in df.columns or not isinstance(df.schema[rule.field].dataType, T.StringType):
        return df
    value = field(rule.field)
    return _kept(
        df, Scoped(rule), {"__k0": value}, lambda r: 1, free=value.isNull(), ts=ts, row_id=row_id, delay=delay
    )


def rate_limit(df: DataFrame, rules, *, source="source", ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.suppress.rate_limit``."""
    scoped = parse_scoped(rules, LimitRule.parse)
    return _kept(
        df, scoped, {"__k0": field(source)}, lambda r: r.limit, strict=True, ts=ts, row_id=row_id, delay=delay
    )


def sequence(df: DataFrame, rules=None, *, per_source: str, ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.numbering.sequence`` with a counter for each source.

    A counter that sources share is one key; ``streaming.stepped.start_sequence`` has it.
    Rows without a time get no number.
    """
    from tidelog.operators.numbering import SequenceRule

    scoped = parse_scoped({} if rules is None else rules, SequenceRule.parse)
    present = [r for r in (scoped.default, *scoped.by_source.values()) if r is not None]
    require(bool(present), "sequence: at least one rule is required")
    start = by_source(scoped, lambda r: F.lit(None if r is None else r.start).cast("long"))
    ruled = field(ts).isNotNull() & start.isNotNull() | (field(ts) >= end_time(df.schema[ts].dataType.simpleString()))
    out = keyed_stream(df.filter(ruled), field(per_source), ts, row_id, delay, Number(), "seq long, row string", tag=start)
    numbered = unpack(out, df.schema).select("__row.*", F.col("seq").alias("__n"))
    others = unclosed(df, ts).filter(~F.coalesce(ruled, F.lit(False))).withColumn("__n", F.lit(None).cast("long"))
    both = numbered.unionByName(others)
    for name in dict.fromkeys(r.field for r in present):
        writes = by_source(scoped, lambda r: F.lit(r is not None and r.field == name))
        before = field(name).cast("long") if name in df.columns else F.lit(None).cast("long")
        both = both.withColumn(name, F.when(writes, F.col("__n")).otherwise(before))
    return both.drop("__n")


def assemble_multiline(df: DataFrame, rules, *, source="source", ts="ts", row_id="id", line="line", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.multiline.assemble_multiline``, scoped rules included.

    A record is emitted when the next one starts, with a timeout once the
    watermark passes it, else when the stream is closed. Lines without a time
    stand alone and pass at once.
    """
    from tidelog.operators.multiline import parse_rules, rule_columns, text_columns

    scoped = parse_rules(rules, source)
    opens, most, timeout = rule_columns(scoped, field(line))
    tag = F.concat_ws(",", F.when(opens, "1").otherwise("0"), most, timeout)
    lines = df.select(field(source).alias(source), field(ts).alias(ts), field(row_id).alias(row_id), field(line).alias(line))
    out = keyed_stream(
        lines, F.to_json(F.array(field(source))), ts, row_id, delay, Assemble(),
        "source string, t long, id string, n_lines long, lines array<string>", tag=tag,
    )
    # Lines travel inside packed rows; take them out of each.
    first = F.from_json(F.get("lines", 0), lines.schema, PACK)
    head = [F.from_json("source", "array<string>")[0].alias(source), first.getField(ts).alias(ts), first.getField(row_id).alias(row_id)]
    assembled = out.select(*head, "n_lines", F.array_join(F.transform("lines", lambda p: F.get_json_object(p, f"$.{line}")), "\n").alias("__text"))
    alone = lines.filter(field(ts).isNull()).select(source, ts, row_id, F.lit(1).cast("long").alias("n_lines"), field(line).alias("__text"))
    both = assembled.unionByName(alone)
    return both.select(source, ts, row_id, "n_lines", *text_columns(scoped, F.col("__text")))


def pair_join(df: DataFrame, rule, *, source="source", ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.pairs.pair_join``: structs ``left`` and ``right``."""
    from tidelog.operators.pairs import PairRule

    rule = PairRule.parse(rule)
    wanted = field(source).isin(rule.left_source, rule.right_source) & field(rule.key_field).isNotNull()
    both = df.filter(wanted | (field(ts) >= end_time(df.schema[ts].dataType.simpleString())))
    side = F.when(field(source) == rule.left_source, "left").otherwise("right")
    out = keyed_stream(
        both, field(rule.key_field), ts, row_id, delay, Pair(positive_window(rule.window)),
        "left string, right string", tag=side,
    )
    return unpack(unpack(out, df.schema, "left", "__l"), df.schema, "right", "__r").select(
        F.col("__l").alias("left"), F.col("__r").alias("right")
    )


def _totals(df: DataFrame, widths: list[tuple[int, Column | None]], numbers: list[Column], source, ts, row_id, delay) -> DataFrame:
    """``source, t, width, n, totals, lows, highs`` of anchored windows of several widths (each with the rows it counts)."""
    rows = df.select(field(source).alias("__source"), field(ts).alias("__ts"), field(row_id).alias("__id"), *[n.alias(f"__v{i}") for i, n in enumerate(numbers)], F.array(*[
        F.when(F.lit(True) if on is None else on, F.lit(width)) for width, on in widths
    ]).alias("__widths"))
    # The closing row counts nowhere but must reach the watermark.
    closing = field("__ts") >= end_time(rows.schema["__ts"].dataType.simpleString())
    wanted = F.filter("__widths", lambda w: w.isNotNull())
    rows = rows.withColumn("__width", F.explode(F.when(closing, F.array(F.lit(0).cast("long"))).otherwise(wanted.cast("array<long>"))))
    tag = F.concat_ws(",", F.col("__width"), *[F.col(f"__v{i}").cast("string") for i in range(len(numbers))])
    out = keyed_stream(
        rows.select("__source", "__ts", "__id", "__width", *[f"__v{i}" for i in range(len(numbers))]),
        F.to_json(F.array(F.col("__source").cast("string"), F.col("__width").cast("string"))), "__ts", "__id", delay, AnchoredTotals(),
        "key string, t long, n long, totals array<double>, lows array<double>, highs array<double>", tag=tag,
    )
    key = F.from_json("key", "array<string>")
    return out.select(key[0].alias(source), "t", key[1].cast("long").alias("width"), "n", "totals", "lows", "highs")


def anchored_agg(df: DataFrame, rules, *, source="source", ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.aggregates.anchored_agg``: any rules and widths, scoped or not, in one pass."""
    from tidelog.operators.aggregates import AggregateRule, governed, number

    scoped = parse_scoped(rules, lambda r: parse_all(AggregateRule, r))
    cells: dict[tuple[int, str, str], set] = {}
    for name, part in [(None, scoped.default or ()), *scoped.by_source.items()]:
        for rule in part:
            cells.setdefault((positive_window(rule.window), rule.field, rule.op), set()).add(name)
    require(bool(cells), "aggregate: at least one rule is required")
    fields = list(dict.fromkeys(f for _, f, _ in cells))
    widths = [(w, governed(scoped, set().union(*(n for (x, _, _), n in cells.items() if x == w)))) for w in sorted({w for w, _, _ in cells})]
    out = _totals(df, widths, [number(df, f) for f in fields], source, ts, row_id, delay)
    held = {"count": F.col("n").cast("double")}

    def value(on: str, op: str) -> Column:
        return held.get(op, F.get({"sum": "totals", "min": "lows", "max": "highs"}.get(op, "totals"), fields.index(on)))

    listed = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(o).alias("op"), value(f, o).alias("value"), ((F.col("width") == w) & governed(scoped, names)).alias("on"))
        for (w, f, o), names in cells.items()
    ])
    long = out.withColumn("c", F.explode(F.filter(listed, lambda c: c["on"])))
    start = F.timestamp_micros("t").cast(df.schema[ts].dataType)
    return long.select(field(source), "c.field", "c.op", start.alias("window_start"), F.col("width").alias("width_us"), "c.value")


def anchored_totals(df: DataFrame, value: str, window, *, source="source", ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Count, sum, min and max of one number in anchored windows, one row per window."""
    number = F.coalesce(field(value).cast("double"), F.lit(0.0))
    out = _totals(df, [(positive_window(window), None)], [number], source, ts, row_id, delay)
    return out.select(
        source, F.timestamp_micros("t").alias("window_start"), F.col("n").alias("count"),
        F.get("totals", 0).alias("sum"), F.get("lows", 0).alias("min"), F.get("highs", 0).alias("max"),
    )


def threshold_alerts(
    df: DataFrame, rules, interval, *, name: str = "name", n: str | None = None, ts="ts", row_id="id", delay="0 seconds"
) -> DataFrame:
    """Streaming form of a counter report with ``operators.counters.threshold_alerts``."""
    from tidelog.operators.counters import AlertRule

    rules = {r.counter: (r.threshold, duration_us(r.cooldown)) for r in parse_all(AlertRule, rules, needed=True)}
    amount = (field(n) if n else F.lit(1)).cast("long")
    out = keyed_stream(
        df.filter(field(name).isin(list(rules)) | (field(ts) >= end_time(df.schema[ts].dataType.simpleString()))), field(name), ts, row_id, delay,
        CounterAlerts(positive_window(interval), rules), "name string, t long, value long", tag=amount,
    )
    return out.select(F.timestamp_micros("t").alias("tick"), "name", "value")


def match_alerts(df: DataFrame, rules, *, source="source", ts="ts", row_id="id", delay="0 seconds") -> DataFrame:
    """Streaming form of ``operators.counters.match_alerts``: any rules, scoped or not. Records without a time don't count."""
    from tidelog.operators.counters import fires, rule_hits

    hits = rule_hits(df, rules)
    # The closing row matches no rule but must reach the watermark.
    closing = df.filter(field(ts) >= end_time(df.schema[ts].dataType.simpleString())).withColumn("__hit", F.lit(None).cast(hits.schema["__hit"].dataType))
    both = hits.unionByName(closing)
    key = F.to_json(F.array(field(source).cast("string"), F.col("__hit.rule").cast("string")))
    out = keyed_stream(both, key, ts, row_id, delay, Number(), "seq long, row string", tag=F.lit("1"))
    counted = unpack(out, both.schema).select("__row.*", F.col("seq").alias("count")).withColumn("rule", F.col("__hit.rule"))
    return counted.filter(fires(F.col("count"))).drop("__hit")
