"""Stream operators whose rows share one order: a table operator runs on what each micro-batch completes.

A keyed stream operator walks a key's rows in one task. Where all rows share
one key (a counter or a limit over all sources, the neighbours in time of two
inputs) that task would get the whole stream. Here each micro-batch takes the
rows that its watermark has passed, still a table of any size, and runs the
distributed table operator on it. What the next batch must know is a small
table carried on: counts so far, the rows of an open window.

Everything of a batch is written under its number: held rows, carry and output.
A batch that is run again after a failure starts from the batch before it and
overwrites its own folders, so each row comes out once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.columns import field, micros
from tidelog.operators import numbering, pairs, suppress
from tidelog.plans.anchored import WINDOW_START, anchored_windows
from tidelog.plans.sizing import maybe_broadcast
from tidelog.specs import duration_us, positive_window, require
from tidelog.streaming.closing import end_time

# From the rows a batch completes, the carry of the batch before and the time reached: output and new carry.
Step = Callable[[DataFrame, DataFrame | None, int], tuple[DataFrame, DataFrame | None]]


class Steps:
    """The folders of a stepped stream, one for each batch; the last two are kept."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.root = spark, f"{checkpoint}/steps"
        self.jvm = spark.sparkContext._jvm
        self.system = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.system.mkdirs(self._path(self.root))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def done(self, batch: int) -> bool:
        return self.system.exists(self._path(f"{self.root}/{batch}/reached/_SUCCESS"))

    def batches(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.system.listStatus(self._path(self.root)))

    def before(self, batch: int) -> int | None:
        known = [b for b in self.batches() if b < batch and self.done(b)]
        return known[-1] if known else None

    def read(self, batch: int | None, name: str) -> DataFrame | None:
        where = f"{self.root}/{batch}/{name}"
        if batch is None or not self.system.exists(self._path(where)):
            return None
        return self.spark.read.parquet(where)

    def write(self, batch: int, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{batch}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{batch}/{name}")

    def forget(self, batch: int) -> None:
        """Drop what no batch run again could need."""
        for old in [b for b in self.batches() if b < batch][:-1]:
            self.system.delete(self._path(f"{self.root}/{old}"), True)


def start_stepped(df: DataFrame, step: Step, path: str, checkpoint: str, *, ts: str = "ts", delay: str | float = 0, **trigger) -> StreamingQuery:
    """Run ``step`` on the rows each batch completes; its output goes below ``path/batch=<number>``.

    A row is complete once a row ``delay`` later was seen, in its batch or one
    before; one that comes after that is dropped. Rows without a time are
    complete at once. The closing row completes all.
    """
    require(df.isStreaming, "a stream is needed; the table operators take tables")
    held_back = duration_us(delay)
    spark = df.sparkSession
    end = end_time(df.schema[ts].dataType.simpleString())

    def run(rows: DataFrame, batch: int) -> None:
        steps = Steps(spark, checkpoint)
        if steps.done(batch):
            return
        last = steps.before(batch)
        reached = steps.read(last, "reached")
        seen, limit = (None, None) if reached is None else reached.first()
        time = micros(ts)
        fresh = rows if limit is None else rows.filter(field(ts).isNull() | (time > limit))
        held = steps.read(last, "held")
        pending = fresh if held is None else fresh.unionByName(held.filter(time > limit))
        held = steps.write(batch, "held", pending.filter(field(ts).isNull() | (field(ts) < end)))
        newest = rows.agg(F.max(micros(ts))).first()[0]
        seen = max((t for t in (seen, newest) if t is not None), default=None)
        limit = None if seen is None else max(seen - held_back, limit if limit is not None else seen - held_back)
        ready = held.filter(field(ts).isNull() if limit is None else field(ts).isNull() | (time <= limit))
        out, carry = step(ready, steps.read(last, "carry"), limit if limit is not None else -(2**62))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if carry is not None:
            steps.write(batch, "carry", carry)
        steps.write(batch, "reached", spark.range(1).select(F.lit(seen).cast("long").alias("seen"), F.lit(limit).cast("long").alias("reached")).coalesce(1))
        steps.forget(batch)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_sequence(
    df: DataFrame, rules, path: str, checkpoint: str, *, per_source: str | None = None, ts: str = "ts", row_id: str = "id",
    delay: str | float = 0, rows_per_task: int | None = None, **trigger,
) -> StreamingQuery:
    """Streaming form of ``operators.numbering.sequence``, shared counters included.

    A batch's rows are numbered in slices of their order, slice counts and all;
    the count of each counter so far is carried on.
    """
    scoped = suppress.parse_scoped(rules, numbering.SequenceRule.parse)
    names = list(dict.fromkeys(r.field for r in (scoped.default, *scoped.by_source.values()) if r is not None))
    key = field(per_source) if per_source else suppress.scope_key(scoped)

    def step(ready: DataFrame, carry: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
        numbered = numbering.sequence(ready, scoped, per_source=per_source, ts=ts, row_id=row_id, rows_per_task=rows_per_task)
        counts = ready.filter(field(ts).isNotNull()).groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n"))
        if carry is None:
            return numbered, counts
        before = maybe_broadcast(carry.withColumnsRenamed({"key": "__key", "n": "__before"}))
        placed = numbered.withColumn("__scope", key.cast("string")).join(before, F.col("__scope").eqNullSafe(F.col("__key")), "left")
        shifted = placed.withColumns({n: field(n) + F.coalesce("__before", F.lit(0)) for n in names})
        return shifted.select(*[field(c) for c in numbered.columns]), carry.unionByName(counts).groupBy("key").agg(F.sum("n").alias("n"))

    return start_stepped(df, step, path, checkpoint, ts=ts, delay=delay, **trigger)


def start_ceiling(
    df: DataFrame, rules, path: str, checkpoint: str, *, origin_us: int | None = None, ts: str = "ts", row_id: str = "id",
    delay: str | float = 0, rows_per_task: int | None = None, **trigger,
) -> StreamingQuery:
    """Streaming form of ``operators.suppress.ceiling``, limits shared by sources included.

    Carried on are the rows let through in each scope's last window, at most its
    limit: they hold its opening and what is left of it. Each task picks its
    first rows of a window before they meet.
    """
    scoped = suppress.parse_scoped(rules, suppress.LimitRule.parse)
    width = suppress.by_source(scoped, lambda r: F.lit(None if r is None else positive_window(r.window)).cast("long"))

    def step(ready: DataFrame, carry: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
        rows = ready.withColumn("__old", F.lit(False))
        rows = rows if carry is None else rows.unionByName(carry)
        kept = suppress.ceiling(rows, scoped, ts=ts, row_id=row_id, origin_us=origin_us, rows_per_task=rows_per_task)
        # Rows that open windows are let through, so windows of these rows alone are the same ones.
        ruled = kept.withColumns({"__scope": suppress.scope_key(scoped), "__width": width}).filter("__width IS NOT NULL")
        windows = anchored_windows(ruled.withColumnRenamed("__width", "__w0"), ["__scope"], ts, F.col("__w0"), origin_us=origin_us)
        last = windows.groupBy("__scope").agg(F.max(WINDOW_START).alias("__last")).withColumnRenamed("__scope", "__s")
        open_ = windows.join(F.broadcast(last), F.col("__scope").eqNullSafe(F.col("__s")) & (F.col(WINDOW_START) == F.col("__last")))
        names = [field(c) for c in ready.columns]
        return kept.filter("NOT __old").select(*names), open_.select(*names, F.lit(True).alias("__old"))

    return start_stepped(df, step, path, checkpoint, ts=ts, delay=delay, **trigger)


def start_nearest(
    df: DataFrame, is_left: Column, key: str, window, path: str, checkpoint: str, *, ts: str = "ts", row_id: str = "id",
    keep_unmatched: bool = False, delay: str | float = 0, rows_per_task: int | None = None, **trigger,
) -> StreamingQuery:
    """Streaming form of ``operators.pairs.nearest_join``: ``is_left`` tells the sides of one stream apart.

    A left row waits until no right row can come nearer. Carried on are waiting
    left rows and the right rows within reach of any, so what is held covers
    three windows of time at most.
    """
    width = positive_window(window)

    def step(ready: DataFrame, carry: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame]:
        time = micros(ts)
        rows = ready.filter(field(ts).isNotNull()).select(
            field(key).alias(key), field(ts).alias(ts), field(row_id).alias(row_id), F.coalesce(is_left, F.lit(False)).alias("__left")
        )
        rows = rows if carry is None else rows.unionByName(carry)
        due = time + width <= limit
        matched = pairs.nearest_join(
            rows.filter(F.col("__left") & due), rows.filter(~F.col("__left")), key, window, ts=ts, row_id=row_id,
            keep_unmatched=keep_unmatched, rows_per_task=rows_per_task,
        )
        waiting = F.col("__left") & ~due
        return matched, rows.filter(waiting | (~F.col("__left") & (time >= limit - 2 * width)))

    return start_stepped(df, step, path, checkpoint, ts=ts, delay=delay, **trigger)
