"""Writing records: JSON lines, text lines, console, fan-out, routed output."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.columns import field
from tidelog.functions.layouts import format_time
from tidelog.operators.render import as_text, json_of_columns
from tidelog.plans.sizing import staged
from tidelog.specs import require

Writer = Callable[[DataFrame], None]

STYLES = ("json", "text")


def _text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_text(df, name), F.lit("")) if name in df.columns else F.lit("")


def tabbed_lines(df: DataFrame, ingest: str | None = None) -> DataFrame:
    """``time<TAB>level<TAB>message``; an empty time becomes the ingest time."""
    now = format_time(field(ingest).cast("timestamp") if ingest else F.current_timestamp())
    time = F.nullif(_text_or_empty(df, "time"), F.lit(""))
    line = F.concat_ws("\t", F.coalesce(time, now), _text_or_empty(df, "level"), _text_or_empty(df, "message"))
    return df.select(line.alias("value"))


def entry_lines(df: DataFrame, style: str = "text") -> DataFrame:
    """Lines of ``source, line, timestamp`` entries: ``[time] source: line`` or JSON."""
    require(style in STYLES, f"sink: unknown style {style!r}")
    if style == "json":
        return df.select(json_of_columns(df, ["source", "line", "timestamp"]).alias("value"))
    stamp = format_time(field("timestamp").cast("timestamp"))
    return df.select(
        F.concat(F.lit("["), stamp, F.lit("] "), F.col("source"), F.lit(": "), F.col("line")).alias("value")
    )


def write_json(df: DataFrame, path: str) -> None:
    """Append one JSON object per line."""
    df.write.mode("append").json(path)


def write_text(df: DataFrame, path: str, ingest: str | None = None) -> None:
    """Append tabbed lines."""
    tabbed_lines(df, ingest).write.mode("append").text(path)


def json_sink(path: str) -> Writer:
    return lambda df: write_json(df, path)


def text_sink(path: str, ingest: str | None = None) -> Writer:
    return lambda df: write_text(df, path, ingest)


def print_row(row) -> None:
    print(row[0], flush=True)


def console_sink(ingest: str | None = None) -> Writer:
    """Every row as a line on the output of the task that has it."""
    return lambda df: tabbed_lines(df, ingest).foreach(print_row)


def fan_out(df: DataFrame, sinks: Mapping[str, Writer], *, stop_at_error: bool = False) -> None:
    """Write the same rows to every sink; the input is computed once, into the shared checkpoint folder.

    All sinks are tried unless ``stop_at_error``; errors are raised at the end.
    """
    require(bool(sinks), "at least one sink is required")
    errors = []
    held = staged(df) if len(sinks) > 1 else df
    for name, write in sinks.items():
        try:
            write(held)
        except Exception as error:
            if stop_at_error:
                raise
            errors.append((name, error))
    if errors:
        raise RuntimeError("sinks failed: " + "; ".join(f"{n}: {e}" for n, e in errors)) from errors[0][1]


@dataclass(frozen=True)
class BatchFolders:
    """A sink with a folder for each micro-batch, which appears whole or not at all.

    A batch is written beside its place and then renamed to it. The renamed
    folder is the mark that the batch is there, so one that comes again after a
    failure is passed over. Read ``path`` as a table; the batch is a column.
    """

    path: str
    write: Callable[[DataFrame, str], None]

    def take(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place, beside = spot(f"{self.path}/batch={batch}"), spot(f"{self.path}/.staged-{batch}")
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(place):
            return
        system.delete(beside, True)
        self.write(df, beside.toString())
        if not system.rename(beside, place):
            raise OSError(f"sink: could not move batch {batch} to its place below {self.path}")


def json_folders(path: str) -> BatchFolders:
    return BatchFolders(path, lambda df, where: df.write.json(where))


def text_folders(path: str, ingest: str | None = None) -> BatchFolders:
    return BatchFolders(path, lambda df, where: tabbed_lines(df, ingest).write.text(where))


def write_routed(df: DataFrame, path: str, *, sink: str = "sink", fmt: str = "json") -> None:
    """Routed rows below ``path/sink=<name>``."""
    df.write.mode("append").partitionBy(sink).format(fmt).save(path)


def route_to(df: DataFrame, sinks: Mapping[str, Writer], *, sink: str = "sink") -> None:
    """Give each sink its routed rows."""
    named = {name: (lambda rows, n=name, w=write: w(rows.filter(field(sink) == n).drop(sink))) for name, write in sinks.items()}
    fan_out(df, named)


def start_json(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stream JSON lines to ``path``; restarts go on where ``checkpoint`` says."""
    return (
        df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_text(df: DataFrame, path: str, checkpoint: str, ingest: str | None = None, **trigger) -> StreamingQuery:
    """Stream tabbed lines to ``path``."""
    return (
        tabbed_lines(df, ingest).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_console(df: DataFrame, checkpoint: str, ingest: str | None = None, **trigger) -> StreamingQuery:
    return (
        tabbed_lines(df, ingest).writeStream.foreach(print_row).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def start_fan_out(df: DataFrame, sinks: Mapping[str, Writer | BatchFolders], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch to every sink, in order; an error stops the stream, a restart goes on from there.

    :class:`BatchFolders` take each batch once whatever fails. Other sinks are
    marked below ``checkpoint`` as they finish a batch and not asked again, so
    only the one that failed sees a batch twice.
    """
    require(bool(sinks), "at least one sink is required")

    def marked(name: str, write: Writer, batch: int) -> Writer:
        def once(rows: DataFrame) -> None:
            spark = rows.sparkSession
            mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/sinks/{name}/{batch}")
            system = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if not system.exists(mark):
                write(rows)
                system.create(mark).close()

        return once

    def give(rows: DataFrame, batch: int) -> None:
        bound = {
            name: (lambda df, s=sink: s.take(df, batch)) if isinstance(sink, BatchFolders) else marked(name, sink, batch)
            for name, sink in sinks.items()
        }
        fan_out(rows, bound, stop_at_error=True)

    return df.writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_batches(
    df: DataFrame, path: str, checkpoint: str, *, max_size: int = 100, interval: str = "5 seconds", fmt: str = "json"
) -> StreamingQuery:
    """Stream files of at most ``max_size`` rows, one set per ``interval``."""
    require(max_size >= 1, "batch: max_size must be >= 1")
    return (
        df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", max_size).trigger(processingTime=interval).start()
    )


def resume_ingest(df: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet", timeout: int | None = None) -> StreamingQuery:
    """Append what is new since the last call with this ``checkpoint``, then stop."""
    query = (
        df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    return query
