"""Streaming operators Spark has built in, with watermarks set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.columns import field
from tidelog.specs import positive_window
from tidelog.streaming.closing import unclosed


def event_time(df: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """The stream with ``ts`` as TIMESTAMP under a watermark, less its closing row."""
    return unclosed(df.withColumn(ts, field(ts).cast("timestamp")).withWatermark(ts, delay), ts)


def dedupe_within_watermark(df: DataFrame, fields: list[str], *, ts: str = "ts", delay: str) -> DataFrame:
    """Spark's own windowed duplicate filter; state goes with the watermark.

    Unlike anchored dedupe, any first arrival within ``delay`` counts.
    """
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark(fields)


def distinct_records(df: DataFrame, fields: list[str]) -> DataFrame:
    """Endless duplicate filter; its state grows with the number of keys."""
    return df.dropDuplicates(fields)


def tumbling_totals(df: DataFrame, value: str, window, *, source: str = "source", ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Count, sum, min, max per source and clock-aligned window."""
    number = F.coalesce(field(value).cast("double"), F.lit(0.0))
    width = positive_window(window)
    grouped = event_time(df, ts, delay).groupBy(F.window(field(ts), f"{width} microseconds"), field(source))
    totals = grouped.agg(
        F.count("*").alias("count"), F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max")
    )
    return totals.select(source, F.col("window.start").alias("window_start"), "count", "sum", "min", "max")


def sliding_counts(df: DataFrame, window, buckets: int, *, keys: list[str] | None = None, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Rows per sliding window (and per ``keys``)."""
    width = positive_window(window)
    span = F.window(field(ts), f"{width} microseconds", f"{width // buckets} microseconds")
    counted = event_time(df, ts, delay).groupBy(span, *[field(k) for k in keys or []]).agg(F.count("*").alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(keys or []), "n"
    )


def start_per_batch(
    df: DataFrame, build: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Run a record-wise table operator (such as ``geo_enrich``) on each micro-batch."""
    return (
        df.writeStream.foreachBatch(lambda rows, _: write(build(rows)))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
