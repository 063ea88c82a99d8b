"""The end of a finite stream.

A stateful operator holds rows until the watermark passes them, and the
watermark never passes the last row by itself. :func:`closable` adds a second
input to a stream, an empty folder. :func:`close` puts one closing row there,
with the time :data:`END`: it moves the watermark past every other row, so open
windows, records and timers come out in the batch after it. Operators drop the
closing row itself once the watermark has seen it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.columns import field
from tidelog.sources.sinks import resume_ingest
from tidelog.specs import require

# Fixed value: the time of a closing row, past any record's.
END = "9999-12-31 00:00:00"


def end_time(like: str = "timestamp"):
    return F.lit(END).cast(like)


def _files(spark: SparkSession, folder: str):
    """The folder's file system and path; the folder is made if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    return system, path


def closed(spark: SparkSession, folder: str) -> bool:
    system, path = _files(spark, folder)
    return any(status.getPath().getName() == "_SUCCESS" for status in system.listStatus(path))


def closable(df: DataFrame, folder: str, *, ts: str = "ts") -> DataFrame:
    """The stream with its closing row to come: null in all columns but ``ts``.

    ``folder`` must be the stream's own. Apply this before the stateful
    operator; filters and parsers before it never see the closing row.
    """
    require(df.isStreaming, "a stream is needed")
    _files(df.sparkSession, folder)
    rows = df.sparkSession.readStream.schema("closing timestamp").parquet(folder)
    filled = [
        F.col("closing").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name)
        for f in df.schema
    ]
    return df.unionByName(rows.select(*filled))


def unclosed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The rows that are no closing rows.

    The test names the time column, so it stays above the operator that takes
    the watermark from it.
    """
    return df.filter(field(ts).isNull() | (field(ts) < end_time(df.schema[ts].dataType.simpleString())))


def close(spark: SparkSession, folder: str) -> None:
    """Put the closing row into the folder; once is enough."""
    if not closed(spark, folder):
        spark.range(1).select(end_time().alias("closing")).coalesce(1).write.mode("append").parquet(folder)


def ingest(df: DataFrame, path: str, checkpoint: str, folder: str, **options) -> StreamingQuery:
    """Append what is new; the stream stays open. Fails on a stream that was closed, as its rows would all be late."""
    require(not closed(df.sparkSession, folder), "the stream was closed; its watermark has passed every row")
    return resume_ingest(df, path, checkpoint, **options)


def ingest_to_end(df: DataFrame, path: str, checkpoint: str, folder: str, **options) -> StreamingQuery:
    """Append what is new, then close the stream and append what it still held. Safe to run again."""
    if not closed(df.sparkSession, folder):
        resume_ingest(df, path, checkpoint, **options)
    close(df.sparkSession, folder)
    return resume_ingest(df, path, checkpoint, **options)
