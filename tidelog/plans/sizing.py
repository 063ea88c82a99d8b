"""Size checks taken before a plan shape is chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import ensure_checkpoint_dir

# A broadcast side is held whole on every executor, so it must stay small.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count rows and text bytes of ``df``, stopping once past ``max_rows``."""
    sized = df.select(F.octet_length(F.to_json(F.struct("*"))).cast("long").alias("n"))
    row = sized.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    return row["rows"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there.

    For costly rows (parsed text, say) that several passes read. Survives the
    loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def require_table(df: DataFrame) -> None:
    if df.isStreaming:
        raise ValueError("ordered operators take tables; tidelog.streaming has their streaming forms")


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size allows it.

    Otherwise the join is told to shuffle, since Spark's estimate of a table made
    by ``explode`` may be far too small and would broadcast it all the same;
    adaptive execution splits hot keys of the larger side.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df.hint("merge")
