"""Counters of a running stream, taken from its progress."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.specs import require

SCHEMA = "run string, batch long, at string, stage string, name string, value long"


def counted(df: DataFrame, stage: str, counters: dict[str, Column | None]) -> DataFrame:
    """The stream as it is, with its rows counted on their way: those that meet a condition, or all (None).

    The counts are taken within the tasks that handle the rows and come with
    each batch's progress; nothing is read again.
    """
    require(bool(counters), "counters: at least one is required")
    parts = [(F.count(F.lit(1)) if on is None else F.count_if(on)).alias(name) for name, on in counters.items()]
    return df.observe(stage, *parts)


class StageCounters(StreamingQueryListener):
    """Collects the counts of :func:`counted` stages of all queries; ``start`` before them.

    The driver holds a row per batch, stage and counter, the last ``keep`` of
    them; totals go on for as long as the listener does.
    """

    def __init__(self, keep: int = 100_000):
        self._rows: deque = deque(maxlen=keep)
        self._totals: dict[tuple[str, str], int] = {}
        self._done: set[tuple[str, int]] = set()
        self._ended: dict[str, threading.Event] = {}

    def start(self, spark: SparkSession) -> StageCounters:
        spark.streams.addListener(self)
        return self

    def stop(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def _ending(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._ending(str(event.runId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run, batch = str(progress.runId), progress.batchId
        # A batch without new rows may report the numbers of the one before it again.
        if (run, batch) in self._done or not progress.observedMetrics:
            return
        self._done.add((run, batch))
        for stage, row in progress.observedMetrics.items():
            for name, value in row.asDict().items():
                self._rows.append((run, batch, progress.timestamp, stage, name, value))
                self._totals[stage, name] = self._totals.get((stage, name), 0) + value

    def onQueryTerminated(self, event) -> None:
        self._ending(str(event.runId)).set()

    def finish(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Wait for a query's end and for the last of its progress, which comes after it."""
        query.awaitTermination()
        if not self._ending(str(query.runId)).wait(timeout):
            raise TimeoutError("counters: the end of the query was not reported")

    def history(self, spark: SparkSession) -> DataFrame:
        """A row per batch, stage and counter."""
        return spark.createDataFrame(list(self._rows), SCHEMA)

    def totals(self, spark: SparkSession) -> DataFrame:
        """``stage, name, value``: each counter so far."""
        rows = [(stage, name, value) for (stage, name), value in sorted(self._totals.items())]
        return spark.createDataFrame(rows, "stage string, name string, value long")
