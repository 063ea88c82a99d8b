"""The registered queries: every operator over whole driver tables, with SQL to check against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import configure, ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL that gives the same result."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log records."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.col("event_type").alias("level"),
        "ts",
        F.col("event_id").alias("id"),
        "user_id",
        "value",
        "props",
    )


LOGS_SQL = "SELECT event_type AS source, event_type AS level, ts, event_id AS id, user_id, value, props FROM events"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def load() -> None:
    """Import the modules that register queries."""
    from workload import enrichment, records, stateful, text, windows  # noqa: F401
    from workload import io_and_streams  # noqa: F401
