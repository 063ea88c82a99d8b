"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# SQL settings every operator assumes.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

CLUSTER_PARTITIONS = "8000"

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def configure_streaming(spark: SparkSession) -> SparkSession:
    """As :func:`configure`, plus the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return configure(spark)


def build_session(
    app: str = "tidelog", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Create a session. Leave ``master`` unset on a cluster (spark-submit sets it)."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not master:
        # Adaptive execution only merges partitions, so a cluster starts with many.
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", CLUSTER_PARTITIONS)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without
    that setting gets a folder of its own, because there one machine is the
    whole cluster.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
