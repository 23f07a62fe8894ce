"""Session settings and lake layout.

Everything in this library assumes a UTC session: the warehouse stores UTC
instants, `DATE(ts)` means the UTC calendar day, and the ISO strings the
read queries return end in a literal ``Z``.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Runtime settings the library relies on. They are all session-scoped SQL
# confs, so they can be applied to a session that a cluster already built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # REBALANCE before partitioned writes splits a hot publication date
    # over several tasks instead of one.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


# Sizes for large scans and writes, applied only where the session leaves
# them unset (a cluster's own tuning wins): ~256 MB scan splits, and AQE
# aiming at ~256 MB per shuffle partition, which is also the size of the
# files a rebalanced write produces.
SIZE_DEFAULTS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library needs to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in SIZE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "inkwell", cores: str = "*", partitions: int = 8,
                  scratch: str | None = None) -> SparkSession:
    """A local session for tests and the bench: UI off, UTC, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("INKWELL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if scratch:  # the folder all tasks share; a cluster names its own
        builder = builder.config("spark.checkpoint.dir", scratch)
    event_log = os.environ.get("INKWELL_EVENT_LOG")
    if event_log:
        # stage and task metrics for the bench, into its own scratch folder
        builder = (builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log)
                   .config("spark.eventLog.rolling.enabled", "false")
                   .config("spark.eventLog.compress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


# Dataset names of the warehouse (raw landing, analytics rollups, ops).
RAW, ANALYTICS, OPS = "raw", "analytics", "ops"


@dataclass(frozen=True)
class Settings:
    """Parameters the reference reads from its settings object."""

    default_window_days: int = 12
    missing_section_threshold: int = 0
    missing_published_at_threshold: int = 0
    recent_dag_id: str = "guardian_ingest_recent"
    backfill_dag_id: str = "guardian_backfill_range"
    overview_run_sample: int = 50


@dataclass(frozen=True)
class Lake:
    """Where the warehouse tables live: ``{root}/{dataset}/{table}``."""

    root: str

    def path(self, dataset: str, table: str) -> str:
        return f"{self.root.rstrip('/')}/{dataset}/{table}"
