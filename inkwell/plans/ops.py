"""Run-history jobs and base-table creation (SRC-7).

``sync_pipeline_runs`` takes the run records an orchestrator reported, merges
them into ``ops.pipeline_runs`` and returns the failed runs not yet alerted.
Delivering the alerts (the webhook) is outside Spark; ``acknowledge`` then adds
the delivered runs to the alert ledger.

The history is partitioned by the month a run started in. A key index names
the month of every run, so a sync reads and writes only the months its runs
are in or move to. The index layer is written after the history and carries
the history's state as its tag; where that is not the newest state (a sync
died in between, or another one is about to add its layer), the next sync
rebuilds the index from the key columns of the history. A sync publishes on
top of the state it read; if another one was faster, it merges again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.config import OPS, Lake, Settings, configure
from inkwell.functions.formats import utc_literal
from inkwell.operators import runs as run_ops
from inkwell.schemas import ALERT_LEDGER, DATA_QUALITY_RESULTS, PIPELINE_RUNS
from inkwell.sources.key_index import KeyIndex
from inkwell.sources.store import Conflict, TableStore

RUNS_TABLE = "pipeline_runs"
QUALITY_TABLE = "data_quality_results"
ALERTS_TABLE = "alert_ledger"
RUN_INDEX = "pipeline_run_months"
# Months with failed runs that nobody has acknowledged.
OPEN_MONTHS = "pipeline_open_months"
MONTH = "start_month"
ATTEMPTS = 5


def ensure_base_tables(spark: SparkSession, lake: Lake) -> list[str]:
    """SRC-7: create the replace tables that are absent, empty, with their
    declared schema. Append tables (raw, quarantine, ledger) need nothing:
    an absent one reads as empty. Returns the tables created. A history that an
    earlier release wrote without months is laid out anew."""
    store = TableStore(spark, lake)
    created = []
    for name, schema in ((RUNS_TABLE, PIPELINE_RUNS), (QUALITY_TABLE, DATA_QUALITY_RESULTS)):
        if store.ensure(OPS, name, schema):
            created.append(name)
    if not created and store.head(OPS, RUNS_TABLE).startswith("version=") and not store.partition_folders(OPS, RUNS_TABLE, MONTH):
        old, base = store.read(OPS, RUNS_TABLE), store.head(OPS, RUNS_TABLE)
        if not old.isEmpty():
            store.replace(old.select(*PIPELINE_RUNS.fieldNames(), month_of().alias(MONTH)), OPS, RUNS_TABLE,
                          partition_by=(MONTH,), cluster_by=("started_at",), base=base)
    return created


def month_of(started: str = "started_at") -> Column:
    return F.date_format(started, "yyyy-MM")


def run_key() -> Column:
    """Null where the MERGE key has a null part: such a run never matches."""
    return F.concat("dag_id", F.lit("\u001f"), "run_id")


def run_index(store: TableStore) -> KeyIndex:
    return KeyIndex(store, OPS, RUN_INDEX, place_type=StringType())


def _history(store: TableStore) -> DataFrame:
    return store.read(OPS, RUNS_TABLE, schema=PIPELINE_RUNS, columns=[*PIPELINE_RUNS.fieldNames(), MONTH],
                      partitions=StructType([StructField(MONTH, StringType(), True)]))


def in_months(months: list) -> Column:
    known = [m for m in months if m is not None]
    cond = F.coalesce(F.col(MONTH).isin(*known), F.lit(False)) if known else F.lit(False)
    return cond | F.col(MONTH).isNull() if None in months else cond


def read_runs(spark: SparkSession, lake: Lake) -> DataFrame:
    return _history(TableStore(spark, lake)).select(*PIPELINE_RUNS.fieldNames())


def newest_runs(spark: SparkSession, lake: Lake, n: int) -> DataFrame:
    """The runs of the newest months that hold ``n`` runs together, or all: what any
    list of the latest ``n`` is taken from. Runs without a start come last."""
    store = TableStore(spark, lake)
    months = sorted(store.partition_values(OPS, RUNS_TABLE, MONTH), key=lambda m: m or "", reverse=True)
    history, width = _history(store), 1
    while width < len(months) and history.where(in_months(months[:width])).limit(n).count() < n:
        width *= 2
    found = history if width >= len(months) else history.where(in_months(months[:width]))
    return found.select(*PIPELINE_RUNS.fieldNames())


def find_run(spark: SparkSession, lake: Lake, run_id: str, dag_id: str) -> DataFrame:
    """RPT-11 on the stored history: the index names the months to look in."""
    store = TableStore(spark, lake)
    index, history = run_index(store), _history(store)
    if index.exists() and index.newest_tag() == store.head(OPS, RUNS_TABLE):
        history = history.where(in_months(index.places_of(f"{dag_id}\u001f{run_id}")))
    return run_ops.run_lookup(history.select(*PIPELINE_RUNS.fieldNames()), run_id, dag_id)


def merge_runs(store: TableStore, source: DataFrame) -> list:
    """RUN-1 on the stored history; returns the months that were written. ``source``
    has one row per key and is read more than once. Raises ``Conflict`` if
    another writer published meanwhile."""
    base = store.head(OPS, RUNS_TABLE)
    index, history = run_index(store), _history(store)
    keyed = history.where(run_key().isNotNull()).select(run_key().alias("key"), F.col(MONTH).alias("place"),
                                                        F.lit(0).cast("long").alias("loads"))
    if not index.exists() or index.newest_tag() != base:
        index.rebuild(keyed, keyed.count(), tag=base, seq=_time_of(base))
    mine = source.select("*", month_of().alias(MONTH), run_key().alias("key"))
    known = index.of_keys(mine.where("key IS NOT NULL").select("key"))
    months = [r[0] for r in mine.select(MONTH).unionByName(known.select(F.col("place").alias(MONTH))).distinct().collect()]
    if not months:
        return []  # nothing was reported
    merged = run_ops.upsert_runs(history.where(in_months(months)).select(*PIPELINE_RUNS.fieldNames()), source)
    store.replace_partitions(merged.select("*", month_of().alias(MONTH)), OPS, RUNS_TABLE, partition_by=MONTH,
                             values=months, cluster_by=("started_at",), base=base)
    head = store.head(OPS, RUNS_TABLE)
    index.add(mine.where("key IS NOT NULL").select("key", F.col(MONTH).alias("place"), F.lit(0).cast("long").alias("loads")),
              tag=head, seq=_time_of(head))
    index.fold()
    return months


def _time_of(name: str) -> int:
    """When a state or version was named, as the order of index layers."""
    return int(name.split("=", 1)[1].split("-", 1)[0]) if "=" in name else 0


def sync_pipeline_runs(spark: SparkSession, lake: Lake, records: DataFrame, *,
                       settings: Settings = Settings()) -> DataFrame:
    """Merge reported run records into the history; return the alert feed.

    The feed holds the failed runs that nobody has acknowledged, whoever
    reported them and when: those of the months this sync wrote, and of the
    months earlier feeds came from. It changes nothing: a run is fed by every
    sync until ``acknowledge`` records its delivery.
    """
    configure(spark)
    store = TableStore(spark, lake)
    ensure_base_tables(spark, lake)
    source = run_ops.latest_per_key(run_ops.runs_from_records(
        records, recent_dag_id=settings.recent_dag_id, backfill_dag_id=settings.backfill_dag_id)).persist()
    try:
        for attempt in range(ATTEMPTS):
            try:
                written = merge_runs(store, source)
                break
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
    finally:
        source.unpersist()
    for attempt in range(ATTEMPTS):
        base = store.head(OPS, OPEN_MONTHS)
        opened = {r[0] for r in store.read(OPS, OPEN_MONTHS).collect()} if base != "none" else set()
        feed = _feed(spark, lake, opened | set(written))
        left = {r[0] for r in feed.select(month_of()).distinct().collect()}
        if left == opened:
            break
        try:
            store.replace(spark.createDataFrame([(m,) for m in left], f"{MONTH} string").coalesce(1), OPS, OPEN_MONTHS, base=base)
            break
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    return feed


def _feed(spark: SparkSession, lake: Lake, months: set) -> DataFrame:
    history = _history(TableStore(spark, lake)).where(in_months(list(months)))
    return run_ops.failed_run_feed(history.select(*PIPELINE_RUNS.fieldNames()), read_alerts(spark, lake))


def read_alerts(spark: SparkSession, lake: Lake) -> DataFrame:
    return TableStore(spark, lake).read(OPS, ALERTS_TABLE, schema=ALERT_LEDGER)


def acknowledge(spark: SparkSession, lake: Lake, delivered: DataFrame, *,
                alerted_at: datetime | None = None) -> None:
    """RUN-7: record feed rows as delivered, so that no later sync feeds them.

    Call it after the delivery succeeded; a run whose delivery failed stays
    in the feed. Acknowledging a run again changes nothing for the feed.
    """
    stamp = utc_literal(alerted_at) if alerted_at else F.current_timestamp()
    rows = delivered.withColumn("alerted_at", stamp)
    TableStore(spark, lake).append(rows.select(*[
        F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ALERT_LEDGER.fieldNames()]), OPS, ALERTS_TABLE)
