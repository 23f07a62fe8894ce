"""RUN-1 … RUN-7: pipeline-run history.

Run records reported by the orchestrator are normalised into the
``pipeline_runs`` layout (RUN-2…4), upserted by (dag_id, run_id) with one
full outer join (RUN-1), serialised for display (RUN-5/6), and failed
runs not yet alerted are fed once each (RUN-7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.formats import col_of
from inkwell.schemas import RUN_RECORD

# States kept as they are; anything else becomes 'scheduled'.
KNOWN_STATES = ("success", "failed", "running", "queued", "scheduled")
DEFAULT_STATE = "scheduled"
RECENT_WINDOW = "recent ingest"
MANUAL_WINDOW = "manual backfill"
UNKNOWN_WINDOW = "Unknown"
RUN_KEY = ("dag_id", "run_id")
RUN_COLUMNS = ("run_id", "dag_id", "status", "trigger", "started_at", "finished_at", "window",
               "error_summary")


def normalize_state(state: str | Column) -> Column:
    """RUN-2."""
    state = col_of(state)
    return F.when(state.isin(*KNOWN_STATES), state).otherwise(F.lit(DEFAULT_STATE))


def _present(c: Column) -> Column:
    """Python truthiness of an optional string: null and '' are absent."""
    return c.isNotNull() & (c != "")


def backfill_window(conf: Column) -> Column:
    """RUN-4 for manual runs: 'start to end' when conf has both dates."""
    start, end = conf.getItem("start_date"), conf.getItem("end_date")
    return (F.when(_present(start) & _present(end), F.concat(start, F.lit(" to "), end))
            .otherwise(F.lit(MANUAL_WINDOW)))


def parse_instant(c: str | Column) -> Column:
    """ISO-8601 text to a UTC timestamp; null when unparseable."""
    return F.try_to_timestamp(col_of(c))


def runs_from_records(records: DataFrame, *, recent_dag_id: str = "guardian_ingest_recent",
                      backfill_dag_id: str = "guardian_backfill_range") -> DataFrame:
    """RUN-3/4: orchestrator records → ``pipeline_runs`` rows.

    Records of the recent-ingest job are system-triggered, those of the
    backfill job manual. started_at falls back to the logical date.
    """
    manual = F.col("dag_id") == F.lit(backfill_dag_id)
    started = F.when(_present(F.col("start_date")), F.col("start_date")).otherwise(F.col("logical_date"))
    return records.filter(F.col("dag_id").isin(recent_dag_id, backfill_dag_id)).select(
        F.col("dag_run_id").alias("run_id"),
        "dag_id",
        normalize_state("state").alias("status"),
        F.when(manual, F.lit("manual")).otherwise(F.lit("system")).alias("trigger"),
        parse_instant(started).alias("started_at"),
        parse_instant("end_date").alias("finished_at"),
        F.when(manual, backfill_window(F.col("conf"))).otherwise(F.lit(RECENT_WINDOW)).alias("window"),
        F.lit(None).cast("string").alias("error_summary"),
    )


def backfill_record(spark: SparkSession, run_id: str, dag_id: str, state: str, start_date: str, end_date: str,
                    ended: str | None = None) -> DataFrame:
    """One run record of a backfill started here; a ``manual__<instant>`` run id
    carries the instant it was started at."""
    started = run_id.split("__", 1)[1] if "__" in run_id else None
    return spark.createDataFrame([(run_id, dag_id, state, started, ended, started,
                                   {"start_date": start_date, "end_date": end_date})], RUN_RECORD)


def latest_per_key(source: DataFrame) -> DataFrame:
    """One source row per (dag_id, run_id): the latest started_at wins.

    Rows with a null key part never match anything and are all kept. The
    keyed rows go through a plain ``row_number() = 1``, which Catalyst plans
    as a WindowGroupLimit on both sides of the shuffle: a run reported a
    million times sends one row per map task, not a million to one task.
    """
    keyed = F.col("dag_id").isNotNull() & F.col("run_id").isNotNull()
    order = [F.col(c).desc_nulls_last() for c in ("started_at", "finished_at", "status", "trigger",
                                                  "window", "error_summary")]
    w = Window.partitionBy(*RUN_KEY).orderBy(*order)
    latest = (source.filter(keyed).withColumn("_rank", F.row_number().over(w))
              .filter(F.col("_rank") == 1).drop("_rank"))
    return latest.unionByName(source.filter(~keyed))


def upsert_runs(target: DataFrame, source: DataFrame) -> DataFrame:
    """RUN-1: MERGE on (dag_id, run_id): matched rows take the source's
    values, unmatched source rows are inserted, other target rows stay.

    One full outer join on the key: each side is shuffled once and every
    output row takes the source's columns when a source row is present.
    Null keys never compare equal, so such rows of either side go around the
    join, as in a MERGE: in it they would all hash to one task.
    """
    src = latest_per_key(source).select(*RUN_COLUMNS)
    keyed = F.col("dag_id").isNotNull() & F.col("run_id").isNotNull()
    around = target.filter(~keyed).select(*RUN_COLUMNS).unionByName(src.filter(~keyed))
    target, src = target.filter(keyed), src.filter(keyed)
    t = target.select(*[F.col(c).alias(f"_t_{c}") for c in RUN_COLUMNS])
    s = src.select(*[F.col(c).alias(f"_s_{c}") for c in RUN_COLUMNS], F.lit(True).alias("_from_source"))
    on = (F.col("_t_dag_id") == F.col("_s_dag_id")) & (F.col("_t_run_id") == F.col("_s_run_id"))
    joined = t.join(s, on, "full_outer")
    from_source = F.col("_from_source").isNotNull()
    return joined.select(*[F.when(from_source, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c)
                           for c in RUN_COLUMNS]).unionByName(around)


def _python_iso(ts: Column) -> Column:
    """``datetime.isoformat()`` of a UTC timestamp: microseconds only when
    non-zero, offset ``+00:00``."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(base, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
                 F.lit("+00:00")))


def serialize_runs(runs: DataFrame) -> DataFrame:
    """RUN-5/6: display form of run rows (read through ``pipeline_runs``
    query output, whose window column is ``run_window``)."""
    window = F.col("run_window") if "run_window" in runs.columns else F.col("window")
    return runs.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("dag_id").cast("string").alias("dag_id"),
        normalize_state(F.col("status")).alias("status"),
        F.col("trigger").cast("string").alias("trigger"),
        _python_iso(F.col("started_at")).alias("started_at"),
        _python_iso(F.col("finished_at")).alias("finished_at"),
        F.when(_present(window), window).otherwise(F.lit(UNKNOWN_WINDOW)).alias("window"),
        F.col("error_summary").cast("string").alias("error_summary"),
    )


def failed_run_feed(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """RUN-7: failed runs not yet alerted, one row per run id.

    Runs with an empty id are left out. The ledger holds run ids already
    sent; append the feed's ids to it after delivery.
    """
    failed = runs.filter((F.col("status") == "failed") & _present(F.col("run_id")))
    fresh = failed.join(ledger.select("run_id"), on="run_id", how="left_anti")
    w = Window.partitionBy("run_id").orderBy(F.col("dag_id").asc_nulls_last(),
                                             F.col("started_at").desc_nulls_last())
    once = fresh.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1)
    return once.select(
        F.lit("dag_run_failed").alias("event"), "run_id", "dag_id", "status", "started_at",
        "window", "error_summary")


def failed_in_latest(runs: DataFrame, n: int) -> DataFrame:
    """RPT-12: failed runs among the latest ``n`` (started_at desc, run_id desc)."""
    latest = runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()).limit(n)
    return latest.agg(F.count_if(F.col("status") == "failed").alias("recent_failures"))


def run_lookup(runs: DataFrame, run_id: str, dag_id: str = "guardian_backfill_range") -> DataFrame:
    """RPT-11: one run of the backfill job by id (no cap on history)."""
    return runs.filter((F.col("run_id") == F.lit(run_id)) & (F.col("dag_id") == F.lit(dag_id)))
