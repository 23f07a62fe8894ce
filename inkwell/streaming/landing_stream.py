"""ING-5: the hourly incremental ingest as a Structured Streaming job.

The landing folder is a file stream; each micro-batch holds the pages landed
since the last one. The stream's checkpoint replaces the date watermark as
the progress marker, so no page is read twice and none is skipped after a
restart. ``foreachBatch`` writes the batch through the same validation as
the batch load into ``batch=stream-<name>-<id>`` (overwrite): a batch that is
replayed after a failure rewrites its own directory instead of appending
twice. The ingest stamp is ``current_timestamp()`` taken on the stream,
which Spark fixes per micro-batch in its offset log, so replays stamp alike.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.config import Lake, configure
from inkwell.plans.refresh import run_transforms
from inkwell.sources import landing
from inkwell.sources.store import TableStore

STREAM_NAME = "landing"


def landing_stream(spark: SparkSession, landing_dir: str, *, max_files_per_trigger: int | None = None,
                   one_page_per_file: bool = False) -> DataFrame:
    reader = spark.readStream.format("text")
    if one_page_per_file:
        reader = reader.option("wholetext", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    path = F.col("_metadata.file_path")
    return reader.load(landing_dir).select(
        "value",
        F.to_date(F.regexp_extract(path, r"day=(\d{4}-\d{2}-\d{2})", 1)).alias("day"),
        path.alias("file_path"),
        F.current_timestamp().alias("_batch_ts"),
    )


def start(spark: SparkSession, lake: Lake, landing_dir: str, *, checkpoint: str | None = None,
          name: str = STREAM_NAME, available_now: bool = True,
          processing_time: str | None = None, refresh: bool = False, **source_options) -> StreamingQuery:
    """Start the ingest stream. With ``refresh`` each micro-batch is also merged into
    the analytics tables before it counts as done: one that failed half-way
    is replayed, and one that was merged already changes nothing, because its
    load carries (query id, batch id) and the ledger of merged loads knows it.
 ``available_now`` drains what has landed and
    stops (the scheduled hourly run); else it runs every ``processing_time``.

    The checkpoint defaults to ``{lake}/_checkpoints/{name}``, on the same
    shared store as the tables.
    """
    configure(spark)
    store = TableStore(spark, lake)
    checkpoint = checkpoint or f"{lake.root.rstrip('/')}/_checkpoints/{name}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # batch numbers start again with a new checkpoint, the query id does
        # not: a replay meets its own batch, never that of another query
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        landing.load(store, batch, F.col("_batch_ts"), batch_id=f"stream-{name}-{query}-{batch_id:012d}")
        if refresh:
            report = run_transforms(spark, lake, incremental=True)
            if report.status != "materialized":
                raise RuntimeError(f"batch {batch_id} is loaded but not merged: {report}")

    writer = (landing_stream(spark, landing_dir, **source_options).writeStream
              .queryName(f"inkwell-{name}")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(write_batch))
    writer = (writer.trigger(availableNow=True) if available_now
              else writer.trigger(processingTime=processing_time or "1 hour"))
    return writer.start()


def run_available_now(spark: SparkSession, lake: Lake, landing_dir: str, **kwargs) -> int:
    """Drain the landing folder once; returns the raw batches written so far."""
    query = start(spark, lake, landing_dir, available_now=True, **kwargs)
    query.awaitTermination()
    return landing.live_loads(TableStore(spark, lake)).count()
