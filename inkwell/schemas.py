"""Declared schemas of the base tables and of the landed inputs."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _s(name: str) -> StructField:
    return StructField(name, StringType(), True)


ARTICLES_RAW = StructType([
    _s("guardian_id"), _s("web_url"), _s("web_title"),
    _s("section_id"), _s("section_name"), _s("pillar_id"), _s("pillar_name"),
    StructField("published_at", TimestampType(), True),
    StructField("ingested_at", TimestampType(), True),
    StructField("tags", ArrayType(StringType(), True), True),
    StructField("api_response_page", LongType(), True),
    _s("raw_payload"),
])

PIPELINE_RUNS = StructType([
    _s("run_id"), _s("dag_id"), _s("status"), _s("trigger"),
    StructField("started_at", TimestampType(), True),
    StructField("finished_at", TimestampType(), True),
    _s("window"), _s("error_summary"),
])

DATA_QUALITY_RESULTS = StructType([
    _s("check_name"),
    StructField("check_date", DateType(), True),
    _s("severity"), _s("status"), _s("observed_value"), _s("threshold"),
    _s("details_json"),
    StructField("created_at", TimestampType(), True),
])

# One landed source page: the envelope is parsed, results stay raw JSON text
# so that non-object elements and unknown fields survive to the quarantine.
PAGE_ENVELOPE = "response struct<pages int, currentPage int, results array<string>>"

# Fields of one source result that the normaliser maps to columns.
SOURCE_RESULT = StructType([
    _s("id"), _s("webUrl"), _s("webTitle"),
    _s("sectionId"), _s("sectionName"), _s("pillarId"), _s("pillarName"),
    _s("webPublicationDate"),
    StructField("tags", ArrayType(StringType(), True), True),   # each tag as its own text
])

# Run record as the orchestrator reports it.
RUN_RECORD = StructType([
    _s("dag_run_id"), _s("dag_id"), _s("state"),
    _s("start_date"), _s("end_date"), _s("logical_date"),
    StructField("conf", MapType(StringType(), StringType(), True), True),
])

# Ledger of failed runs already alerted.
ALERT_LEDGER = StructType([_s("run_id"), StructField("alerted_at", TimestampType(), True)])
