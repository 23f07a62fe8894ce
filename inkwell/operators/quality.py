"""DQ-1 … DQ-4: data-quality checks as one aggregate scan each.

DQ-1 and DQ-2 share a single pass over the table (both counts in one global
aggregate with partial aggregation), then ``inline`` turns the one-row result
into one row per check. Any table with the columns can be checked, e.g. raw
before the 'Unknown' default as well as ``articles_latest`` after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.formats import utc_literal

# Names, severity and detail texts of the checks.
MISSING_SECTION = "Missing section names"
MISSING_PUBLISHED = "Missing publication date"
DUPLICATE_IDS = "Duplicate guardian IDs"
FRESHNESS_LAG = "Freshness lag"
SEVERITY = "warning"
SECTION_DETAIL = "Section name should always be populated."
PUBLISHED_DETAIL = "Published timestamp should always be available."
DUPLICATE_DETAIL = "Each article id should be loaded once per ingest."
FRESHNESS_DETAIL = "Newest ingest should trail the newest article by the budget at most."
DUPLICATE_THRESHOLD = 1
FRESHNESS_THRESHOLD_MINUTES = 20


def _stamps(as_of: datetime | None) -> tuple[Column, Column]:
    if as_of is None:
        return F.current_date(), F.current_timestamp()
    ts = utc_literal(as_of)
    return F.to_date(ts), ts


def _check(name: str, observed: Column, threshold: int, detail: str) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"),
        F.lit(SEVERITY).alias("severity"),
        F.when(observed <= F.lit(threshold), F.lit("pass")).otherwise(F.lit("warn")).alias("status"),
        observed.cast("string").alias("observed_value"),
        F.lit(str(threshold)).alias("threshold"),
        F.to_json(F.struct(F.lit(detail).alias("detail"))).alias("details_json"),
    )


def _rows(agg: DataFrame, checks: list[Column], as_of: datetime | None) -> DataFrame:
    check_date, created_at = _stamps(as_of)
    return agg.select(F.inline(F.array(*checks))).select(
        "check_name", check_date.alias("check_date"), "severity", "status", "observed_value",
        "threshold", "details_json", created_at.alias("created_at"))


def quality_results(table: DataFrame, *, missing_section_threshold: int = 0,
                    missing_published_at_threshold: int = 0,
                    as_of: datetime | None = None) -> DataFrame:
    """DQ-1 + DQ-2 in the ``data_quality_results`` layout.

    ``table`` holds articles, or ``article_day_stats``: the counts per date and
    section, where an article without a publication time has no date.
    """
    counted = "article_count" in table.columns
    rows = F.col("article_count") if counted else F.lit(1)
    undated = F.col("publication_date" if counted else "published_at").isNull()
    unnamed = F.col("section_name").isNull() | (F.col("section_name") == "")
    agg = table.agg(
        F.coalesce(F.sum(F.when(unnamed, rows)), F.lit(0)).cast("long").alias("_sections"),
        F.coalesce(F.sum(F.when(undated, rows)), F.lit(0)).cast("long").alias("_published"),
    )
    return _rows(agg, [
        _check(MISSING_SECTION, F.col("_sections"), missing_section_threshold, SECTION_DETAIL),
        _check(MISSING_PUBLISHED, F.col("_published"), missing_published_at_threshold, PUBLISHED_DETAIL),
    ], as_of)


def duplicate_ids(raw: DataFrame, *, threshold: int = DUPLICATE_THRESHOLD,
                  as_of: datetime | None = None) -> DataFrame:
    """DQ-3: ids loaded more than once in raw (count of such ids).

    Two hash aggregates with partial aggregation: a hot id collapses to one
    row per map task before the shuffle.
    """
    loads = raw.filter(F.col("guardian_id").isNotNull()).select(
        F.col("guardian_id").alias("key"), F.lit(1).cast("long").alias("loads"))
    return duplicate_ids_of(loads, threshold=threshold, as_of=as_of)


def duplicate_ids_of(loads: DataFrame, *, threshold: int = DUPLICATE_THRESHOLD,
                     as_of: datetime | None = None) -> DataFrame:
    """DQ-3 from load counts per ``key``, which add up: rows of raw, or the key
    index, which no run has to read raw for."""
    per_id = loads.groupBy("key").agg(F.sum("loads").alias("n"))
    agg = per_id.agg(F.count_if(F.col("n") > 1).alias("_dups"))
    return _rows(agg, [_check(DUPLICATE_IDS, F.col("_dups"), threshold, DUPLICATE_DETAIL)], as_of)


def freshness_budget(content_freshness: DataFrame, *, threshold: int = FRESHNESS_THRESHOLD_MINUTES,
                     as_of: datetime | None = None) -> DataFrame:
    """DQ-4: freshness lag of MAT-7 against a budget in minutes."""
    agg = content_freshness.agg(F.max("freshness_lag_minutes").alias("_lag"))
    return _rows(agg, [_check(FRESHNESS_LAG, F.col("_lag"), threshold, FRESHNESS_DETAIL)], as_of)
