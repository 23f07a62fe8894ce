"""

``entry(spark)`` runs the flagship query on sf0.001. ``queries()`` holds one
DataFrame`` over the whole test tables; ``oracle_sql()`` holds the same
computation in DuckDB SQL over the same parquet views.

The test tables hold no articles, so every query starts from the
``articles_raw`` rows that ``inkwell.sources.adapters`` derives from
``events`` (FIXTURES.md §8); the oracle spells that derivation as the CTE
``articles_raw``. Tables whose columns are timestamps, dates or arrays are
returned in served form (ISO text, ``yyyy-MM-dd``, ``|``-joined) so both
engines print identical values. Columns stamped with the current time are
left out of the comparison.
"""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.config import Lake, configure
from inkwell.functions.formats import plain_types
from inkwell.operators import quality, rollups
from inkwell.operators import runs as run_ops
from inkwell.operators.latest import articles_latest
from inkwell.plans import ingest, ops, refresh
from inkwell.plans import queries as q
from inkwell.plans import reports, titles
from inkwell.plans.api import Warehouse
from inkwell.plans.catalog import TABLES, Tables
from inkwell.sources import adapters, landing
from inkwell.sources.store import TableStore

SF_SMOKE = "/root/testdata/sf0.001"

# Query parameters (fixed values): the whole month of the test data, a
# default 12-day window ending on its last day, and search arguments.
FULL = ("2024-01-01", "2024-01-31")
DEFAULT_WINDOW = ("2024-01-19", "2024-01-30")
SEARCH_TEXT = "story 1"
SEARCH_SECTION = "Politics"
SEARCH_TAG = "purchase"
DETAIL_ID = "article/1000"
AS_OF_TS = datetime(2024, 1, 31, 6, 0, 0)
BACKFILL = ("2024-01-01", "2024-02-02")
# Run history: the stored history is the first sync (runs before the split
# hour), the incoming sync overlaps it by six days.
HISTORY_BEFORE = "2024-01-16"
SYNC_FROM = "2024-01-10"
# The incremental refresh merges the rows ingested from here on.
MERGE_FROM = "2024-01-25"
# Letters beyond ASCII, both wildcards, and a backslash.
DOCUMENT_SEARCHES = ("É", "e%00%", "th_ ", "C\\D")
# A rare title, both wildcards, and runs too short for postings.
TITLE_SEARCHES = ("Story 1007", "STORY %77_", "y_1%5 ", "7%8")
LOOKUP_RUN = "manual__2024-01-12T05:00:00"


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables.derived(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top sections over the whole month of deduplicated articles."""
    t = _t(spark, SF_SMOKE)
    return q.top_sections(t.section_counts_daily, *FULL)


def _configured(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Every query runs in a UTC session with the library's runtime settings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators, none if their folder is absent."""
    try:
        import corpus_pipeline
        from inkwell.llm import registry
    except ImportError as e:
        # absent on purpose, or one of its third-party modules is: the warehouse works without
        warnings.warn(f"no training-data queries: {e}", stacklevel=2)
        return {}, {}
    sql = registry.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return registry.queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(fn) for name, fn in (_queries() | _training_data()[0]).items()}


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def content_freshness(spark, sf):
        return plain_types(_t(spark, sf).content_freshness.drop("refreshed_at"))

    return {
        # MAT-1 … MAT-7
        "articles_latest": lambda s, d: plain_types(_t(s, d).articles_latest),
        "article_tags": lambda s, d: plain_types(_t(s, d).article_tags),
        "daily_volume": lambda s, d: plain_types(_t(s, d).daily_volume),
        "section_counts_daily": lambda s, d: plain_types(_t(s, d).section_counts_daily),
        "section_daily": lambda s, d: plain_types(_t(s, d).section_daily),
        "tag_counts_daily": lambda s, d: plain_types(_t(s, d).tag_counts_daily),
        "content_freshness": content_freshness,
        # QRY-1 … QRY-8
        "overview_metrics": lambda s, d: q.overview_metrics(_t(s, d).articles_latest, *FULL),
        "overview_metrics_default_window":
            lambda s, d: q.overview_metrics(_t(s, d).articles_latest, *DEFAULT_WINDOW),
        "freshness": lambda s, d: q.freshness(_t(s, d).content_freshness),
        "publishing_volume": lambda s, d: q.publishing_volume(_t(s, d).daily_volume, *FULL),
        "sections_series": lambda s, d: q.sections_series(_t(s, d).section_daily, *FULL),
        "top_sections": lambda s, d: q.top_sections(_t(s, d).section_counts_daily, *FULL),
        "top_tags": lambda s, d: q.top_tags(_t(s, d).tag_counts_daily, *FULL),
        "articles_search": lambda s, d: plain_types(q.articles_search(
            _t(s, d).articles_latest, *FULL, query_text=SEARCH_TEXT, section=SEARCH_SECTION,
            row_limit=20, row_offset=20)),
        "articles_search_tag": lambda s, d: plain_types(q.articles_search(
            _t(s, d).articles_latest, *DEFAULT_WINDOW, tag=SEARCH_TAG)),
        "article_detail": lambda s, d: plain_types(q.article_detail(_t(s, d).articles_latest, DETAIL_ID)),
        **_more_queries(),
        **_job_queries(),
    }


def _landed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = adapters.landing_pages_from_events(adapters.read_table(spark, sf_dir, "events"))
    return pages.select("value", "day", F.lit(None).cast("string").alias("file_path"))


def _validated_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed page envelopes built from events, parsed and validated."""
    return landing.validated(_landed_text(spark, sf_dir), AS_OF_TS)


_lakes: dict[tuple[str, str], Lake] = {}


def _lakes_folder(spark: SparkSession) -> str:
    """The folder that all machines share, below which warehouses are made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return root or tempfile.mkdtemp(prefix="inkwell-lake-")


def _together(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Jobs that do not read what the others write, at the same time: the stages of few
    tasks of one leave the cluster to the other."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            job.result()


def _lake(spark: SparkSession, sf_dir: str) -> Lake:
    """A warehouse in the shared folder, filled and refreshed by the jobs, once per
    session: all rows before ``MERGE_FROM`` and a full refresh, then the rows
    since, an incremental refresh, the fold of both loads, and two run syncs, the
    failures of the first one acknowledged."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _lakes:
        lake = Lake(f"{_lakes_folder(spark)}/lake-{uuid.uuid4().hex}")
        events = adapters.read_table(spark, sf_dir, "events")
        store, raw = TableStore(spark, lake), adapters.articles_raw_from_events(adapters.dealt(events))
        late = F.col("ingested_at") >= F.lit(MERGE_FROM).cast("timestamp")

        def refreshed(incremental):
            report = refresh.run_transforms(spark, lake, refreshed_at=AS_OF_TS, incremental=incremental)
            if report.status != "materialized":
                raise RuntimeError(report)

        def articles():
            landing.append_raw(store, raw.filter(~late))
            refreshed(False)
            _together(spark, lambda: titles.index_titles(spark, lake), lambda: landing.append_raw(store, raw.filter(late)))
            refreshed(True)
            _together(spark, lambda: titles.index_titles(spark, lake), lambda: refresh.compact_raw(store, most_loads=1))

        def run_syncs():
            day = F.col("ts")
            for when, sync in enumerate((day < F.lit(HISTORY_BEFORE).cast("timestamp_ntz"), day >= F.lit(SYNC_FROM).cast("timestamp_ntz"))):
                feed = ops.sync_pipeline_runs(spark, lake, adapters.run_records_from_events(adapters.dealt(events.filter(sync))))
                if when == 0:
                    ops.acknowledge(spark, lake, feed)

        _together(spark, articles, run_syncs)
        _lakes[key] = lake
    return _lakes[key]


def _job_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """What the jobs have written, read back through the library."""
    def table(name):
        return lambda s, d: plain_types(refresh.read_analytics(TableStore(s, _lake(s, d)), name).drop("refreshed_at"))

    def key_index(s, d):
        return plain_types(refresh.article_index(TableStore(s, _lake(s, d))).read().select(
            "key", F.col("place").alias("publication_date"), "loads"))

    def duplicate_ids(s, d):
        return plain_types(quality.duplicate_ids_of(refresh.article_index(TableStore(s, _lake(s, d))).layers(), as_of=AS_OF_TS))

    def article_detail(s, d):
        return plain_types(Warehouse(s, _lake(s, d)).article(DETAIL_ID))

    def raw_rows(s, d):
        return plain_types(landing.read_raw(TableStore(s, _lake(s, d))))

    def raw_count(s, d):
        return s.createDataFrame([(landing.raw_article_count(TableStore(s, _lake(s, d))),)], "rows long")

    def raw_watermark(s, d):
        return plain_types(s.createDataFrame([(landing.latest_ingested_at(TableStore(s, _lake(s, d))),)], "watermark timestamp_ntz"))

    def run_history(s, d):
        return plain_types(ops.read_runs(s, _lake(s, d)))

    def run_page(s, d):
        return plain_types(q.pipeline_runs(ops.newest_runs(s, _lake(s, d), 20), row_limit=10, row_offset=10))

    def run_lookup(s, d):
        return plain_types(ops.find_run(s, _lake(s, d), LOOKUP_RUN, "guardian_backfill_range"))

    def title_grams(s, d):
        postings = titles.postings_of(TableStore(s, _lake(s, d)))
        return plain_types(postings.groupBy("publication_date", "gram").agg(F.count(F.lit(1)).alias("articles")))

    def title_search(s, d):
        store = TableStore(s, _lake(s, d))
        found = [q.search_filter(titles.narrowed(store, lambda: refresh.read_analytics(store, "articles_latest"), *FULL, text),
                                 *FULL, query_text=text).select(F.lit(text).alias("search"), "guardian_id", "web_title")
                 for text in TITLE_SEARCHES]
        return reduce(DataFrame.unionByName, found)

    def article_search(s, d):
        page = Warehouse(s, _lake(s, d)).articles(*FULL, q_text=SEARCH_TEXT, section=SEARCH_SECTION, limit=20, offset=20)
        return plain_types(page["articles"])

    def run_feed(s, d):
        none = adapters.run_records_from_events(adapters.read_table(s, d, "events")).limit(0)
        return plain_types(ops.sync_pipeline_runs(s, _lake(s, d), none))

    return {f"job_{n}": table(n) for n in (*TABLES, refresh.SPANS)} | {f"job_{f.__name__}": f for f in (
        key_index, duplicate_ids, article_detail, raw_rows, raw_count, raw_watermark, run_history, run_page, run_lookup, run_feed,
        title_grams, title_search, article_search)}


def _runs(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """Run rows from events; ``where`` bounds the event time (pushed to the
    scan), which is the run's logical hour."""
    events = adapters.read_table(spark, sf_dir, "events")
    if where is not None:
        events = events.filter(where)
    return run_ops.runs_from_records(adapters.run_records_from_events(events))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history: the first sync merged into an empty table, so one
    row per key."""
    first_sync = _runs(spark, sf_dir, F.col("ts") < F.lit(HISTORY_BEFORE).cast("timestamp_ntz"))
    return run_ops.latest_per_key(first_sync)


def _merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sync = _runs(spark, sf_dir, F.col("ts") >= F.lit(SYNC_FROM).cast("timestamp_ntz"))
    return run_ops.upsert_runs(_history(spark, sf_dir), sync)


def _more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def quality_results(s, d):
        return plain_types(quality.quality_results(_t(s, d).articles_latest, as_of=AS_OF_TS))

    def quality_results_raw(s, d):
        return plain_types(quality.quality_results(_t(s, d).raw, as_of=AS_OF_TS))

    def quality_report(s, d):
        return q.data_quality(quality.quality_results(_t(s, d).articles_latest, as_of=AS_OF_TS))

    def duplicate_ids(s, d):
        return plain_types(quality.duplicate_ids(_t(s, d).raw, as_of=AS_OF_TS))

    def freshness_budget(s, d):
        return plain_types(quality.freshness_budget(_t(s, d).content_freshness, as_of=AS_OF_TS))

    def reject_split(s, d):
        rows = _validated_landing(s, d).drop("landing_day")
        return plain_types(rows)

    def reject_counts(s, d):
        return _validated_landing(s, d).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))

    def backfill_report(s, d):
        return plain_types(ingest.backfill_day_report(_validated_landing(s, d), *BACKFILL))

    def raw_watermark(s, d):
        return plain_types(q.max_ingested(_t(s, d).raw))

    def run_normalise(s, d):
        return plain_types(_runs(s, d))

    def run_upsert(s, d):
        return plain_types(_merged_runs(s, d))

    def pipeline_runs(s, d):
        return plain_types(q.pipeline_runs(_merged_runs(s, d)))

    def pipeline_runs_page2(s, d):
        return plain_types(q.pipeline_runs(_merged_runs(s, d), row_limit=10, row_offset=10))

    def runs_serialised(s, d):
        return run_ops.serialize_runs(q.pipeline_runs(_merged_runs(s, d), row_limit=25))

    def failed_run_feed(s, d):
        ledger = _history(s, d).filter(F.col("status") == "failed").select("run_id")
        return plain_types(run_ops.failed_run_feed(_merged_runs(s, d), ledger))

    def run_lookup(s, d):
        return plain_types(run_ops.run_lookup(_merged_runs(s, d), LOOKUP_RUN))

    def failed_run_count(s, d):
        return run_ops.failed_in_latest(_merged_runs(s, d), 50)

    def overview_kpis(s, d):
        t = _t(s, d)
        metrics = q.overview_metrics(t.articles_latest, *FULL)
        return reports.overview_kpis(metrics, q.freshness(t.content_freshness),
                                     run_ops.failed_in_latest(_merged_runs(s, d), 50))

    def overview_freshness(s, d):
        t = _t(s, d)
        metrics = q.overview_metrics(t.articles_latest, *DEFAULT_WINDOW)
        return reports.freshness_block(q.freshness(t.content_freshness), metrics)

    def ops_status(s, d):
        t = _t(s, d)
        return reports.ops_status(t, quality.quality_results(t.articles_latest, as_of=AS_OF_TS))["status"]

    def section_share(s, d):
        return reports.section_share(q.top_sections(_t(s, d).section_counts_daily, *FULL))

    def tag_rank(s, d):
        return reports.tag_rank(q.top_tags(_t(s, d).tag_counts_daily, *FULL)).withColumn(
            "rank", F.col("rank").cast("long"))

    def trailing_volume(s, d):
        return reports.trailing_points(q.publishing_volume(_t(s, d).daily_volume, *FULL),
                                       reports.TRAILING_VOLUME_POINTS)

    def trailing_sections(s, d):
        return reports.trailing_points(q.sections_series(_t(s, d).section_daily, *FULL),
                                       reports.TRAILING_SECTION_POINTS)

    def search_page_info(s, d):
        page = reports.search_page(_t(s, d).articles_latest, reports.DateWindow(*_dates(FULL)),
                                   query_text=SEARCH_TEXT, section=SEARCH_SECTION, limit=20, offset=20)
        return page["paging"]

    def search_summaries(s, d):
        page = reports.search_page(_t(s, d).articles_latest, reports.DateWindow(*_dates(DEFAULT_WINDOW)),
                                   tag=SEARCH_TAG, limit=20, offset=40)
        return plain_types(page["articles"])

    def merged(name):
        """One table of the incremental refresh: the rows of the last six days
        of ingest merged into the tables of all earlier rows."""
        def run(s, d):
            raw = _t(s, d).raw
            late = F.col("ingested_at") >= F.lit(MERGE_FROM).cast("timestamp")
            before = Tables(raw=raw.filter(~late), refreshed_at=AS_OF_TS)
            previous = {n: getattr(before, n) for n in TABLES} | {
                refresh.STATS: rollups.article_day_stats(before.articles_latest)}
            if name == refresh.SPANS:
                previous[name] = before.tag_span_counts
            out = refresh.merged_tables(previous, raw.filter(late), AS_OF_TS)[name]
            return plain_types(out.drop("refreshed_at"))

        return run

    def page_completeness(s, d):
        return plain_types(landing.page_completeness(_landed_text(s, d), BACKFILL))

    def page_quarantine(s, d):
        rows = _validated_landing(s, d).filter(F.col("reject_reason").isin(
            landing.UNPARSEABLE_PAGE, landing.NO_RESPONSE, landing.RESULTS_NOT_A_LIST))
        return plain_types(rows.select("landing_day", "reject_reason", "raw_payload"))

    def default_range(s, d):
        newest = _t(s, d).raw.agg(F.to_date(F.max("published_at"))).first()[0]
        return s.createDataFrame([(reports.window(today=newest).label,)], "range string")

    def raw_count(s, d):
        """The landed pages loaded into a warehouse of their own."""
        store = TableStore(s, Lake(f"{_lakes_folder(s)}/lake-loads-{uuid.uuid4().hex}"))
        landing.load(store, _landed_text(s, d), AS_OF_TS)
        return s.createDataFrame([(landing.raw_article_count(store), landing.read_quarantine(store).count())],
                                 "loaded long, rejected long")

    def report_sections(s, d):
        return reports.sections_report(_t(s, d), reports.DateWindow(*_dates(DEFAULT_WINDOW)))["leaders"]

    def report_section_series(s, d):
        return reports.sections_report(_t(s, d), reports.DateWindow(*_dates(DEFAULT_WINDOW)))["series"]

    def report_tags(s, d):
        return reports.tags_report(_t(s, d), reports.DateWindow(*_dates(DEFAULT_WINDOW)))["tags"]

    def report_volume(s, d):
        return reports.volume_report(_t(s, d), reports.DateWindow(*_dates(DEFAULT_WINDOW)), "hour")["series"]

    def report_overview_volume(s, d):
        t = _t(s, d)
        return reports.overview(t, _merged_runs(s, d), reports.DateWindow(*_dates(DEFAULT_WINDOW)))["daily_volume"]

    def ops_status_checks(s, d):
        t = _t(s, d)
        return plain_types(reports.ops_status(t, quality.quality_results(t.articles_latest, as_of=AS_OF_TS))["checks"])

    def article_detail_report(s, d):
        return plain_types(reports.article_report(_t(s, d).articles_latest, DETAIL_ID))

    def documents_search(s, d):
        raw = adapters.articles_from_documents(adapters.read_table(s, d, "documents"))
        found = [q.search_filter(articles_latest(raw), *FULL, query_text=text).select(
            F.lit(text).alias("search"), "guardian_id", "web_title") for text in DOCUMENT_SEARCHES]
        return reduce(DataFrame.unionByName, found)

    return {
        **{f"refresh_incremental_{n}": merged(n) for n in TABLES},
        "overview_metrics_from_stats": lambda s, d: q.overview_metrics_of(_t(s, d).article_day_stats, *FULL),
        "quality_results_from_stats": lambda s, d: plain_types(
            quality.quality_results(_t(s, d).article_day_stats, as_of=AS_OF_TS)),
        "tag_span_counts": lambda s, d: _t(s, d).tag_span_counts,
        "top_tags_from_spans": lambda s, d: q.top_tags_of_spans(_t(s, d).tag_span_counts, *FULL),
        "refresh_incremental_tag_span_counts": merged(refresh.SPANS),
        "page_completeness": page_completeness,
        "page_quarantine": page_quarantine,
        "raw_count": raw_count,
        "default_range": default_range,
        "report_sections": report_sections,
        "report_section_series": report_section_series,
        "report_tags": report_tags,
        "report_volume": report_volume,
        "report_overview_volume": report_overview_volume,
        "ops_status_checks": ops_status_checks,
        "article_detail_report": article_detail_report,
        "documents_search": documents_search,
        # DQ-1 … DQ-4
        "quality_results": quality_results,
        "quality_results_raw": quality_results_raw,
        "quality_report": quality_report,
        "duplicate_ids": duplicate_ids,
        "freshness_budget": freshness_budget,
        # SRC-1 … SRC-5, SRC-9, ING-2
        "reject_split": reject_split,
        "reject_counts": reject_counts,
        "backfill_report": backfill_report,
        "raw_watermark": raw_watermark,
        # RUN-1 … RUN-7, QRY-10, RPT-11, RPT-12
        "run_normalise": run_normalise,
        "run_upsert": run_upsert,
        "pipeline_runs": pipeline_runs,
        "pipeline_runs_page2": pipeline_runs_page2,
        "runs_serialised": runs_serialised,
        "failed_run_feed": failed_run_feed,
        "run_lookup": run_lookup,
        "failed_run_count": failed_run_count,
        # RPT-3, RPT-4, RPT-8, RPT-10, RPT-13 … RPT-16
        "overview_kpis": overview_kpis,
        "overview_freshness": overview_freshness,
        "ops_status": ops_status,
        "section_share": section_share,
        "tag_rank": tag_rank,
        "trailing_volume": trailing_volume,
        "trailing_sections": trailing_sections,
        "search_page_info": search_page_info,
        "search_summaries": search_summaries,
    }


def _dates(pair):
    from datetime import date

    return tuple(date.fromisoformat(x) for x in pair)


# ---------------------------------------------------------------- oracle SQL

_SECTION = """CASE event_id % 11 WHEN 0 THEN 'World news' WHEN 1 THEN 'Politics'
    WHEN 2 THEN 'Business' WHEN 3 THEN 'Culture' WHEN 4 THEN 'Art and design'
    WHEN 5 THEN 'Environment' WHEN 6 THEN 'Technology' WHEN 7 THEN 'Digital media'
    WHEN 8 THEN '' WHEN 9 THEN 'Sport' ELSE NULL END"""
_PILLAR = """CASE event_id % 11 WHEN 0 THEN 'News' WHEN 1 THEN 'News' WHEN 2 THEN 'News'
    WHEN 3 THEN 'Arts' WHEN 4 THEN 'Arts' WHEN 5 THEN 'News' WHEN 6 THEN 'News'
    WHEN 7 THEN 'Arts' WHEN 9 THEN 'Sport' ELSE NULL END"""

_RAW = f"""articles_raw AS (
  SELECT
    CASE WHEN event_type = 'error' THEN NULL
         ELSE 'article/' || CAST(event_id // 4 AS VARCHAR) END AS guardian_id,
    'https://example.org/u/' || CAST(user_id AS VARCHAR) AS web_url,
    event_type || ' story ' || CAST(event_id AS VARCHAR) AS web_title,
    lower(regexp_replace({_SECTION}, '[^A-Za-z]', '', 'g')) AS section_id,
    {_SECTION} AS section_name,
    CASE WHEN {_PILLAR} IS NOT NULL THEN 'pillar/' || lower({_PILLAR}) END AS pillar_id,
    {_PILLAR} AS pillar_name,
    CAST(ts AS TIMESTAMP) AS published_at,
    date_trunc('day', CAST(ts AS TIMESTAMP)) + INTERVAL 1 DAY
      + to_hours(CAST(event_id % 2 AS BIGINT)) AS ingested_at,
    CASE WHEN event_id % 13 = 0 THEN NULL
         ELSE [event_type, 'k' || json_extract_string(props, '$.k')] END AS tags,
    event_id % 4 AS api_response_page,
    '{{"id": ' || CAST(event_id AS VARCHAR) || ', "type": "' || event_type
      || '", "props": ' || props || '}}' AS raw_payload
  FROM events)"""

_LATEST = """articles_latest AS (
  SELECT guardian_id, web_url, web_title, section_id,
    COALESCE(section_name, 'Unknown') AS section_name, pillar_id,
    COALESCE(pillar_name, 'Unknown') AS pillar_name, published_at, ingested_at,
    CAST(published_at AS DATE) AS publication_date,
    COALESCE(tags, CAST([] AS VARCHAR[])) AS tags, api_response_page, raw_payload
  FROM (
    SELECT *, row_number() OVER (
      PARTITION BY COALESCE(guardian_id,
                            COALESCE(web_url, '') || '#' || CAST(published_at AS VARCHAR))
      ORDER BY ingested_at DESC NULLS LAST, api_response_page DESC NULLS LAST,
               web_title DESC NULLS LAST, raw_payload DESC NULLS LAST) AS rn
    FROM articles_raw)
  WHERE rn = 1)"""

_TAGS = """article_tags AS (
  SELECT guardian_id, publication_date, published_at, section_name, pillar_name, tag
  FROM articles_latest, UNNEST(tags) AS u(tag))"""

_ROLLUPS = """daily_volume AS (
  SELECT publication_date, COUNT(*) AS article_count FROM articles_latest GROUP BY publication_date),
section_counts_daily AS (
  SELECT publication_date, section_name AS section, COUNT(*) AS article_count
  FROM articles_latest GROUP BY publication_date, section_name),
section_daily AS (
  SELECT publication_date,
    CAST(SUM(CASE WHEN lower(section) LIKE '%world%' THEN article_count ELSE 0 END) AS BIGINT) AS world,
    CAST(SUM(CASE WHEN lower(section) LIKE '%politic%' THEN article_count ELSE 0 END) AS BIGINT) AS politics,
    CAST(SUM(CASE WHEN lower(section) LIKE '%business%' THEN article_count ELSE 0 END) AS BIGINT) AS business,
    CAST(SUM(CASE WHEN lower(section) LIKE '%culture%' OR lower(section) LIKE '%art%'
             THEN article_count ELSE 0 END) AS BIGINT) AS culture,
    CAST(SUM(CASE WHEN lower(section) LIKE '%climate%' OR lower(section) LIKE '%environment%'
             THEN article_count ELSE 0 END) AS BIGINT) AS climate,
    CAST(SUM(CASE WHEN lower(section) LIKE '%tech%' OR lower(section) LIKE '%digital%'
             THEN article_count ELSE 0 END) AS BIGINT) AS technology
  FROM section_counts_daily GROUP BY publication_date),
tag_counts_daily AS (
  SELECT publication_date, tag, COUNT(*) AS article_count FROM article_tags
  GROUP BY publication_date, tag),
content_freshness AS (
  SELECT COUNT(*) AS total_articles, COUNT(DISTINCT section_name) AS active_sections,
    MAX(ingested_at) AS last_sync_at, MAX(published_at) AS watermark,
    date_sub('minute', MAX(published_at), MAX(ingested_at)) AS freshness_lag_minutes
  FROM articles_latest)"""

_BASE = f"WITH {_RAW},\n{_LATEST},\n{_TAGS},\n{_ROLLUPS}\n"


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ') AS {c}"


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


def _win(start: str, end: str) -> str:
    return f"publication_date BETWEEN DATE '{start}' AND DATE '{end}'"


_LATEST_COLS = (
    "guardian_id, web_url, web_title, section_id, section_name, pillar_id, pillar_name, "
    f"{_ts('published_at')}, {_ts('ingested_at')}, {_day('publication_date')}, "
    "array_to_string(tags, '|') AS tags, api_response_page, raw_payload")


def oracle_sql() -> dict[str, str]:
    return _oracle_sql() | _further_oracles() | _training_data()[1]


def _further_oracles() -> dict[str, str]:
    base = _oracle_sql()
    in_default_window = lambda sql: sql.replace(_win(*FULL), _win(*DEFAULT_WINDOW))
    title = """split_part(COALESCE(text, ''), chr(10), 1) || ' ' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '100%' WHEN 2 THEN 'a_b' ELSE 'c\\d' END"""
    searches = "\nUNION ALL\n".join(
        f"SELECT '{x}' AS search, guardian_id, web_title FROM titled WHERE lower(web_title) LIKE '%' || lower('{x}') || '%'"
        for x in ("É", "e%00%", "th_ ", "C\\D"))
    return {
        # merging late rows gives what computing everything gives
        **{f"refresh_incremental_{name}": base[name] for name in (
            "articles_latest", "article_tags", "daily_volume", "section_counts_daily", "section_daily",
            "tag_counts_daily", "content_freshness")},
        "overview_metrics_from_stats": base["overview_metrics"],
        "quality_results_from_stats": base["quality_results"],
        "page_completeness": f"""SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN landed > 0 THEN announced END AS announced,
  COALESCE(landed, 0) AS landed, COALESCE(announced - landed, 0) AS unreadable,
  COALESCE(landed > 0 AND landed >= announced, FALSE) AS complete
FROM range(DATE '{BACKFILL[0]}', DATE '{BACKFILL[1]}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d) LEFT JOIN (
  SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT event_id // 50 + 1) AS announced,
    COUNT(DISTINCT event_id // 50 + 1) FILTER (WHERE (event_id // 50 + 1) % 7 <> 3) AS landed
  FROM events GROUP BY 1) ON day = CAST(d AS DATE)""",
        "page_quarantine": f"""WITH {_LANDED}
SELECT strftime(landing_day, '%Y-%m-%d') AS landing_day, reject_reason, raw_payload FROM validated
WHERE reject_reason = 'unparseable_page'""",
        "raw_count": f"""WITH {_LANDED} SELECT COUNT(*) FILTER (WHERE reject_reason IS NULL) AS loaded,
  COUNT(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected FROM validated""",
        "default_range": _BASE + """SELECT strftime(CAST(MAX(published_at) AS DATE) - 11, '%Y-%m-%d') || ' to '
  || strftime(CAST(MAX(published_at) AS DATE), '%Y-%m-%d') AS range FROM articles_raw""",
        **dict.fromkeys(("tag_span_counts", "refresh_incremental_tag_span_counts", "job_tag_span_counts"), _BASE + """
SELECT CAST(level AS INTEGER) AS level, CAST(date_diff('day', DATE '1970-01-01', publication_date) >> level AS INTEGER) AS span, tag,
  CAST(SUM(article_count) AS BIGINT) AS article_count
FROM tag_counts_daily, range(13) t(level) WHERE publication_date IS NOT NULL GROUP BY 1, 2, 3"""),
        "top_tags_from_spans": base["top_tags"],
        # what the jobs wrote equals what the rows say
        **{f"job_{name}": base[name] for name in (
            "articles_latest", "article_tags", "daily_volume", "section_counts_daily", "section_daily",
            "tag_counts_daily", "content_freshness", "duplicate_ids", "article_detail", "raw_watermark", "run_lookup")},
        "job_run_history": base["run_upsert"], "job_run_page": base["pipeline_runs_page2"], "job_run_feed": base["failed_run_feed"],
        "job_raw_count": _BASE + "SELECT COUNT(*) AS rows FROM articles_raw",
        "job_raw_rows": _BASE + f"""SELECT guardian_id, web_url, web_title, section_id, section_name, pillar_id, pillar_name,
  {_ts('published_at')}, {_ts('ingested_at')}, array_to_string(tags, '|') AS tags, api_response_page, raw_payload FROM articles_raw""",
        "job_title_grams": _BASE + f"""SELECT {_day('publication_date')}, gram, COUNT(*) AS articles FROM (
  SELECT publication_date, UNNEST(list_distinct(list_transform(range(1, length(web_title) - 1),
    lambda i: substr(lower(web_title), CAST(i AS INTEGER), 3)))) AS gram FROM articles_latest WHERE publication_date IS NOT NULL) GROUP BY 1, 2""",
        "job_title_search": _BASE + "\nUNION ALL\n".join(
            f"SELECT '{x}' AS search, guardian_id, web_title FROM articles_latest WHERE {_win(*FULL)} "
            f"AND lower(web_title) LIKE '%' || lower('{x}') || '%'" for x in TITLE_SEARCHES),
        "job_article_search": _summary_sql(base["articles_search"]),
        "job_key_index": _BASE + f"""SELECT COALESCE(guardian_id, COALESCE(web_url, '') || '#' || CAST(published_at AS VARCHAR)) AS key,
  {_day('publication_date')}, loads FROM articles_latest l LEFT JOIN (
    SELECT COALESCE(guardian_id, COALESCE(web_url, '') || '#' || CAST(published_at AS VARCHAR)) AS k, COUNT(guardian_id) AS loads
    FROM articles_raw GROUP BY 1) r
  ON r.k = COALESCE(guardian_id, COALESCE(web_url, '') || '#' || CAST(published_at AS VARCHAR))""",
        "report_sections": in_default_window(base["top_sections"]),
        "report_section_series": in_default_window(base["sections_series"]),
        "report_tags": in_default_window(base["top_tags"]),
        "report_volume": in_default_window(base["publishing_volume"]),
        "report_overview_volume": in_default_window(base["publishing_volume"]),
        "ops_status_checks": base["quality_report"],
        "article_detail_report": base["article_detail"],
        "documents_search": f"""WITH titled AS (
  SELECT 'doc/' || doc_id AS guardian_id, {title} AS web_title FROM documents)
{searches}""",
    }


def _oracle_sql() -> dict[str, str]:
    f0, f1 = FULL
    d0, d1 = DEFAULT_WINDOW
    return {
        "articles_latest": _BASE + f"SELECT {_LATEST_COLS} FROM articles_latest",
        "article_tags": _BASE + f"""SELECT guardian_id, {_day('publication_date')},
  {_ts('published_at')}, section_name, pillar_name, tag FROM article_tags""",
        "daily_volume": _BASE + f"SELECT {_day('publication_date')}, article_count FROM daily_volume",
        "section_counts_daily": _BASE + f"""SELECT {_day('publication_date')}, section, article_count
FROM section_counts_daily""",
        "section_daily": _BASE + f"""SELECT {_day('publication_date')}, world, politics, business,
  culture, climate, technology FROM section_daily""",
        "tag_counts_daily": _BASE + f"""SELECT {_day('publication_date')}, tag, article_count
FROM tag_counts_daily""",
        "content_freshness": _BASE + f"""SELECT total_articles, active_sections, {_ts('last_sync_at')},
  {_ts('watermark')}, freshness_lag_minutes FROM content_freshness""",
        "overview_metrics": _BASE + _overview(f0, f1),
        "overview_metrics_default_window": _BASE + _overview(d0, d1),
        "freshness": _BASE + f"""SELECT total_articles, active_sections,
  {_iso('last_sync_at')} AS last_sync_at, {_iso('watermark')} AS watermark, freshness_lag_minutes
FROM content_freshness LIMIT 1""",
        "publishing_volume": _BASE + f"""SELECT strftime(publication_date, '%Y-%m-%d') AS date,
  article_count AS value FROM daily_volume WHERE {_win(f0, f1)} ORDER BY publication_date""",
        "sections_series": _BASE + f"""SELECT strftime(publication_date, '%Y-%m-%d') AS date, world,
  politics, business, culture, climate, technology
FROM section_daily WHERE {_win(f0, f1)} ORDER BY publication_date""",
        "top_sections": _BASE + f"""SELECT section, CAST(SUM(article_count) AS BIGINT) AS count
FROM section_counts_daily WHERE {_win(f0, f1)} GROUP BY section
ORDER BY count DESC, section ASC NULLS FIRST LIMIT 4""",
        "top_tags": _BASE + f"""SELECT tag, count, 'Live' AS momentum FROM (
  SELECT tag, CAST(SUM(article_count) AS BIGINT) AS count
  FROM tag_counts_daily WHERE {_win(f0, f1)} GROUP BY tag
  ORDER BY count DESC, tag ASC NULLS FIRST LIMIT 8)""",
        "articles_search": _search_sql(
            f0, f1, f"AND lower(web_title) LIKE '%' || lower('{SEARCH_TEXT}') || '%' "
                    f"AND section_name = '{SEARCH_SECTION}'", 20, 20),
        "articles_search_tag": _search_sql(d0, d1, f"AND list_contains(tags, '{SEARCH_TAG}')", 20, 0),
        "article_detail": _BASE + f"""SELECT guardian_id, web_title, web_url, section_id, section_name,
  pillar_name, {_iso('published_at')} AS published_at, array_to_string(tags, '|') AS tags, raw_payload
FROM articles_latest WHERE guardian_id = '{DETAIL_ID}' LIMIT 1""",
        **_more_oracles(),
    }


def _overview(start: str, end: str) -> str:
    return f"""SELECT COUNT(*) AS total_articles,
  COUNT(DISTINCT COALESCE(section_name, 'Unknown')) AS active_sections,
  {_iso('MAX(ingested_at)')} AS last_sync_at, {_iso('MAX(published_at)')} AS watermark,
  date_sub('minute', MAX(published_at), MAX(ingested_at)) AS freshness_lag_minutes
FROM articles_latest WHERE {_win(start, end)}"""


def _search_sql(start: str, end: str, where: str, limit: int, offset: int) -> str:
    return _BASE + f"""SELECT guardian_id, web_title, web_url, section_id, section_name, pillar_name,
  published_text AS published_at, array_to_string(tags, '|') AS tags
FROM (SELECT *, {_iso('published_at')} AS published_text FROM articles_latest
      WHERE {_win(start, end)} {where})
ORDER BY published_text DESC NULLS LAST, guardian_id ASC NULLS FIRST, web_title ASC NULLS FIRST
LIMIT {limit} OFFSET {offset}"""


def _summary_sql(search: str) -> str:
    """The served summary of found articles: empty text for a missing id, title or date."""
    return (search.replace("SELECT guardian_id, web_title,", "SELECT COALESCE(guardian_id, '') AS guardian_id, "
                           "COALESCE(web_title, '') AS web_title,", 1)
            .replace("published_text AS published_at,", "COALESCE(published_text, '') AS published_at,", 1))


# ------------------------------------------------------- more oracle SQL

_AS_OF_DAY = AS_OF_TS.strftime("%Y-%m-%d")
_AS_OF_ISO = AS_OF_TS.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _check_sql(name: str, observed: str, threshold: int, detail: str, source: str) -> str:
    return f"""SELECT '{name}' AS check_name, '{_AS_OF_DAY}' AS check_date, 'warning' AS severity,
  CASE WHEN {observed} <= {threshold} THEN 'pass' ELSE 'warn' END AS status,
  CAST({observed} AS VARCHAR) AS observed_value, '{threshold}' AS threshold,
  to_json(struct_pack(detail := '{detail}'))::VARCHAR AS details_json,
  '{_AS_OF_ISO}' AS created_at
FROM {source}"""


def _quality_sql(table: str) -> str:
    return (_check_sql("Missing section names", "COUNT(*) FILTER (WHERE section_name IS NULL OR section_name = '')",
                       0, "Section name should always be populated.", table)
            + "\nUNION ALL\n"
            + _check_sql("Missing publication date", "COUNT(*) FILTER (WHERE published_at IS NULL)",
                         0, "Published timestamp should always be available.", table))


# Landing pages built from events, as the validator sees them.
_LANDED = f"""landed AS (
  SELECT event_id, event_type, user_id, CAST(ts AS TIMESTAMP) AS ts, props,
    CAST(ts AS DATE) AS landing_day,
    event_id % 29 = 0 AS not_object,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 17 = 0 THEN ''
         ELSE 'article/' || CAST(event_id // 4 AS VARCHAR) END AS src_id,
    CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'not-a-date'
         ELSE 'ok' END AS src_date,
    {_SECTION} AS src_section, {_PILLAR} AS src_pillar, value
  FROM events),
elements AS (
  SELECT *, CASE WHEN not_object THEN 'not an object ' || event_id ELSE '{{' || concat_ws(',',
      '"id":"' || src_id || '"', '"type":"article"', '"webUrl":"https://example.org/u/' || user_id || '"',
      '"webTitle":"' || event_type || ' story ' || event_id || '"',
      '"sectionId":"' || lower(regexp_replace(src_section, '[^A-Za-z]', '', 'g')) || '"',
      '"sectionName":"' || src_section || '"', '"pillarId":"pillar/' || lower(src_pillar) || '"',
      '"pillarName":"' || src_pillar || '"',
      '"webPublicationDate":"' || CASE src_date WHEN 'ok' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') ELSE src_date END || '"',
      CASE WHEN event_id % 13 <> 0 THEN '"tags":[{{"webTitle":"' || event_type || '"}},{{"webTitle":""}},'
        || CASE WHEN event_id % 31 = 0 THEN '{{}}' ELSE '{{"webTitle":"k' || json_extract_string(props, '$.k') || '"}}' END || ']' END,
      '"fields":{{"score":' || value || '}}') || '}}' END AS element
  FROM landed),
pages AS (
  SELECT landing_day, event_id // 50 + 1 AS cut_page,
    arg_min(CASE WHEN not_object THEN '"' || element || '"' ELSE element END, event_id) AS first_element
  FROM elements GROUP BY 1, 2),
announced AS (SELECT landing_day, COUNT(*) AS n FROM pages GROUP BY 1),
validated AS (
  SELECT landing_day, NULL AS guardian_id, NULL AS web_url, NULL AS web_title, NULL AS section_id,
    NULL AS section_name, NULL AS pillar_id, NULL AS pillar_name, NULL AS published_at, '' AS tags,
    NULL AS api_response_page, 'unparseable_page' AS reject_reason,
    '{{"response": {{"status": "ok", "pages": ' || n || ', "currentPage": ' || cut_page || ', "results": ['
      || substr(first_element, 1, 10) AS raw_payload
  FROM pages JOIN announced USING (landing_day) WHERE cut_page % 7 = 3
  UNION ALL
  SELECT landing_day,
    CASE WHEN not_object THEN NULL ELSE src_id END AS guardian_id,
    CASE WHEN not_object THEN NULL ELSE 'https://example.org/u/' || CAST(user_id AS VARCHAR) END AS web_url,
    CASE WHEN not_object THEN NULL ELSE event_type || ' story ' || CAST(event_id AS VARCHAR) END AS web_title,
    CASE WHEN not_object THEN NULL ELSE lower(regexp_replace(src_section, '[^A-Za-z]', '', 'g')) END AS section_id,
    CASE WHEN not_object THEN NULL ELSE src_section END AS section_name,
    CASE WHEN not_object OR src_pillar IS NULL THEN NULL ELSE 'pillar/' || lower(src_pillar) END AS pillar_id,
    CASE WHEN not_object THEN NULL ELSE src_pillar END AS pillar_name,
    CASE WHEN not_object OR src_date IS NULL OR src_date <> 'ok' THEN NULL
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS published_at,
    CASE WHEN not_object OR event_id % 13 = 0 THEN ''
         WHEN event_id % 31 = 0 THEN event_type
         ELSE event_type || '|k' || json_extract_string(props, '$.k') END AS tags,
    event_id // 50 + 1 AS api_response_page,
    CASE WHEN not_object THEN 'not_a_dict'
         WHEN src_id IS NULL OR src_id = '' THEN 'missing_guardian_id'
         WHEN src_date IS NULL THEN 'missing_published_at'
         WHEN src_date <> 'ok' THEN 'unparseable_published_at' END AS reject_reason,
    element AS raw_payload
  FROM elements WHERE (event_id // 50 + 1) % 7 <> 3)"""

_RUN_RECORDS = """run_records AS (
  SELECT
    CASE WHEN user_id % 2 = 1 THEN 'manual__' ELSE 'scheduled__' END
      || strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S') AS dag_run_id,
    CASE WHEN user_id % 2 = 1 THEN 'guardian_backfill_range' ELSE 'guardian_ingest_recent' END AS dag_id,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
      WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'up_for_retry' END AS state,
    CASE WHEN event_id % 7 = 0 THEN NULL
         ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ') END AS start_date,
    CASE WHEN event_type IN ('purchase', 'error')
         THEN strftime(CAST(ts AS TIMESTAMP) + to_seconds(CAST(floor(value) AS BIGINT)),
                       '%Y-%m-%dT%H:%M:%S.%fZ') END AS end_date,
    strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%SZ') AS logical_date,
    CASE WHEN user_id % 2 = 1 AND event_id % 3 IN (0, 1)
         THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') END AS conf_start,
    CASE WHEN user_id % 2 = 1 AND event_id % 3 = 0
         THEN strftime(CAST(ts AS DATE) + 2, '%Y-%m-%d') END AS conf_end
  FROM events)"""


def _runs_sql(name: str, where: str) -> str:
    return f"""{name} AS (
  SELECT dag_run_id AS run_id, dag_id,
    CASE WHEN state IN ('success', 'failed', 'running', 'queued', 'scheduled') THEN state
         ELSE 'scheduled' END AS status,
    CASE WHEN dag_id = 'guardian_backfill_range' THEN 'manual' ELSE 'system' END AS trigger,
    try_cast(CASE WHEN start_date IS NOT NULL AND start_date <> '' THEN start_date ELSE logical_date END
             AS TIMESTAMP) AS started_at,
    try_cast(end_date AS TIMESTAMP) AS finished_at,
    CASE WHEN dag_id = 'guardian_backfill_range' THEN
           CASE WHEN conf_start <> '' AND conf_end <> '' THEN conf_start || ' to ' || conf_end
                ELSE 'manual backfill' END
         ELSE 'recent ingest' END AS "window",
    CAST(NULL AS VARCHAR) AS error_summary
  FROM run_records
  WHERE dag_id IN ('guardian_ingest_recent', 'guardian_backfill_range') AND {where})"""


def _latest_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT run_id, dag_id, status, trigger, started_at, finished_at, "window", error_summary FROM (
    SELECT *, CASE WHEN dag_id IS NOT NULL AND run_id IS NOT NULL THEN row_number() OVER (
      PARTITION BY dag_id, run_id ORDER BY started_at DESC NULLS LAST, finished_at DESC NULLS LAST,
      status DESC NULLS LAST, trigger DESC NULLS LAST, "window" DESC NULLS LAST,
      error_summary DESC NULLS LAST) ELSE 1 END AS rk
    FROM {source}) WHERE rk = 1)"""


# MERGE: matched target rows take the source's values, unmatched target rows
# stay, unmatched source rows are inserted.
_RUNS = f"""WITH {_RUN_RECORDS},
{_runs_sql('history_sync', f"logical_date < '{HISTORY_BEFORE}'")},
{_runs_sql('sync', f"logical_date >= '{SYNC_FROM}'")},
{_runs_sql('all_runs', 'TRUE')},
{_latest_sql('history', 'history_sync')},
{_latest_sql('sync_latest', 'sync')},
merged AS (
  SELECT s.* FROM history h JOIN sync_latest s ON s.dag_id = h.dag_id AND s.run_id = h.run_id
  UNION ALL SELECT * FROM history h WHERE NOT EXISTS (
    SELECT 1 FROM sync_latest s WHERE s.dag_id = h.dag_id AND s.run_id = h.run_id)
  UNION ALL SELECT * FROM sync_latest s WHERE NOT EXISTS (
    SELECT 1 FROM history h WHERE s.dag_id = h.dag_id AND s.run_id = h.run_id)),
failures AS (
  SELECT COUNT(*) FILTER (WHERE status = 'failed') AS recent_failures FROM (
    SELECT status FROM merged ORDER BY started_at DESC NULLS LAST, run_id DESC NULLS LAST LIMIT 50))
"""

_RUN_COLS = ("run_id, dag_id, status, trigger, " + _ts("started_at") + ", " + _ts("finished_at")
             + ', "window", error_summary')


def _py_iso(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN strftime({c}, '%f') = '000000' THEN '' ELSE '.' || strftime({c}, '%f') END"
            f" || '+00:00' END AS {c}")


def _page_sql(limit: int, offset: int) -> str:
    return _RUNS + f"""SELECT run_id, dag_id, status, trigger, {_ts('started_at')}, {_ts('finished_at')},
  "window" AS run_window, error_summary
FROM merged ORDER BY merged.started_at DESC NULLS LAST, run_id DESC NULLS LAST LIMIT {limit} OFFSET {offset}"""


def _more_oracles() -> dict[str, str]:
    f0, f1 = FULL
    d0, d1 = DEFAULT_WINDOW
    b0, b1 = BACKFILL
    kpis = f"""metrics AS ({_overview(f0, f1)}),
block AS (
  SELECT COALESCE(r.last_sync_at, 'No data') AS last_sync_at, COALESCE(r.watermark, 'No data') AS watermark,
    CASE WHEN r.freshness_lag_minutes IS NULL THEN 'No data'
         ELSE CAST(r.freshness_lag_minutes AS VARCHAR) || ' min' END AS lag
  FROM (SELECT arg_min(struct_pack(last_sync_at, watermark, freshness_lag_minutes), p) AS r FROM (
    SELECT {_iso('last_sync_at')} AS last_sync_at, {_iso('watermark')} AS watermark,
      freshness_lag_minutes, 0 AS p FROM content_freshness
    UNION ALL SELECT last_sync_at, watermark, freshness_lag_minutes, 1 FROM metrics)))"""
    return {
        "quality_results": _BASE + _quality_sql("articles_latest"),
        "quality_results_raw": _BASE + _quality_sql("articles_raw"),
        "quality_report": _BASE + f"""SELECT check_name AS name, status, observed_value, threshold,
  json_extract_string(details_json, '$.detail') AS detail FROM ({_quality_sql('articles_latest')})
ORDER BY name""",
        "duplicate_ids": _BASE + _check_sql(
            "Duplicate guardian IDs", "COUNT(*) FILTER (WHERE n > 1)", 1,
            "Each article id should be loaded once per ingest.",
            "(SELECT guardian_id, COUNT(*) AS n FROM articles_raw WHERE guardian_id IS NOT NULL GROUP BY guardian_id)"),
        "freshness_budget": _BASE + _check_sql(
            "Freshness lag", "MAX(freshness_lag_minutes)", 20,
            "Newest ingest should trail the newest article by the budget at most.", "content_freshness"),
        "reject_split": f"""WITH {_LANDED}
SELECT guardian_id, web_url, web_title, section_id, section_name, pillar_id, pillar_name, published_at,
  '2024-01-31T06:00:00.000000Z' AS ingested_at, tags, api_response_page, reject_reason, raw_payload,
  reject_reason IS NULL AS accepted FROM validated""",
        "reject_counts": f"""WITH {_LANDED}
SELECT reject_reason, COUNT(*) AS rows FROM validated GROUP BY reject_reason""",
        "backfill_report": f"""WITH {_LANDED},
days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '{b0}', DATE '{b1}' + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)),
counts AS (SELECT landing_day AS day, COUNT(*) FILTER (WHERE reject_reason IS NULL) AS loaded,
  COUNT(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected FROM validated GROUP BY landing_day)
SELECT strftime(days.day, '%Y-%m-%d') AS day, COALESCE(loaded, 0) AS loaded, COALESCE(rejected, 0) AS rejected
FROM days LEFT JOIN counts ON days.day = counts.day""",
        "raw_watermark": _BASE + f"SELECT {_ts('watermark')} FROM (SELECT MAX(ingested_at) AS watermark FROM articles_raw)",
        "run_normalise": _RUNS + f"SELECT {_RUN_COLS} FROM all_runs",
        "run_upsert": _RUNS + f"SELECT {_RUN_COLS} FROM merged",
        "pipeline_runs": _page_sql(10, 0),
        "pipeline_runs_page2": _page_sql(10, 10),
        "runs_serialised": _RUNS + f"""SELECT run_id, dag_id, status, trigger, {_py_iso('started_at')},
  {_py_iso('finished_at')}, CASE WHEN "window" IS NOT NULL AND "window" <> '' THEN "window" ELSE 'Unknown' END AS "window",
  error_summary
FROM (SELECT * FROM merged ORDER BY started_at DESC NULLS LAST, run_id DESC NULLS LAST LIMIT 25)""",
        "failed_run_feed": _RUNS + f"""SELECT 'dag_run_failed' AS event, run_id, dag_id, status, {_ts('started_at')},
  "window", error_summary FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dag_id ASC NULLS LAST,
    started_at DESC NULLS LAST) AS n
  FROM merged m WHERE status = 'failed' AND run_id IS NOT NULL AND run_id <> ''
    AND NOT EXISTS (SELECT 1 FROM history h WHERE h.status = 'failed' AND h.run_id = m.run_id))
WHERE n = 1""",
        "run_lookup": _RUNS + f"""SELECT {_RUN_COLS} FROM merged
WHERE run_id = '{LOOKUP_RUN}' AND dag_id = 'guardian_backfill_range'""",
        "failed_run_count": _RUNS + "SELECT recent_failures FROM failures",
        "overview_kpis": _RUNS.replace("WITH ", "WITH " + _RAW + ",\n" + _LATEST + ",\n" + _TAGS + ",\n"
                                       + _ROLLUPS + ",\n", 1).rstrip() + f""",
{kpis}
SELECT 1 AS position, 'Guardian articles' AS label, format('{{:,}}', COALESCE(total_articles, 0)) AS value,
  'Deduped warehouse' AS delta, 'neutral' AS tone FROM metrics
UNION ALL SELECT 2, 'Sections covered', CAST(COALESCE(active_sections, 0) AS VARCHAR), 'Current range', 'neutral' FROM metrics
UNION ALL SELECT 3, 'Freshness lag', lag, 'Current sync', 'neutral' FROM block
UNION ALL SELECT 4, 'Recent failures', CAST(recent_failures AS VARCHAR), 'Persisted run history', 'neutral' FROM failures""",
        "overview_freshness": _BASE.rstrip() + f""",
{kpis.replace(_overview(f0, f1), _overview(d0, d1))}
SELECT last_sync_at, watermark, lag FROM block""",
        "ops_status": _BASE + f"""SELECT COALESCE({_iso('last_sync_at')}, 'No data') AS last_sync_at,
  CASE WHEN freshness_lag_minutes IS NULL THEN 'No data'
       ELSE CAST(freshness_lag_minutes AS VARCHAR) || ' min' END AS freshness_lag,
  COALESCE({_iso('watermark')}, 'No data') AS watermark
FROM content_freshness""",
        "section_share": _BASE + f"""SELECT section, count, count / greatest(max(count) OVER (), 1) * 100 AS share FROM (
  SELECT section, CAST(SUM(article_count) AS BIGINT) AS count
  FROM section_counts_daily WHERE {_win(f0, f1)} GROUP BY section
  ORDER BY count DESC, section ASC NULLS FIRST LIMIT 4)""",
        "tag_rank": _BASE + f"""SELECT row_number() OVER (ORDER BY count DESC, tag ASC NULLS FIRST) AS rank,
  tag, count, 'Live' AS momentum FROM (
  SELECT tag, CAST(SUM(article_count) AS BIGINT) AS count
  FROM tag_counts_daily WHERE {_win(f0, f1)} GROUP BY tag
  ORDER BY count DESC, tag ASC NULLS FIRST LIMIT 8)""",
        "trailing_volume": _BASE + f"""SELECT * FROM (SELECT strftime(publication_date, '%Y-%m-%d') AS date,
  article_count AS value FROM daily_volume WHERE {_win(f0, f1)} ORDER BY date DESC LIMIT 6) ORDER BY date""",
        "trailing_sections": _BASE + f"""SELECT * FROM (SELECT strftime(publication_date, '%Y-%m-%d') AS date,
  world, politics, business, culture, climate, technology
  FROM section_daily WHERE {_win(f0, f1)} ORDER BY date DESC LIMIT 10) ORDER BY date""",
        "search_page_info": _BASE + f"""SELECT total, CAST(greatest(1, ceil(total / 20)) AS BIGINT) AS total_pages,
  CAST(2 AS BIGINT) AS current_page, 40 < total AS has_next, TRUE AS has_previous
FROM (SELECT COUNT(*) AS total FROM articles_latest WHERE {_win(f0, f1)}
  AND lower(web_title) LIKE '%' || lower('{SEARCH_TEXT}') || '%' AND section_name = '{SEARCH_SECTION}')""",
        "search_summaries": _summary_sql(_search_sql(d0, d1, f"AND list_contains(tags, '{SEARCH_TAG}')", 20, 40)),
    }
