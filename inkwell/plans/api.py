"""The reference's API surface as Python methods over a lake.

One method per route, with the same arguments and defaults; each returns
DataFrames (or a dict of them) instead of a JSON response, so callers keep
the work on Spark and collect only what they show. No server.
"""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession

from inkwell.config import OPS, Lake, Settings, configure
from inkwell.functions.windows import validate_range
from inkwell.operators import runs as run_ops
from inkwell.plans import ingest, ops, refresh, reports, titles
from inkwell.plans import queries as q
from inkwell.plans.catalog import Tables
from inkwell.schemas import DATA_QUALITY_RESULTS
from inkwell.sources.store import TableStore


class Warehouse:
    def __init__(self, spark: SparkSession, lake: Lake, settings: Settings = Settings(),
                 today: date | None = None):
        self.spark = configure(spark)
        self.lake = lake
        self.settings = settings
        self.today = today

    @property
    def tables(self) -> Tables:
        return Tables.from_lake(self.spark, self.lake)

    def _window(self, from_date, to_date) -> reports.DateWindow:
        return reports.window(from_date, to_date, settings=self.settings, today=self.today)

    def _runs(self, newest: int) -> DataFrame:
        ops.ensure_base_tables(self.spark, self.lake)
        return ops.newest_runs(self.spark, self.lake, newest)

    # ------------------------------------------------------------ analytics
    def overview(self, from_date=None, to_date=None) -> dict:
        return reports.overview(self.tables, self._runs(self.settings.overview_run_sample),
                                self._window(from_date, to_date), self.settings)

    def sections(self, from_date=None, to_date=None) -> dict:
        return reports.sections_report(self.tables, self._window(from_date, to_date))

    def tags(self, from_date=None, to_date=None, limit: int = q.DEFAULT_TAG_LIMIT) -> dict:
        return reports.tags_report(self.tables, self._window(from_date, to_date), limit)

    def articles(self, from_date=None, to_date=None, q_text: str | None = None, section: str | None = None,
                 tag: str | None = None, limit: int = q.DEFAULT_SEARCH_LIMIT, offset: int = 0) -> dict:
        """A page of matches and their number. Title postings name the days to look at."""
        w = self._window(from_date, to_date)
        latest = titles.narrowed(TableStore(self.spark, self.lake), lambda: self.tables.articles_latest, w.start, w.end, q_text)
        return reports.search_page(latest, w, query_text=q_text, section=section, tag=tag, limit=limit, offset=offset)

    def article(self, guardian_id: str) -> DataFrame:
        """One article or no rows (not found). The key index names the days to look at."""
        latest = self.tables.articles_latest
        days = refresh.article_days(TableStore(self.spark, self.lake), guardian_id)
        return reports.article_report(latest if days is None else latest.filter(refresh.in_dates(days)), guardian_id)

    def publishing_volume(self, from_date=None, to_date=None, granularity: str = "day") -> dict:
        return reports.volume_report(self.tables, self._window(from_date, to_date), granularity)

    # ------------------------------------------------------------------ ops
    def status(self) -> dict:
        ops.ensure_base_tables(self.spark, self.lake)
        checks = TableStore(self.spark, self.lake).read(OPS, ops.QUALITY_TABLE, schema=DATA_QUALITY_RESULTS)
        return reports.ops_status(self.tables, checks)

    def runs(self, limit: int = q.DEFAULT_RUN_LIMIT, offset: int = 0) -> DataFrame:
        return run_ops.serialize_runs(q.pipeline_runs(self._runs(limit + offset), limit, offset))

    def backfill(self, landing_dir: str, start_date: str, end_date: str) -> dict:
        """Records the run as queued, loads the range (checked first) and records
        how it ended. Returns the load's report with the ``run_id``."""
        validate_range(start_date, end_date)
        run_id = f"manual__{datetime.now(UTC).isoformat()}"

        def record(state: str, ended: str | None = None) -> None:
            ops.sync_pipeline_runs(self.spark, self.lake, run_ops.backfill_record(
                self.spark, run_id, self.settings.backfill_dag_id, state, start_date, end_date, ended), settings=self.settings)

        record("queued")
        try:
            report = ingest.run_backfill(self.spark, self.lake, landing_dir, start_date, end_date)
        except Exception:
            record("failed", datetime.now(UTC).isoformat())
            raise
        record("success", datetime.now(UTC).isoformat())
        return {**report, "run_id": run_id}

    def backfill_status(self, run_id: str) -> DataFrame:
        ops.ensure_base_tables(self.spark, self.lake)
        return run_ops.serialize_runs(ops.find_run(self.spark, self.lake, run_id, self.settings.backfill_dag_id))
