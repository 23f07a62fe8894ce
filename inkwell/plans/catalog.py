"""The warehouse tables as one object: derived lazily, or read from the lake.

``Tables.derived`` builds every table as a lazy plan over raw rows (used by
the registered queries: nothing is written, Catalyst sees the whole chain).
``Tables.from_lake`` reads the written versions (used by the reports: the read
queries then prune date partitions on disk); its ``raw`` is empty, since no
report reads raw rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from inkwell.config import ANALYTICS, Lake, configure
from inkwell.operators import rollups
from inkwell.operators.latest import articles_latest
from inkwell.schemas import ARTICLES_RAW
from inkwell.sources import adapters


TABLES = ("articles_latest", "article_tags", "daily_volume", "section_counts_daily", "section_daily",
          "tag_counts_daily", "content_freshness")


@dataclass
class Tables:
    raw: DataFrame
    refreshed_at: datetime | None = None
    stored: dict[str, DataFrame] | None = None

    def _get(self, name: str, build):
        if self.stored and name in self.stored:
            return self.stored[name]
        return build()

    @cached_property
    def articles_latest(self) -> DataFrame:
        return self._get("articles_latest", lambda: articles_latest(self.raw))

    @cached_property
    def article_tags(self) -> DataFrame:
        return self._get("article_tags", lambda: rollups.article_tags(self.articles_latest))

    @cached_property
    def daily_volume(self) -> DataFrame:
        return self._get("daily_volume", lambda: rollups.daily_volume(self.articles_latest))

    @cached_property
    def section_counts_daily(self) -> DataFrame:
        return self._get("section_counts_daily",
                         lambda: rollups.section_counts_daily(self.articles_latest))

    @cached_property
    def section_daily(self) -> DataFrame:
        return self._get("section_daily", lambda: rollups.section_daily(self.section_counts_daily))

    @cached_property
    def tag_counts_daily(self) -> DataFrame:
        return self._get("tag_counts_daily", lambda: rollups.tag_counts_daily(self.article_tags))

    @cached_property
    def tag_span_counts(self) -> DataFrame:
        return self._get("tag_span_counts", lambda: rollups.tag_span_counts(self.tag_counts_daily))

    @property
    def has_spans(self) -> bool:
        """Whether the spans are stored; working them out costs more than reading days."""
        return bool(self.stored) and "tag_span_counts" in self.stored

    @cached_property
    def article_day_stats(self) -> DataFrame:
        return self._get("article_day_stats", lambda: rollups.article_day_stats(self.articles_latest))

    @cached_property
    def content_freshness(self) -> DataFrame:
        return self._get("content_freshness",
                         lambda: rollups.content_freshness(self.articles_latest, self.refreshed_at))

    @classmethod
    def derived(cls, spark: SparkSession, sf_dir: str, refreshed_at: datetime | None = None) -> Tables:
        configure(spark)
        return cls(raw=adapters.articles_raw(spark, sf_dir), refreshed_at=refreshed_at)

    @classmethod
    def from_lake(cls, spark: SparkSession, lake: Lake) -> Tables:
        from inkwell.sources.store import TableStore

        configure(spark)
        store = TableStore(spark, lake)
        # an absent table reads as empty: a read never becomes a rebuild, and
        # raw is not listed at all
        empty = cls(raw=spark.createDataFrame([], ARTICLES_RAW))
        stored = {name: store.read(ANALYTICS, name) if store.exists(ANALYTICS, name) else getattr(empty, name).limit(0)
                  for name in TABLES}
        for name in ("article_day_stats", "tag_span_counts"):  # else from the articles
            if store.exists(ANALYTICS, name):
                stored[name] = store.read(ANALYTICS, name)
        return cls(raw=empty.raw, stored=stored)
