"""RPT-1 … RPT-16: the user-facing results composed from the read queries.

Every report is a set of small DataFrames built from the QRY plans; the one-
row figures are combined with unions and global aggregates (never a cross
join), and the UI's derived numbers (share of the leader, rank, trailing
points, page maths) are columns computed on Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkwell.config import Settings
from inkwell.functions.formats import NO_DATA, minutes_label, thousands
from inkwell.functions.windows import range_label, resolve_window
from inkwell.operators import runs as run_ops
from inkwell.plans import queries as q
from inkwell.plans.catalog import Tables

# KPI labels and notes, in display order.
KPI_ARTICLES = ("Guardian articles", "Deduped warehouse")
KPI_SECTIONS = ("Sections covered", "Current range")
KPI_LAG = ("Freshness lag", "Current sync")
KPI_FAILURES = ("Recent failures", "Persisted run history")
TONE = "neutral"
TRAILING_VOLUME_POINTS = 6
TRAILING_SECTION_POINTS = 10


@dataclass(frozen=True)
class DateWindow:
    start: date
    end: date

    @property
    def label(self) -> str:
        return range_label(self.start, self.end)


def window(from_date=None, to_date=None, *, settings: Settings = Settings(),
           today: date | None = None) -> DateWindow:
    """RPT-1 / RPT-2."""
    start, end = resolve_window(from_date, to_date, default_days=settings.default_window_days, today=today)
    return DateWindow(start, end)


def freshness_block(freshness: DataFrame, metrics: DataFrame) -> DataFrame:
    """RPT-4: the freshness row when that table has one, else the windowed
    metrics; null fields read ``No data``. One row."""
    cols = ("last_sync_at", "watermark", "freshness_lag_minutes")
    both = (freshness.select(*cols, F.lit(0).alias("_p"))
            .unionByName(metrics.select(*cols, F.lit(1).alias("_p"))))
    pick = both.agg(F.min_by(F.struct(*cols), F.col("_p")).alias("r")).select("r.*")
    return pick.select(
        F.coalesce("last_sync_at", F.lit(NO_DATA)).alias("last_sync_at"),
        F.coalesce("watermark", F.lit(NO_DATA)).alias("watermark"),
        minutes_label("freshness_lag_minutes").alias("lag"),
    )


def overview_kpis(metrics: DataFrame, freshness: DataFrame, recent_failures: DataFrame) -> DataFrame:
    """RPT-3: four KPI rows (position, label, value, delta, tone).

    The windowed metrics, the freshness row and the failure count are
    unioned and folded by one global aggregate: each source is evaluated
    once, with no cross join; the lag comes from the freshness row when
    there is one, else from the metrics (RPT-4's rule). ``inline`` then
    turns the single row into the four KPIs.
    """
    none = F.lit(None)
    cols = ("_p", "total_articles", "active_sections", "freshness_lag_minutes", "recent_failures")
    rows = (
        freshness.select(F.lit(0).alias("_p"), none.cast("long").alias("total_articles"),
                         none.cast("long").alias("active_sections"), "freshness_lag_minutes",
                         none.cast("long").alias("recent_failures"))
        .unionByName(metrics.select(F.lit(1).alias("_p"), "total_articles", "active_sections",
                                    "freshness_lag_minutes", none.cast("long").alias("recent_failures")))
        .unionByName(recent_failures.select(none.cast("int").alias("_p"), none.cast("long").alias("total_articles"),
                                            none.cast("long").alias("active_sections"),
                                            none.cast("long").alias("freshness_lag_minutes"),
                                            F.col("recent_failures").cast("long")))
        .select(*cols)
    )
    one = rows.agg(
        F.max("total_articles").alias("total"), F.max("active_sections").alias("sections"),
        F.min_by(F.struct("freshness_lag_minutes"), "_p").getField("freshness_lag_minutes").alias("lag"),
        F.max("recent_failures").alias("failures"))

    def kpi(position: int, label_note: tuple[str, str], value) -> Column:
        label, note = label_note
        return F.struct(F.lit(position).alias("position"), F.lit(label).alias("label"), value.alias("value"),
                        F.lit(note).alias("delta"), F.lit(TONE).alias("tone"))

    return one.select(F.inline(F.array(
        kpi(1, KPI_ARTICLES, thousands(F.coalesce("total", F.lit(0)))),
        kpi(2, KPI_SECTIONS, F.coalesce("sections", F.lit(0)).cast("string")),
        kpi(3, KPI_LAG, minutes_label("lag")),
        kpi(4, KPI_FAILURES, F.coalesce("failures", F.lit(0)).cast("string")),
    )))


def overview(t: Tables, runs: DataFrame, w: DateWindow, settings: Settings = Settings()) -> dict:
    """RPT-5: range, KPIs, daily volume, freshness block, top sections."""
    metrics = q.overview_metrics_of(t.article_day_stats, w.start, w.end)
    fresh = q.freshness(t.content_freshness)
    failures = run_ops.failed_in_latest(runs, settings.overview_run_sample)
    return {
        "range": w.label,
        "kpis": overview_kpis(metrics, fresh, failures),
        "freshness": freshness_block(fresh, metrics),
        "daily_volume": q.publishing_volume(t.daily_volume, w.start, w.end),
        "top_sections": q.top_sections(t.section_counts_daily, w.start, w.end),
    }


def sections_report(t: Tables, w: DateWindow) -> dict:
    """RPT-6: topic series and section leaders."""
    return {"range": w.label,
            "series": q.sections_series(t.section_daily, w.start, w.end),
            "leaders": q.top_sections(t.section_counts_daily, w.start, w.end)}


def tags_report(t: Tables, w: DateWindow, limit: int = q.DEFAULT_TAG_LIMIT) -> dict:
    """RPT-7: top tags with momentum (default 'Live')."""
    tags = (q.top_tags_of_spans(t.tag_span_counts, w.start, w.end, limit) if t.has_spans
            else q.top_tags(t.tag_counts_daily, w.start, w.end, limit))
    return {"range": w.label,
            "tags": tags.withColumn("momentum", F.coalesce("momentum", F.lit(q.TAG_MOMENTUM)))}


def _summary() -> list:
    """Columns of an article as served: empty text for a missing id, title or
    date, an empty list for missing tags."""
    return [F.coalesce("guardian_id", F.lit("")).alias("guardian_id"),
            F.coalesce("web_title", F.lit("")).alias("web_title"),
            F.col("web_url"), F.col("section_id"), F.col("section_name"), F.col("pillar_name"),
            F.coalesce("published_at", F.lit("")).alias("published_at"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags")]


def article_report(latest: DataFrame, guardian_id: str) -> DataFrame:
    """One article as served, with its raw payload, or no rows (not found)."""
    return q.article_detail(latest, guardian_id).select(*_summary(), "raw_payload")


def search_page(latest: DataFrame, w: DateWindow, *, query_text=None, section=None, tag=None,
                limit: int = q.DEFAULT_SEARCH_LIMIT, offset: int = 0, literal: bool = False) -> dict:
    """RPT-8: one page of article summaries plus the number of matches.

    Summary defaults: empty strings for a missing id, title or date, and an
    empty tag list. The total counts all matches (for paging), not the page.

    One scan gives both: the top-k of the page reads every match, and an
    ``Observation`` on the matches counts them on the way. The job runs here;
    what it returns is a page of ``limit`` rows at most and one number.
    """
    spark, matches = latest.sparkSession, Observation("matches")
    matched = q.search_filter(latest, w.start, w.end, query_text=query_text, section=section, tag=tag, literal=literal)
    # at least one row: the optimizer would skip the scan of an empty page
    page = q.search_rows(matched.observe(matches, F.count(F.lit(1)).alias("total")), max(limit, 1), offset).select(*_summary())
    articles = spark.createDataFrame(page.collect()[:limit], page.schema)
    total = spark.createDataFrame([(int(matches.get["total"]),)], "total long")
    return {"range": w.label, "query": query_text, "section": section, "tag": tag,
            "articles": articles, "total": total,
            "paging": page_info(total, offset, limit)}


def volume_report(t: Tables, w: DateWindow, granularity: str = "day") -> dict:
    """RPT-9: the publishing volume with the granularity echoed (quirk 11:
    'hour' still returns days, as the source does)."""
    return {"range": w.label, "granularity": granularity,
            "series": q.publishing_volume(t.daily_volume, w.start, w.end)}


def ops_status(t: Tables, quality_results: DataFrame) -> dict:
    """RPT-10: freshness strings and the quality checks."""
    fresh = q.freshness(t.content_freshness)
    empty = fresh.sparkSession.createDataFrame(
        [], "last_sync_at string, watermark string, freshness_lag_minutes bigint")
    block = freshness_block(fresh, empty).select(
        "last_sync_at", F.col("lag").alias("freshness_lag"), "watermark")
    return {"status": block, "checks": q.data_quality(quality_results)}


def section_share(top_sections: DataFrame) -> DataFrame:
    """RPT-13: each leader's count as a percentage of the largest (≥ 1).

    The window spans the top-k result only (at most k rows).
    """
    top = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    return top_sections.select("section", "count", (F.col("count") / top * 100).alias("share"))


def tag_rank(tags: DataFrame) -> DataFrame:
    """RPT-14: position 1…N in the tag list (count desc, tag asc)."""
    w = Window.partitionBy().orderBy(F.col("count").desc(), F.col("tag").asc_nulls_first())
    return tags.select(F.row_number().over(w).alias("rank"), "tag", "count", "momentum")


def trailing_points(series: DataFrame, n: int) -> DataFrame:
    """RPT-15: the last ``n`` points of a date series, ascending."""
    return series.orderBy(F.col("date").desc()).limit(n).orderBy("date")


def page_info(total: DataFrame, offset: int, page_size: int = 20) -> DataFrame:
    """RPT-16: pages = max(1, ceil(total/size)); current = offset/size + 1;
    has_next = offset + size < total; has_previous = offset > 0."""
    n, page_size = F.col("total"), max(page_size, 1)
    return total.select(
        "total",
        F.greatest(F.lit(1), F.ceil(n / F.lit(page_size))).cast("long").alias("total_pages"),
        F.lit(offset // page_size + 1).cast("long").alias("current_page"),
        (F.lit(offset + page_size) < n).alias("has_next"),
        F.lit(offset > 0).alias("has_previous"),
    )
