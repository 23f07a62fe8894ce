"""QRY-1 … QRY-11: the parameterised reads over the warehouse tables.

Each function takes the table(s) it reads as DataFrames plus plain Python
arguments and returns a lazy DataFrame. Date windows are bound as literals
on ``publication_date``; over a table written with ``partitionBy`` they become
``PartitionFilters`` and the scan skips other days' files. Optional filters
that are ``None`` are never added to the plan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.formats import iso_day, iso_seconds, lag_minutes
from inkwell.operators.latest import UNKNOWN
from inkwell.operators.rollups import SPAN_LEVELS, article_day_stats

# Constant momentum of the tag list, sizes of the top lists.
TAG_MOMENTUM = "Live"
TOP_SECTIONS = 4
DEFAULT_TAG_LIMIT = 8
DEFAULT_SEARCH_LIMIT = 20
DEFAULT_RUN_LIMIT = 10


def in_window(start: date | str, end: date | str, column: str = "publication_date") -> Column:
    """``column BETWEEN DATE(start) AND DATE(end)``; reversed gives nothing."""
    return F.col(column).between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))


def overview_metrics(latest: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """QRY-1 over the articles: windowed count, distinct sections, last sync,
    watermark, lag."""
    return overview_metrics_of(article_day_stats(latest), start, end)


def overview_metrics_of(stats: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """QRY-1 over ``article_day_stats``: a few rows per day, no article is read."""
    agg = stats.filter(in_window(start, end)).agg(
        F.coalesce(F.sum("article_count"), F.lit(0)).cast("long").alias("total_articles"),
        F.countDistinct(F.coalesce("section_name", F.lit(UNKNOWN))).alias("active_sections"),
        F.max("last_ingested_at").alias("_last"),
        F.max("last_published_at").alias("_mark"),
    )
    return agg.select(
        "total_articles", "active_sections",
        iso_seconds("_last").alias("last_sync_at"),
        iso_seconds("_mark").alias("watermark"),
        lag_minutes("_last", "_mark").alias("freshness_lag_minutes"),
    )


def freshness(content_freshness: DataFrame) -> DataFrame:
    """QRY-2: the freshness row with ISO timestamps (not windowed)."""
    return content_freshness.select(
        "total_articles", "active_sections",
        iso_seconds("last_sync_at").alias("last_sync_at"),
        iso_seconds("watermark").alias("watermark"),
        "freshness_lag_minutes",
    ).limit(1)


def publishing_volume(daily_volume: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """QRY-3: date text and article count in the window, by date."""
    return (daily_volume.filter(in_window(start, end))
            .orderBy("publication_date")
            .select(iso_day("publication_date").alias("date"), F.col("article_count").alias("value")))


def sections_series(section_daily: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """QRY-4: the six topic buckets per date in the window, by date."""
    return (section_daily.filter(in_window(start, end))
            .orderBy("publication_date")
            .select(iso_day("publication_date").alias("date"),
                    "world", "politics", "business", "culture", "climate", "technology"))


def top_sections(section_counts: DataFrame, start: date | str, end: date | str,
                 k: int = TOP_SECTIONS) -> DataFrame:
    """QRY-5: sections by article count in the window, top ``k``.

    Ties go to the section name ascending so the list is stable.
    """
    return (section_counts.filter(in_window(start, end))
            .groupBy("section").agg(F.sum("article_count").cast("long").alias("count"))
            .orderBy(F.col("count").desc(), F.col("section").asc_nulls_first())
            .limit(k))


def top_tags(tag_counts: DataFrame, start: date | str, end: date | str,
             row_limit: int = DEFAULT_TAG_LIMIT) -> DataFrame:
    """QRY-6: tags by mentions in the window, top ``row_limit``, momentum 'Live'."""
    return _most_tags(tag_counts.filter(in_window(start, end)), row_limit)


def span_cover(start: date | str, end: date | str, levels: int = SPAN_LEVELS) -> list[tuple[int, int]]:
    """(level, span) of the fewest spans that make up a window: two a level at most,
    and as many of the highest level as it takes. A reversed window has none."""
    first = (date.fromisoformat(str(start)) - date(1970, 1, 1)).days
    after = (date.fromisoformat(str(end)) - date(1970, 1, 1)).days + 1
    out = []
    for level in range(levels):
        if first >= after:
            break
        if level == levels - 1:
            out += [(level, span) for span in range(first, after)]
            break
        if first & 1:
            out.append((level, first))
            first += 1
        if after & 1:
            after -= 1
            out.append((level, after))
        first, after = first >> 1, after >> 1
    return out


def top_tags_of_spans(spans: DataFrame, start: date | str, end: date | str, row_limit: int = DEFAULT_TAG_LIMIT) -> DataFrame:
    """QRY-6 from ``tag_span_counts``: a window of a year reads some sixteen spans
    instead of 365 days. The spans are literals, so the scan skips row groups."""
    by_level: dict[int, list[int]] = {}
    for level, span in span_cover(start, end):
        by_level.setdefault(level, []).append(span)
    where = F.lit(False)
    for level, found in by_level.items():
        where = where | ((F.col("level") == level) & F.col("span").isin(*found))
    return _most_tags(spans.filter(where), row_limit)


def _most_tags(counts: DataFrame, row_limit: int) -> DataFrame:
    return (counts.groupBy("tag").agg(F.sum("article_count").cast("long").alias("count"))
            .orderBy(F.col("count").desc(), F.col("tag").asc_nulls_first())
            .limit(row_limit)
            .select("tag", "count", F.lit(TAG_MOMENTUM).alias("momentum")))


def search_filter(latest: DataFrame, start: date | str, end: date | str, *,
                  query_text: str | None = None, section: str | None = None,
                  tag: str | None = None, literal: bool = False) -> DataFrame:
    """The WHERE clause of QRY-7, shared with the match count of RPT-8.

    ``query_text`` matches ``lower(web_title) LIKE '%' || lower(text) || '%'``
    so ``%`` and ``_`` act as wildcards; ``literal=True`` matches plain text.
    Section is exact and case-sensitive; tag is exact element membership.
    """
    df = latest.filter(in_window(start, end))
    if query_text is not None:
        title = F.lower(F.col("web_title"))
        needle = F.lower(F.lit(query_text))
        # a backslash in the text is a plain character, not an escape
        pattern = F.concat(F.lit("%"), F.replace(needle, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        df = df.filter(title.contains(needle) if literal else F.like(title, pattern))
    if section is not None:
        df = df.filter(F.col("section_name") == F.lit(section))
    if tag is not None:
        df = df.filter(F.array_contains("tags", F.lit(tag)))
    return df


def articles_search(latest: DataFrame, start: date | str, end: date | str, *,
                    query_text: str | None = None, section: str | None = None,
                    tag: str | None = None, row_limit: int = DEFAULT_SEARCH_LIMIT,
                    row_offset: int = 0, literal: bool = False) -> DataFrame:
    """QRY-7: newest first, one page of ``row_limit`` after ``row_offset``.

    Order is the second-precision ISO text descending (as the source orders by
    the formatted alias), then id and title ascending so pages never overlap.
    Plans as one ``TakeOrderedAndProject`` keeping offset+limit rows per task.
    """
    matched = search_filter(latest, start, end, query_text=query_text, section=section,
                            tag=tag, literal=literal)
    return search_rows(matched, row_limit, row_offset)


def search_rows(matched: DataFrame, row_limit: int, row_offset: int = 0) -> DataFrame:
    """The page of QRY-7 out of the matches."""
    page = (matched.select(
                "guardian_id", "web_title", "web_url", "section_id", "section_name",
                "pillar_name", iso_seconds("published_at").alias("published_at"), "tags")
            .orderBy(F.col("published_at").desc_nulls_last(), F.col("guardian_id").asc_nulls_first(),
                     F.col("web_title").asc_nulls_first()))
    if row_offset:
        page = page.offset(row_offset)
    return page.limit(row_limit)


def article_detail(latest: DataFrame, guardian_id: str) -> DataFrame:
    """QRY-8: one article by id including its raw payload (pushed-down equality)."""
    return (latest.filter(F.col("guardian_id") == F.lit(guardian_id))
            .select("guardian_id", "web_title", "web_url", "section_id", "section_name",
                    "pillar_name", iso_seconds("published_at").alias("published_at"), "tags",
                    "raw_payload")
            .limit(1))


def data_quality(results: DataFrame) -> DataFrame:
    """QRY-9: checks by name with the detail text pulled from the JSON."""
    return results.select(
        F.col("check_name").alias("name"), "status", "observed_value", "threshold",
        F.get_json_object("details_json", "$.detail").alias("detail"),
    ).orderBy("name")


def pipeline_runs(runs: DataFrame, row_limit: int = DEFAULT_RUN_LIMIT, row_offset: int = 0) -> DataFrame:
    """QRY-10: runs newest first (started_at desc, run_id desc), one page."""
    page = runs.select(
        "run_id", "dag_id", "status", "trigger", "started_at", "finished_at",
        F.col("window").alias("run_window"), "error_summary",
    ).orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc_nulls_last())
    if row_offset:
        page = page.offset(row_offset)
    return page.limit(row_limit)


def max_ingested(raw: DataFrame) -> DataFrame:
    """QRY-11 / SRC-9: ``MAX(ingested_at)`` of raw; one row, null when empty."""
    return raw.agg(F.max("ingested_at").alias("watermark"))
