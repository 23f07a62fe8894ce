"""MAT-2 … MAT-7: rollups rebuilt from ``articles_latest``.

Each is one narrow projection plus a hash aggregate with partial (map-side)
aggregation, so the shuffle carries one row per group per map task; a date or
section holding a third of all articles shuffles no more than any other. The
inputs are read with column pruning: a rollup over publication_date and
section_name reads two columns of the partitioned table, never the payload.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.buckets import bucket_sums
from inkwell.functions.formats import lag_minutes, utc_literal


def article_tags(latest: DataFrame) -> DataFrame:
    """MAT-2: one row per (article, tag) via inner explode.

    Articles with no tags vanish; a tag repeated inside one article gives
    repeated rows (no distinct).
    """
    return latest.select(
        "guardian_id", "publication_date", "published_at", "section_name", "pillar_name",
        F.explode(F.coalesce("tags", F.array().cast("array<string>"))).alias("tag"),
    )


def daily_volume(latest: DataFrame) -> DataFrame:
    """MAT-3: articles per publication date (a null date keeps its group)."""
    return latest.groupBy("publication_date").agg(F.count(F.lit(1)).alias("article_count"))


def section_counts_daily(latest: DataFrame) -> DataFrame:
    """MAT-4: articles per date and section."""
    return latest.groupBy("publication_date", F.col("section_name").alias("section")).agg(
        F.count(F.lit(1)).alias("article_count"))


def section_daily(section_counts: DataFrame) -> DataFrame:
    """MAT-5: six overlapping topic buckets per date, from MAT-4.

    Every date present in MAT-4 gets a row, with zeros where nothing matched.
    """
    return section_counts.groupBy("publication_date").agg(
        *bucket_sums(F.col("section"), F.col("article_count")))


def tag_counts_daily(tags: DataFrame) -> DataFrame:
    """MAT-6: tag mentions per date and tag, from MAT-2."""
    return tags.groupBy("publication_date", "tag").agg(F.count(F.lit(1)).alias("article_count"))


# Spans of up to 2 ** 12 days, some eleven years.
SPAN_LEVELS = 13


def _day_number() -> Column:
    return F.datediff("publication_date", F.lit("1970-01-01").cast("date"))


def tag_span_counts(daily: DataFrame, levels: int = SPAN_LEVELS) -> DataFrame:
    """MAT-6 over spans of 1, 2, 4, … days: ``level``, ``span`` (day number >> level), tag and
    count. Undated tags are in no window and so in no span."""
    rows = daily.where("publication_date IS NOT NULL").select(
        _day_number().alias("day"), "tag", "article_count", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    return rows.groupBy("level", F.expr("shiftright(day, level)").alias("span"), "tag").agg(
        F.sum("article_count").cast("long").alias("article_count"))


def patched_tag_spans(spans: DataFrame, daily: DataFrame, changed: DataFrame, levels: int = SPAN_LEVELS) -> DataFrame:
    """``spans`` after the days ``changed`` (distinct ``publication_date``) have got the counts ``daily``.

    A span without a changed day stays. One with is the sum of the changed days'
    new counts and of the largest spans inside it without a changed day: two
    for each level and changed day at most, however many days it has.
    """
    touched = (changed.where("publication_date IS NOT NULL").select(
        _day_number().alias("day"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
        .select("level", F.expr("shiftright(day, level)").alias("span")).distinct())
    kept = spans.join(touched, ["level", "span"], "left_anti")
    parent = touched.select((F.col("level") - 1).alias("level"), F.explode(F.array(F.col("span") * 2, F.col("span") * 2 + 1)).alias("span"))
    inside = kept.join(parent, ["level", "span"], "left_semi").select("level", "span", "tag", "article_count")
    days = daily.where("publication_date IS NOT NULL").select(
        F.lit(-1).alias("level"), _day_number().alias("span"), "tag", "article_count")
    # a changed day counts in every level from 0 on, a span in every level above its own
    above = F.explode(F.when(F.col("level") < levels - 1, F.sequence(F.col("level") + 1, F.lit(levels - 1)))).alias("to")
    up = F.expr("shiftright(span, to - greatest(level, 0))").alias("span")
    anew = (inside.unionByName(days).select("*", above).select(F.col("to").alias("level"), up, "tag", "article_count")
            .groupBy("level", "span", "tag").agg(F.sum("article_count").cast("long").alias("article_count")))
    return kept.select(*anew.columns).unionByName(anew)


def article_day_stats(latest: DataFrame) -> DataFrame:
    """What MAT-7 needs to know of each date and section."""
    return latest.groupBy("publication_date", "section_name").agg(
        F.count(F.lit(1)).alias("article_count"),
        F.max("ingested_at").alias("last_ingested_at"),
        F.max("published_at").alias("last_published_at"))


def freshness_of(stats: DataFrame, refreshed_at: datetime | None = None) -> DataFrame:
    """MAT-7 from ``article_day_stats``: one row of global freshness figures.

    ``refreshed_at`` pins the stamp (tests, reruns); by default it is the
    query's current timestamp. An empty input still gives one row.
    """
    stamp = utc_literal(refreshed_at) if refreshed_at else F.current_timestamp()
    agg = stats.agg(
        F.coalesce(F.sum("article_count"), F.lit(0)).cast("long").alias("total_articles"),
        F.countDistinct("section_name").alias("active_sections"),
        F.max("last_ingested_at").alias("last_sync_at"),
        F.max("last_published_at").alias("watermark"),
    )
    return agg.select(
        "total_articles", "active_sections", "last_sync_at", "watermark",
        lag_minutes("last_sync_at", "watermark").alias("freshness_lag_minutes"),
        stamp.alias("refreshed_at"),
    )


def content_freshness(latest: DataFrame, refreshed_at: datetime | None = None) -> DataFrame:
    """MAT-7 from the articles."""
    return freshness_of(article_day_stats(latest), refreshed_at)
