"""Hot keys: one article id with a third of all raw rows, one day with a
third of all articles, one run key reported many times. Results stay whole
and exact; the plans bound what a hot key sends through the shuffle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.operators import rollups, runs as run_ops
from inkwell.operators.latest import articles_latest
from inkwell.schemas import ARTICLES_RAW


def _raw(spark, n=30_000):
    # rows 0..n/3 are versions of one live blog; the rest are distinct ids,
    # a third of which publish on one hot day
    base = spark.range(n).select(
        F.when(F.col("id") < n // 3, F.lit("live/blog")).otherwise(F.concat(F.lit("a/"), F.col("id").cast("string")))
        .alias("guardian_id"),
        F.lit("https://x").alias("web_url"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("web_title"),
        F.lit(None).cast("string").alias("section_id"),
        F.when(F.col("id") % 3 == 0, F.lit("World")).otherwise(F.lit("Sport")).alias("section_name"),
        F.lit(None).cast("string").alias("pillar_id"),
        F.lit(None).cast("string").alias("pillar_name"),
        F.when(F.col("id") % 3 == 1, F.lit("2026-03-01 10:00:00").cast("timestamp"))
        .otherwise(F.timestamp_add("DAY", F.col("id") % 90, F.lit("2026-01-01 00:00:00").cast("timestamp")))
        .alias("published_at"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2026-03-02 00:00:00").cast("timestamp")).alias("ingested_at"),
        F.array(F.lit("hot")).alias("tags"),
        (F.col("id") % 5).alias("api_response_page"),
        F.lit("{}").alias("raw_payload"),
    )
    return base.select(*ARTICLES_RAW.fieldNames())


def test_hot_article_key_keeps_its_newest_version(spark):
    n = 30_000
    latest = articles_latest(_raw(spark, n).repartition(16))
    assert latest.count() == 1 + (n - n // 3)
    blog = latest.filter(F.col("guardian_id") == "live/blog").collect()
    assert len(blog) == 1 and blog[0]["web_title"] == f"t{n // 3 - 1}"


def test_hot_day_rollups_are_exact(spark):
    n = 30_000
    latest = articles_latest(_raw(spark, n))
    vol = {str(r["publication_date"]): r["article_count"] for r in rollups.daily_volume(latest).collect()}
    assert sum(vol.values()) == latest.count()
    hot = latest.filter(F.col("publication_date") == F.lit("2026-03-01").cast("date")).count()
    assert vol["2026-03-01"] == hot and hot > latest.count() // 4
    tags = rollups.tag_counts_daily(rollups.article_tags(latest))
    assert tags.agg(F.sum("article_count")).first()[0] == latest.count()


def test_run_reported_many_times_dedups_to_one(spark):
    t0 = datetime(2026, 3, 1)
    rows = [("hot", "d", "running", "system", t0 + timedelta(seconds=i), None, "w", None) for i in range(5000)]
    rows += [(f"r{i}", "d", "success", "system", t0, None, "w", None) for i in range(100)]
    src = spark.createDataFrame(rows, "run_id string, dag_id string, status string, trigger string, "
                                      "started_at timestamp, finished_at timestamp, window string, error_summary string")
    out = run_ops.latest_per_key(src.repartition(8))
    assert out.count() == 101
    assert out.filter("run_id = 'hot'").first()["started_at"] == t0 + timedelta(seconds=4999)
