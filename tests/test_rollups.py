"""MAT-2 … MAT-7 semantics (quirks 7, 10, 13, 20, 21)."""

from __future__ import annotations

from datetime import date

from conftest import raw_rows

from inkwell.operators import rollups
from inkwell.operators.latest import articles_latest


def _latest(spark, rows):
    return articles_latest(raw_rows(spark, rows))


def _row(i, **kw):
    base = {"guardian_id": f"id{i}", "web_title": f"t{i}", "published_at": "2026-03-01 10:00:00",
            "ingested_at": "2026-03-01 10:30:00"}
    base.update(kw)
    return base


def test_article_tags_inner_explode_and_repeats(spark):
    latest = _latest(spark, [_row(1, tags=["x", "x", "y"]), _row(2, tags=None), _row(3, tags=[])])
    tags = sorted((r["guardian_id"], r["tag"]) for r in rollups.article_tags(latest).collect())
    assert tags == [("id1", "x"), ("id1", "x"), ("id1", "y")]
    counts = {r["tag"]: r["article_count"] for r in rollups.tag_counts_daily(rollups.article_tags(latest)).collect()}
    assert counts == {"x": 2, "y": 1}


def test_daily_volume_keeps_null_date_group(spark):
    latest = _latest(spark, [_row(1), _row(2), _row(3, published_at=None)])
    got = {r["publication_date"]: r["article_count"] for r in rollups.daily_volume(latest).collect()}
    assert got == {date(2026, 3, 1): 2, None: 1}


def test_section_buckets_overlap_and_unmatched_dates_get_zero_rows(spark):
    rows = [_row(1, section_name="World news"), _row(2, section_name="Party politics"),
            _row(3, section_name="Digital art"), _row(4, section_name="Sport"),
            _row(5, section_name="Football", published_at="2026-03-02 09:00:00")]
    sc = rollups.section_counts_daily(_latest(spark, rows))
    got = {str(r["publication_date"]): r.asDict() for r in rollups.section_daily(sc).collect()}
    day1 = got["2026-03-01"]
    assert (day1["world"], day1["politics"], day1["culture"], day1["technology"]) == (1, 1, 2, 1)
    assert day1["business"] == 0 and day1["climate"] == 0
    assert all(got["2026-03-02"][k] == 0 for k in ("world", "politics", "business", "culture", "climate",
                                                     "technology"))


def test_content_freshness_lag_truncates_toward_zero(spark):
    plus = _latest(spark, [_row(1, published_at="2026-03-01 10:00:00", ingested_at="2026-03-01 10:04:20")])
    minus = _latest(spark, [_row(1, published_at="2026-03-01 10:04:20", ingested_at="2026-03-01 10:00:00")])
    assert rollups.content_freshness(plus).first()["freshness_lag_minutes"] == 4
    assert rollups.content_freshness(minus).first()["freshness_lag_minutes"] == -4


def test_content_freshness_of_empty_table_is_one_row(spark):
    empty = _latest(spark, []).limit(0)
    r = rollups.content_freshness(empty).collect()
    assert len(r) == 1 and r[0]["total_articles"] == 0 and r[0]["last_sync_at"] is None
