"""QRY-1 … QRY-10 and the window/paging rules (quirks 2-6, 12, 21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from datetime import date

from conftest import raw_rows

from inkwell.functions.windows import range_label, resolve_window, validate_range
from inkwell.operators import rollups
from inkwell.operators.latest import articles_latest
from inkwell.plans import queries as q

import pytest


def test_default_window_is_twelve_days_inclusive():
    assert resolve_window(today=date(2026, 3, 12)) == (date(2026, 3, 1), date(2026, 3, 12))
    assert resolve_window("2026-02-01", "2026-02-05") == (date(2026, 2, 1), date(2026, 2, 5))
    assert range_label(*resolve_window(None, "2026-03-12")) == "2026-03-01 to 2026-03-12"


def test_backfill_range_validation():
    assert validate_range("2026-03-01", "2026-03-01")
    with pytest.raises(ValueError):
        validate_range("2026-03-02", "2026-03-01")
    with pytest.raises(ValueError):
        validate_range("03/01/2026", "2026-03-02")


def _articles(spark):
    rows = []
    for i in range(30):
        rows.append({
            "guardian_id": f"id{i:02d}", "web_title": f"Story {i} about 50% off_sale" if i % 5 == 0 else f"Story {i}",
            "section_name": ["World news", "Politics", "Sport"][i % 3],
            "published_at": f"2026-03-{1 + i % 10:02d} 10:00:00", "ingested_at": "2026-03-12 00:00:00",
            "tags": ["politics", "uk"] if i % 2 else ["sport"],
        })
    return articles_latest(raw_rows(spark, rows))


def test_reversed_window_is_empty_and_metrics_still_one_row(spark):
    latest = _articles(spark)
    m = q.overview_metrics(latest, "2026-03-10", "2026-03-01").collect()
    assert len(m) == 1 and m[0]["total_articles"] == 0 and m[0]["last_sync_at"] is None
    assert q.publishing_volume(rollups.daily_volume(latest), "2026-03-10", "2026-03-01").count() == 0


def test_top_sections_tie_break_by_name(spark):
    latest = _articles(spark)
    top = [tuple(r) for r in q.top_sections(rollups.section_counts_daily(latest), "2026-03-01", "2026-03-31").collect()]
    assert top == [("Politics", 10), ("Sport", 10), ("World news", 10)]


def test_top_tags_limit_and_momentum(spark):
    latest = _articles(spark)
    tags = q.top_tags(rollups.tag_counts_daily(rollups.article_tags(latest)), "2026-03-01", "2026-03-31", 2).collect()
    assert [(r["tag"], r["count"], r["momentum"]) for r in tags] == [("politics", 15, "Live"), ("sport", 15, "Live")]


def test_search_filters(spark):
    latest = _articles(spark)
    full = ("2026-03-01", "2026-03-31")
    assert q.search_filter(latest, *full).count() == 30                       # None → no filter
    assert q.search_filter(latest, *full, query_text="STORY 1").count() == 11  # case-insensitive
    assert q.search_filter(latest, *full, query_text="50%_off").count() == 6   # wildcards (quirk 4)
    assert q.search_filter(latest, *full, query_text="50%_off", literal=True).count() == 0
    assert q.search_filter(latest, *full, section="politics").count() == 0     # case-sensitive
    assert q.search_filter(latest, *full, section="Politics").count() == 10
    assert q.search_filter(latest, *full, tag="uk").count() == 15


def test_search_pages_never_overlap(spark):
    latest = _articles(spark)
    pages = [q.articles_search(latest, "2026-03-01", "2026-03-31", row_limit=7, row_offset=o).collect()
             for o in range(0, 35, 7)]
    ids = [r["guardian_id"] for p in pages for r in p]
    assert len(ids) == 30 and len(set(ids)) == 30
    texts = [r["published_at"] for r in pages[0]]
    assert texts == sorted(texts, reverse=True) and texts[0].endswith("Z")


def test_article_detail_found_and_missing(spark):
    latest = _articles(spark)
    assert q.article_detail(latest, "id03").first()["web_title"] == "Story 3"
    assert q.article_detail(latest, "nope").count() == 0


def test_pipeline_runs_order_and_offset(spark):
    from datetime import datetime

    runs = spark.createDataFrame(
        [(f"r{i}", "d", "success", "system", datetime(2026, 3, 1, i % 3), None, "w", None) for i in range(6)],
        "run_id string, dag_id string, status string, trigger string, started_at timestamp, "
        "finished_at timestamp, window string, error_summary string")
    got = [r["run_id"] for r in q.pipeline_runs(runs, 3, 0).collect()]
    assert got == ["r5", "r2", "r4"]
    assert [r["run_id"] for r in q.pipeline_runs(runs, 3, 3).collect()] == ["r1", "r3", "r0"]
    assert "run_window" in q.pipeline_runs(runs).columns


def test_search_backslash_is_a_plain_character(spark):
    latest = articles_latest(raw_rows(spark, [
        {"guardian_id": "1", "web_title": "A\\B", "published_at": "2026-03-01T10:00:00", "ingested_at": "2026-03-01T11:00:00"},
        {"guardian_id": "2", "web_title": "100\\", "published_at": "2026-03-01T10:00:00", "ingested_at": "2026-03-01T11:00:00"},
        {"guardian_id": "3", "web_title": "ÉCOLE a_b", "published_at": "2026-03-01T10:00:00", "ingested_at": "2026-03-01T11:00:00"}]))

    def found(text):
        return sorted(r["guardian_id"] for r in q.articles_search(latest, "2026-03-01", "2026-03-01", query_text=text).collect())

    assert found("a\\b") == ["1"]
    assert found("100\\") == ["2"]
    assert found("École") == ["3"]
    assert found("a_b") == ["1", "3"]


def test_document_titles_hold_the_whole_first_line(spark):
    from inkwell.sources.adapters import articles_from_documents

    docs = spark.createDataFrame([(0, "x" * 200 + " needle\nnext", "en", "web"), (4, None, "en", "web")],
                                 "doc_id long, text string, lang string, source string")
    titles = {r["guardian_id"]: r["web_title"] for r in articles_from_documents(docs).collect()}
    assert titles == {"doc/0": "x" * 200 + " needle ", "doc/4": " "}


def test_spans_make_up_any_window(spark):
    import random
    from datetime import date, timedelta

    from inkwell.operators import rollups

    rng, origin = random.Random(4), date(1969, 11, 3)
    for _ in range(300):
        start = origin + timedelta(days=rng.randint(0, 9000))
        end = start + timedelta(days=rng.choice([-1, 0, 1, 6, 30, 400, 6000]))
        days = [d for level, span in q.span_cover(start, end, 8) for d in range(span << level, (span + 1) << level)]
        first = (start - date(1970, 1, 1)).days
        assert sorted(days) == list(range(first, first + (end - start).days + 1))
        assert len(q.span_cover(start, end)) <= 26 or (end - start).days > 8000
    rows = [(origin + timedelta(days=rng.randint(0, 700)) if rng.random() < 0.98 else None, rng.choice("abcdef"), rng.randint(1, 9))
            for _ in range(3000)]
    daily = spark.createDataFrame(rows, "publication_date date, tag string, article_count long").groupBy(
        "publication_date", "tag").agg(F.sum("article_count").alias("article_count")).persist()
    spans = rollups.tag_span_counts(daily, 11).persist()
    read = lambda df: sorted(tuple(r) for r in df.collect())
    for length in (0, 12, 100, 365, 700):
        start = origin + timedelta(days=rng.randint(0, 300))
        w = start, start + timedelta(days=length)
        assert read(q.top_tags_of_spans(spans, *w, 4)) == read(q.top_tags(daily, *w, 4))
    # days that change, come and go: only spans around them are summed anew
    changed = [origin + timedelta(days=n) for n in (0, 5, 6, 300, 699, 1000)]
    new = spark.createDataFrame([(changed[0], "a", 100), (changed[2], "g", 1), (changed[5], "b", 7)], daily.schema)
    days = spark.createDataFrame([(d,) for d in changed] + [(None,)], "publication_date date")
    after = daily.join(days, "publication_date", "left_anti").unionByName(new)
    want = sorted(tuple(r) for r in rollups.tag_span_counts(after, 11).collect())
    assert read(rollups.patched_tag_spans(spans, new, days, 11).select("level", "span", "tag", "article_count")) == want
