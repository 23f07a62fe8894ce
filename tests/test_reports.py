"""RPT-1 … RPT-16 composed results."""

from __future__ import annotations

from datetime import date, datetime

from conftest import SF_SMALL, raw_rows

from inkwell.operators import rollups
from inkwell.operators.latest import articles_latest
from inkwell.plans import queries as q
from inkwell.plans import reports
from inkwell.plans.catalog import Tables
from inkwell.schemas import PIPELINE_RUNS


def _runs(spark, n_failed=2):
    rows = [(f"r{i}", "guardian_ingest_recent", "failed" if i < n_failed else "success", "system",
             datetime(2026, 3, 1, i), None, "recent ingest", None) for i in range(5)]
    return spark.createDataFrame(rows, PIPELINE_RUNS)


def test_window_and_label():
    w = reports.window(today=date(2026, 3, 12))
    assert w.label == "2026-03-01 to 2026-03-12"


def test_overview_kpis_and_freshness_block(spark):
    t = Tables.derived(spark, SF_SMALL, refreshed_at=datetime(2024, 2, 1))
    ov = reports.overview(t, _runs(spark), reports.window("2024-01-01", "2024-01-31"))
    kpis = [tuple(r) for r in ov["kpis"].orderBy("position").collect()]
    total = t.articles_latest.count()
    assert kpis[0] == (1, "Guardian articles", f"{total:,}", "Deduped warehouse", "neutral")
    assert kpis[1][1:3] == ("Sections covered", "11")
    assert kpis[2][2].endswith(" min")
    assert kpis[3][1:3] == ("Recent failures", "2")
    block = ov["freshness"].first()
    assert block["last_sync_at"].endswith("Z") and block["lag"].endswith(" min")


def test_freshness_falls_back_to_metrics_then_no_data(spark):
    metrics = spark.createDataFrame([("2026-03-12T10:00:00Z", "2026-03-12T09:00:00Z", 60)],
                                    "last_sync_at string, watermark string, freshness_lag_minutes bigint")
    empty = metrics.limit(0)
    assert tuple(reports.freshness_block(empty, metrics).first()) == ("2026-03-12T10:00:00Z", "2026-03-12T09:00:00Z", "60 min")
    null_row = spark.createDataFrame([(None, None, None)], metrics.schema)
    assert tuple(reports.freshness_block(null_row, metrics).first()) == ("No data", "No data", "No data")


def _latest(spark):
    rows = [{"guardian_id": f"id{i}", "web_title": f"T{i}", "section_name": ["A", "B", "C", "D", "E"][i % 5],
             "published_at": f"2026-03-{1 + i % 12:02d} 08:00:00", "ingested_at": "2026-03-12 09:00:00",
             "tags": [f"tag{i % 4}"]} for i in range(45)]
    return articles_latest(raw_rows(spark, rows))


def test_share_rank_trailing_and_paging(spark):
    latest = _latest(spark)
    top = q.top_sections(rollups.section_counts_daily(latest), "2026-03-01", "2026-03-31")
    share = {r["section"]: r["share"] for r in reports.section_share(top).collect()}
    assert share["A"] == 100.0 and len(share) == 4
    tags = q.top_tags(rollups.tag_counts_daily(rollups.article_tags(latest)), "2026-03-01", "2026-03-31")
    ranks = [(r["rank"], r["tag"]) for r in reports.tag_rank(tags).collect()]
    assert ranks[0] == (1, "tag0") and [r for r, _ in ranks] == list(range(1, len(ranks) + 1))
    vol = q.publishing_volume(rollups.daily_volume(latest), "2026-03-01", "2026-03-31")
    assert [r["date"] for r in reports.trailing_points(vol, 6).collect()] == \
        [f"2026-03-{d:02d}" for d in range(7, 13)]
    page = reports.search_page(latest, reports.window("2026-03-01", "2026-03-31"), limit=20, offset=40)
    info = page["paging"].first()
    assert (info["total"], info["total_pages"], info["current_page"], info["has_next"]) == (45, 3, 3, False)
    assert page["articles"].count() == 5


def test_volume_echoes_granularity_and_tags_momentum(spark):
    t = Tables.derived(spark, SF_SMALL)
    w = reports.window("2024-01-01", "2024-01-31")
    assert reports.volume_report(t, w, "hour")["granularity"] == "hour"
    assert {r["momentum"] for r in reports.tags_report(t, w)["tags"].collect()} == {"Live"}
    assert reports.sections_report(t, w)["leaders"].count() == 4


def test_report_shapes_match_the_api_fixtures(spark):
    """Column names and types of FIXTURES.md §3 (the API response blocks)."""
    from inkwell.operators import quality

    t = Tables.derived(spark, SF_SMALL)
    w = reports.window("2024-01-01", "2024-01-31")
    shape = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    assert shape(reports.volume_report(t, w)["series"]) == [("date", "string"), ("value", "bigint")]
    assert shape(reports.sections_report(t, w)["series"]) == [("date", "string")] + [
        (c, "bigint") for c in ("world", "politics", "business", "culture", "climate", "technology")]
    assert shape(reports.sections_report(t, w)["leaders"]) == [("section", "string"), ("count", "bigint")]
    assert shape(reports.tags_report(t, w)["tags"]) == [("tag", "string"), ("count", "bigint"),
                                                        ("momentum", "string")]
    runs = spark.createDataFrame([], PIPELINE_RUNS)
    assert shape(reports.overview(t, runs, w)["kpis"])[1:] == [("label", "string"), ("value", "string"),
                                                               ("delta", "string"), ("tone", "string")]
    assert shape(q.freshness(t.content_freshness)) == [
        ("total_articles", "bigint"), ("active_sections", "bigint"), ("last_sync_at", "string"),
        ("watermark", "string"), ("freshness_lag_minutes", "bigint")]
    checks = reports.ops_status(t, quality.quality_results(t.articles_latest))["checks"]
    assert [n for n, _ in shape(checks)] == ["name", "status", "observed_value", "threshold", "detail"]
    summaries = reports.search_page(t.articles_latest, w)["articles"]
    assert [n for n, _ in shape(summaries)] == ["guardian_id", "web_title", "web_url", "section_id",
                                                "section_name", "pillar_name", "published_at", "tags"]


def test_search_page_scans_once_and_counts_all(spark):
    from conftest import raw_rows

    from inkwell.operators.latest import articles_latest

    latest = articles_latest(raw_rows(spark, [
        {"guardian_id": f"a{i:02d}", "web_title": "Story" if i % 3 else "other", "published_at": "2026-03-02 10:00:00",
         "ingested_at": "2026-03-03 00:00:00", "section_name": "World"} for i in range(30)]))
    w = reports.window("2026-03-01", "2026-03-31")
    for limit, offset, rows in ((5, 0, 5), (5, 18, 2), (5, 40, 0), (0, 0, 0)):
        page = reports.search_page(latest, w, query_text="story", limit=limit, offset=offset)
        assert page["articles"].count() == rows and page["total"].first()["total"] == 20
    none = reports.search_page(latest, w, query_text="absent")
    assert none["articles"].count() == 0 and none["total"].first()["total"] == 0
    # the number is there already: nothing of the search is run again for it
    assert "web_title" not in page["total"]._jdf.queryExecution().executedPlan().toString()
