"""The route-shaped facade over a built lake."""

from __future__ import annotations

import tempfile
from datetime import date, datetime

import pytest

from conftest import SF_SMALL
from inkwell.config import Lake
from inkwell.plans import ingest, ops, refresh
from inkwell.plans.api import Warehouse
from inkwell.sources import adapters


@pytest.fixture(scope="module")
def wh(spark, scratch):
    root = tempfile.mkdtemp(prefix="api-", dir=scratch)
    events = adapters.read_table(spark, SF_SMALL, "events")
    adapters.write_landing(adapters.landing_pages_from_events(events), f"{root}/landing")
    lake = Lake(f"{root}/lake")
    stamp = datetime(2024, 2, 1, 6)
    ingest.bootstrap(spark, lake, f"{root}/landing", "2024-01-01", "2024-01-31", ingested_at=stamp)
    ops.sync_pipeline_runs(spark, lake, adapters.run_records_from_events(events))
    w = Warehouse(spark, lake, today=date(2024, 1, 30))
    w.landing = f"{root}/landing"
    return w


def test_analytics_routes(wh):
    ov = wh.overview()
    assert ov["range"] == "2024-01-19 to 2024-01-30"
    assert ov["kpis"].count() == 4 and ov["daily_volume"].count() == 12
    assert ov["top_sections"].count() == 4
    assert wh.sections("2024-01-01", "2024-01-31")["series"].count() == 28   # two days landed unreadable pages only
    assert wh.tags(limit=3)["tags"].count() == 3
    page = wh.articles("2024-01-01", "2024-01-31", q_text="story", limit=5, offset=5)
    assert page["articles"].count() == 5 and page["paging"].first()["current_page"] == 2
    first = page["articles"].first()["guardian_id"]
    assert wh.article(first).count() == 1 and wh.article("missing").count() == 0
    assert wh.publishing_volume(granularity="hour")["granularity"] == "hour"


def test_ops_routes(wh):
    st = wh.status()
    assert st["status"].count() == 1 and st["checks"].count() == 2
    runs = wh.runs(limit=5).collect()
    assert len(runs) == 5 and runs[0]["started_at"].endswith("+00:00")
    manual = wh.runs(limit=200).filter("dag_id = 'guardian_backfill_range'").first()["run_id"]
    assert wh.backfill_status(manual).count() == 1
    with pytest.raises(ValueError):
        wh.backfill(wh.landing, "2024-01-05", "2024-01-01")
    done = wh.backfill(wh.landing, "2024-01-30", "2024-01-30")
    assert done["loaded"] > 0
    row = wh.backfill_status(done["run_id"]).first()
    assert (row["status"], row["trigger"], row["window"]) == ("success", "manual", "2024-01-30 to 2024-01-30")
    with pytest.raises(Exception):
        wh.backfill("/nowhere/at/all", "2024-01-30", "2024-01-30")
    failed = [r for r in wh.runs(limit=200).collect() if r["status"] == "failed" and r["window"] == "2024-01-30 to 2024-01-30"]
    assert len(failed) == 1


def test_absent_tables_read_as_empty_without_raw(spark):
    root = tempfile.mkdtemp(prefix="inkwell-api-raw-")
    lake = Lake(f"{root}/lake")
    from inkwell.sources import landing
    from inkwell.sources.store import TableStore

    landing.append_raw(TableStore(spark, lake), adapters.articles_raw(spark, SF_SMALL))
    w = Warehouse(spark, lake, today=date(2024, 1, 30))
    series = w.sections("2024-01-01", "2024-01-31")["series"]
    assert series.count() == 0 and "articles_raw" not in str(series.inputFiles())
    assert [r["value"] for r in w.overview()["kpis"].orderBy("position").collect()][:2] == ["0", "0"]
    assert w.article("article/1").count() == 0


def test_article_defaults(spark):
    from conftest import raw_rows
    from inkwell.operators.latest import articles_latest
    from inkwell.plans import reports

    latest = articles_latest(raw_rows(spark, [{"guardian_id": "a", "ingested_at": "2026-03-01T11:00:00"}]))
    row = reports.article_report(latest, "a").first()
    assert (row["web_title"], row["published_at"], row["tags"]) == ("", "", [])
