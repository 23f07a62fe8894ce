"""DQ-1 … DQ-4 (quirk 9)."""

from __future__ import annotations

import json
from datetime import datetime

from conftest import raw_rows

from inkwell.operators import quality, rollups
from inkwell.operators.latest import articles_latest
from inkwell.plans import queries as q

AS_OF = datetime(2026, 3, 12, 8, 0, 0)


def _raw(spark):
    return raw_rows(spark, [
        {"guardian_id": "a", "section_name": None, "published_at": "2026-03-01 10:00:00", "ingested_at": "2026-03-01 10:00:00"},
        {"guardian_id": "b", "section_name": "", "published_at": None, "ingested_at": "2026-03-01 10:00:00"},
        {"guardian_id": "c", "section_name": "World", "published_at": "2026-03-01 10:00:00", "ingested_at": "2026-03-01 10:00:00"},
        {"guardian_id": "c", "section_name": "World", "published_at": "2026-03-01 10:00:00", "ingested_at": "2026-03-02 10:00:00"},
    ])


def test_checks_on_raw_and_after_defaults(spark):
    raw = _raw(spark)
    on_raw = {r["check_name"]: r for r in quality.quality_results(raw, as_of=AS_OF).collect()}
    assert on_raw[quality.MISSING_SECTION]["observed_value"] == "2"
    assert on_raw[quality.MISSING_PUBLISHED]["observed_value"] == "1"
    on_latest = {r["check_name"]: r for r in quality.quality_results(articles_latest(raw), as_of=AS_OF).collect()}
    # null became 'Unknown'; only the empty string is still counted
    assert on_latest[quality.MISSING_SECTION]["observed_value"] == "1"
    assert on_latest[quality.MISSING_SECTION]["status"] == "warn"
    r = on_latest[quality.MISSING_SECTION]
    assert json.loads(r["details_json"]) == {"detail": quality.SECTION_DETAIL}
    assert str(r["check_date"]) == "2026-03-12" and r["severity"] == "warning" and r["threshold"] == "0"


def test_thresholds(spark):
    raw = _raw(spark)
    rows = {r["check_name"]: r["status"] for r in quality.quality_results(
        raw, missing_section_threshold=2, missing_published_at_threshold=0, as_of=AS_OF).collect()}
    assert rows == {quality.MISSING_SECTION: "pass", quality.MISSING_PUBLISHED: "warn"}


def test_report_reads_detail_and_sorts(spark):
    rep = q.data_quality(quality.quality_results(_raw(spark), as_of=AS_OF)).collect()
    assert [r["name"] for r in rep] == sorted([quality.MISSING_SECTION, quality.MISSING_PUBLISHED])
    assert rep[0]["detail"] == quality.PUBLISHED_DETAIL


def test_duplicates_and_freshness_budget(spark):
    raw = _raw(spark)
    dup = quality.duplicate_ids(raw, as_of=AS_OF).first()
    assert dup["observed_value"] == "1" and dup["status"] == "pass"
    fresh = rollups.content_freshness(articles_latest(raw))
    budget = quality.freshness_budget(fresh, as_of=AS_OF).first()
    assert budget["status"] == "warn" and int(budget["observed_value"]) > 20
