"""MAT-1: latest version per article (quirk 1), defaults and plan shape."""

from __future__ import annotations

from conftest import raw_rows

from inkwell.operators.latest import articles_latest


def _latest(spark, rows):
    return {(r["guardian_id"], r["web_title"]): r for r in articles_latest(raw_rows(spark, rows)).collect()}


def test_newest_ingest_wins_then_highest_page(spark):
    rows = [
        {"guardian_id": "a", "web_title": "old", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-01 11:00:00", "api_response_page": 5},
        {"guardian_id": "a", "web_title": "new", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-02 11:00:00", "api_response_page": 1},
        {"guardian_id": "b", "web_title": "p1", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-02 11:00:00", "api_response_page": 1},
        {"guardian_id": "b", "web_title": "p2", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-02 11:00:00", "api_response_page": 2},
    ]
    out = _latest(spark, rows)
    assert set(out) == {("a", "new"), ("b", "p2")}


def test_null_id_falls_back_to_url_and_date(spark):
    rows = [
        {"guardian_id": None, "web_url": "u1", "web_title": "x", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-01 11:00:00", "api_response_page": 1},
        {"guardian_id": None, "web_url": "u1", "web_title": "y", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-01 12:00:00", "api_response_page": 1},
        {"guardian_id": None, "web_url": "u1", "web_title": "z", "published_at": "2026-03-02 10:00:00",
         "ingested_at": "2026-03-01 12:00:00", "api_response_page": 1},
    ]
    assert set(_latest(spark, rows)) == {(None, "y"), (None, "z")}


def test_null_id_and_null_date_collapse_to_one(spark):
    rows = [
        {"guardian_id": None, "web_url": f"u{i}", "web_title": f"t{i}", "published_at": None,
         "ingested_at": f"2026-03-0{i} 11:00:00", "api_response_page": 1}
        for i in range(1, 4)
    ]
    out = _latest(spark, rows)
    assert list(out) == [(None, "t3")]


def test_empty_string_id_is_an_id(spark):
    rows = [
        {"guardian_id": "", "web_url": "u1", "web_title": "a", "published_at": "2026-03-01 10:00:00",
         "ingested_at": "2026-03-01 11:00:00"},
        {"guardian_id": "", "web_url": "u2", "web_title": "b", "published_at": "2026-03-05 10:00:00",
         "ingested_at": "2026-03-01 12:00:00"},
    ]
    assert list(_latest(spark, rows)) == [("", "b")]


def test_defaults_and_publication_date(spark):
    rows = [{"guardian_id": "a", "web_title": "t", "section_name": None, "pillar_name": None, "tags": None,
             "published_at": "2026-03-01 23:59:59", "ingested_at": "2026-03-02 00:30:00"}]
    r = articles_latest(raw_rows(spark, rows)).first()
    assert r["section_name"] == "Unknown" and r["pillar_name"] == "Unknown"
    assert r["tags"] == []
    assert str(r["publication_date"]) == "2026-03-01"


def test_full_ties_pick_the_same_row_on_reruns(spark):
    rows = [{"guardian_id": "a", "web_title": t, "raw_payload": p, "published_at": "2026-03-01 10:00:00",
             "ingested_at": "2026-03-01 11:00:00", "api_response_page": 1}
            for t, p in (("t1", "{}"), ("t2", "{}"), ("t2", '{"x":1}'))]
    df = raw_rows(spark, rows)
    picks = {tuple(articles_latest(df.repartition(n)).select("web_title", "raw_payload").first())
             for n in (1, 3, 7)}
    assert picks == {("t2", "{}")}


def test_plan_limits_rows_before_the_shuffle(spark):
    rows = [{"guardian_id": "a", "published_at": "2026-03-01 10:00:00", "ingested_at": "2026-03-01 11:00:00"}]
    plan = articles_latest(raw_rows(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "Partial" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
