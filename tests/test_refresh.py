"""MAT-run: order, downstream skip, sibling isolation, versioned replace."""

from __future__ import annotations

import re
from datetime import datetime

import pytest

from inkwell.config import ANALYTICS, Lake
from inkwell.plans import refresh
from inkwell.plans.catalog import Tables
from inkwell.plans import queries as q
from inkwell.sources import adapters, landing
from inkwell.sources.store import TableStore

from conftest import SF_SMALL

STAMP = datetime(2024, 2, 1, 6, 0, 0)


@pytest.fixture(scope="module")
def lake(spark, scratch):
    lake = Lake(f"{scratch}/lake-refresh")
    landing.append_raw(TableStore(spark, lake), adapters.articles_raw(spark, SF_SMALL))
    return lake


def _status(report):
    return {s["table"]: (s["status"], s.get("blocked_by")) for s in report.steps}


def test_all_steps_in_order(spark, lake):
    report = refresh.run_transforms(spark, lake, refreshed_at=STAMP)
    assert report.status == "materialized"
    assert [s["table"] for s in report.steps] == [name for name, _ in refresh.STEPS]
    t = Tables.from_lake(spark, lake)
    derived = Tables.derived(spark, SF_SMALL)
    assert t.articles_latest.count() == derived.articles_latest.count()
    assert sorted(map(tuple, q.top_sections(t.section_counts_daily, "2024-01-01", "2024-01-31").collect())) == \
        sorted(map(tuple, q.top_sections(derived.section_counts_daily, "2024-01-01", "2024-01-31").collect()))
    df = report.to_df(spark)
    assert df.count() == 7 and "blocked_by" in df.columns


def test_root_failure_skips_all_six(spark, lake):
    report = refresh.run_transforms(spark, lake, fail={"articles_latest": RuntimeError("boom")})
    st = _status(report)
    assert report.status == "failed"
    assert st["articles_latest"] == ("failed", None)
    assert all(st[n][0] == "skipped" for n in st if n != "articles_latest")
    assert st["section_daily"] == ("skipped", ["section_counts_daily"])
    assert report.steps[0]["error"] == "boom"


def test_branch_failure_leaves_siblings_running(spark, lake):
    report = refresh.run_transforms(spark, lake, fail={"article_tags": RuntimeError("tags")})
    st = _status(report)
    assert st["tag_counts_daily"] == ("skipped", ["article_tags"])
    for name in ("articles_latest", "daily_volume", "section_counts_daily", "section_daily", "content_freshness"):
        assert st[name][0] == "ok"


def test_replace_keeps_readers_on_a_committed_version(spark, lake):
    store = TableStore(spark, lake)
    before = store.current(ANALYTICS, "daily_volume")
    reader = store.read(ANALYTICS, "daily_volume")          # bound to `before`
    refresh.run_transforms(spark, lake, only=["daily_volume"])
    after = store.current(ANALYTICS, "daily_volume")
    assert after != before and after > before
    assert reader.count() == store.read(ANALYTICS, "daily_volume").count()
    assert len(store.versions(ANALYTICS, "daily_volume")) <= 2


def test_partitioned_layout_prunes_dates(spark, lake):
    store = TableStore(spark, lake)
    latest = refresh.read_analytics(store, "articles_latest")
    plan = q.overview_metrics(latest, "2024-01-05", "2024-01-06")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publication_date" in plan
    assert "web_title" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_incremental_refresh_equals_full_rebuild(spark, scratch):
    from pyspark.sql import functions as F

    events = adapters.read_table(spark, SF_SMALL, "events")
    raw = adapters.articles_raw_from_events(events)
    parts = [raw.filter(F.col("published_at") < F.lit("2024-01-10").cast("timestamp")),
             raw.filter(F.col("published_at").between(F.lit("2024-01-10").cast("timestamp"),
                                                      F.lit("2024-01-20").cast("timestamp"))),
             raw.filter(F.col("published_at") > F.lit("2024-01-20").cast("timestamp")),
             raw.filter(F.col("published_at") < F.lit("2024-01-05").cast("timestamp"))]   # a re-ingest
    from conftest import raw_rows

    orphans = [{"guardian_id": None, "web_url": f"u{i}", "web_title": f"orphan {i}", "published_at": None,
                "ingested_at": f"2024-02-0{i + 1} 00:00:00", "api_response_page": 1} for i in range(3)]
    parts[0] = parts[0].unionByName(raw_rows(spark, orphans[:2]))
    parts[3] = parts[3].unionByName(raw_rows(spark, orphans[2:]))
    inc, full = Lake(f"{scratch}/lake-inc"), Lake(f"{scratch}/lake-full")
    from inkwell.plans.catalog import Tables

    def same_as_recomputed(lake):
        """Every table equals the full computation over the raw rows so far."""
        store = TableStore(spark, lake)
        derived = Tables(raw=landing.read_raw(store))
        for name, _ in refresh.STEPS:
            got = refresh.read_analytics(store, name)
            cols = [c for c in got.columns if c not in ("raw_payload", "refreshed_at")]
            want = getattr(derived, name).select(*cols)
            assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect())), name

    for i, part in enumerate(parts):
        for lake in (inc, full):
            landing.append_raw(TableStore(spark, lake), part, batch_id=f"{i:04d}")
        report = refresh.run_transforms(spark, inc, incremental=True)
        assert report.status == "materialized"
        same_as_recomputed(inc)
    refresh.run_transforms(spark, full)

    def got(lake, name):
        df = refresh.read_analytics(TableStore(spark, lake), name)
        cols = [c for c in df.columns if c not in ("raw_payload", "refreshed_at")]
        return sorted(map(str, df.select(*cols).collect()))

    for name, _ in refresh.STEPS:
        assert got(inc, name) == got(full, name), name
    orphan = refresh.read_analytics(TableStore(spark, inc), "articles_latest").filter("web_title like 'orphan%'")
    assert [r["web_title"] for r in orphan.collect()] == ["orphan 2"]
    ledger = TableStore(spark, inc).read(ANALYTICS, refresh.LEDGER)
    assert sorted(r["batch"] for r in ledger.collect()) == ["0000", "0001", "0002", "0003"]


def test_incremental_plan_filters_untouched_rows_map_side(spark, scratch):
    lake = Lake(f"{scratch}/lake-incplan")
    store = TableStore(spark, lake)
    landing.append_raw(store, adapters.articles_raw(spark, SF_SMALL), batch_id="0000")
    refresh.run_transforms(spark, lake)
    assert refresh.plan_delta(store).dates == []                 # nothing new
    late = adapters.articles_raw(spark, SF_SMALL).filter("published_at >= timestamp'2024-01-29'")
    landing.append_raw(store, late, batch_id="0001")
    delta = refresh.plan_delta(store)
    assert [str(d) for d in delta.dates] == ["2024-01-29", "2024-01-30"]
    text = delta.latest_rows._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in text and "ResolvedHint" not in text
    # every scan of whole rows is of folders that the index, or the load log, named
    scans = re.findall(r"Scan parquet (\[[^\]]*\])[^\n]*?PartitionFilters: (\[[^\n]*?\]), PushedFilters", text)
    wide = [filters for columns, filters in scans if "web_title" in columns]
    assert len(wide) >= 2 and "[]" not in wide
    delta.release()


def _index(store):
    return sorted((str(r["key"]), str(r["place"]), r["loads"]) for r in refresh.article_index(store).read().collect())


def _index_anew(store):
    raw = landing.read_raw(store)
    return sorted((str(r["key"]), str(r["place"]), r["loads"]) for r in refresh.index_rows(
        Tables(raw=raw).articles_latest, raw).collect())


def test_key_index_follows_every_run(spark, scratch, monkeypatch):
    """Layers, folds, runs that die before, in and after the index's write: places and
    loads equal those counted from raw, and each article is found on its day alone."""
    from conftest import raw_rows
    from pyspark.sql import functions as F

    from inkwell.plans.api import Warehouse
    from inkwell.sources import key_index

    monkeypatch.setattr(key_index, "KEYS_PER_BUCKET", 100)
    monkeypatch.setattr(refresh, "article_index", lambda s: key_index.KeyIndex(s, ANALYTICS, refresh.INDEX, most_layers=2))
    raw = adapters.articles_raw(spark, SF_SMALL)

    def moving(day, n=0):
        return raw_rows(spark, [{"guardian_id": "moving", "web_url": "u", "web_title": day, "section_name": "World", "tags": [],
                                 "published_at": f"{day} 10:00:00", "ingested_at": f"2025-01-0{n + 1} 00:00:00", "api_response_page": 1},
                                {"guardian_id": None, "web_url": "v", "web_title": "undated", "published_at": None,
                                 "ingested_at": "2024-02-01 00:00:00", "api_response_page": 1}])

    lake = Lake(f"{scratch}/lake-index")
    store = TableStore(spark, lake)
    landing.append_raw(store, raw.where(F.col("published_at") < "2024-01-10").unionByName(moving("2024-01-02")), batch_id="first")
    assert refresh.run_transforms(spark, lake).status == "materialized"
    assert _index(store) == _index_anew(store) and len(refresh.article_index(store)._buckets()) > 1
    replace = TableStore.replace

    def no_ledger(self, df, dataset, table, **kw):
        if table == refresh.LEDGER:
            raise RuntimeError("died after the index")
        return replace(self, df, dataset, table, **kw)

    for i, (day, broken) in enumerate([("2024-01-12", None), ("2024-01-20", "index"), ("2024-01-15", "ledger"), ("2024-01-03", "tags")]):
        landing.append_raw(store, raw.where(F.to_date("published_at") == day).unionByName(moving(day, i + 1)), batch_id=f"{i:04d}")
        if broken == "ledger":
            with monkeypatch.context() as m, pytest.raises(RuntimeError):
                m.setattr(TableStore, "replace", no_ledger)
                refresh.run_transforms(spark, lake, incremental=True)
        elif broken:
            died = refresh.run_transforms(spark, lake, incremental=True, fail={
                refresh.INDEX if broken == "index" else "article_tags": RuntimeError("died")})
            assert died.status == "failed" and (died.error == "died") == (broken == "index")
        if broken:
            # between the runs the article is found wherever the table has it
            assert Warehouse(spark, lake).article("moving").first()["web_title"] == day
            landing.append_raw(store, moving(day, i + 1), batch_id=f"{i:04d}b")   # the next run covers more than the one that died
        assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
        assert _index(store) == _index_anew(store), day
        # the day now, and the one before
        assert len(refresh.article_index(store).places_of("moving")) <= 5
        assert Warehouse(spark, lake).article("moving").first()["web_title"] == day
    assert Warehouse(spark, lake).article("no such article").count() == 0
    plan = Warehouse(spark, lake).article("moving")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(publication_date" in plan or "PartitionFilters: [coalesce(publication_date" in plan
    # DQ-3 is counted from the index, without raw
    ids = landing.read_raw(store).where("guardian_id IS NOT NULL").groupBy("guardian_id").count().where("count > 1").count()
    refresh.run_quality_checks(spark, lake, extended=True, as_of=STAMP)
    found = store.read("ops", "data_quality_results").where("check_name = 'Duplicate guardian IDs'").first()
    assert found["observed_value"] == str(ids)


def _table(spark, lake, name):
    df = refresh.read_analytics(TableStore(spark, lake), name)
    cols = [c for c in df.columns if c not in ("raw_payload", "refreshed_at")]
    return sorted(map(str, df.select(*cols).collect()))


def test_failure_of_any_step_is_repaired_by_the_next_run(spark, scratch, monkeypatch):
    """Each of the seven steps fails once, and the swap of articles_latest dies
    between its data and its state; after the next run all tables are right."""
    from pyspark.sql import functions as F

    raw = adapters.articles_raw(spark, SF_SMALL)
    days = ["2024-01-04", "2024-01-08", "2024-01-12", "2024-01-16", "2024-01-20", "2024-01-24", "2024-01-28", "2024-01-30"]
    lake = Lake(f"{scratch}/lake-heal")
    store = TableStore(spark, lake)
    landing.append_raw(store, raw.filter(F.col("published_at") < "2024-01-03"), batch_id="first")
    refresh.run_transforms(spark, lake)
    for i, (day, step) in enumerate(zip(days, [n for n, _ in refresh.STEPS] + ["publish"])):
        landing.append_raw(store, raw.filter(F.to_date("published_at") <= day), batch_id=f"{i:04d}")
        with monkeypatch.context() as m:
            if step == "publish":
                m.setattr(TableStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
            broken = refresh.run_transforms(spark, lake, incremental=True,
                                            fail={} if step == "publish" else {step: RuntimeError("x")})
        assert broken.status == "failed"
        if i % 3 == 2 or step == "publish":
            assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
            derived = Tables(raw=landing.read_raw(store))
            for name, _ in refresh.STEPS:
                want = getattr(derived, name)
                cols = [c for c in refresh.read_analytics(store, name).columns if c not in ("raw_payload", "refreshed_at")]
                assert _table(spark, lake, name) == sorted(map(str, want.select(*cols).collect())), (step, name)


def test_hourly_run_builds_a_table_missing_on_disk(spark, scratch):
    raw = adapters.articles_raw(spark, SF_SMALL)
    lake = Lake(f"{scratch}/lake-missing")
    store = TableStore(spark, lake)
    landing.append_raw(store, raw.filter("event_type <> 'view'"), batch_id="0000")
    refresh.run_transforms(spark, lake)
    store.delete(store.table_path(ANALYTICS, "article_tags"))
    landing.append_raw(store, raw.filter("event_type = 'view'"), batch_id="0001")
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    full = Lake(f"{scratch}/lake-missing-full")
    landing.append_raw(TableStore(spark, full), raw)
    refresh.run_transforms(spark, full)
    tags = lambda lk: sorted(map(str, refresh.read_analytics(TableStore(spark, lk), "tag_counts_daily").collect()))
    assert tags(lake) == tags(full)


def test_failed_run_that_moved_a_key_is_repaired(spark, scratch):
    from conftest import raw_rows

    def row(title, published, ingested):
        return {"guardian_id": "moving", "web_url": "u", "web_title": title, "section_name": "World",
                "published_at": published, "ingested_at": ingested, "api_response_page": 1, "tags": ["t"]}

    base = adapters.articles_raw(spark, SF_SMALL)
    first = base.unionByName(raw_rows(spark, [row("v1", "2024-01-05 10:00:00", "2024-02-01 00:00:00")]))
    moved = raw_rows(spark, [row("v2", "2024-01-20 10:00:00", "2024-02-02 00:00:00")])
    lake, full = Lake(f"{scratch}/lake-moved"), Lake(f"{scratch}/lake-moved-full")
    store = TableStore(spark, lake)
    landing.append_raw(store, first, batch_id="0000")
    refresh.run_transforms(spark, lake)
    landing.append_raw(store, moved, batch_id="0001")
    broken = refresh.run_transforms(spark, lake, incremental=True,
                                    fail={"daily_volume": RuntimeError("x"), "article_tags": RuntimeError("y")})
    assert broken.status == "failed"
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    for b, part in (("0000", first), ("0001", moved)):
        landing.append_raw(TableStore(spark, full), part, batch_id=b)
    refresh.run_transforms(spark, full)
    for name, _ in refresh.STEPS:
        df = lambda lk: refresh.read_analytics(TableStore(spark, lk), name)
        cols = [c for c in df(lake).columns if c not in ("raw_payload", "refreshed_at")]
        assert sorted(map(str, df(lake).select(*cols).collect())) == \
            sorted(map(str, df(full).select(*cols).collect())), name
    assert refresh._pending(TableStore(spark, lake)) == []


def test_pending_dates_without_new_batches(spark, scratch):
    from datetime import date

    lake = Lake(f"{scratch}/lake-pending")
    store = TableStore(spark, lake)
    landing.append_raw(store, adapters.articles_raw(spark, SF_SMALL), batch_id="0000")
    refresh.run_transforms(spark, lake)
    before = sorted(map(str, refresh.read_analytics(store, "daily_volume").collect()))
    refresh._write_dates(store, [date(2024, 1, 3), None])          # left by an interrupted run
    assert refresh.plan_delta(store).dates == [date(2024, 1, 3), None]
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    assert sorted(map(str, refresh.read_analytics(store, "daily_volume").collect())) == before
    assert refresh._pending(store) == []
