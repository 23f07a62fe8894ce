"""SRC-1 … SRC-9 and ING-1/2/3 on landed JSON pages (FIXTURES.md §1-2)."""

from __future__ import annotations

import json
import os
from datetime import date, datetime

import pytest

import __spark_entry__ as contract
from conftest import SF_SMALL
from inkwell.config import Lake
from inkwell.plans import ingest
from inkwell.sources import adapters, landing
from inkwell.sources.store import TableStore

STAMP = datetime(2026, 3, 12, 9, 0, 0)


def _article(i, **kw):
    a = {"id": f"world/2026/mar/{i}", "webUrl": f"https://x/{i}", "webTitle": f"Story {i}",
         "sectionId": "world", "sectionName": "World news", "pillarId": "pillar/news", "pillarName": "News",
         "webPublicationDate": "2026-03-11T12:00:00Z", "tags": [{"webTitle": "UK"}, {"webTitle": ""}, {}]}
    a.update(kw)
    return a


def _land(root, day, page, payload, pretty=False):
    d = os.path.join(root, f"day={day}")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"page-{page:05d}.json"), "w") as fh:
        fh.write(json.dumps(payload, indent=1 if pretty else None))


@pytest.fixture
def landing_dir(scratch):
    import tempfile

    root = tempfile.mkdtemp(prefix="landing-", dir=scratch)
    no_page = _article(3, extra={"kept": True})
    no_page.pop("tags")
    _land(root, "2026-03-11", 1, {"response": {"pages": 2, "results": [
        _article(1), _article(2, id=None), "not an object", _article(4, webPublicationDate="soon"),
        _article(5, webPublicationDate=None), _article(6, id=""), no_page]}})
    _land(root, "2026-03-11", 2, {"response": {"pages": 2, "results": []}}, pretty=True)
    _land(root, "2026-03-12", 1, {"response": {"pages": 1}})
    _land(root, "2026-03-12", 2, {"response": {"results": [_article(7, webPublicationDate="2026-03-12T01:02:03Z")]}})
    return root


def test_validation_reasons_and_page_numbers(spark, landing_dir):
    text = landing.read_landing(spark, landing_dir, one_page_per_file=True)
    rows = landing.validated(text, STAMP).collect()
    reasons = sorted((r["reject_reason"] or "ok") for r in rows)
    assert reasons == sorted(["ok", "missing_guardian_id", "not_a_dict", "unparseable_published_at",
                              "missing_published_at", "missing_guardian_id", "ok", "ok"])
    by_id = {r["guardian_id"]: r for r in rows if r["accepted"]}
    first = by_id["world/2026/mar/1"]
    assert first["tags"] == ["UK"] and first["api_response_page"] == 1
    assert first["published_at"] == datetime(2026, 3, 11, 12, 0) and first["ingested_at"] == STAMP
    assert by_id["world/2026/mar/3"]["tags"] == []
    assert json.loads(by_id["world/2026/mar/3"]["raw_payload"])["extra"] == {"kept": True}
    assert by_id["world/2026/mar/7"]["api_response_page"] == 2   # page from the file name


def test_load_counts_and_quarantine(spark, scratch, landing_dir):
    lake = Lake(f"{scratch}/lake-load")
    store = TableStore(spark, lake)
    assert landing.raw_article_count(store) == 0 and landing.latest_ingested_at(store) is None
    text = landing.read_landing(spark, landing_dir, one_page_per_file=True)
    assert landing.load(store, text, STAMP) == {"loaded": 3, "rejected": 5}
    assert landing.raw_article_count(store) == 3
    assert landing.latest_ingested_at(store) == STAMP
    assert landing.read_quarantine(store).count() == 5


def test_all_rejected_loads_nothing(spark, scratch):
    import tempfile

    root = tempfile.mkdtemp(prefix="landing-bad-", dir=scratch)
    _land(root, "2026-03-11", 1, {"response": {"results": [_article(1, id=None), 5]}})
    store = TableStore(spark, Lake(f"{scratch}/lake-bad"))
    assert landing.load(store, landing.read_landing(spark, root, one_page_per_file=True), STAMP) == \
        {"loaded": 0, "rejected": 2}
    assert landing.raw_article_count(store) == 0


def test_backfill_recent_and_bootstrap(spark, scratch, landing_dir):
    lake = Lake(f"{scratch}/lake-jobs")
    rev = ingest.run_backfill(spark, lake, landing_dir, "2026-03-12", "2026-03-11", ingested_at=STAMP)
    assert (rev["loaded"], rev["rejected"]) == (0, 0)
    one = ingest.run_backfill(spark, lake, landing_dir, "2026-03-12", "2026-03-12", ingested_at=STAMP)
    assert (one["loaded"], one["rejected"]) == (1, 0)
    with pytest.raises(ValueError):
        ingest.run_backfill(spark, lake, landing_dir, "2026-03-12", "2026-03-11", validate=True)
    recent = ingest.run_recent_ingest(spark, lake, landing_dir, today=date(2026, 3, 12),
                                      ingested_at=datetime(2026, 3, 12, 10))
    assert recent["watermark_source"] == "warehouse" and recent["start_date"] == "2026-03-12"
    assert recent["loaded"] == 1
    skipped = ingest.bootstrap(spark, lake, landing_dir, "2026-03-11", "2026-03-12")
    assert skipped == {"mode": "bootstrap", "status": "skipped", "existing_rows": 2}
    fresh = Lake(f"{scratch}/lake-boot")
    first = ingest.run_recent_ingest(spark, fresh, landing_dir, today=date(2026, 3, 12), ingested_at=STAMP)
    assert first["watermark_source"] == "default_24h" and first["start_date"] == "2026-03-11"
    boot = ingest.bootstrap(spark, fresh, landing_dir, "2026-03-11", "2026-03-12", force=True, ingested_at=STAMP)
    assert boot["mode"] == "bootstrap" and boot["status"] == "loaded" and boot["existing_rows"] == 3
    assert boot["transforms"] == "materialized" and boot["quality"] == "materialized"
    assert ingest.bootstrap_window(3, date(2026, 3, 12)) == (date(2026, 3, 10), date(2026, 3, 12))


def test_counts_and_watermark_come_from_the_load_log(spark, scratch):
    from pyspark.sql import functions as F

    from inkwell.config import RAW
    from inkwell.sources import adapters

    lake = Lake(f"{scratch}/lake-log")
    store = TableStore(spark, lake)
    raw = adapters.articles_raw(spark, "/root/testdata/sf0.001")
    landing.append_raw(store, raw.filter("event_type = 'view'"), batch_id="0001")
    # a load that died between its data and its log row counts nowhere
    orphan = raw.filter("event_type = 'click'").withColumn("accepted", F.lit(True))
    store.append(orphan, RAW, landing.RAW_TABLE, batch_id="0002", partition_by=("accepted",))
    views = raw.filter("event_type = 'view'")
    assert landing.raw_article_count(store) == views.count() == landing.read_raw(store).count()
    assert landing.latest_ingested_at(store) == views.agg(F.max(F.col("ingested_at").cast("timestamp_ntz"))).first()[0]
    # done over again under its id it counts once
    landing.append_raw(store, raw.filter("event_type = 'click'"), batch_id="0002")
    assert landing.raw_article_count(store) == raw.filter("event_type in ('view', 'click')").count() == landing.read_raw(store).count()


def test_folding_loads_changes_no_row(spark, scratch, monkeypatch):
    """Counts, rows and rejects before, after, and after a fold that dies at each of its three writes."""
    import os

    from pyspark.sql import functions as F

    from inkwell.config import RAW
    from inkwell.sources import adapters

    lake = Lake(f"{scratch}/lake-folds")
    store = TableStore(spark, lake)
    pages = adapters.landing_pages_from_events(adapters.read_table(spark, "/root/testdata/sf0.001", "events"))
    text = pages.select("value", "day", F.lit(None).cast("string").alias("file_path")).persist()
    days = [r["day"] for r in text.select("day").distinct().orderBy("day").limit(5).collect()]
    for i, day in enumerate(days):
        landing.load(store, text.where(F.col("day") == day), STAMP, batch_id=f"{i:04d}")

    def seen():
        rows = lambda df: sorted(map(str, df.drop("tags").collect()))
        return (landing.raw_article_count(store), landing.latest_ingested_at(store), rows(landing.read_raw(store)),
                rows(landing.read_quarantine(store)))

    def folders():
        return {n.split("=")[1] for n in os.listdir(store.table_path(RAW, landing.RAW_TABLE)) if n.startswith("batch=")}

    before = seen()
    assert before[0] == len(before[2]) > 0 and before[3]
    done = spark.createDataFrame([(f"{i:04d}",) for i in range(4)], "batch string")     # the fifth is not refreshed yet
    assert landing.compact(store, done, most_loads=4) == 0
    append = TableStore.append
    for table in (landing.FOLDS_TABLE, landing.RAW_TABLE, landing.LOAD_LOG_TABLE):
        def die(self, df, dataset, name, **kw):
            if name == table:
                raise RuntimeError("died")
            return append(self, df, dataset, name, **kw)

        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(TableStore, "append", die)
            landing.compact(store, done, most_loads=2)
        assert seen() == before, table
    assert landing.compact(store, done, most_loads=2) == 4
    assert seen() == before and landing.live_loads(store).count() == 2
    assert {f"{i:04d}" for i in range(5)} <= folders()          # a reader may still hold them
    # the next fold takes the fold in, and removes what the first one held
    done = spark.createDataFrame([("0004",)], "batch string")
    assert landing.compact(store, done, most_loads=1) == 2
    assert seen() == before and landing.live_loads(store).count() == 1
    assert not {f"{i:04d}" for i in range(4)} & folders() and "0004" in folders()
    # large loads stay as they are
    assert landing.compact(store, done, most_loads=0, fold_rows=10) == 0
    plan = landing.read_raw(store)._jdf.queryExecution().executedPlan().toString()
    assert "0004" not in plan and "dynamicpruning" in plan
    text.unpersist()


def test_hourly_run_ingests_rebuilds_and_checks(spark, scratch, landing_dir):
    lake = Lake(f"{scratch}/lake-hourly")
    first = ingest.run_hourly(spark, lake, landing_dir, today=date(2026, 3, 12), ingested_at=STAMP)
    assert first["ingest"]["loaded"] == 3 and first["transforms"] == "materialized"
    assert first["quality"] == "materialized" and first["checks"] == 2
    again = ingest.run_hourly(spark, lake, landing_dir, today=date(2026, 3, 12),
                              ingested_at=datetime(2026, 3, 12, 10))
    assert again["ingest"]["watermark_source"] == "warehouse" and again["transforms"] == "materialized"
    from inkwell.plans.catalog import Tables

    assert Tables.from_lake(spark, lake).articles_latest.count() == 3


def _reasons(spark, root, **kw):
    rows = landing.validated(landing.read_landing(spark, root, **kw), STAMP).collect()
    return sorted((r["reject_reason"] or "ok") for r in rows), rows


def test_no_page_vanishes(spark, scratch):
    import tempfile

    root = tempfile.mkdtemp(prefix="landing-broken-", dir=scratch)
    d = os.path.join(root, "day=2026-03-11")
    os.makedirs(d)
    pages = {1: json.dumps({"response": {"pages": 7, "results": [_article(1)]}})[:-9], 2: "<html>502</html>",
             3: json.dumps({"message": "no key"}), 4: json.dumps({"response": {"results": {"id": "x"}}}),
             5: json.dumps({"response": {"pages": 7, "results": None}}), 6: json.dumps({"response": 5}),
             7: json.dumps({"response": {"pages": 7, "results": [_article(2)]}})}
    for page, text in pages.items():
        with open(os.path.join(d, f"page-{page:05d}.json"), "w") as fh:
            fh.write(text)
    got, rows = _reasons(spark, root, one_page_per_file=True)
    assert got == sorted(["unparseable_page", "unparseable_page", "no_response", "no_response", "results_not_a_list", "ok"])
    kept = {r["api_response_page"]: r["raw_payload"] for r in rows if not r["accepted"]}
    assert kept[2] == pages[2] and kept[4] == pages[4]
    text = landing.read_landing(spark, root, one_page_per_file=True)
    day = landing.page_completeness(text).first()
    assert (day["announced"], day["landed"], day["unreadable"], day["complete"]) == (7, 2, 5, False)
    # a day of broken pages only, and a day of the window without any page
    bad = os.path.join(root, "day=2026-03-13")
    os.makedirs(bad)
    for page in (1, 2):
        with open(os.path.join(bad, f"page-{page:05d}.json"), "w") as fh:
            fh.write("<html>")
    text = landing.read_landing(spark, root, one_page_per_file=True)
    found = [tuple(r) for r in landing.page_completeness(text, (date(2026, 3, 11), date(2026, 3, 13))).orderBy("day").collect()]
    assert found == [(date(2026, 3, 11), 7, 2, 5, False), (date(2026, 3, 12), None, 0, 0, False),
                     (date(2026, 3, 13), None, 0, 2, False)]
    assert landing.page_completeness(text).count() == 2


def test_pretty_page_read_as_lines_is_rejected_not_lost(spark, scratch):
    import tempfile

    root = tempfile.mkdtemp(prefix="landing-pretty-", dir=scratch)
    _land(root, "2026-03-11", 1, {"response": {"pages": 1, "results": [_article(1)]}}, pretty=True)
    got, _ = _reasons(spark, root)
    assert "ok" not in got and "unparseable_page" in got


def test_element_types_tags_and_dates(spark, scratch):
    import tempfile

    root = tempfile.mkdtemp(prefix="landing-types-", dir=scratch)
    _land(root, "2026-03-11", 1, {"response": {"pages": 1, "results": [
        json.dumps(_article(1)),                                            # a string that looks like an object
        [_article(2)], 5, None, True,
        _article(3, tags=[{"webTitle": "k"}, 5, "x", None, {"webTitle": "l"}]),
        _article(4, webPublicationDate="12:30"), _article(5, tags="none")]}})
    got, rows = _reasons(spark, root, one_page_per_file=True)
    assert got == sorted(["not_a_dict"] * 5 + ["ok", "unparseable_published_at", "ok"])
    tags = {r["guardian_id"]: r["tags"] for r in rows if r["accepted"]}
    assert tags == {"world/2026/mar/3": ["k", "l"], "world/2026/mar/5": []}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_the_warehouse_are_built_by_all_tasks(spark, monkeypatch):
    """A file of one row group is one task's: raw rows and run records are built after
    the events have been dealt over the cluster."""
    plans = {}

    def stop(name):
        def job(*args):
            plans[name] = _plan(next(a for a in args if hasattr(a, "_jdf")))
            raise InterruptedError(name)
        return job

    monkeypatch.setattr(contract.landing, "append_raw", stop("raw"))
    monkeypatch.setattr(contract.ops, "sync_pipeline_runs", stop("runs"))
    with pytest.raises(InterruptedError):
        contract._lake(spark, f"{SF_SMALL}/")
    assert set(plans) == {"raw", "runs"} and all("Exchange hashpartitioning(event_id" in p for p in plans.values())


def test_landed_pages_move_events_not_json(spark):
    """The events are dealt by page before their JSON is built, and no page moves again."""
    pages = adapters.landing_pages_from_events(adapters.read_table(spark, SF_SMALL, "events"))
    above = _plan(pages).split("StructsToJson")[0]
    assert "Exchange hashpartitioning" not in above and "BroadcastHashJoin" in above
    events = [(i, datetime(2024, 1, 1 + i % 2), 1, "view", 1.0, '{"k": 1}') for i in (0, 1, 1, 49, 50, 120)]
    events.append((None, datetime(2024, 1, 1), 1, "view", 1.0, None))
    few = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    found = {(r["day"].day, r["page"]): json.loads(r["value"])["response"] for r in
             adapters.landing_pages_from_events(few).where("page % 7 <> 3").collect()}
    assert {k: (v["pages"], v["currentPage"], len(v["results"])) for k, v in found.items()} == {
        (1, 2): (3, 2, 1), (2, 1): (1, 1, 3), (1, 1): (3, 1, 1)}


def test_raw_count_fills_no_other_warehouse(spark, monkeypatch):
    def lake(*_):
        raise AssertionError("the warehouse of the jobs is not asked for")

    monkeypatch.setattr(contract, "_lake", lake)
    row = contract.queries()["raw_count"](spark, SF_SMALL).first()
    reject = {r["reject_reason"]: r["rows"] for r in contract.queries()["reject_counts"](spark, SF_SMALL).collect()}
    assert row["loaded"] == reject.pop(None) > 0 and row["rejected"] == sum(reject.values()) > 0
