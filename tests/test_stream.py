"""ING-5: the stream equals the batch load, survives restarts, replays alike."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from inkwell.config import RAW, Lake
from inkwell.sources import adapters, landing
from inkwell.sources.store import TableStore
from inkwell.streaming import landing_stream

from conftest import SF_SMALL

COLS = ["guardian_id", "web_title", "published_at", "api_response_page", "tags"]


def _rows(df):
    return sorted(map(str, df.select(*COLS).collect()))


def test_stream_matches_batch_across_restarts(spark, scratch):
    root = tempfile.mkdtemp(prefix="stream-", dir=scratch)
    events = adapters.read_table(spark, SF_SMALL, "events")
    pages = adapters.landing_pages_from_events(events)
    early = pages.filter(F.col("day") < F.lit("2024-01-15").cast("date"))
    late = pages.filter(F.col("day") >= F.lit("2024-01-15").cast("date"))
    adapters.write_landing(early, f"{root}/landing")

    lake = Lake(f"{root}/lake")
    n1 = landing_stream.run_available_now(spark, lake, f"{root}/landing")
    first = landing.read_raw(TableStore(spark, lake)).count()
    # a second run with nothing new writes nothing
    assert landing_stream.run_available_now(spark, lake, f"{root}/landing") == n1
    # new days land in their own directories; the restarted stream takes only those
    late.select("day", "value").write.mode("append").partitionBy("day").text(f"{root}/landing")
    landing_stream.run_available_now(spark, lake, f"{root}/landing")
    store = TableStore(spark, lake)
    streamed = landing.read_raw(store)
    assert streamed.count() > first

    batch_lake = Lake(f"{root}/batch")
    batch_store = TableStore(spark, batch_lake)
    landing.load(batch_store, landing.read_landing(spark, f"{root}/landing"), datetime(2024, 2, 1))
    assert _rows(streamed) == _rows(landing.read_raw(batch_store))
    assert landing.read_quarantine(store).count() == landing.read_quarantine(batch_store).count()


def test_replayed_batch_overwrites_itself(spark, scratch):
    root = tempfile.mkdtemp(prefix="replay-", dir=scratch)
    events = adapters.read_table(spark, SF_SMALL, "events")
    adapters.write_landing(adapters.landing_pages_from_events(events), f"{root}/landing")
    store = TableStore(spark, Lake(f"{root}/lake"))
    text = landing.read_landing(spark, f"{root}/landing")
    a = landing.load(store, text, datetime(2024, 2, 1), batch_id="stream-x-000000000000")
    b = landing.load(store, text, datetime(2024, 2, 1), batch_id="stream-x-000000000000")
    assert a == b
    assert landing.read_raw(store).count() == a["loaded"]
    assert len(store.batches(RAW, landing.RAW_TABLE)) == 1


def test_stream_of_one_page_per_file(spark, scratch):
    import json
    import os

    root = tempfile.mkdtemp(prefix="stream-files-", dir=scratch)
    for day, page in (("2026-03-11", 1), ("2026-03-11", 2), ("2026-03-12", 1)):
        d = f"{root}/landing/day={day}"
        os.makedirs(d, exist_ok=True)
        with open(f"{d}/page-{page:05d}.json", "w") as fh:
            json.dump({"response": {"results": [{"id": f"a/{day}/{page}", "webTitle": "t",
                                                 "webPublicationDate": f"{day}T10:00:00Z"}, 7]}}, fh, indent=2)
    lake = Lake(f"{root}/lake")
    landing_stream.run_available_now(spark, lake, f"{root}/landing", one_page_per_file=True)
    store = TableStore(spark, lake)
    rows = sorted((r["guardian_id"], r["api_response_page"]) for r in landing.read_raw(store).collect())
    assert rows == [("a/2026-03-11/1", 1), ("a/2026-03-11/2", 2), ("a/2026-03-12/1", 1)]
    assert landing.read_quarantine(store).count() == 3


def test_new_checkpoint_keeps_what_another_query_wrote(spark, scratch):
    import json as js
    import os

    root, lake = f"{scratch}/landing-two", Lake(f"{scratch}/lake-two")

    def land(day, ident):
        os.makedirs(f"{root}/day={day}", exist_ok=True)
        with open(f"{root}/day={day}/page-00001.json", "w") as fh:
            fh.write(js.dumps({"response": {"pages": 1, "results": [
                {"id": ident, "webPublicationDate": f"{day}T10:00:00Z"}]}}))

    land("2026-03-11", "a")
    landing_stream.run_available_now(spark, lake, root, checkpoint=f"{scratch}/ckpt-one")
    land("2026-03-12", "b")
    landing_stream.run_available_now(spark, lake, root, checkpoint=f"{scratch}/ckpt-two")
    store = TableStore(spark, lake)
    assert len(store.committed_batch_ids("raw", landing.RAW_TABLE)) == 2
    assert sorted(r["guardian_id"] for r in landing.read_raw(store).collect()) == ["a", "a", "b"]


def test_a_stream_that_refreshes_equals_the_batch(spark, scratch, monkeypatch):
    """Three micro-batches, the second one dies after its load; then a merged batch is replayed."""
    import json

    import pytest

    from inkwell.config import ANALYTICS
    from inkwell.plans import refresh

    root = tempfile.mkdtemp(prefix="stream-refresh-", dir=scratch)
    pages = adapters.landing_pages_from_events(adapters.read_table(spark, SF_SMALL, "events"))
    bounds = ["2024-01-01", "2024-01-12", "2024-01-20", "2024-02-01"]
    lake, batch = Lake(f"{root}/lake"), Lake(f"{root}/batch")

    def tables(lk):
        store = TableStore(spark, lk)
        out = {}
        for name, _ in refresh.STEPS:
            df = store.read(ANALYTICS, name).drop("refreshed_at", "ingested_at", "last_sync_at", "freshness_lag_minutes")
            out[name] = sorted(map(str, df.select(*sorted(df.columns)).collect()))
        return out

    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        some = pages.filter((F.col("day") >= lo) & (F.col("day") < hi)).select("day", "value").coalesce(1)
        some.write.mode("append").partitionBy("day").text(f"{root}/landing")
        if i == 1:
            with monkeypatch.context() as m, pytest.raises(Exception):
                m.setattr(landing_stream, "run_transforms", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
                landing_stream.run_available_now(spark, lake, f"{root}/landing", refresh=True)
        assert landing_stream.run_available_now(spark, lake, f"{root}/landing", refresh=True) == i + 1
    landing.load(TableStore(spark, batch), landing.read_landing(spark, f"{root}/landing"), datetime(2024, 2, 1))
    refresh.run_transforms(spark, batch)
    streamed = tables(lake)
    assert streamed == tables(batch)
    # the last batch once more, as after a checkpoint that was not written
    store = TableStore(spark, lake)
    query = json.loads(spark.read.text(f"{lake.root}/_checkpoints/landing/metadata").first()["value"])["id"]
    text = landing.read_landing(spark, f"{root}/landing", days=("2024-01-20", "2024-02-01"))
    landing.load(store, text, datetime(2024, 2, 2), batch_id=f"stream-landing-{query}-{2:012d}")
    assert refresh.plan_delta(store).dates == []
    refresh.run_transforms(spark, lake, incremental=True)
    assert tables(lake) == streamed
