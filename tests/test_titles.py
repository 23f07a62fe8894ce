"""Title search over trigram postings (QRY-7): equal to the scan, fewer days read."""

from __future__ import annotations

import tempfile
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import raw_rows, ts
from inkwell.config import ANALYTICS, Lake
from inkwell.operators import titles as ops
from inkwell.plans import queries as q
from inkwell.plans import refresh, titles
from inkwell.sources import landing
from inkwell.sources.store import Conflict, TableStore

WINDOW = ("2026-03-01", "2026-03-09")
TITLES = {1: "Budget vote delayed", 2: "Élection à Köln 50% off", 3: "vote_count C\\D", 4: "ab", 5: None, 6: "Rain 🌧️🌧️🌧️ again",
          7: "BUDGET", 8: "Budge t", 9: "x" * 5000 + " needle"}
SEARCHES = ("budget", "BUDGET%delayed", "é", "élec", "50%_off", "c\\d", "e_c", "🌧️🌧️", "ab", "", "%", "needle", "absent!", "vote", "t v")


def articles(spark, found: dict, at: str = "2026-03-20T06:00:00", month: str = "2026-03"):
    return raw_rows(spark, [dict(guardian_id=f"a/{i}", web_title=title, published_at=ts(f"{month}-{i:02d}T10:00:00"), ingested_at=ts(at),
                                 api_response_page=1) for i, title in found.items()])


@pytest.fixture
def lake(spark, scratch):
    lake = Lake(tempfile.mkdtemp(prefix="titles-", dir=scratch))
    landing.append_raw(TableStore(spark, lake), articles(spark, TITLES))
    assert refresh.run_transforms(spark, lake).status == "materialized"
    return lake


def found(spark, lake, text, literal=False, window=WINDOW):
    store = TableStore(spark, lake)
    latest = titles.narrowed(store, lambda: refresh.read_analytics(store, "articles_latest"), *window, text, literal)
    scan = refresh.read_analytics(store, "articles_latest")

    def ids(df):
        return sorted(r[0] for r in q.search_filter(df, *window, query_text=text, literal=literal).select("guardian_id").collect())

    got = ids(latest)
    assert got == ids(scan), text
    return got


def days(spark, lake, text, window=WINDOW):
    return titles.search_days(TableStore(spark, lake), *window, text)


def test_grams(spark):
    rows = spark.createDataFrame([("AbCd",), ("aaaaa",), ("ab",), ("",), (None,), ("a🌧️b",), ("İx",)], "t string")
    got = [r[0] for r in rows.select(ops.grams(F.col("t"))).collect()]
    assert got == [["abc", "bcd"], ["aaa"], [], [], [], ["a🌧️", "🌧️b"], ["i̇x"]]
    assert ops.needle_grams("ab%cdef_gh") == ["cde", "def"]
    assert ops.needle_grams("ab%c", literal=True) == ["ab%", "b%c"]
    assert ops.needle_grams("ab_%") == [] == ops.needle_grams("")
    many = ops.needle_grams("".join(chr(200 + i) for i in range(100)))
    assert len(many) == ops.MOST_GRAMS and len(set(many)) == ops.MOST_GRAMS


@settings(max_examples=200, deadline=None)
@given(st.text("abé%_\\", max_size=12), st.text("abé_%\\", max_size=12), st.text("ab", max_size=4))
def test_a_match_has_every_gram(before, text, after):
    # wildcards filled in by plain letters
    title = before + text.replace("%", after).replace("_", "b") + after
    assert all(g in title for g in ops.needle_grams(text))
    assert all(g in before + text + after for g in ops.needle_grams(text, literal=True))


def test_equals_the_scan_and_opens_fewer_days(spark, lake):
    assert days(spark, lake, "budget") is None                       # no postings yet: all days
    assert titles.index_titles(spark, lake) == 9
    assert titles.index_titles(spark, lake) == 0
    for text in SEARCHES:
        found(spark, lake, text)
        found(spark, lake, text, literal=True)
    assert found(spark, lake, None) and found(spark, lake, "budget", window=("2026-03-07", "2026-03-01")) == []
    assert days(spark, lake, "budget") == [date(2026, 3, 1), date(2026, 3, 7)]
    assert days(spark, lake, "bud%delayed", ("2026-03-01", "2026-03-02")) == [date(2026, 3, 1)]
    assert days(spark, lake, "absent!") == [] and days(spark, lake, "b_d%e") is None
    store = TableStore(spark, lake)
    latest = titles.narrowed(store, lambda: refresh.read_analytics(store, "articles_latest"), *WINDOW, "needle")
    # one day's files are opened, of nine
    assert len(latest.select(F.input_file_name()).distinct().collect()) == 1


def test_days_that_changed_since_are_searched_until_indexed(spark, lake):
    titles.index_titles(spark, lake)
    # a/1 gets another title, a/2 moves to the 8th, a/10 is new
    changed = raw_rows(spark, [
        dict(guardian_id="a/1", web_title="Needle found", published_at=ts("2026-03-01T10:00:00")),
        dict(guardian_id="a/2", web_title="Moved needle", published_at=ts("2026-03-08T10:00:00"))])
    changed = changed.withColumn("ingested_at", F.lit(ts("2026-03-21T06:00:00")))
    landing.append_raw(TableStore(spark, lake), changed)
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    assert found(spark, lake, "needle") == ["a/1", "a/2", "a/9"]
    assert days(spark, lake, "absent!") == [date(2026, 3, 1), date(2026, 3, 8)]
    # the 1st and the 8th have other folders; the 2nd is gone
    assert titles.index_titles(spark, lake) == 3
    assert days(spark, lake, "absent!") == []
    assert found(spark, lake, "needle") == ["a/1", "a/2", "a/9"] and found(spark, lake, "50%off") == []


def test_a_job_that_dies_loses_nothing(spark, lake, monkeypatch):
    titles.index_titles(spark, lake)
    landing.append_raw(TableStore(spark, lake), articles(spark, {3: "Needle"}, "2026-03-22T06:00:00"))
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    whole = TableStore.replace

    def dies(self, df, dataset, table, **kw):
        if table == titles.INDEXED:
            raise OSError("lost")
        return whole(self, df, dataset, table, **kw)

    with monkeypatch.context() as m:
        m.setattr(TableStore, "replace", dies)
        with pytest.raises(OSError):
            titles.index_titles(spark, lake)
    assert found(spark, lake, "needle") == ["a/3", "a/9"]
    assert titles.index_titles(spark, lake) == 1 and found(spark, lake, "needle") == ["a/3", "a/9"]
    # a full refresh writes new folders: all are searched, then indexed again
    assert refresh.run_transforms(spark, lake).status == "materialized"
    assert len(days(spark, lake, "absent!")) == 9 and titles.index_titles(spark, lake) == 9
    assert found(spark, lake, "needle") == ["a/3", "a/9"]


def test_two_runs_at_once(spark, lake, monkeypatch):
    titles.index_titles(spark, lake)
    landing.append_raw(TableStore(spark, lake), articles(spark, {4: "Needle"}, "2026-03-22T06:00:00"))
    assert refresh.run_transforms(spark, lake, incremental=True).status == "materialized"
    listed = titles._indexed

    def other_first(store):
        monkeypatch.setattr(titles, "_indexed", listed)
        titles.index_titles(spark, lake)
        return listed(store) | {"2026-03-04": "older"}

    monkeypatch.setattr(titles, "_indexed", other_first)
    with pytest.raises(Conflict):
        titles.index_titles(spark, lake)
    assert found(spark, lake, "needle") == ["a/4", "a/9"] and days(spark, lake, "absent!") == []


def test_a_table_that_changes_meanwhile_is_searched_whole(spark, lake):
    titles.index_titles(spark, lake)
    store = TableStore(spark, lake)

    def articles_later():
        landing.append_raw(store, articles(spark, {6: "Needle"}, "2026-03-23T06:00:00"))
        refresh.run_transforms(spark, lake, incremental=True)
        return refresh.read_analytics(store, "articles_latest")

    latest = titles.narrowed(store, articles_later, *WINDOW, "needle")
    assert sorted(r[0] for r in q.search_filter(latest, *WINDOW, query_text="needle").select("guardian_id").collect()) == ["a/6", "a/9"]


def test_no_titles_at_all(spark, scratch):
    lake = Lake(tempfile.mkdtemp(prefix="titles-", dir=scratch))
    store = TableStore(spark, lake)
    landing.append_raw(store, articles(spark, {1: None, 2: "ab"}))
    refresh.run_transforms(spark, lake)
    assert titles.index_titles(spark, lake) == 2
    assert store.current(ANALYTICS, titles.GRAMS) is not None
    assert found(spark, lake, "abc") == [] and found(spark, lake, "ab") == ["a/2"] and days(spark, lake, "abc") == []
