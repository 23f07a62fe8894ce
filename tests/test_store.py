"""The versioned table store: atomic versions, vacuum, batches, partition swaps."""

from __future__ import annotations

import os
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from inkwell.config import Lake
from inkwell.sources.store import TableStore


def _rows(df):
    return sorted((r["x"], str(r["d"])) for r in df.collect())


def test_versions_commit_and_vacuum(spark, scratch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    for i in range(4):
        store.replace(spark.createDataFrame([(i,)], "x int"), "a", "t")
    assert len(store.versions("a", "t")) == 2
    assert store.read("a", "t").first()["x"] == 3
    # a version without its commit marker is never read
    os.makedirs(store.table_path("a", "t") + "/version=99999999999999999999-zzzzzzzz")
    assert store.read("a", "t").first()["x"] == 3


def test_batches_replay_and_committed_listing(spark, scratch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    df = spark.createDataFrame([(1,), (2,)], "x int")
    store.append(df, "r", "t", batch_id="b1")
    store.append(df, "r", "t", batch_id="b1")            # replay rewrites itself
    store.append(df.limit(1), "r", "t", batch_id="b2")
    os.makedirs(store.table_path("r", "t") + "/batch=b3/_temporary/0")   # an uncommitted load
    assert store.committed_batch_ids("r", "t") == ["b1", "b2"]
    assert store.batch_ids("r", "t") == ["b1", "b2", "b3"]
    from pyspark.sql.types import IntegerType, StructField, StructType

    assert store.read("r", "t", schema=StructType([StructField("x", IntegerType())])).count() == 3


def test_partition_swap_replaces_and_removes_emptied_days(spark, scratch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    base = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None), (4, "2024-01-03")],
                                 "x int, d string").withColumn("d", F.to_date("d"))
    store.replace(base, "a", "p", partition_by=("d",))
    change = spark.createDataFrame([(20, "2024-01-02")], "x int, d string").withColumn("d", F.to_date("d"))
    store.replace_partitions(change, "a", "p", partition_by="d",
                               values=[date(2024, 1, 2), date(2024, 1, 3), None])
    assert _rows(store.read("a", "p")) == [(1, "2024-01-01"), (20, "2024-01-02")]


def test_a_swap_that_dies_leaves_the_table_as_it_was(spark, scratch, monkeypatch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    base = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, d string").withColumn("d", F.to_date("d"))
    store.replace(base, "a", "p", partition_by=("d",))
    change = spark.createDataFrame([(20, "2024-01-02")], "x int, d string").withColumn("d", F.to_date("d"))

    def die(*args):
        raise RuntimeError("died between the data and the state")

    with monkeypatch.context() as m:
        m.setattr(TableStore, "_publish", die)
        with pytest.raises(RuntimeError):
            store.replace_partitions(change, "a", "p", partition_by="d", values=[date(2024, 1, 2)])
    # a state without its marker is not read either
    os.makedirs(store.table_path("a", "p") + "/state=99999999999999999999-zzzzzzzz")
    assert _rows(store.read("a", "p")) == [(1, "2024-01-01"), (2, "2024-01-02")]
    for x in (21, 22, 23):
        store.replace_partitions(change.withColumn("x", F.lit(x)), "a", "p", partition_by="d", values=[date(2024, 1, 2)])
        assert _rows(store.read("a", "p")) == [(1, "2024-01-01"), (x, "2024-01-02")]
    left = [n for n in os.listdir(store.table_path("a", "p")) if n.startswith("version=")]
    assert len(left) == 3                       # the base and the patches of the last two states
    store.replace(base, "a", "p", partition_by=("d",))
    assert _rows(store.read("a", "p")) == [(1, "2024-01-01"), (2, "2024-01-02")]


def test_uncommitted_batches_are_not_read(spark, scratch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    schema = spark.createDataFrame([(1,)], "x int").schema
    for b in ("b1", "b2"):
        store.append(spark.createDataFrame([(1,)], schema), "r", "t", batch_id=b)
    os.remove(store.table_path("r", "t") + "/batch=b2/_SUCCESS")      # the files moved, the marker did not come
    assert store.read("r", "t", schema=schema).count() == 1
    os.remove(store.table_path("r", "t") + "/batch=b1/_SUCCESS")
    assert store.read("r", "t", schema=schema).count() == 0


def test_of_two_writers_on_one_version_the_second_conflicts(spark, scratch):
    import time

    from inkwell.sources import store as module

    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    one = lambda x: spark.createDataFrame([(x,)], "x int")
    assert store.head("a", "t") == "none"
    store.replace(one(1), "a", "t", base="none")
    base = store.head("a", "t")
    store.replace(one(2), "a", "t", base=base)
    for stale in (base, "none"):
        with pytest.raises(module.Conflict):
            store.replace(one(3), "a", "t", base=stale)
    assert [r["x"] for r in store.read("a", "t").collect()] == [2]
    # both have read the same version; the other one has claimed it and not published yet
    base = store.head("a", "t")
    store._claim("a", "t", base, "version=00000000000000000009-dead")
    with pytest.raises(module.Conflict):
        store.replace(one(4), "a", "t", base=base)
    assert len([n for n in os.listdir(store.table_path("a", "t")) if n.startswith("version=")]) == 2   # the loser left nothing
    # a claim whose writer died is taken over after a while
    claim = f"{store.table_path('a', 't')}/{module.CLAIMS}/{base}"
    os.utime(claim, (time.time() - 2 * module.STALE_CLAIM,) * 2)
    store.replace(one(5), "a", "t", base=base)
    assert [r["x"] for r in store.read("a", "t").collect()] == [5]


def test_added_partitions_and_tags(spark, scratch):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="store-", dir=scratch)))
    row = lambda x, d: spark.createDataFrame([(x, d)], "x int, d string")
    read = lambda: sorted(tuple(r) for r in store.read("a", "p", schema=StructType([StructField("x", IntegerType())]),
                          partitions=StructType([StructField("d", StringType())]), columns=["x", "d"]).collect())
    store.replace(row(1, "k"), "a", "p", partition_by=("d",))
    store.add_partitions(row(2, "k"), "a", "p", partition_by="d", tag="run 1")
    store.add_partitions(row(3, "m"), "a", "p", partition_by="d", tag="run 2")
    assert read() == [(1, "k"), (2, "k"), (3, "m")] and store.newest_tag("a", "p", "d") == "run 2"
    store.add_partitions(row(4, "k"), "a", "p", partition_by="d", tag="run 2")        # done over again
    assert read() == [(1, "k"), (2, "k"), (4, "k")]
    store.replace_partitions(row(5, "k"), "a", "p", partition_by="d", values=["k"])
    assert read() == [(5, "k")]
    with pytest.raises(Exception, match="no longer the newest"):
        store.add_partitions(row(6, "k"), "a", "p", partition_by="d", base="none")


def test_a_partitioned_table_without_rows_has_its_columns(spark, scratch):
    store = TableStore(spark, Lake(tempfile.mkdtemp(prefix="empty-", dir=scratch)))
    rows = spark.createDataFrame([(1, "a")], "n long, day string")
    for base in (None, "none"):
        table = f"t{base}"
        store.replace(rows.limit(0), "d", table, partition_by=("day",), base=base)
        assert store.read("d", table).columns == ["n", "day"] and store.read("d", table).count() == 0
        store.replace_partitions(rows, "d", table, partition_by="day", values=["a"])
        assert [tuple(r) for r in store.read("d", table).collect()] == [(1, "a")]
        store.replace_partitions(rows.limit(0), "d", table, partition_by="day", values=["a"])
        assert store.read("d", table).columns == ["n", "day"] and store.read("d", table).count() == 0
