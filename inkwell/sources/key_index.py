"""Where every key of a partitioned table lives, so that a merge or a lookup
reads only those partitions.

One narrow row per key and change: the key, the partition (``place``) that
holds its row, the one that held it before, and how many rows were loaded for
it. Rows are dealt into hash buckets of the key, sorted by key inside each file.
A run *adds a layer*: it writes the rows of its own keys only, whatever the
size of the index, and publishes them with the layers before. The newest row of
a key (``seq``) holds its place; loads add up over layers. A bucket with many
layers is folded into one.

Each layer of a run carries the run's ``tag``. A run that died after its layer
and is done over again publishes the same tag, which replaces the layer: loads
never count twice. Two runs that add at the same time do not lose a layer: the
second adds its own on top of the first's (``Conflict``, then again).

The number of buckets is fixed by a rebuild from the number of keys and is
part of each bucket's name (``3of64``).
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, LongType, StringType, StructField, StructType

from inkwell.sources.store import Conflict, TableStore

KEYS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 4096
MOST_LAYERS = 8
ATTEMPTS = 5
BUCKET = "bucket"


def build(latest: DataFrame, raw: DataFrame, key: Column, place: str, loaded: Column) -> DataFrame:
    """``key``, ``place`` and ``loads`` from the table and the rows it was made of;
    ``loaded`` says which of those count as loads. The null key is a key."""
    rows = latest.select(key.alias("key"), F.col(place).alias("place"), F.lit(0).cast("long").alias("loads")).unionByName(
        raw.select(key.alias("key"), F.lit(None).cast(latest.schema[place].dataType).alias("place"),
                   F.when(loaded, 1).otherwise(0).cast("long").alias("loads")))
    # a key has one row in the table, so at most one place
    return rows.groupBy("key").agg(F.max("place").alias("place"), F.sum("loads").alias("loads"))


def layer(latest: DataFrame, raw: DataFrame, known: DataFrame, key: Column, place: str, loaded: Column) -> DataFrame:
    """The rows of one run: its keys' new places, the places before (of ``known``,
    with ``key`` and ``place``) and its loads."""
    return build(latest, raw, key, place, loaded).unionByName(
        known.select("key", F.col("place").alias("before")), allowMissingColumns=True).groupBy("key").agg(
        F.max("place").alias("place"), F.max("before").alias("before"), F.sum("loads").alias("loads"))


def folded(layers: DataFrame) -> DataFrame:
    """One row per key: newest place and the one before it, all loads."""
    newest = F.max(F.struct("seq", "place", "before")).alias("_n")
    return layers.groupBy("key").agg(newest, F.sum("loads").alias("loads")).select(
        "key", F.col("_n.place").alias("place"), F.col("_n.before").alias("before"), "loads", F.col("_n.seq").alias("seq"))


class KeyIndex:
    def __init__(self, store: TableStore, dataset: str, table: str, place_type: DataType | None = None,
                 most_layers: int = MOST_LAYERS):
        self.store, self.dataset, self.table, self.most_layers = store, dataset, table, most_layers
        kind = place_type or DateType()
        self.schema = StructType([StructField("key", StringType(), True), StructField("place", kind, True),
                                  StructField("before", kind, True), StructField("loads", LongType(), True),
                                  StructField("seq", LongType(), True)])

    def exists(self) -> bool:
        return self.store.current(self.dataset, self.table) is not None

    def _buckets(self) -> list[str]:
        return [f.rsplit("=", 1)[1] for f in self.store.partition_folders(self.dataset, self.table, BUCKET)]

    def _count(self) -> int:
        """How many buckets there are; an index without rows has one."""
        return next((int(b.split("of")[1]) for b in self._buckets()), 1)

    @staticmethod
    def _bucket(key: Column, n: int) -> Column:
        return F.concat(F.pmod(F.xxhash64(key), F.lit(n)).cast("string"), F.lit(f"of{n}"))

    def _dealt(self, rows: DataFrame, n: int, seq: int | None) -> DataFrame:
        before = F.col("before") if "before" in rows.columns else F.lit(None).cast(self.schema["before"].dataType)
        return rows.select("key", "place", before.alias("before"), "loads",
                           F.lit(time.time_ns() if seq is None else seq).alias("seq"), self._bucket(F.col("key"), n).alias(BUCKET))

    def rebuild(self, rows: DataFrame, keys: int, tag: str = "", seq: int | None = None) -> None:
        n = min(MOST_BUCKETS, max(1, math.ceil(keys / KEYS_PER_BUCKET)))
        self.store.replace(self._dealt(rows, n, seq), self.dataset, self.table, partition_by=(BUCKET,), cluster_by=("key",))
        if tag:
            self.store.tag_all(self.dataset, self.table, BUCKET, tag)

    def newest_tag(self) -> str:
        return self.store.newest_tag(self.dataset, self.table, BUCKET)

    def add(self, rows: DataFrame, tag: str = "", seq: int | None = None) -> None:
        """Publish a layer; an earlier one of the same tag goes. ``seq`` orders
        layers where the time of writing does not."""
        dealt = self._dealt(rows, self._count(), seq)
        for attempt in range(ATTEMPTS):
            try:
                return self.store.add_partitions(dealt, self.dataset, self.table, partition_by=BUCKET, cluster_by=("key",),
                                                 tag=tag, base=self.store.head(self.dataset, self.table))
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise

    def fold(self) -> int:
        """Fold the buckets of more than ``most_layers`` layers; how many that were."""
        buckets = self._buckets()
        many = sorted({b for b in buckets if buckets.count(b) > self.most_layers})
        if many:
            rows = folded(self.layers().where(F.col(BUCKET).isin(*many)))
            self.store.replace_partitions(
                rows.select(*self.schema.fieldNames(), self._bucket(F.col("key"), self._count()).alias(BUCKET)),
                self.dataset, self.table, partition_by=BUCKET, values=many, cluster_by=("key",), tag=self.newest_tag(),
                base=self.store.head(self.dataset, self.table))
        return len(many)

    def layers(self) -> DataFrame:
        return self.store.read(self.dataset, self.table, schema=self.schema,
                               partitions=StructType([StructField(BUCKET, StringType(), True)]),
                               columns=[*self.schema.fieldNames(), BUCKET])

    def read(self) -> DataFrame:
        return folded(self.layers())

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """``key`` and ``place`` of those of ``keys`` (distinct, column ``key``) that the index
        knows. Only the buckets of these keys are opened, of which there are
        at most as many as the index has."""
        n = self._count()
        buckets = keys.select(self._bucket(F.col("key"), n).alias(BUCKET)).distinct().collect() if n > 1 else []
        rows = self.layers()
        if buckets:
            rows = rows.where(F.col(BUCKET).isin(*[r[0] for r in buckets]))
        mine = rows.join(keys.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        return folded(mine).select("key", "place")

    def places_of(self, key: str | None) -> list:
        """Every partition that may hold the row of one key: one bucket is opened,
        and of its files only the row groups around the key."""
        literal = F.lit(key).cast("string")
        rows = self.layers().where((F.col(BUCKET) == self._bucket(literal, self._count())) & F.col("key").eqNullSafe(literal))
        found = rows.select("place", "before").collect()
        # a reader may hold the table as it was before the newest layer
        return list({r["place"] for r in found} | {r["before"] for r in found if r["before"] is not None})
