"""Warehouse tables on plain Parquet in a shared folder.

Replace tables (``CREATE OR REPLACE TABLE``) are written to a fresh
``version=<id>`` directory and become visible only once Spark's committer has
written its ``_SUCCESS`` marker, so readers never see a half-written table and
a rebuild may read the version it replaces. Append tables (raw, quarantine,
ledgers) get one ``batch=<id>`` directory per load; a replayed load that reuses
its batch id overwrites itself, which makes stream batches idempotent, and a
batch is read only once its marker is there.

A partitioned table can also be changed a few partitions at a time: the new
partitions go to a ``version=<id>-patch`` directory, and a ``state=<id>``
listing then names the directory of every partition of the table. The listing
is published by its marker, last of all; nothing that a reader may see is
changed in place, so a run that dies at any point leaves the table as it was.
A partition may also get a further directory (``add_partitions``).

A writer that read a table before it changes it names what it read (``base``,
from ``head``). Just before publishing it creates, without overwriting, a claim
on that base: of two writers on the same base, the second gets a ``Conflict``
and has to read and change the table again. No update is lost.

Ids sort by time, so "latest committed version" is the greatest name with a
marker. Listing uses the Hadoop FileSystem of the session, so the same code
runs on a local disk, HDFS or an object store.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkwell.config import Lake

VERSION, BATCH, STATE = "version", "batch", "state"
PATCH_SUFFIX = "-patch"
MARKER = "_SUCCESS"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
# Distinct keys expected per row group (~128 MB of article rows); sizes the
# bloom filters to about 1% false positives without overshooting.
BLOOM_NDV = 200_000
CLAIMS = "_claims"
# Seconds after which a claim without its publication counts as left by a dead writer.
STALE_CLAIM = 600.0


class Conflict(RuntimeError):
    """Another writer published on top of the same version first."""


def new_id() -> str:
    """Time-sortable unique id for a version or batch directory."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class TableStore:
    def __init__(self, spark: SparkSession, lake: Lake):
        self.spark = spark
        self.lake = lake
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        # one file system for all paths of a lake
        self._fs = self._path(lake.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ filesystem
    def _fs_path(self, path: str):
        return self._fs, self._path(path)

    def _marked(self, root: str, prefix: str) -> list[str]:
        """Names of the committed directories: one listing, not a look at each."""
        found = self._fs.globStatus(self._path(f"{root}/{prefix}=*/{MARKER}")) or []
        return sorted(s.getPath().getParent().getName() for s in found)

    def _children(self, path: str, prefix: str) -> list[str]:
        fs, p = self._fs_path(path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(prefix + "="))

    def _committed(self, path: str) -> bool:
        fs, p = self._fs_path(f"{path}/{MARKER}")
        return bool(fs.exists(p))

    def delete(self, path: str) -> None:
        fs, p = self._fs_path(path)
        if fs.exists(p):
            fs.delete(p, True)

    # ------------------------------------------------------------- versions
    def table_path(self, dataset: str, table: str) -> str:
        return self.lake.path(dataset, table)

    def versions(self, dataset: str, table: str) -> list[str]:
        root = self.table_path(dataset, table)
        return [f"{root}/{name}" for name in self._marked(root, VERSION) if not name.endswith(PATCH_SUFFIX)]

    def current(self, dataset: str, table: str) -> str | None:
        """The newest committed whole version (a later state may refer to it)."""
        committed = self.versions(dataset, table)
        return committed[-1] if committed else None

    def _states(self, dataset: str, table: str) -> list[str]:
        return self._marked(self.table_path(dataset, table), STATE)

    def _state(self, dataset: str, table: str) -> str | None:
        """The newest state, where it is newer than the newest whole version."""
        states = self._states(dataset, table)
        current = self.current(dataset, table) if states else None
        if current is None:
            return None
        newest = current.rsplit("/", 1)[1].split("=", 1)[1]
        return states[-1] if states[-1].split("=", 1)[1] > newest else None

    def _state_entries(self, dataset: str, table: str, state: str) -> list[tuple[str, str]]:
        """(``version=…/column=value``, tag) of every partition directory in a state. A
        listing is a line per directory: read as it is, not by a Spark job."""
        fs, path = self._fs_path(f"{self.table_path(dataset, table)}/{state}")
        parts = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
        lines = [line for part in parts for line in self._text(fs, part).splitlines() if line]
        return sorted(tuple(f"{line}\t".split("\t")[:2]) for line in lines)

    def _state_folders(self, dataset: str, table: str, state: str) -> list[str]:
        return [folder for folder, _ in self._state_entries(dataset, table, state)]

    def _entries(self, dataset: str, table: str, column: str) -> list[tuple[str, str]]:
        state, current = self._state(dataset, table), self.current(dataset, table)
        if state is not None:
            return self._state_entries(dataset, table, state)
        if current is None:
            return []
        version = current.rsplit("/", 1)[1]
        return [(f"{version}/{name}", "") for name in self._children(current, column)]

    def partition_folders(self, dataset: str, table: str, column: str) -> list[str]:
        """``version=…/column=value`` of every directory that makes up the table now."""
        return [folder for folder, _ in self._entries(dataset, table, column)]

    # ---------------------------------------------------------- conflicts
    def newest_tag(self, dataset: str, table: str, column: str) -> str:
        """Tag of the directory written last."""
        return max(self._entries(dataset, table, column), default=("", ""))[1]

    def tag_all(self, dataset: str, table: str, column: str, tag: str) -> None:
        """Publish the table as it is, every directory under ``tag``."""
        self._publish(dataset, table, new_id(), [f"{f}\t{tag}" for f in self.partition_folders(dataset, table, column)])

    def head(self, dataset: str, table: str) -> str:
        """Name of what a reader sees now: the newest state or version."""
        state, current = self._state(dataset, table), self.current(dataset, table)
        return state or (current.rsplit("/", 1)[1] if current else "none")

    def _claim(self, dataset: str, table: str, base: str, name: str) -> None:
        """Win the right to publish ``name`` on top of ``base``, or raise ``Conflict``."""
        root = self.table_path(dataset, table)
        if self.head(dataset, table) != base:
            raise Conflict(f"{root}: {base} is no longer the newest version")
        fs, path = self._fs_path(f"{root}/{CLAIMS}/{base}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            holder, age = self._text(fs, path), time.time() - fs.getFileStatus(path).getModificationTime() / 1000
            if self._committed(f"{root}/{holder}") or age < STALE_CLAIM:
                raise Conflict(f"{root}: {holder} was written on top of {base} at the same time") from e
            out = fs.create(path, True)  # its writer died before it published
        out.write(bytearray(name.encode()))
        out.close()
        if self._text(fs, path) != name:
            raise Conflict(f"{root}: the claim on {base} was taken over")

    def _text(self, fs, path) -> str:
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, dataset: str, table: str) -> bool:
        return self.current(dataset, table) is not None or bool(self.batches(dataset, table))

    def replace(self, df: DataFrame, dataset: str, table: str, *,
                partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (),
                bloom_filters: Sequence[str] = (), rebalance: bool = True, keep: int = 2,
                base: str | None = None) -> str:
        """SNK-1: write a new version; older ones beyond ``keep`` are dropped.
        With ``base`` only if that is still the newest version (``Conflict``).

        Partitioned tables are rebalanced on the partition column first: AQE
        splits a hot day over several writers and merges thin days, so file
        sizes stay near the advisory size whatever the skew, and a day is not
        scattered over every task of the upstream shuffle (files = days x
        splits, not days x tasks). Rows are sorted by the clustering columns
        inside each file for min/max skipping.

        ``rebalance=False`` is for inputs already laid out one day per task
        (an incremental pass over the previous version's files).

        ``bloom_filters`` adds a Parquet bloom filter per row group on those
        columns, for equality lookups by a key the layout does not sort by.

        Unpartitioned tables (the rollups) keep the partitioning of the
        aggregate that produced them and are only sorted inside each file by
        the clustering columns: Parquet row-group statistics then skip other
        dates without a sampling job or another shuffle.
        """
        path = f"{self.table_path(dataset, table)}/{VERSION}={new_id()}"
        if partition_by:
            out = df.hint("rebalance", *partition_by) if rebalance else df
            out = out.sortWithinPartitions(*partition_by, *cluster_by)
        else:
            out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
        writer = out.write.mode("errorifexists")
        for column in bloom_filters:
            # point lookups on a column the files are not sorted by: the
            # reader skips row groups whose filter rules the value out
            writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                      .option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_NDV)))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if base is None:
            writer.parquet(path)
        else:
            writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        if partition_by and not self._children(path, partition_by[0]):
            # no rows, no folders: one empty file, so that the table has its columns
            (self.spark.createDataFrame([], df.schema).coalesce(1).write.mode("append")
             .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path))
        if base is not None:
            self._publishing(path, lambda: self._claim(dataset, table, base, path.rsplit("/", 1)[1]))
            fs, marker = self._fs_path(f"{path}/{MARKER}")
            fs.create(marker, True).close()
        self._vacuum(dataset, table, keep)
        return path

    def _publishing(self, written: str, publish) -> None:
        """``publish``; what a writer that lost has written goes."""
        try:
            publish()
        except Conflict:
            self.delete(written)
            raise

    def replace_partitions(self, df: DataFrame, dataset: str, table: str, *, partition_by: str,
                           values: Sequence, cluster_by: Sequence[str] = (),
                           bloom_filters: Sequence[str] = (), tag: str = "", keep: int = 2,
                           base: str | None = None) -> None:
        """Replace the ``values`` partitions; those without rows go.

        The other partitions are neither read nor copied: the state that is
        published at the end refers to their files. Before that, readers see
        the table as it was; a failed job publishes nothing.
        """
        replaced = {f"{partition_by}={NULL_PARTITION if v is None else v}" for v in values}
        self._patch(df, dataset, table, partition_by, lambda name, _, written: name in replaced or name in written,
                    tag=tag, cluster_by=cluster_by, bloom_filters=bloom_filters, keep=keep, base=base)

    def add_partitions(self, df: DataFrame, dataset: str, table: str, *, partition_by: str, tag: str = "",
                       cluster_by: Sequence[str] = (), keep: int = 2, base: str | None = None) -> None:
        """Add rows as further directories of their partitions; directories added
        earlier under the same ``tag`` go."""
        self._patch(df, dataset, table, partition_by, lambda _, other, __: bool(tag) and other == tag,
                    tag=tag, cluster_by=cluster_by, keep=keep, base=base)

    def _patch(self, df: DataFrame, dataset: str, table: str, partition_by: str, gone, *, tag: str = "",
               cluster_by: Sequence[str] = (), bloom_filters: Sequence[str] = (), keep: int = 2,
               base: str | None = None) -> None:
        """Write the rows to a patch, then publish a state of it and of the
        directories that are not ``gone`` (partition, tag, partitions written)."""
        if self.current(dataset, table) is None:
            raise FileNotFoundError(self.table_path(dataset, table))
        root, new = self.table_path(dataset, table), new_id()
        version = f"{VERSION}={new}{PATCH_SUFFIX}"
        out = df.hint("rebalance", partition_by).sortWithinPartitions(partition_by, *cluster_by)
        writer = out.write.mode("errorifexists")
        for column in bloom_filters:
            writer = (writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                      .option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_NDV)))
        writer.partitionBy(partition_by).parquet(f"{root}/{version}")
        written = self._children(f"{root}/{version}", partition_by)
        entries = [(f, t) for f, t in self._entries(dataset, table, partition_by) if not gone(f.split("/", 1)[1], t, written)]
        entries += [(f"{version}/{name}", tag) for name in written]
        if base is not None:
            self._publishing(f"{root}/{version}", lambda: self._claim(dataset, table, base, f"{STATE}={new}"))
        self._publish(dataset, table, new, [f"{f}\t{t}" if t else f for f, t in entries])
        self._vacuum(dataset, table, keep)

    def _publish(self, dataset: str, table: str, state: str, folders: list[str]) -> None:
        root = f"{self.table_path(dataset, table)}/{STATE}={state}"
        fs, listing = self._fs_path(f"{root}/part-00000")
        out = fs.create(listing, False)
        out.write(bytearray("\n".join(sorted(folders)).encode()))
        out.close()
        fs.create(self._fs_path(f"{root}/{MARKER}")[1], True).close()

    def partition_values(self, dataset: str, table: str, column: str) -> list:
        """Values of a partition column (None for the null partition)."""
        values = [f.rsplit("=", 1)[1] for f in self.partition_folders(dataset, table, column)]
        return [None if v == NULL_PARTITION else v for v in values]

    def _vacuum(self, dataset: str, table: str, keep: int) -> None:
        """Drop what neither the newest ``keep`` whole versions nor the newest
        ``keep`` states refer to. Directories newer than all of these are left
        alone: another run may be writing them."""
        if keep <= 0:
            return
        root = self.table_path(dataset, table)
        states, whole = self._states(dataset, table), [v.rsplit("/", 1)[1] for v in self.versions(dataset, table)]
        if not whole:
            return
        id_of = lambda name: name.split("=", 1)[1].removesuffix(PATCH_SUFFIX)
        # states older than the newest whole version can no longer be current
        live = [x for x in states if id_of(x) > id_of(whole[-1])][-keep:]
        used = set(whole[-keep:]) | {f.split("/", 1)[0] for x in live for f in self._state_folders(dataset, table, x)}
        newest = max(map(id_of, [*whole, *states]))
        for name in self._children(root, VERSION):
            if name not in used and id_of(name) < newest:
                self.delete(f"{root}/{name}")
        for name in states:
            if name not in live:
                self.delete(f"{root}/{name}")
        fs, claims = self._fs_path(f"{root}/{CLAIMS}")
        if fs.exists(claims):  # a claim on what no reader can hold any more
            for status in fs.listStatus(claims):
                name = status.getPath().getName()
                if name not in used and name not in live and name != "none" and id_of(name) < newest:
                    fs.delete(status.getPath(), False)

    # -------------------------------------------------------------- batches
    def batch_ids(self, dataset: str, table: str) -> list[str]:
        """Ids of the batch directories (one listing of the table root)."""
        root = self.table_path(dataset, table)
        return [name.split("=", 1)[1] for name in self._children(root, BATCH)]

    def batch_committed(self, dataset: str, table: str, batch_id: str) -> bool:
        return self._committed(f"{self.table_path(dataset, table)}/{BATCH}={batch_id}")

    def committed_batch_ids(self, dataset: str, table: str) -> list[str]:
        """Ids of the batches whose load committed, from one glob listing
        (not one existence check per batch)."""
        return [name.split("=", 1)[1] for name in self._marked(self.table_path(dataset, table), BATCH)]

    def delete_batch(self, dataset: str, table: str, batch_id: str) -> None:
        self.delete(f"{self.table_path(dataset, table)}/{BATCH}={batch_id}")

    def batches(self, dataset: str, table: str) -> list[str]:
        root = self.table_path(dataset, table)
        return [f"{root}/{name}" for name in self._marked(root, BATCH)]

    def append(self, df: DataFrame, dataset: str, table: str, *, batch_id: str | None = None,
               partition_by: Sequence[str] = ()) -> str:
        """SRC-5: one batch directory per load; same id → same directory."""
        path = f"{self.table_path(dataset, table)}/{BATCH}={batch_id or new_id()}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    # ----------------------------------------------------------------- read
    def read(self, dataset: str, table: str, schema: StructType | None = None,
             columns: Sequence[str] | None = None,
             partitions: StructType | None = None, where: Column | None = None) -> DataFrame:
        """Current version of a replace table, or all batches of an append
        table; an absent table reads as empty with ``schema``.

        An append table is read as one partitioned dataset rooted at the
        table: Spark lists the ``batch=`` directories (in parallel on the
        cluster once there are many) and ``where`` on the ``partitions``
        columns below the batch level prunes directories before any file is
        opened. Batches without their marker (a load that died) are filtered
        out by name; there are only ever a few of them.
        """
        current = self.current(dataset, table)
        state = self._state(dataset, table)
        root = self.table_path(dataset, table)
        if state is not None:
            folders = self._state_folders(dataset, table, state)
            if folders:
                reader = self.spark.read.option("basePath", root)
                if schema is not None and partitions is not None:
                    reader = reader.schema(StructType([*schema.fields, StructField(VERSION, StringType(), True), *partitions.fields]))
                df = reader.parquet(*[f"{root}/{f}" for f in folders]).drop(VERSION)
            elif schema is not None and partitions is not None:
                df = self.spark.createDataFrame([], StructType([*schema.fields, *partitions.fields]))
            else:
                df = self.spark.read.parquet(current).limit(0)
        elif current is not None and schema is not None and partitions is not None:
            df = self.spark.read.schema(StructType([*schema.fields, *partitions.fields])).parquet(current)
        elif current is not None:
            df = self.spark.read.parquet(current)
        else:
            found = self.batch_ids(dataset, table)
            committed = set(self.committed_batch_ids(dataset, table))
            if not committed:
                if schema is None:
                    raise FileNotFoundError(root)
                empty = StructType([StructField(BATCH, StringType(), True), *schema.fields,
                                    *(partitions.fields if partitions else [])])
                df = self.spark.createDataFrame([], empty)
                return df.select(*columns) if columns else df.select(*schema.fieldNames())
            reader = self.spark.read.option("basePath", root)
            if schema is not None:
                extra = [StructField(BATCH, StringType(), True), *(partitions.fields if partitions else [])]
                reader = reader.schema(StructType([*schema.fields, *extra]))
            df = reader.parquet(root)
            if unfinished := [b for b in found if b not in committed]:
                df = df.filter(~F.col(BATCH).cast("string").isin(*unfinished))
            if where is not None:
                df = df.filter(where)
        if columns:
            df = df.select(*columns)
        elif schema is not None:
            df = df.select(*schema.fieldNames())
        return df

    def rows(self, dataset: str, table: str, schema: StructType, partitions: StructType | None = None) -> DataFrame:
        """Every row that lies in an append table, with its ``batch``: also of loads
        that never ended. What counts is for the caller to join."""
        root = self.table_path(dataset, table)
        whole = StructType([*schema.fields, StructField(BATCH, StringType(), True), *(partitions.fields if partitions else [])])
        fs, path = self._fs_path(root)
        if not fs.exists(path):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.option("basePath", root).schema(whole).parquet(root)

    def ensure(self, dataset: str, table: str, schema: StructType) -> bool:
        """SRC-7: create an empty committed version if the table is absent."""
        if self.exists(dataset, table):
            return False
        path = f"{self.table_path(dataset, table)}/{VERSION}={new_id()}"
        self.spark.createDataFrame([], schema).write.parquet(path)
        return True
