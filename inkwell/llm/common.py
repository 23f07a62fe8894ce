"""Shared folder, lineage cuts and connected components.

Everything that outlives a stage is written as a Parquet table below the
folder the cluster names in ``spark.checkpoint.dir``, which all executors
share. A lost executor therefore re-runs only the stage at hand.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own (tests); any
    other session is refused, because a machine-local folder would be
    invisible to the other machines.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_inkwell_shared", None)
    if current:
        return current.rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    # a running session's setting cannot be changed, so the context remembers it
    sc._inkwell_shared = tempfile.mkdtemp(prefix="inkwell-shared-")
    return sc._inkwell_shared


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new table path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder, one folder for each value of ``folders``, and
    read it back: the lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(sc: SparkContext) -> None:
    """Give the executors' Python this package, once per context.

    Spark serves the archive from the driver, so a cluster needs no installed
    copy and no shared working folder.
    """
    if getattr(sc, "_inkwell_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="inkwell-ship-")) / "inkwell.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._inkwell_shipped = True


# Texts may be long: an Arrow batch of Spark's default 10,000 of them takes
# hundreds of MB outside the heap while it grows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors; every column
    may be null. Batch sizes that the session leaves unset are set to what
    suits long texts."""
    ship(df.sparkSession.sparkContext)
    conf = df.sparkSession.conf
    for key, size in BATCH.items():
        if conf.get(key, None) is None:
            conf.set(key, size)
    if isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return df.mapInArrow(function, schema)


def text_of(column: str = "text"):
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a``, ``b``), the
    component being its smallest node.

    Alternates the large-star and the small-star step: every node sends its
    neighbours to its smallest neighbour, first the larger ones, then the
    smaller ones, until nothing changes. Each step is one ``min`` aggregate
    with partial sums before the shuffle and one join with its result, so a
    node with very many neighbours costs no list and no pair of neighbours.
    Each round is written to the shared folder. Edges with a null end and
    loops are ignored; a repeated edge counts once.
    """
    now = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
           .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now = materialize(now, f"{name}-edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        now = materialize(_small_star(_large_star(now)), f"{name}-round")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge leads from a node straight to its component's smallest node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge already points from the larger to the smaller node
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return (joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
