"""Embedding near-duplicates: random hyperplanes, exact cosine, components.

Each vector gets one sign signature per table: ``bits`` signs of products with
random hyperplanes of a fixed seed. Vectors with equal signatures in some
table are candidates, and every candidate pair is checked by its cosine in
double precision. At cosine 0.95 a sign agrees with probability 0.899, so one
of 24 tables of 14 bits agrees with probability 0.998, and with more above. Bits
grow with the logarithm of the rows, so that a bucket of unrelated vectors
does not grow with the table, and the tables with the bits, so that a link is
found with the same probability at every size (``layout``): 16 million rows take
24 tables of 14 bits, a billion 48 of 20.

Equal vectors are one class with a multiplicity, so copies cost one vector. A
bucket is split into parts of at most ``cell_rows`` classes, and each pair of
parts is one cell: a matrix product in one task. A pair that meets in several
tables is counted in the first one where it does, which both signatures tell.
A cell emits each class's number of linked vectors and the edges of a spanning
forest, never the pairs; components then follow from the edges.

Defined results: a vector that is null, empty, zero, or holds a null or a
non-finite component links with nothing and is its own component; vectors of
different length link with nothing; repeated rows are vectors of their own,
linked with each other; a null id links like others but names no component;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, map_arrow, materialize
from inkwell.llm.simhash_dedup import Links

THRESHOLD = 0.95
# fewest bits, rows to a bucket of unrelated vectors, probability that a link at the threshold is found
BITS = 14
BUCKET_ROWS = 1024
RECALL = 0.9975
CELL_ROWS = 2048
SEED = 7


def layout(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Tables and bits for a table of ``rows`` vectors."""
    bits = max(BITS, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
    agrees = min(0.999, (1 - math.acos(threshold) / math.pi) ** bits)
    return math.ceil(math.log(1 - RECALL) / math.log1p(-agrees)), bits


def _planes(length: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, tables * bits))


def _signatures(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    signs = (vectors @ _planes(vectors.shape[1], tables, bits, seed) >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def signed(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """The classes (``vector`` as binary doubles) with an array of signatures."""
    schema = classes.select("*", F.array(F.lit(0).cast("long")).alias("signature")).schema

    def add(batches):
        for batch in batches:
            data = batch.column("vector").to_pylist()
            out: list = [None] * len(data)
            by_length: dict[int, list[int]] = {}
            for i, d in enumerate(data):
                by_length.setdefault(len(d), []).append(i)
            for rows in by_length.values():
                found = _signatures(np.stack([np.frombuffer(data[i]) for i in rows]), tables, bits, seed)
                for i, s in zip(rows, found.tolist()):
                    out[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=schema.names)

    return map_arrow(classes, add, schema)


def _packed(vectors: DataFrame, column: str) -> DataFrame:
    """``id`` and ``vector`` (binary doubles, null where it links with nothing)."""
    rows = vectors.select(F.col("id"), F.col(column).cast("array<double>").alias("v"))
    schema = rows.select("id", F.lit(b"").alias("vector")).schema

    def pack(batches):
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = None if not v or None in v else np.array(v, np.float64) + 0.0
                with np.errstate(over="ignore", under="ignore"):
                    good = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vector"])

    return map_arrow(rows, pack, schema)


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(d) for d in data])
    # scaled by the largest component first, so that no square overflows
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cell(table: int, names: list[str], vectors: np.ndarray, signatures: np.ndarray, weights: np.ndarray, side: np.ndarray,
          threshold: float):
    """(name, linked vectors) and (name, name) of one cell."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = len(right) == 0
    right = left if alone else right
    linked, links = np.zeros(len(names), np.int64), Links(len(names))
    for i in range(0, len(left), 512):
        rows = left[i:i + 512]
        near = vectors[rows] @ vectors[right].T >= threshold
        if alone:
            near &= np.arange(len(right))[None, :] > np.arange(i, i + len(rows))[:, None]
        for a, b in _in_blocks(*np.nonzero(near)):
            a, b = rows[a], right[b]
            if table:
                new = ~(signatures[a, :table] == signatures[b, :table]).any(axis=1)
                a, b = a[new], b[new]
            np.add.at(linked, a, weights[b])
            np.add.at(linked, b, weights[a])
            links.add(a, b)
    some = np.flatnonzero(linked)
    apart = np.flatnonzero(links.label != np.arange(len(names)))
    return ([(names[k], None, int(linked[k])) for k in some]
            + [(names[k], names[links.label[k]], 0) for k in apart])


def _in_blocks(a: np.ndarray, b: np.ndarray, size: int = 200_000):
    for i in range(0, len(a), size):
        yield a[i:i + size], b[i:i + size]


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD,
                    tables: int | None = None, bits: int | None = None, cell_rows: int = CELL_ROWS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` for every row of ``vectors``. Tables and
    bits follow from the number of rows unless given."""
    packed = materialize(_packed(vectors.select(F.col(id_column).alias("id"), column), column), "embedding-rows")
    name = F.substring(F.sha2("vector", 256), 1, 32)
    valid = packed.where("vector IS NOT NULL")
    suits = layout(valid.count(), threshold)
    tables, bits = tables or suits[0], bits or suits[1]
    # equal vectors, reduced by their digest before any vector moves twice
    classes = (valid.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")))
    classes = materialize(signed(classes, tables, bits, seed), "embedding-classes")
    keyed = classes.select("name", "copies", "vector", "signature", F.length("vector").alias("length"),
                           F.posexplode("signature").alias("table", "key"))
    bucket = ["table", "length", "key"]
    sizes = keyed.select(*bucket).groupBy(*bucket).count().where("count > 1")
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("count") / cell_rows).cast("int")).drop("count"), "embedding-buckets")
    cells = (keyed.join(sizes, bucket)
             .withColumn("mine", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*bucket, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                     F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "name", "copies", "vector", "signature"))
    order = [*bucket, "lo", "hi"]
    dealt = cells.repartition(*order).sortWithinPartitions(*order)

    def compare(batches):
        held, key, out = [], None, []

        def flush():
            if len(held) > 1:
                names, copies, data, signatures, side = (list(x) for x in zip(*held))
                out.extend(_cell(key[0], names, _unit(data), np.array(signatures), np.array(copies), np.array(side), threshold))
            held.clear()

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in order))
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "copies", "vector", "signature", "side")))
            for k, row in zip(keys, rows):
                if k != key:
                    flush()
                    key = k
                held.append(row)
            if len(out) > 10_000:
                yield _found(out)
                out.clear()
        flush()
        yield _found(out)

    found = materialize(map_arrow(dealt, compare, "a string, b string, n long"), "embedding-links")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"), "embedding")
    placed = materialize(
        classes.select("name", "copies", "least").join(linked, "name", "left")
        .join(groups, F.col("name") == F.col("node"), "left")
        .select("name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least",
                F.coalesce("component", "name").alias("component")), "embedding-placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    results = placed.join(least, "component").select("name", "n_links", "component_id")
    good = valid.select("id", name.alias("name")).join(results, "name").select("id", "n_links", "component_id")
    bad = packed.where("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad)


def _found(rows: list) -> pa.RecordBatch:
    a, b, n = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())],
                                      names=["a", "b", "n"])
