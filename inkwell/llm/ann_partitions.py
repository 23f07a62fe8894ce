"""Approximate nearest neighbours by cosine through learned partitions.

1. Sample: at most ``SAMPLE`` distinct vectors (and ``SAMPLE_BYTES``), chosen by
   a hash of their content. The index is fitted on it and nothing else is.
2. Its neighbour graph (``DEGREE`` nearest by cosine, both ways) is cut into
   balanced partitions by recursive bisection: a spectral order of the
   nodes, split in proportion, then swaps of nodes that lower the cut.
3. A small classifier (one hidden layer) learns from a vector how its
   neighbours spread over the partitions.
4. Every row, sampled or not, is indexed in its most probable partition. A query
   is routed to its ``probes`` most probable ones; how many that are is
   measured on sampled vectors the classifier was not fitted on, as the fewest
   that hold ``RECALL`` of their true neighbours. On data without structure
   that is most of the partitions.
5. Reranking: a partition's rows and its queries are dealt into blocks of at most
   ``BLOCK_BYTES`` of vectors, and each pair of blocks is one cell: a matrix
   product, then the exact cosine of the best in double precision on the
   original vectors (scaled by powers of two, which changes no digit).

Equal vectors are one class with its ``k + 1`` smallest ids, on both sides, so
a vector that a third of all rows repeat costs one row in the index and one
query; the answer is then handed to every query id, without its own id.

Defined results: a vector that is null, empty, zero, or holds a null or a
non-finite component takes no part, nor does a row without id; rows that
repeat an id count once, by the vector whose digest is smallest; vectors whose
length is not that of most sampled vectors meet all vectors of their own
length, in the same blocks; ties go to the smaller id; fewer candidates than
``k`` are all returned; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, materialize, ship

K = 5
EVERY = 50
SAMPLE = 8192
SAMPLE_BYTES = 64 << 20
DEGREE = 10
PARTITION_ROWS = 256
MOST_PARTITIONS = 128
HIDDEN = 64
EPOCHS = 30
RECALL = 0.97
BLOCK_BYTES = 8 << 20
SEED = 3


# ------------------------------------------------------------------- fitting

def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of each row of unit vectors, nearest first."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i:i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(s), 0), np.int64)
        order = np.argsort(-np.take_along_axis(s, best, axis=1), axis=1, kind="stable")
        out[i:i + 512] = np.take_along_axis(best, order, axis=1)
    return out


def _bisect(edges: np.ndarray, n: int, left: int, rng) -> np.ndarray:
    """Which of ``n`` nodes go left, ``left`` of them, with few of ``edges`` cut."""
    a, b = edges
    degree = np.bincount(a, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(60):  # power iteration towards the second eigenvector of the walk
        x = 0.5 * x + 0.5 * np.bincount(a, x[b], n) / degree
        x -= (x * degree).sum() / degree.sum()
        x /= np.abs(x).max() + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[:left]] = True
    best, cut = side.copy(), int((side[a] != side[b]).sum())
    for _ in range(20):
        # what moving a node alone would take off the cut
        gain = 2 * np.bincount(a, side[a] != side[b], n) - degree
        from_left, from_right = np.flatnonzero(side), np.flatnonzero(~side)
        from_left = from_left[np.argsort(-gain[from_left], kind="stable")]
        from_right = from_right[np.argsort(-gain[from_right], kind="stable")]
        m = min(len(from_left), len(from_right))
        pays = int((gain[from_left[:m]] + gain[from_right[:m]] > 0).sum())
        if not pays:
            break
        # neighbours that move together undo each other's gain: half of the swaps at a time
        swap = max(1, pays // 2)
        side[from_left[:swap]], side[from_right[:swap]] = False, True
        now = int((side[a] != side[b]).sum())
        if now < cut:
            best, cut = side.copy(), now
    return best


def partition_graph(near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """The partition of each node of the neighbour graph; sizes differ by one at most a level."""
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(len(near)), near.shape[1])
    b = near.ravel()
    edges = np.unique(np.stack([np.append(a, b), np.append(b, a)]), axis=1)
    out = np.zeros(len(near), np.int64)
    work = [(np.arange(len(near)), 0, parts)]
    place = np.empty(len(near), np.int64)
    while work:
        nodes, first, n = work.pop()
        if n == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        place[:] = -1
        place[nodes] = np.arange(len(nodes))
        own = place[edges]
        own = own[:, (own >= 0).all(axis=0)]
        half = n // 2
        left = _bisect(own, len(nodes), len(nodes) * half // n, rng)
        work += [(nodes[left], first, half), (nodes[~left], first + half, n - half)]
    return out


@dataclass
class Router:
    """Probabilities of the partitions given a vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def length(self) -> int:
        return len(self.w1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of unit vectors."""
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit_router(x: np.ndarray, soft: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Router:
    """Cross entropy against the soft targets, by Adam."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], soft.shape[1]
    p = [rng.standard_normal((d, hidden)) * (2 / d) ** 0.5 * d ** 0.5, np.zeros(hidden),
         rng.standard_normal((hidden, parts)) * hidden ** -0.5, np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            rows = order[i:i + 128]
            own, y = x[rows], soft[rows]
            z = np.maximum(own @ p[0] + p[1], 0)
            s = z @ p[2] + p[3]
            e = np.exp(s - s.max(axis=1, keepdims=True))
            ds = (e / e.sum(axis=1, keepdims=True) - y) / len(rows)
            dz = (ds @ p[2].T) * (z > 0)
            step += 1
            for j, g in enumerate((own.T @ dz + 1e-5 * p[0], dz.sum(axis=0), z.T @ ds + 1e-5 * p[2], ds.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 0.005 * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, rows: int, k: int = K, recall: float = RECALL, seed: int = SEED,
        partition_rows: int = PARTITION_ROWS) -> Router:
    """Partitions, classifier and number of probes for a table of ``rows`` vectors."""
    x = unit(sample)
    parts = max(1, min(MOST_PARTITIONS, max(4, rows // partition_rows), len(x) // 16))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    held = np.sort(rng.permutation(len(x))[:max(1, len(x) // 5)])
    fitted = np.setdiff1d(np.arange(len(x)), held)
    near = neighbours(x[fitted], DEGREE)
    of = partition_graph(near, parts, seed)
    soft = np.zeros((len(fitted), parts))
    np.add.at(soft, (np.arange(len(fitted))[:, None], of[np.column_stack([np.arange(len(fitted)), near])]), 1.0)
    router = fit_router(x[fitted], soft / soft.sum(axis=1, keepdims=True), seed=seed)
    # the place of a true neighbour's partition among those of a query
    true = _of_rows(x, held, k)
    ranked = router.ranked(x[held], parts)
    place = np.argsort(ranked, axis=1)
    place = np.take_along_axis(place, router.ranked(x, 1)[:, 0][true], axis=1)
    found = np.array([(place < m).mean() for m in range(1, parts + 1)]) if true.size else np.ones(1)
    # an index with no partition left out finds all, whatever rounding says
    router.probes = int(np.argmax(found >= min(recall, found[-1]))) + 1
    return router


def _of_rows(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The nearest ``k`` other rows of some rows."""
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    k = min(k, len(x) - 1)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


# ------------------------------------------------------------------ indexing

def _packed(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``id``, ``name`` and ``vector`` (binary doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).where("id IS NOT NULL")
    schema = rows.select("id", F.lit(b"").alias("vector")).schema

    def pack(batches):
        for batch in batches:
            keep, out = [], []
            for i, v in enumerate(batch.column("v").to_pylist()):
                x = None if not v or None in v else np.array(v, np.float64) + 0.0
                if x is not None and np.isfinite(x).all() and x.any():
                    keep.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())],
                                             names=["id", "vector"])

    return map_arrow(rows, pack, schema).select("id", F.substring(F.sha2("vector", 256), 1, 32).alias("name"), "vector")


def _stacked(data: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(d) for d in data])


def routed(classes: DataFrame, router: Router, probes: int) -> DataFrame:
    """``classes`` with the array ``parts``: the most probable partitions. Vectors of
    another length than the router's share a partition with their length's negative."""
    schema = classes.select("*", F.array(F.lit(0)).alias("parts")).schema

    def add(batches):
        for batch in batches:
            data = batch.column("vector").to_pylist()
            own = [i for i, d in enumerate(data) if len(d) == 8 * router.length]
            out = [[-len(d) // 8] for d in data]
            if own:
                for i, p in zip(own, router.ranked(unit(_stacked([data[i] for i in own])), probes).tolist()):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return map_arrow(classes, add, schema)


def sample_of(classes: DataFrame, rows: int, size: int = SAMPLE, size_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Up to ``size`` vectors of the length that most sampled ones have, by hash."""
    share = min(1.0, 1.2 * size / max(1, rows))
    # names are hexadecimal digits of a hash
    few = classes.where(F.conv(F.substring("name", 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    found = [r["vector"] for r in few.select("name", "vector").orderBy("name").limit(size).collect()]
    lengths = sorted({len(d) for d in found}, key=lambda n: (-sum(len(d) == n for d in found), n))
    found = [d for d in found if len(d) == lengths[0]] if found else []
    return _stacked([bytes(d) for d in found[:max(1, size_bytes // lengths[0])]]) if found else np.zeros((0, 1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def best_of_cell(queries: np.ndarray, rows: np.ndarray, ids: list[list], k: int):
    """For each query its ``k`` best (id, cosine) among the classes ``rows`` with their smallest ids."""
    q, x = _scaled(queries), _scaled(rows)
    q_norm, x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    q_unit, x_unit = q / q_norm[:, None], x / x_norm[:, None]
    kth = min(k, len(x))
    for i in range(0, len(q), 256):
        near = q_unit[i:i + 256] @ x_unit.T
        # the product's rounding must not decide: all that come near the k-th best are computed anew
        least = np.partition(near, len(x) - kth, axis=1)[:, len(x) - kth] - 1e-9
        a, b = np.nonzero(near >= least[:, None])
        ends = np.cumsum(np.bincount(a, minlength=len(near)))
        for j, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            own = b[start:end]
            score = (q[i + j] * x[own]).sum(axis=1) / (q_norm[i + j] * x_norm[own])
            order = np.argsort(-score, kind="stable")
            # a class beyond the k best ones only matters if it ties with the last of them
            order = order[:max(k, int((score >= score[order[min(k, len(order)) - 1]]).sum()))]
            some = [(-s, name) for s, c in zip(score[order].tolist(), own[order].tolist()) for name in ids[c]]
            yield i + j, [(name, -s) for s, name in sorted(some)[:k]]


def search(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = EVERY, k: int = K,
           recall: float = RECALL, seed: int = SEED, partition_rows: int = PARTITION_ROWS,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest found of every row whose id is
    divisible by ``every``, among all other rows."""
    packed = materialize(_packed(vectors, id_column, column), "ann-rows")
    # an id stands for one vector; ids and digests are narrow
    ids = materialize(packed.groupBy("id").agg(F.min("name").alias("name")), "ann-ids")
    smallest = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    members = (ids.withColumn("nth", smallest).where(F.col("nth") <= k + 1)
               .groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = ids.where(F.col("id") % every == 0)
    classes = materialize(packed.groupBy("name").agg(F.first("vector").alias("vector")).join(members, "name")
                          .join(asked.select("name").distinct().withColumn("asked", F.lit(True)), "name", "left"), "ann-classes")
    n = classes.count()
    router = fit(sample_of(classes, n), n, k, recall, seed, partition_rows)
    base = materialize(routed(classes.select("name", "vector", "ids"), router, 1).withColumn("part", F.col("parts")[0]).drop("parts"),
                       "ann-index")
    queries = materialize(routed(classes.where("asked").select("name", "vector"), router, router.probes)
                          .withColumn("part", F.explode("parts")).drop("parts"), "ann-queries")

    def blocks(df, alias):
        return df.groupBy("part").agg(F.ceil(F.sum(F.length("vector")) / block_bytes).cast("int").alias(alias))

    counts = materialize(blocks(base, "n_base").join(blocks(queries, "n_queries"), "part"), "ann-blocks")

    def dealt(df, own, other):
        return (df.join(counts, "part").withColumn(own, F.pmod(F.xxhash64("name"), F.col(f"n_{own}")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_base", "n_queries"))

    cell = ["part", "base", "queries"]
    id_type = ids.schema["id"].dataType.simpleString()
    id_kind = pa.int32() if id_type == "int" else pa.int64()

    def rerank(left, right):
        out = [(), (), ()]
        if left.num_rows and right.num_rows:
            names = left.column("name").to_pylist()
            found = [(names[i], name, s) for i, best in best_of_cell(
                _stacked(left.column("vector").to_pylist()), _stacked(right.column("vector").to_pylist()),
                right.column("ids").to_pylist(), k + 1) for name, s in best]
            out = list(zip(*found))
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), id_kind, pa.float64()))], names=["name", "id", "score"])

    ship(vectors.sparkSession.sparkContext)
    found = materialize(dealt(queries, "queries", "base").groupBy(*cell).cogroup(dealt(base, "base", "queries").groupBy(*cell))
                        .applyInArrow(rerank, f"name string, id {id_type}, score double"), "ann-found")
    # one more than asked for, as the query's own id may be among them
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "id"))
    best = (found.withColumn("nth", order).where(F.col("nth") <= k + 1)
            .groupBy("name").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("best")))
    mine = asked.join(best, "name").select(
        F.col("id").alias("query_id"),
        F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
