"""SimHash near-duplicates through BK-trees.

A text's fingerprint has 64 bits: words are lower-cased (A-Z) runs without
white space, shingles are four words joined by a space, and a bit is set if
it is set in more than half of the shingles' XXH64 hashes (seed 42). Texts of
fewer words have one shingle, texts without words the fingerprint zero.

Fingerprints at most ``radius`` bits apart are linked. Distinct fingerprints
are dealt into *shards*: the 64 bits are cut into ``radius + 2`` blocks, and
two fingerprints within the radius agree in at least two of them, so there is
a shard for each pair of blocks and their value. In each shard the
fingerprints form a BK-tree (children keyed by their distance to the parent),
and each fingerprint follows only the edges within the radius of its distance
to a node. The pigeonhole argument makes this exact.

The trees go to the tasks that hold their queries through the shuffle, not by
broadcast: all trees together hold every fingerprint of the corpus, which has
no size bound. A shard with more than ``shard_rows`` fingerprints is split
into parts; each pair of parts is one tree with its queries, so no task holds
more than two parts of a shard. A tree emits the edges of a spanning forest of
the links found, never the pairs.

Defined results: a null text is empty; repeated rows and equal texts share a
fingerprint and a component; documents whose id is null link like others but
name no component (a component of null ids only has the id null); an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import connected_components, map_arrow, materialize, text_of

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_ROWS = 8192
PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: str, words_per_shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = len(words) - words_per_shingle + 1
        starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words_per_shingle - 1:].tolist())],
                          dtype="<u8")
    # bits are counted in blocks, so a very long text needs no 64 bytes a shingle at once
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16384):
        part = hashes[i:i + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, words_per_shingle: int = SHINGLE) -> DataFrame:
    """``_row`` and the signed 64-bit ``_fp`` for every row of ``df`` (columns ``_row``, ``_text``)."""
    schema = df.select("_row", F.lit(0).cast("long").alias("_fp")).schema

    def add(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            fps = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(fps, pa.int64())], names=["_row", "_fp"])

    return map_arrow(df, add, schema)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 2`` blocks that cover 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _shard_keys(fp: Column, radius: int) -> Column:
    """One struct (pair, key) for each pair of blocks."""
    part = lambda shift, width: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("pair"), F.shiftleft(part(*a), b[1]).bitwiseOR(part(*b)).alias("key"))
                     for i, (a, b) in enumerate(itertools.combinations(_blocks(radius), 2))])


class Forest:
    """The BK-trees of many shards, built and searched a level at a time.

    ``group[i]`` is the shard of fingerprint ``i``. The first fingerprint of a
    shard is its root; every other one goes down to the child at its distance,
    and the first to reach an empty child stays there. That is what inserting
    one by one gives, done for all fingerprints of a level at once.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        n = len(fps)
        self.fps = fps
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        order = np.argsort(group, kind="stable")
        first = order[np.r_[True, np.diff(group[order]) != 0]] if n else order
        self.root_of = dict(zip(group[first].tolist(), first.tolist()))
        rest = np.setdiff1d(order, first, assume_unique=True)
        at = np.array([self.root_of[g] for g in group[rest].tolist()], np.int64)
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            slot = at * 65 + d
            by = np.lexsort((rest, slot))
            rest, slot, at, d = rest[by], slot[by], at[by], d[by]
            head = np.r_[True, np.diff(slot) != 0]
            child = rest[head]
            self.parent[child], self.edge[child] = at[head], d[head]
            at = child[np.cumsum(head) - 1][~head]
            rest = rest[~head]
        kids = np.argsort(self.parent, kind="stable")
        self.kids = kids[np.searchsorted(self.parent[kids], 0):]
        self.first_kid = np.searchsorted(self.parent[self.kids], np.arange(n))
        self.last_kid = np.searchsorted(self.parent[self.kids], np.arange(n), side="right")

    def search(self, fps: np.ndarray, roots: np.ndarray, radius: int):
        """Yield (query index, node) arrays of the nodes within the radius of each query."""
        step = PAIRS_AT_ONCE // 4
        todo = [(np.arange(i, min(i + step, len(fps))), roots[i:i + step]) for i in range(0, len(fps), step)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            yield q[hit], node[hit]
            size = self.last_kid[node] - self.first_kid[node]
            q, node, d, size = (x[size > 0] for x in (q, node, d, size))
            bound = np.cumsum(size)
            # a bounded number of pairs at a time, whatever the tree's breadth
            for part in np.split(np.arange(len(q)), np.searchsorted(bound, np.arange(PAIRS_AT_ONCE, bound[-1], PAIRS_AT_ONCE)) if len(q) else []):
                if not len(part):
                    continue
                s = size[part]
                offset = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                kid = self.kids[np.repeat(self.first_kid[node[part]], s) + offset]
                near = np.abs(self.edge[kid] - np.repeat(d[part], s)) <= radius
                if near.any():
                    todo.append((np.repeat(q[part], s)[near], kid[near]))


class Links:
    """Union-find over array positions, fed with arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _forest_edges(fps: np.ndarray, cell: np.ndarray, side: np.ndarray, radius: int):
    """(a, b) fingerprints: a spanning forest of the links in each cell.

    A cell's rows on side 0 form the tree; those on side 1 (the other part of
    a split shard) only search it. Without side 1, side 0 searches itself.
    """
    tree = side == 0
    nodes, order = np.flatnonzero(tree), np.flatnonzero(~tree)
    forest = Forest(fps[nodes], cell[nodes])
    has_other = np.isin(cell[nodes], cell[order])
    ask = np.concatenate([nodes[~has_other], order])
    ask = ask[np.isin(cell[ask], cell[nodes])]
    roots = np.array([forest.root_of[c] for c in cell[ask].tolist()], np.int64)
    links = Links(len(fps))
    for q, node in forest.search(fps[ask], roots, radius):
        links.add(ask[q], nodes[node])
    apart = np.flatnonzero(links.label != np.arange(len(fps)))
    return fps[apart], fps[links.label[apart]]


def link_edges(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of the links among the
    distinct, non-null fingerprints ``_fp``."""
    rows = materialize(fps.select("_fp", F.explode(_shard_keys(F.col("_fp"), radius)).alias("k"))
                       .select("_fp", "k.pair", "k.key"), "simhash-shards")
    sizes = rows.groupBy("pair", "key").count().where("count > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("count") / shard_rows).cast("int"))
    rows = rows.join(sizes.drop("count"), ["pair", "key"])
    mine = F.pmod(F.xxhash64("_fp"), F.col("parts")).cast("int")
    # a part meets itself and every other part of its shard once
    rows = (rows.withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("_fp", "pair", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                    F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side")))
    dealt = rows.repartition("pair", "key", "lo", "hi").sortWithinPartitions("pair", "key", "lo", "hi", "side")

    def connect(batches):
        held: list[pa.RecordBatch] = []
        held_rows = 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                held_rows += batch.num_rows
                if held_rows < 4 * shard_rows:
                    continue
            if not held_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            names = ("_fp", "pair", "key", "lo", "hi", "side")
            f, pair, key, lo, hi, side = (table.column(c).to_numpy() for c in names)
            new = np.r_[True, (np.diff(pair) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)]
            cell = np.cumsum(new) - 1
            # the last cell may go on in the next batch
            end = len(f) if batch is None else int(np.flatnonzero(new)[-1])
            held = [b for b in table.slice(end).to_batches() if b.num_rows]
            held_rows = len(f) - end
            a, b = _forest_edges(f[:end].view(np.uint64), cell[:end], side[:end], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return map_arrow(dealt, connect, "a long, b long")


def components_of(marked: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``_fp``, ``component`` (its least fingerprint) and ``component_id`` (its
    least document id) for every distinct fingerprint of ``marked`` (doc_id, _fp)."""
    classes = materialize(marked.groupBy("_fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = connected_components(link_edges(classes, radius, shard_rows), "simhash")
    placed = materialize(classes.join(found, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "least", F.coalesce("component", "_fp").alias("component")), "simhash-placed")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return placed.join(named, "component").select("_fp", "component", "component_id")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE, radius: int = RADIUS,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id``, ``_fp`` (signed) and ``component_id`` for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").alias("_row"), text_of().alias("_text"))
    marked = materialize(with_fingerprint(rows, words_per_shingle).withColumnRenamed("_row", "doc_id"), "simhash-fps")
    return marked.join(components_of(marked, radius, shard_rows), "_fp").select("doc_id", "_fp", "component_id")


def keep_first(docs: DataFrame, words_per_shingle: int = SHINGLE, radius: int = RADIUS,
               shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of every component, with all its columns.

    The document with the component's smallest id stays; where several rows
    have that id, the one with the least row hash. A component of null ids
    only keeps one row, chosen the same way.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row_hash = F.xxhash64(*columns, *[c.isNull() for c in columns])
    rows = docs.select(F.struct(F.col("doc_id"), row_hash.alias("hash")).alias("_row"), text_of().alias("_text"))
    marked = materialize(with_fingerprint(rows, words_per_shingle).select("_row.doc_id", "_row.hash", "_fp"), "simhash-fps")
    first = (marked.join(components_of(marked, radius, shard_rows), "_fp")
             .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("component").agg(F.first("component_id").alias("_id"), F.min("hash").alias("_hash"))
             .select("_id", "_hash").distinct())
    first = materialize(first, "simhash-kept")
    whole = docs.select(F.struct(*columns).alias("_doc"), F.col("doc_id").alias("_doc_id"), row_hash.alias("_doc_hash"))
    kept = whole.join(first, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_hash") == F.col("_hash")), "left_semi")
    # rows equal in all columns share id and hash: one of them stays
    again = Window.partitionBy("_doc_id", "_doc_hash").orderBy("_doc_hash")
    return kept.withColumn("_n", F.row_number().over(again)).where("_n = 1").select("_doc.*")
