"""Target-distribution importance resampling over hashed word runs.

Features are all runs of one to ``longest`` consecutive words. Each falls into
a bucket by its CRC-32. A bucket's gain is the log ratio of its share in the
target texts to its share in all documents; a document's weight is the sum of
its features' gains. Gumbel noise of the document's own hash turns weights
into scores whose largest ones are a draw without replacement.

CRC-32 by position table: the sum is linear over XOR, so a span's CRC is a
constant of its length XOR the contributions of its bytes, each a table entry
by (byte, distance from the span's end). All spans of a batch are looked up at
once and folded by ``bitwise_xor.reduceat``. A span longer than the table is
cut into blocks from its end; blocks are folded pairwise, the left one moved
over the right one's length by a linear map, so a span of n blocks takes
log2(n) steps.

Jobs: one pass counts buckets (at most one row per bucket and task reaches the
shuffle), one over the target texts, and one weighs the documents and writes
them. The ranking is two-pass: rows are range-partitioned and sorted by score,
and a partition's first rank is the number of rows before it. Only the bucket
table (one row per bucket) passes through the driver.

Defined results: a null text has no words; its weight is 0; a null id counts as
the empty string in the noise and sorts first among ties; repeated rows are
documents of their own, and equal ones are ranked in any order; texts of any
length are whole, with their words in pieces of ``PIECE``; with an empty table
there are no rows, with an empty target every count ``t`` is 0; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import map_arrow, materialize, text_of

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# words whose features are held at once, and bytes looked up at once
PIECE = 1 << 18
LOOKUP = 1 << 19


class PositionCrc:
    """CRC-32 of many spans of one buffer."""

    def __init__(self, depth: int = 256):
        if depth & (depth - 1):
            raise ValueError("the depth is a power of two")
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
        rows = [step]
        for _ in range(depth - 1):
            rows.append(step[rows[-1] & 255] ^ rows[-1] >> 8)
        self.depth = depth
        self.table = np.concatenate(rows)
        # moves over 1, 2, 4, ... bytes: a state's four bytes looked up apart
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        move = step[bits & 255] ^ bits >> 8
        self.moves = []
        for _ in range(40):
            self.moves.append(self._by_byte(move))
            move = self.moved(move, len(self.moves) - 1)

    @staticmethod
    def _by_byte(images: np.ndarray) -> np.ndarray:
        """The linear map that takes bit i to ``images[i]``, as four tables of 256."""
        chosen = np.arange(256)[None, :, None] >> np.arange(8)[None, None, :] & 1
        return np.bitwise_xor.reduce(np.where(chosen, images.reshape(4, 1, 8), 0), axis=2).astype(np.uint32)

    def moved(self, states: np.ndarray, power: int) -> np.ndarray:
        """The states after 2 ** power zero bytes."""
        a, b, c, d = self.moves[power]
        return a[states & 255] ^ b[states >> 8 & 255] ^ c[states >> 16 & 255] ^ d[states >> 24]

    def constants(self, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of that many zero bytes."""
        state = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
        power = 0
        while (left := lengths >> power).any():
            odd = np.flatnonzero(left & 1)
            state[odd] = self.moved(state[odd], power)
            power += 1
        return ~state

    def _raw(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """XOR of the byte contributions of spans within the table's depth."""
        out = np.empty(len(start), np.uint32)
        upto = np.cumsum(end - start)
        i = 0
        while i < len(start):
            before = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + LOOKUP, "right")))
            size = end[i:j] - start[i:j]
            first = upto[i:j] - size - before
            at = np.arange(int(upto[j - 1] - before), dtype=np.int32)
            place = at + np.repeat((start[i:j] - first).astype(np.int32), size)
            distance = np.repeat((first + size - 1).astype(np.int32), size) - at
            out[i:j] = np.bitwise_xor.reduceat(self.table[distance * 256 + data[place]], first)
            i = j
        return out

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of ``data[start:end]`` for every span, none of them empty."""
        size = end - start
        if not len(size):
            return np.zeros(0, np.uint32)
        if size.max() <= self.depth:
            return self._raw(data, start, end) ^ self.constants_short()[size]
        blocks = -(-size // self.depth)
        span = np.repeat(np.arange(len(size)), blocks)
        # a block's number, counted from its span's end
        number = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
        to = end[span] - number * self.depth
        state = self._raw(data, np.maximum(to - self.depth, start[span]), to)
        power = self.depth.bit_length() - 1
        while len(state) > len(size):
            odd = np.flatnonzero(number & 1)
            state[odd] = self.moved(state[odd], power)
            number >>= 1
            new = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (number[1:] != number[:-1])))
            state, span, number = np.bitwise_xor.reduceat(state, new), span[new], number[new]
            power += 1
        return state ^ self.constants(size)

    @cache
    def constants_short(self) -> np.ndarray:
        return self.constants(np.arange(self.depth + 1))


@cache
def position_crc() -> PositionCrc:
    return PositionCrc()


# Word bytes are the digits, letters (A-Z lower-cased) and all bytes of code points above 127.
_LOWER = np.zeros(256, np.uint8)
for _a, _b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _LOWER[_a:_b + 1] = np.arange(_a, _b + 1)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 with a space after each, and where each begins."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    return np.insert(whole, at[1:], 0x20), at[:-1] + np.arange(len(texts))


def features(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS):
    """Pieces of (text, words found, text of each feature, bucket of each feature);
    the first two once per batch of texts, then None."""
    data, begin = _bytes_of(texts)
    data = _LOWER[data]
    inside = data != 0
    data[~inside] = 0x20
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    text = np.searchsorted(begin, start, "right") - 1
    # only the words, one space after each
    inside[end] = True
    data = data[inside]
    size = end - start
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    yield np.bincount(text, minlength=len(texts)), None, None
    crc = position_crc()
    for k in range(1, longest + 1):
        for i in range(0, max(0, len(start) - k + 1), PIECE):
            j = min(i + PIECE, len(start) - k + 1)
            own = np.flatnonzero(text[i:j] == text[i + k - 1:j + k - 1]) + i
            yield None, text[own], crc.spans(data, start[own], end[own + k - 1]) % buckets


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket."""
    rows = docs.select(text_of().alias("_text"))

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column("_text"), longest, buckets):
                if bucket is not None:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = [0] * buckets
    for row in map_arrow(rows, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of each bucket."""
    n = len(source)
    s_all, t_all = float(sum(source) + n), float(sum(target) + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all)))
                     for s, t in zip(source, target)], np.int64)


def noise(h: int) -> int:
    """floor(1000 times Gumbel noise) of a hash of 32 bits."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", text_of().alias("_text"), h.alias("h"))
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", *[zero.alias(c) for c in ("n_words", "n_features", "weight", "score")]).schema

    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if n:
                for found, text, bucket in features(batch.column("_text"), longest, len(gain)):
                    if found is not None:
                        words += found
                        continue
                    count += np.bincount(text, minlength=n)
                    # sums of whole numbers below 2 ** 53 are exact
                    weight += np.bincount(text, gain[bucket], n).astype(np.int64)
            score = weight + np.array([noise(x) for x in batch.column("h").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, count, weight, score))], names=schema.names)

    return map_arrow(rows, weigh, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``;
    the rank is null where it is not drawn. ``target`` needs a column ``text``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = materialize(weighed(docs, gain, longest, seed).withColumn("_row", F.monotonically_increasing_id()), "importance-weights")
    drawn = rows.where(F.col("n_words") >= min_words).count() * percent // 100
    order = [(F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()]
    # the id of a sorted row is its partition and its place there
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = placed.select("*", part.alias("_part"), place.alias("_place"))
    # one row for each task of the sort
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
            .select("_part", F.coalesce(before, F.lit(0)).alias("_base")))
    rank = F.col("_base") + F.col("_place") + 1
    return placed.join(materialize(base, "importance-base"), "_part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
