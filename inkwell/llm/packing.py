"""Packing by concatenate and cut, with two-pass prefix sums.

All documents form one stream of token ids, each document followed by an end
id. The stream is cut into windows of ``size`` ids, so only the last window
is padded. A document's place in the stream is the total of all documents
before it, found in two passes:

1. Each task encodes its documents, keeps a running total and writes every
   document's ids with its offset *in the partition*.
2. The partitions' totals, one small row each, are summed up to each
   partition's global offset. Every document then knows its global offset and
   is cut at the window bounds by itself: no shuffle of ids, no order to keep
   between tasks.

The written table fixes the partitions, so a lost executor in the second pass
changes nothing. Pieces that begin or end inside their document are its
boundary records (``boundary``).

Defined results: a null text is empty (its sequence is the end id alone); a
null id and repeated rows are documents like any other; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.byte_bpe import byte_bpe
from inkwell.llm.common import map_arrow, materialize, text_of

SIZE = 2048
END_ID = 1


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """First pass: doc_id, part, local offset, doc_tokens and the ids.

    Ids are little-endian bytes, 16-bit where the vocabulary allows it, which
    halves what is written."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    schema = rows.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("local"),
                         F.lit(0).cast("long").alias("doc_tokens"), F.lit(0).alias("width"), F.lit(b"").alias("ids")).schema

    def run(batches):
        bpe, part, total = byte_bpe(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                piece = batch.slice(begin, 256)
                local, size, width, ids = [], [], [], []
                for text in piece.column("_text").to_pylist():
                    found = np.append(bpe.encode(text), np.uint32(end_id))
                    w = 2 if found.max() < 65536 else 4
                    local.append(total)
                    size.append(len(found))
                    width.append(w)
                    ids.append(found.astype(f"<u{w}").tobytes())
                    total += len(found)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(width, pa.int32()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "local", "doc_tokens", "width", "ids"])

    return map_arrow(rows, run, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, start, length, ids (uint32, little-endian), doc_tokens,
    sequence_id, offset, boundary."""
    coded = materialize(encode(docs, tokenizer_path, end_id), "packing-ids")
    totals = coded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # one row for each task of the first pass
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = materialize(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "packing-base")
    placed = coded.join(base, "part").withColumn("at", F.col("base") + F.col("local"))
    rows = placed.select("doc_id", "doc_tokens", "at", "width", "ids")
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
                         F.lit(b"").alias("ids"), "doc_tokens", F.lit(0).cast("long").alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"), F.lit(False).alias("boundary")).schema

    def cut(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                piece = batch.slice(begin, 256)
                row, start, length, ids, tokens, sequence, offset, boundary = [], [], [], [], [], [], [], []
                for i, (n, at, w, data) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("doc_tokens", "at", "width", "ids")))):
                    found = np.frombuffer(data, f"<u{w}").astype("<u4")
                    bounds = [0, *range(size - at % size, n, size), n]
                    for a, b in zip(bounds, bounds[1:]):
                        row.append(i)
                        start.append(a)
                        length.append(b - a)
                        ids.append(found[a:b].tobytes())
                        tokens.append(n)
                        sequence.append((at + a) // size)
                        offset.append((at + a) % size)
                        boundary.append(a > 0 or b < n)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)),
                     pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (tokens, sequence, offset)),
                     pa.array(boundary, pa.bool_())], schema=None,
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary"])

    return map_arrow(rows, cut, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "boundary")
