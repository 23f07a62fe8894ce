"""WARC archives: writing, reading back, and the ordered capture index.

Writing: each page becomes a WARC/1.1 ``response`` record, or a ``revisit``
record where its payload occurs before. Archives are written by Spark's text
writer with the record separator as line end, so they commit like any table
and lie on any file system Spark can write. A written row is a bundle of
records of some ``BUNDLE`` bytes and a file holds ``BUNDLES`` of them, so
archives are bounded by bytes (64 MB before compression, and what the last record
of each bundle is longer). Reading: whole files, records by their
Content-Length, one record at a time; no record is found by searching for a
separator, so payloads may hold anything. Each archive is one gzip stream:
``position`` is the offset in the unpacked archive.

The capture index (URL key, timestamp, digest, file, offset) is an external
merge: every archive gives a locally sorted *run* of captures; captures are
range-partitioned by URL key, timestamp and id into ranges of some ``RANGE``
captures, and each task merges the pieces of the runs that fall into its range
with a loser tree. A task keeps its range as Arrow columns and the sort keys, and
hands the merged rows on in batches. Ranges cut through the captures of one
URL too, so a URL with a third of all captures is spread over tasks. The
result is globally ordered. ``history_row`` is a capture's place in its URL's
history: its place within the range, and for the URL a range begins with the
captures of it in the ranges before.

Duplicate payloads are found by their SHA-256 and length with a partial
minimum before the shuffle, so a payload with millions of copies is one row
per task there.

Defined results: a null html is an empty payload; a null URL is the empty URL;
a payload smaller than ``revisit_from`` bytes is always a response; among
equal payloads the rows with the smallest page id are responses (null ids come
last), so repeated rows of that id all are; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import fresh_path, map_arrow, materialize

END = "\r\n\r\n"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
BUNDLE = 2 << 20
BUNDLES = 32
# captures a merge task holds, and those it hands on at once
RANGE = 200_000
SLICE = 8192


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower-cased host."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){path}"


def _header(value: str) -> str:
    """A header's value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def write(pages: DataFrame, path: str, revisit_from: int = 0, bundle: int = BUNDLE, bundles: int = BUNDLES) -> None:
    """Write one record per page below ``path``."""
    rows = pages.select(
        F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("sha", F.sha2("html", 256))
    first = (rows.where(F.col("bytes") >= revisit_from).groupBy("sha", "bytes")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    first = materialize(first.select("sha", "bytes", "first_id"), "warc-first")
    marked = rows.join(first, ["sha", "bytes"], "left").select("page_id", "url", "html", "first_id")
    uid = uuid.uuid5(uuid.NAMESPACE_URL, path)

    def row(records):
        return pa.RecordBatch.from_arrays([pa.array([END.join(records)], pa.string())], names=["value"])

    def records(batches):
        out, size = [], 0
        for batch in batches:
            for page, url, html, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id"))):
                payload = html.encode("utf-8")
                digest = base64.b32encode(_sha1(payload)).decode()
                revisit = first_id is not None and page != first_id
                when = FIRST_CAPTURE + timedelta(seconds=(page or 0) % 3_000_000_000)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
                body = http + ("" if revisit else html)
                head = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
                    f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uid, str(page))}>", f"WARC-Target-URI: {_header(url)}",
                    f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/http; msgtype=response",
                    f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}",
                    *([f"X-Page-ID: {page}"] if page is not None else []),
                    *([f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uid, str(first_id))}>", f"X-Refers-To-Page: {first_id}",
                       "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
                    f"Content-Length: {len(body.encode('utf-8'))}"]
                out.append("\r\n".join(head) + END + body)
                size += len(body)
                if size >= bundle:
                    yield row(out)
                    out, size = [], 0
        if out:
            yield row(out)

    (map_arrow(marked, records, "value string").write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", bundles).text(path))


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data).digest()


def parse(stream):
    """(offset, headers, block) of each record of a binary stream, by Content-Length."""
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        size, headers = len(first), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            headers[name] = value.removeprefix(" ")
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, headers, block
        at += size + 2 + n + 4


CAPTURE = ("page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, "
           "payload_digest string, refers_to long, archive string, position long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below ``path``; every archive is one sorted run.

    Each response's digest is computed anew from its payload and checked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def captures(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                run = []
                for at, h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(h["X-Payload-Bytes"])
                    if h["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        n = len(payload)
                        if base64.b32encode(_sha1(payload)).decode() != digest:
                            raise ValueError(f"{name}: the payload at byte {at} has another digest")
                    page, refers = (int(h[k]) if k in h else None for k in ("X-Page-ID", "X-Refers-To-Page"))
                    run.append((page, h["WARC-Target-URI"], url_key(h["WARC-Target-URI"]), h["WARC-Date"], h["WARC-Type"], n,
                                digest, refers, name, at))
                run.sort(key=_order)
                kinds = (pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = [c.split()[0] for c in CAPTURE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*run)) or [[]] * 10, kinds)], names=names)

    return map_arrow(files, captures, CAPTURE)


def _order(row):
    return row[2], row[3], row[0] is None, row[0] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, so the
    next smallest row takes one comparison per level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.place = [0] * len(runs)
        self.k = max(1, 1 << (len(runs) - 1).bit_length())
        self.losers = [-1] * self.k
        self.head = [self._key(i) for i in range(self.k)]
        winners = list(range(self.k))
        level = self.k
        while level > 1:
            level //= 2
            won = []
            for i in range(level):
                a, b = winners[2 * i], winners[2 * i + 1]
                w, loser = (a, b) if self.head[a] <= self.head[b] else (b, a)
                self.losers[level + i] = loser
                won.append(w)
            winners = won
        self.winner = winners[0]

    def _key(self, i: int):
        if i < len(self.runs) and self.place[i] < len(self.runs[i]):
            return (0, self.key(self.runs[i][self.place[i]]))
        return (1,)

    def __iter__(self):
        while len(self.head[self.winner]) == 2:
            i = self.winner
            yield self.runs[i][self.place[i]]
            self.place[i] += 1
            self.head[i] = self._key(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self.head[self.losers[node]] < self.head[i]:
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def capture_history(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """The captures (as stored: they are counted, then read) in global order of URL
    key, timestamp and page id.

    ``segment`` numbers the ranges, ``segment_row`` the rows within: ordering by
    the two gives the merged index. ``history_row`` counts from 0 within the URL key."""
    spark = captures.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE))
    dealt = (captures.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "position")
             .withColumn("segment", F.spark_partition_id()))
    # the shuffle mixes the runs' pieces; each piece becomes one sorted run again
    dealt = dealt.sortWithinPartitions("archive", "url_key", "captured", F.col("page_id").asc_nulls_last(), "position")
    by = [dealt.columns.index(c) for c in ("url_key", "captured", "page_id", "archive", "position")]

    def merge(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not table:
            return
        keys = [(url, at, page is None, page or 0, archive, place)
                for url, at, page, archive, place in zip(*(table.column(i).to_pylist() for i in by))]
        cuts = [i for i in range(len(keys)) if i == 0 or keys[i][4] != keys[i - 1][4]]
        runs = [range(a, b) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
        order, places, url, place = [], [], None, 0
        at = 0
        for i in LoserTree(runs, keys.__getitem__):
            place = place + 1 if keys[i][0] == url else 0
            url = keys[i][0]
            order.append(i)
            places.append(place)
            if len(order) == SLICE:
                yield from rows(table, order, at, places)
                at, order, places = at + SLICE, [], []
        yield from rows(table, order, at, places)

    def rows(table, order, at, places):
        part = table.take(pa.array(order, pa.int64())).append_column("segment_row", pa.array(range(at, at + len(order)), pa.int64()))
        yield from part.append_column("url_row", pa.array(places, pa.int64())).combine_chunks().to_batches()

    merged = materialize(map_arrow(dealt, merge, CAPTURE + ", segment int, segment_row long, url_row long"), "warc-merged")
    # a URL of several ranges is the first of all but its first range
    cut = merged.where("segment_row = 0").select("url_key").distinct()
    here = merged.join(cut, "url_key", "left_semi").groupBy("url_key", "segment").agg(F.count(F.lit(1)).alias("n"))
    ranges_before = Window.partitionBy("url_key").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = here.select("url_key", "segment", F.sum("n").over(ranges_before).alias("earlier")).where("earlier > 0")
    return (merged.join(before, ["url_key", "segment"], "left")
            .withColumn("history_row", F.col("url_row") + F.coalesce("earlier", F.lit(0)))
            .select(*captures.columns, "segment", "segment_row", "history_row"))


def round_trip(pages: DataFrame, revisit_from: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages as archives, read them back and merge their index."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, revisit_from)
    captures = materialize(read(spark, path), "warc-captures")
    return capture_history(captures)
