"""WARC archives with an index that is written first and read by ranges.

Writing gives one index row a record: file, offset, length, URL and digest. Reading
starts from index rows: those of a file are sorted by offset, ranges that touch or
nearly touch are joined, and each joined range is one read. Records are gzip members of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import file_system, shared_folder, ship, written

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
FILE_BYTES = 64 << 20
GAP = 64 << 10
RANGE = 4 << 20
INDEX_SCHEMA = ("page_id bigint, url string, payload_digest string, record_type string, path string, "
                "offset bigint, length bigint")
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, html string"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit keeps the HTTP head, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", f"<{RECORD}{_named(page_id)}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", ""))))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if revisits:
        fields += [("WARC-Refers-To", f"<{RECORD}{_named(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _named(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _page(value: str) -> int | None:
    name = value.strip("<>").removeprefix(RECORD)
    return None if name == "none" else int(name)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; fails on a wrong length or digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response":
        if len(payload) != int(inner["Content-Length"]) or f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, inner, payload


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    fs, root = file_system(folder)
    fs.create_dir(root)
    out, name, at = None, "", 0
    rows: list[tuple] = []
    try:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisits", "refers_to"))
            for page_id, url, html, revisits, refers_to in zip(*cols):
                if out is None:
                    name, at = f"pages-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode()
                raw = gzip.compress(record(page_id, url, payload, revisits, refers_to), 1, mtime=0)
                out.write(raw)
                rows.append((page_id, url, digest(payload), "revisit" if revisits else "response", f"{folder}/{name}", at, len(raw)))
                at += len(raw)
                if at >= limit:
                    out.close()
                    out = None
            # Index rows go on when their bytes are written; the reader runs after all tasks have ended.
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_INDEX), _INDEX)], schema=_INDEX)
            rows = []
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record a page; returns the index, itself written as a table.

    Input: page_id, url, html (other columns are ignored). Null html: empty. Of records with equal payloads of at
    least ``min_revisit_bytes`` bytes the one with the largest page_id is a response, the others revisit it; rows
    that repeat that page_id and payload are responses too. Null page_ids count as smaller than any; if a group
    has no other, its rows are all responses.

    Winners are found by an aggregate over digests. Only payloads met twice have a winner to look up, so the join is an
    outer join that adaptive execution can split at a hot payload.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("__sha", F.sha1(F.col("html").cast("binary")))
    winners = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("__sha").agg(
        F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __last is not null").drop("__n")
    joined = rows.join(winners, "__sha", "left")
    revisits = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    typed = joined.select("page_id", "url", "html", revisits.alias("revisits"), F.when(revisits, F.col("__last")).alias("refers_to"))
    return written(typed.mapInArrow(lambda it: _write(it, folder, file_bytes), INDEX_SCHEMA), "warc-index")


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[int, int, int]]:
    """(offset, length, records) of the reads that cover sorted (offset, length) spans."""
    reads: list[list[int]] = []
    for offset, length in spans:
        if reads and offset - (reads[-1][0] + reads[-1][1]) <= gap and offset + length - reads[-1][0] <= max(most, length):
            reads[-1][1] = max(reads[-1][1], offset + length - reads[-1][0])
            reads[-1][2] += 1
        else:
            reads.append([offset, length, 1])
    return [tuple(r) for r in reads]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, f = None, None
    for batch in batches:
        paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
        i = 0
        while i < len(paths):
            j = i
            while j < len(paths) and paths[j] == paths[i]:
                j += 1
            if paths[i] != uri:
                if f is not None:
                    f.close()
                uri = paths[i]
                fs, inner = file_system(uri)
                f = fs.open_input_file(inner)
            for at, size, count in coalesced(list(zip(offsets[i:j], lengths[i:j]))):
                raw, rows = memoryview(f.read_at(size, at)), []
                for offset, length in zip(offsets[i:i + count], lengths[i:i + count]):
                    fields, http, payload = parse(zlib.decompress(raw[offset - at:offset - at + length], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    rows.append((_page(fields["WARC-Record-ID"]), int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                 fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None,
                                 unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, None if revisit else payload.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _READ)], schema=_READ)
                i += count
    if f is not None:
        f.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows (any selection of them), read back by coalesced ranges.

    Rows are dealt by stretches of files, sorted by offset; html is null for revisits, whose payload is elsewhere.
    """
    stretch = F.floor(F.col("offset") / RANGE)
    # A fixed number of partitions: index rows are small, but each stands for a read, so they must not be merged by size.
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("path", "offset", "length").repartition(n, "path", stretch)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(_read, READ_SCHEMA)
