"""Token ids in directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k of a file holds the k-th chunk
of every id that has one, and a bitmap saying whether a further chunk follows; a rank
directory counts the set bits before every 512th entry. Token i is found by one look
into each of its levels, without decoding anything around it.

File layout, little-endian: magic ``EDAC1``, three zero bytes; counts of documents,
tokens and levels (uint64); size of each level (uint64); documents: flags (1 byte
each, 0 for a null id), ids (int64), first token (int64); then a level at a time:
chunks (bytes), bitmap (bytes, lowest bit first), directory (uint64, one for 512 entries and a last one).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import file_system, shared_folder, ship, written
from .textarrays import slices
from .tokens import SLICE, encoder, with_end

MAGIC = b"EDAC1\0\0\0"
BLOCK = 512
FILE_TOKENS = 4_000_000
_MANIFEST = "part int, file int, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_file(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes; token positions of document d are ends[d]:ends[d + 1]."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        levels.append((rest.astype(np.uint8), bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)])))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(8)
    flags = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<3Q", len(doc_ids), len(ids), len(levels)) + b"".join(struct.pack("<Q", len(c)) for c, _, _ in levels)
    body = [flags.tobytes(), names.tobytes(), np.asarray(ends, "<i8").tobytes()]
    body += [part for c, b, d in levels for part in (c.tobytes(), b.tobytes(), d.astype("<u8").tobytes())]
    return head + b"".join(body)


class Reader:
    """Random access to a file through any ``read_at(offset, size)``."""

    def __init__(self, read_at):
        self.read_at = read_at
        magic = read_at(0, 32)
        if magic[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_tokens, n_levels = struct.unpack("<3Q", magic[8:])
        self.sizes = struct.unpack(f"<{n_levels}Q", read_at(32, 8 * n_levels))
        at = 32 + 8 * n_levels
        self.docs_at = at
        at += self.n_docs * 9 + (self.n_docs + 1) * 8
        self.levels = []
        for n in self.sizes:
            bits, blocks = (n + 7) // 8, (n + BLOCK - 1) // BLOCK + 1
            self.levels.append((at, at + n, at + n + bits))
            at += n + bits + blocks * 8

    def documents(self) -> tuple[list, np.ndarray]:
        """Document ids and the n+1 token offsets."""
        n = self.n_docs
        raw = self.read_at(self.docs_at, n * 9 + (n + 1) * 8)
        flags, names = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n)
        return [int(d) if f else None for f, d in zip(flags, names)], np.frombuffer(raw, "<i8", n + 1, 9 * n)

    def token(self, i: int) -> int:
        """The i-th id: per level a chunk, a bit and, where it goes on, a directory entry and at most 64 bytes of bitmap."""
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= self.read_at(chunks + i, 1)[0] << (8 * k)
            if not self.read_at(bits + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(bits, directory, i)
        return value

    def _rank(self, bits: int, directory: int, i: int) -> int:
        """Set bits before entry i."""
        block = i // BLOCK
        before = struct.unpack("<Q", self.read_at(directory + 8 * block, 8))[0]
        first = block * BLOCK // 8
        raw = np.frombuffer(self.read_at(bits + first, i // 8 - first + 1), np.uint8)
        return int(before) + int(_ONES[raw[:-1]].sum()) + int(raw[-1] & ((1 << (i % 8)) - 1)).bit_count()

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: one stretch of every level, found by rank."""
        out, live = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, (chunks, bits, directory) in enumerate(self.levels):
            if a >= b:
                break
            out[live] |= np.frombuffer(self.read_at(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            raw = np.frombuffer(self.read_at(bits + a // 8, (b + 7) // 8 - a // 8), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[a % 8:a % 8 + b - a].astype(bool)
            if not more.any():
                break
            live = live[more]
            a = self._rank(bits, directory, a)
            b = a + len(live)
        return out


def _write(batches: Iterator[pa.RecordBatch], path: str, folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    coder, part = encoder(path), TaskContext.get().partitionId()
    fs, root = file_system(folder)
    fs.create_dir(root)
    names: list = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = number = 0

    def flush() -> pa.RecordBatch:
        ids = np.concatenate([x for x, _ in held])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in held]))])
        raw = encode_file(names, ends, ids)
        # Attempts of a task write under names of their own; the manifest says which file counts.
        name = f"ids-{part:05d}-{number:05d}-{uuid.uuid4().hex}.dac"
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(raw)
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "path": [f"{folder}/{name}"],
                                           "n_docs": [len(names)], "n_tokens": [len(ids)], "n_bytes": [len(raw)]})

    for batch in batches:
        for piece in slices(batch, "text", SLICE):
            names += piece.column("doc_id").to_pylist()
            held.append(with_end(*coder.encode(piece.column("text"))))
            size += len(held[-1][0])
            if size >= limit:
                yield flush()
                names, held, size, number = [], [], 0, number + 1
    if held:
        yield flush()


def write_ids(docs: DataFrame, path: str, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every text, append id 1, write files in ascending doc_id order; returns the manifest, written too.

    Input: doc_id, text (other columns are ignored). Null or empty text is its end id alone; a null doc_id comes
    first; rows with one doc_id follow one another by a hash of their text, so a repeated id is no hot key. Texts are shuffled
    once, by range, before they are encoded. The folder defaults to a new one below ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_folder(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("__tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")
    files = ordered.select("doc_id", "text").mapInArrow(lambda it: _write(it, path, folder, file_tokens), _MANIFEST)
    return written(files, "ids-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            fs, inner = file_system(uri)
            with fs.open_input_file(inner) as f:
                reader = Reader(lambda at, size, f=f: f.read_at(size, at))
                names, ends = reader.documents()
                d = 0
                while d < len(names):
                    e = max(d + 1, int(np.searchsorted(ends, ends[d] + 500_000, "right")) - 1)
                    ids = reader.slice(int(ends[d]), int(ends[e])).astype("<u4")
                    raw, at = memoryview(ids.tobytes()), (ends[d:e + 1] - ends[d]) * 4
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(names[d:e], pa.int64()), "start": pa.array(ends[d:e] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(ends[d:e + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                    d = e


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. A file is read by one task, some documents at a time."""
    order = Window.orderBy("part", "file")  # one row a file of four million tokens
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("path", "before")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path").mapInArrow(_read, _READ)
