"""Substring deduplication by fingerprints of suffixes, partitioned by variable-length prefixes.

A suffix is the words of a document from some place on. Suffixes whose first 13 words
are also found in a document with a smaller doc_id lose those words. Of the suffix tree only nodes
13 words deep with two documents below matter here, so no tree is built: 128-bit fingerprints of the first 13 words stand for
these nodes. The work goes in rounds over a file copy of the texts, a task a file, and between rounds only hashes travel:

1. seeds: of every 13 words one 5-word seed is drawn (that with the least hash), so equal
   windows draw equal seeds; a file sends each distinct seed once. Seeds met in one row
   only start no repeat, and all suffixes behind them are dropped.
2. prefixes: the live suffixes are counted by their first 1, 2, 4 and 8 words. A prefix that
   holds more suffixes than a group may have, a fixed number, is lengthened.
   Files know such prefixes by a bit map of fixed size; one that only shares its bit is lengthened too, in all files alike.
3. groups: suffixes go to groups by that variable-length prefix; a group sorts the fingerprints, and a run of
   equal ones is a node. A file sends each once, with its smallest doc_id, so a passage in every
   document is one entry a file, not one a document.
4. removal: a file learns which of its suffixes lie under a node with a smaller doc_id, and
   merges the covered words to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_system, shared_folder, ship, written
from .textarrays import SPACE_SEPARATED, Words, grams, mixed, ragged, slices, trimmed, utf8, whole_grams, words
from .tokens import forget

DEPTH = 13
SEED = 5
GROUP_SUFFIXES = 2_000_000
PREFIXES = (1, 2, 4, 8)
HEAVY_BITS = 1 << 20
NO_ID = np.iinfo(np.int64).max
_SECOND = np.uint64(0xA0761D6478BD642F)
_PARTS = "part int, file int, body binary"
_RESULT = ("doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<first:bigint,last:bigint>>, "
           "rest string, payload string")


def drawn_seeds(w: Words, depth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed place (a word position) of every window of ``depth`` words, and the seed hash of every word position.

    Windows are the positions with ``whole_grams(w, depth)``; other entries mean nothing.
    """
    seed = grams(w.hashes, k)
    span = depth - k + 1
    best, place = seed.copy(), np.arange(len(seed))
    # Sliding minimum by doubling: widths 1, 2, 4 and so on, then one overlapping step to ``span``.
    width = 1
    while width < span:
        step = min(width, span - width)
        later, at = best[step:], place[step:]
        lower = later < best[:len(later)]
        best[:len(later)] = np.where(lower, later, best[:len(later)])
        place[:len(at)] = np.where(lower, at, place[:len(at)])
        width += step
    return place, seed


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


class _File:
    """The rows of one file of the copy, a slice at a time."""

    def __init__(self, uri: str):
        trimmed()
        fs, path = file_system(uri)
        self.f = fs.open_input_file(path)

    def __iter__(self) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
        for batch in pq.ParquetFile(self.f).iter_batches(batch_size=1000):
            for part in slices(batch, "text"):
                w = words(*utf8(part.column("text")), SPACE_SEPARATED)
                ids = part.column("doc_id")
                yield part, w, ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.f.close()


def _bodies(parts: np.ndarray, n: int, file: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each part: the columns' bytes one after another."""
    order = np.argsort(parts, kind="stable")
    bounds = np.searchsorted(parts[order], np.arange(n + 1))
    rows = [(p, b"".join(c[order[bounds[p]:bounds[p + 1]]].tobytes() for c in columns)) for p in range(n) if bounds[p] < bounds[p + 1]]
    for at in range(0, len(rows), 500):
        p, body = zip(*rows[at:at + 500])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([file] * len(p), pa.int32()), pa.array(body, pa.binary())],
                                         ["part", "file", "body"])


def _split(body: bytes, width: int) -> list[np.ndarray]:
    n = len(body) // (8 * width)
    return [np.frombuffer(body, np.uint64, n, 8 * n * k) for k in range(width)]


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Sorted rows gathered by part."""
    key, files, bodies = None, [], []
    for batch in batches:
        for part, file, body in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "body"))):
            if part != key and bodies:
                yield key, files, bodies
                files, bodies = [], []
            key = part
            files.append(file)
            bodies.append(body)
    if bodies:
        yield key, files, bodies


# --- round 1 -------------------------------------------------------------------------


def _send_seeds(uri: str, file: int, n_parts: int) -> Iterator[pa.RecordBatch]:
    found = []
    for _, w, _ in _File(uri):
        place, seed = drawn_seeds(w, DEPTH, SEED)
        at = np.unique(place[whole_grams(w, DEPTH)])
        found.append(np.unique(np.stack([seed[at], w.text_of()[at].astype(np.uint64)], 1), axis=0)[:, 0] if len(at) else seed[:0])
    value, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    yield from _bodies((value % np.uint64(n_parts)).astype(np.int64), n_parts, file, value, (count > 1).astype(np.uint64))


def _shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file, the seeds that several rows have."""
    for part, files, bodies in _runs_of(batches):
        cols = [_split(b, 2) for b in bodies]
        value, often = (np.concatenate(c) for c in zip(*cols))
        owner = np.repeat(files, [len(c[0]) for c in cols])
        order = np.argsort(value, kind="stable")
        value, often, owner = value[order], often[order], owner[order]
        head = np.concatenate([[True], value[1:] != value[:-1]])
        group = np.cumsum(head) - 1
        live = (np.bincount(group, often.astype(float)) + np.bincount(group) > 1)[group]
        yield from _by_file(part, owner[live], value[live])


def _by_file(part: int, owner: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    files, head = np.unique(owner, return_index=True)
    bounds = np.append(head, len(owner))
    body = [b"".join(c[order[a:b]].tobytes() for c in columns) for a, b in zip(bounds, bounds[1:])]
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(files), pa.int32()), pa.array(files, pa.int32()), pa.array(body, pa.binary())],
                                     ["part", "file", "body"])


# --- rounds 2 and 3 -------------------------------------------------------------------


class _Live:
    """Live suffixes of a slice: positions and two independent hashes of their first 13 words."""

    def __init__(self, w: Words, seeds: np.ndarray):
        place, seed = drawn_seeds(w, DEPTH, SEED)
        whole = np.flatnonzero(whole_grams(w, DEPTH))
        self.at = whole[_member(seed[place[whole]], seeds)]
        near = np.unique(ragged(self.at, np.full(len(self.at), DEPTH)))  # the words that live suffixes need
        short = w.hashes[near]
        where = np.searchsorted(near, self.at)
        self.path = np.stack([self._over(short, where, DEPTH, f) for f in (None, _SECOND)], 1) if len(self.at) else np.zeros((0, 2), np.uint64)
        self._words, self._where = short, where

    @staticmethod
    def _over(short: np.ndarray, where: np.ndarray, n: int, factor) -> np.ndarray:
        return (grams(short, n) if factor is None else grams(mixed(short ^ factor), n, factor))[where]

    def prefix(self, n: int) -> np.ndarray:
        return self._over(self._words, self._where, n, None) ^ np.uint64(n)


def _seeds_of(bodies: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in bodies])) if bodies else np.zeros(0, np.uint64)


def _count_prefixes(uri: str, seeds: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Prefixes that might be heavy: a prefix over the limit is over its share of it in some file."""
    found = [[] for _ in PREFIXES]
    for _, w, _ in _File(uri):
        live = _Live(w, seeds)
        for k, n in enumerate(PREFIXES):
            found[k].append(live.prefix(n))
    for parts in found:
        value, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = count >= least
        yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(count[keep].astype(np.int64))], ["prefix", "n"])


def _send_paths(uri: str, file: int, seeds: np.ndarray, heavy: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    found = [(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for _, w, ids in _File(uri):
        live = _Live(w, seeds)
        group = live.prefix(PREFIXES[0])
        for shorter, longer in zip(PREFIXES, (*PREFIXES[1:], DEPTH)):
            group = np.where(heavy[live.prefix(shorter) % np.uint64(HEAVY_BITS)] & (group == live.prefix(shorter)),
                             live.path[:, 0] if longer == DEPTH else live.prefix(longer), group)
        found.append((live.path, ids[w.text_of()[live.at]], group))
    # Each column is joined and its pieces are let go before the next one is.
    columns = [list(x) for x in zip(*found)]
    found.clear()
    path, doc, group = (np.concatenate(columns.pop(0)) for _ in range(3))
    first, smallest = _smallest(path, doc)
    del doc
    parts = (mixed(group[first]) % np.uint64(n_parts)).astype(np.int64)
    yield from _bodies(parts, n_parts, file, path[first, 0], path[first, 1], smallest.view(np.uint64))


def _smallest(path: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each distinct path, and its smallest doc_id."""
    order = np.lexsort((doc, path[:, 1], path[:, 0]))
    p = path[order]
    head = np.concatenate([[True], (p[1:] != p[:-1]).any(1)]) if len(p) else np.zeros(0, bool)
    return order[head], doc[order[head]]


def _beaten_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file, the paths that a smaller doc_id of another file has too."""
    for part, files, bodies in _runs_of(batches):
        cols = [_split(b, 3) for b in bodies]
        one, two, doc = (np.concatenate(c) for c in zip(*cols))
        doc, owner = doc.view(np.int64), np.repeat(files, [len(c[0]) for c in cols])
        order = np.lexsort((doc, two, one))
        one, two, doc, owner = one[order], two[order], doc[order], owner[order]
        head = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        beaten = doc > doc[head][np.cumsum(head) - 1]
        yield from _by_file(part, owner[beaten], one[beaten], two[beaten])


# --- round 4 -------------------------------------------------------------------------


def covered(n_words: int, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n_words + depth + 1, np.int64)
    step[starts] += 1
    step[starts + depth] -= 1
    return np.cumsum(step)[:n_words] > 0


def _remove(uri: str, seeds: np.ndarray, beaten: np.ndarray, payload: bool) -> Iterator[pa.RecordBatch]:
    paths, docs = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    for _, w, ids in _File(uri):
        live = _Live(w, seeds)
        paths.append(live.path)
        docs.append(ids[w.text_of()[live.at]])
    # A path is lost here if a smaller doc_id has it, in this file or (as an entry below all ids) in another.
    joined = np.concatenate([*paths, beaten])
    owner = np.concatenate([*docs, np.full(len(beaten), np.iinfo(np.int64).min)])
    del paths, docs, beaten
    order = np.lexsort((joined[:, 1], joined[:, 0]))
    sorted_path = joined[order]
    del joined
    head = np.flatnonzero(np.concatenate([[True], (sorted_path[1:] != sorted_path[:-1]).any(1)])) if len(order) else order
    least = np.repeat(np.minimum.reduceat(owner[order], head), np.diff(np.append(head, len(order)))) if len(order) else owner
    lost = np.zeros(len(order), bool)
    lost[order] = owner[order] > least
    del owner, order, sorted_path, least, head
    at = 0
    for part, w, ids in _File(uri):
        live = _Live(w, seeds)
        starts = live.at[lost[at:at + len(live.at)]]
        at += len(live.at)
        gone = covered(len(w.hashes), starts)
        data, offsets = utf8(part.column("text"))
        raw = data.tobytes()
        kept, spans, removed, rest = [], [], [], []
        own = part.column("text")
        for d, (a, b) in enumerate(zip(w.first, w.first[1:])):
            inside = gone[a:b]
            removed.append(int(inside.sum()))
            keep = np.flatnonzero(~inside) + a
            kept.append(b" ".join([raw[x:y] for x, y in zip(w.starts[keep].tolist(), w.ends[keep].tolist())]).decode())
            if removed[-1]:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2])])
                rest.append(_without(raw, int(offsets[d]), int(offsets[d + 1]), w.starts[a:b], w.ends[a:b], edges))
            else:
                spans.append([])
                rest.append(own[d].as_py())
        extra = part.column("payload") if payload else pa.nulls(part.num_rows, pa.string())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(rest, pa.string()), extra.cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept", "spans", "rest", "payload"])


def _without(raw: bytes, start: int, end: int, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> str:
    """A text's bytes without the word runs edges[0]..edges[1] - 1, ...: each goes with the white space after it, or, at the end, before it."""
    out, at = [], start
    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
        last = y == len(starts)
        out.append(raw[at:int(ends[x - 1]) if last and x else int(starts[x])])
        at = int(ends[y - 1]) if last else int(starts[y])
    return b"".join([*out, raw[at:end]]).decode()


# --- the whole -------------------------------------------------------------------------


def _file_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row a file of the copy; as many tasks as files."""
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "file int, uri string")
    return rows.repartitionByRange(max(1, len(files)), "file")


def _with_bodies(files: DataFrame, n: int, *tables: DataFrame) -> DataFrame:
    """Files with what earlier rounds answered them, a file's rows together: table number and body."""
    out = files.select("file", "uri", F.lit(-1).alias("table"), F.lit(None).cast("binary").alias("body"))
    for k, t in enumerate(tables):
        out = out.unionByName(t.select("file", F.lit(None).cast("string").alias("uri"), F.lit(k).alias("table"), "body"))
    return out.repartitionByRange(n, "file").sortWithinPartitions("file", "table")


def _each_file(batches: Iterator[pa.RecordBatch], n_tables: int) -> Iterator[tuple[int, str, list[list[bytes]]]]:
    file, uri, bodies = None, None, []
    for batch in batches:
        for f, u, k, body in zip(*(batch.column(c).to_pylist() for c in ("file", "uri", "table", "body"))):
            if f != file:
                if file is not None:
                    yield file, uri, bodies
                file, uri, bodies = f, u, [[] for _ in range(n_tables)]
            if k >= 0:
                bodies[k].append(body)
    if file is not None:
        yield file, uri, bodies


def remove_repeats(docs: DataFrame, payload: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words), spans (removed word positions, first to last), rest (text) and payload of every row.

    Input: doc_id, text and, if named, a string column ``payload`` to carry along (other columns are ignored). Words are runs of
    bytes other than space and \\t to \\r, unchanged; null or empty text has none. A window of 13 words is removed if a
    row with a strictly smaller doc_id has it; rows that share a doc_id do not remove each other's words; a null
    doc_id counts as larger than any. ``kept`` joins what is left by one space; ``rest`` is the text itself without the
    removed words, and byte for byte the input (null if it was) where none was removed.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark, "texts")
    carried = F.col(payload).cast("string") if payload else F.lit(None).cast("string")
    copy = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("payload"))
    copy.write.option("compression", "zstd").parquet(folder)
    names = sorted(spark.read.schema(copy.schema).parquet(folder).inputFiles())
    n_files = max(1, len(names))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_files)
    files = _file_rows(spark, names)

    def seeds(it):
        forget()
        for batch in it:
            for f, u in zip(batch.column("file").to_pylist(), batch.column("uri").to_pylist()):
                yield from _send_seeds(u, f, n_parts)

    def by_part(df: DataFrame, fn, name: str) -> DataFrame:
        dealt = df.repartition(n_parts, "part").sortWithinPartitions("part", "file")
        return written(dealt.mapInArrow(fn, _PARTS), name)

    live = by_part(files.mapInArrow(seeds, _PARTS), _shared_seeds, "seeds")

    def prefixes(it):
        for _, uri, (own,) in _each_file(it, 1):
            yield from _count_prefixes(uri, _seeds_of(own), max(1, GROUP_SUFFIXES / n_files))

    # Files leave out what is below their share of the limit, so a prefix of twice the limit is found for certain.
    counted = _with_bodies(files, n_files, live).mapInArrow(prefixes, "prefix bigint, n bigint")
    heavy = counted.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_SUFFIXES)
    bits = np.zeros(HEAVY_BITS, bool)
    # Distinct bit numbers, no more than HEAVY_BITS whatever the input.
    bits[heavy.select(F.col("prefix").bitwiseAND(HEAVY_BITS - 1).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
    heavy = np.packbits(bits)

    def paths(it):
        long = np.unpackbits(heavy).view(bool)
        for file, uri, (own,) in _each_file(it, 1):
            known = _seeds_of(own)
            own.clear()
            yield from _send_paths(uri, file, known, long, n_parts)

    beaten = by_part(_with_bodies(files, n_files, live).mapInArrow(paths, _PARTS), _beaten_paths, "beaten")

    def remove(it):
        for _, uri, (own, other) in _each_file(it, 2):
            lost = np.concatenate([np.zeros((0, 2), np.uint64), *(np.stack(_split(b, 2), 1) for b in other)])
            known = _seeds_of(own)
            own.clear()
            other.clear()
            yield from _remove(uri, known, lost, payload is not None)

    if not names:
        return spark.createDataFrame([], _RESULT)
    return _with_bodies(files, n_files, live, beaten).mapInArrow(remove, _RESULT)
