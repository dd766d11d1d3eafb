"""Lexical retrieval packing.

Documents become token ids; what exceeds whole windows of 2048 is left over as one
piece a document. Pieces are packed shard by shard. A shard is a bounded run of a
task's input with a BM25 inverted index of its own: a seed document asks the index
for neighbours that are still unused, nearest first, and they fill its window; the
last one is cut where the window ends and its rest stays available. Tokens left at
the end of a shard go into sequences of power-of-two length, which need no padding.

No row is shuffled: shards are stretches of input partitions, so any size of input
needs the memory of one shard a task, and a lost task repeats only its own shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .textarrays import ragged, slices, trimmed
from .tokens import SLICE, encoder, with_end

WINDOW = 2048
SHARD_TOKENS = 3_000_000
QUERY_TERMS = 24
NEIGHBOURS = 24
K1, B = 1.2, 0.75
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Index:
    """BM25 over the pieces of a shard: postings sorted by term, each with its weight."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        pair = ids.astype(np.uint64) << np.uint64(32)
        pair |= np.repeat(np.arange(n, dtype=np.uint64), sizes)
        pair.sort()
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(pair))).astype(np.int32)
        pair = pair[new]
        del new
        # Arrays as narrow as their values: a shard has millions of postings.
        term, self.doc = (pair >> np.uint64(32)).astype(np.int32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int32)
        del pair
        top = int(term[-1]) + 1 if len(term) else 0
        df = np.bincount(term, minlength=top)
        self.end = np.cumsum(df)
        self.begin = self.end - df
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean()))
        self.weight = idf[term] * count * (K1 + 1) / (count + norm[self.doc])
        del count
        # The query of a piece: its shared terms by falling weight; the heaviest are asked for first.
        order = np.flatnonzero(df[term] > 1).astype(np.int32)
        order = order[np.lexsort((-self.weight[order], self.doc[order]))]
        size = np.bincount(self.doc[order], minlength=n)
        head = np.cumsum(size) - size
        self.query = term[order]
        self.query_begin, self.query_end = head, head + size
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces by falling score, at most ``NEIGHBOURS``; the caller asks again for more.

        Scores come from the seed's ``QUERY_TERMS`` heaviest terms; where no unused piece has one of them, from the rest.
        """
        begin, end = self.query_begin[seed], self.query_end[seed]
        middle = min(begin + QUERY_TERMS, end)
        for low, high in ((begin, middle), (middle, end)):
            terms = self.query[low:high]
            at = ragged(self.begin[terms], self.end[terms] - self.begin[terms])
            score = np.bincount(self.doc[at], self.weight[at], self.n) if len(at) else np.zeros(self.n)
            score[~unused] = 0
            hits = np.flatnonzero(score)
            if len(hits):
                break
        if len(hits) > NEIGHBOURS:
            hits = hits[np.argpartition(-score[hits], NEIGHBOURS)[:NEIGHBOURS]]
        return hits[np.lexsort((hits, -score[hits]))]


def pack_shard(ids: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard's documents."""
    total = np.diff(ends)
    whole, out, sequence = total // window, [], 0
    for d in np.flatnonzero(whole).tolist():
        for k in range(int(whole[d])):
            out.append((d, k * window, window, sequence, 0))
            sequence += 1
    at, left = whole * window, total - whole * window
    docs = np.flatnonzero(left)
    index = Index(ids[ragged(ends[docs] + at[docs], left[docs])], left[docs])
    at, left = at[docs].copy(), left[docs].copy()
    unused, order, cursor = np.ones(len(docs), bool), np.argsort(-left, kind="stable"), 0
    remaining = int(left.sum())

    def put(p: int, room: int, offset: int) -> int:
        nonlocal remaining
        size = min(room, int(left[p]))
        out.append((int(docs[p]), int(at[p]), size, sequence, offset))
        at[p] += size
        left[p] -= size
        remaining -= size
        unused[p] = left[p] > 0
        return size

    while remaining:
        target = window if remaining >= window else 1 << (remaining.bit_length() - 1)
        while not unused[order[cursor]]:
            cursor += 1
        seed = int(order[cursor])
        filled = put(seed, target, 0)
        while filled < target:
            near = index.neighbours(seed, unused)
            if not len(near):
                while not unused[order[cursor]]:
                    cursor += 1
                near = order[cursor:cursor + 1]
            for p in near.tolist():
                filled += put(p, target - filled, filled)
                if filled == target:
                    break
        sequence += 1
    return out


def _pack(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    trimmed()
    coder, base = encoder(path), TaskContext.get().partitionId() << 36
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base
        names = [x for d, _, _ in held for x in d]
        ids = np.concatenate([x for _, x, _ in held])
        sizes = np.concatenate([np.diff(e) for _, _, e in held])
        held.clear()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        pieces = pack_shard(ids, ends)
        for k in range(0, len(pieces), 4096):
            d, start, length, seq, offset = map(np.array, zip(*pieces[k:k + 4096]))
            begin = ends[d] + start
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(begin, begin + length)]
            cols = [[names[i] for i in d], start, length, sizes[d], seq + base, offset, raw]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
        base += pieces[-1][3] + 1 if pieces else 0

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            ids, ends = with_end(*coder.encode(part.column("text")))
            held.append((part.column("doc_id").to_pylist(), ids, ends))
            size += len(ids)
            if size >= SHARD_TOKENS:
                yield from flush()
                trimmed()
                size = 0
    if held:
        yield from flush()


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Input: doc_id, text (other columns are ignored). Null or empty text is its end id alone; rows that repeat a
    doc_id are packed each; null doc_id is kept. Every id lies in one piece, offsets of a sequence have no gaps,
    and a sequence is full or has a power-of-two length. ``ids`` are unsigned 32-bit little-endian.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: _pack(it, path), SCHEMA)
