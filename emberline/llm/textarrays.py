"""Words of a batch of texts as numpy arrays: one pass over the bytes, no Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GRAM = np.uint64(0xD6E8FEB86659FD93)

SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, 9, 10, 11, 12, 13]] = False
LETTERS_DIGITS = np.zeros(256, bool)
LETTERS_DIGITS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_powers)) - 1, _STEP)]), dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text comes alone, whole."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = np.cumsum(size), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


@cache
def _trim():
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed() -> None:
    """Give freed memory back to the system: workers live on from stage to stage, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``hashes``, ``starts`` and ``ends`` (byte positions) of all words; words of text d are first[d]:first[d + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``is_word`` holds; no word crosses two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = ends - starts
    heads = np.cumsum(size) - size
    # Four bytes do: a slice is small, and a single text is below 2 GB.
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(heads.astype(np.int32), size)
    code = _BYTE_CODE[data[inside]] * _power(int(size.max(initial=0)) + 1)[place]
    hashes = mixed(np.add.reduceat(code, heads) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int, factor: np.uint64 = _GRAM) -> np.ndarray:
    """Hash of n consecutive entries starting at each place (shorter at the end of the array)."""
    out = hashes.copy()
    for k in range(1, n):
        out[:-k or None] = out[:-k or None] if len(out) <= k else out[:-k] + hashes[k:] * _pow(factor, k)
    return mixed(out)


def _pow(factor: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(factor), k, 2**64))


def whole_grams(w: Words, n: int) -> np.ndarray:
    """Whether the n words from each place on belong to one text."""
    last = np.repeat(w.first[1:], w.counts)
    return np.arange(len(w.hashes)) + n <= last


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all (start, size) pairs, one after another."""
    heads = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - heads, sizes)
