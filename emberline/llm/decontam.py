"""Benchmark decontamination by edit distance: random-walk embedding, bit-sampling LSH, exact check.

A CGK walk reads a string with one random bit a step deciding whether to move on: step
j outputs the current word and then stays or moves by a hash of (j, word). Two strings a few
edits apart fall back into step, so their outputs differ in few places: edit
distance becomes Hamming distance, and sampling a few output places is an LSH family for it.
Words are the alphabet. Each repetition has a walk, a sample and a start word of each item of its own. Walks are short, so
that they fit between edits, and run forwards and backwards in turn: starts are drawn from all words that leave room
ahead, so every word of an item is a start and no single edit hits all repetitions. A document walk starts at every word.
Repetitions go on until the chance to miss an item at the allowed distance is below 1 - recall. Hits are checked by
exact word edit distance.

A document walk is dropped as soon as its outputs so far begin no item's key, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .textarrays import LETTERS_DIGITS, grams, mixed, ragged, slices, trimmed, utf8, whole_grams, words

DISTANCE = 0.2
RECALL = 0.99
STEPS = 8
SAMPLE = 4
MIN_WORDS = 5
BLOCK_BYTES = 1 << 20
SCHEMA = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint, distance int, item_words int"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("distance", pa.int32()), ("item_words", pa.int32())])


def repetitions(distance: float = DISTANCE, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """How many walks reach the recall, if a sampled output survives with the chance that its word was not edited and
    the walk is still in step (taken as another unedited word). Tests hold this against recall measured by item length."""
    hit = (1 - distance) ** (2 * sample)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))


@dataclass
class Walk:
    """One repetition over the items of one walk length: ``step`` is 1 or -1, random bits are hashes of ``seed`` and word.

    A walk that leaves its item ends there: ``whole[k]`` has the keys, items and starts that are whole after k + 1 outputs.
    """

    step: int
    sampled: list[int]
    seed: np.uint64
    begun: list[np.ndarray]
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Index:
    """Keys of all items. ``code`` of a word is its place in the items' vocabulary, or 0.

    All of it grows with the items' words: word counts are kept for pairs that occur, random bits are hashed, not stored.
    Items of fewer than ``MIN_WORDS`` words allow no edit; they are matched whole (``short``).
    """

    def __init__(self, ids: list, texts: list[str | None], distance: float, recall: float, seed: int = 11):
        w = words(*utf8(pa.array([t or "" for t in texts], pa.large_string())), LETTERS_DIGITS)
        runs = [w.hashes[a:b] for a, b in zip(w.first, w.first[1:])]
        use = [i for i, r in enumerate(runs) if len(r) >= MIN_WORDS]
        self.short = {n: self._whole(ids, runs, n) for n in {len(r) for r in runs if 0 < len(r) < MIN_WORDS}}
        self.ids, self.items = [ids[i] for i in use], [runs[i] for i in use]
        self.distance = distance
        self.vocabulary = np.unique(np.concatenate(self.items)) if use else np.zeros(0, np.uint64)
        # First look: 20 bits of the hash; a set bit is then confirmed by search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.word = np.concatenate([np.zeros(1, np.uint64), self.vocabulary])
        self.size = np.array([len(x) for x in self.items], np.int64)
        self.edits = (distance * self.size).astype(np.int64)
        # How often an item has a word, by item and word code.
        named = [i * (len(self.vocabulary) + 1) + self.codes(x).astype(np.int64) for i, x in enumerate(self.items)]
        self.counted, counts = np.unique(np.concatenate(named) if named else np.zeros(0, np.int64), return_counts=True)
        self.counts = counts.astype(np.int32)
        # First look at whether an item has a word: 16 places a pair that occurs, hits are then confirmed by search.
        self.shift = np.uint64(64 - max(1, int(16 * len(self.counted)).bit_length()))
        self.paired = np.zeros(1 << (64 - int(self.shift)), bool)
        self.paired[self._spot(self.counted)] = True
        rng = np.random.default_rng(seed)
        self.walks: list[Walk] = []
        first = []
        steps = np.minimum(self.size, STEPS)
        for r in range(repetitions(distance, recall)):
            for n in np.unique(steps).tolist():
                group = np.flatnonzero(steps == n)
                sampled = [0, *sorted(rng.choice(np.arange(1, n), min(SAMPLE, n) - 1, replace=False).tolist())]
                start = rng.integers(0, self.size[group] - n // 2)
                walk, begins = self._table(rng, -1 if r % 2 else 1, sampled, group, start)
                self.walks.append(walk)
                first.append(begins)
        # A bit a walk and word: whether some item's walk begins with that word.
        self.first = np.packbits(np.stack(first, 1), axis=1, bitorder="little") if first else np.zeros((1, 0), np.uint8)

    @staticmethod
    def _whole(ids: list, runs: list[np.ndarray], n: int) -> tuple[np.ndarray, list]:
        """Sorted hashes of the items of ``n`` words, and their ids in that order."""
        items = [(_run_hash(r), i) for i, r in enumerate(runs) if len(r) == n]
        items.sort()
        return np.array([h for h, _ in items], np.uint64), [ids[i] for _, i in items]

    def short_hits(self, w) -> list[tuple[int, object, int, int]]:
        """(text, item id, first word, words) of the first place of each short item in each text of ``w``."""
        out = []
        for n, (keys, ids) in self.short.items():
            if len(w.hashes) < n:
                continue
            at = np.flatnonzero(whole_grams(w, n))
            key = grams(w.hashes, n)[at]
            some = _among(key, keys)
            at, key = at[some], key[some]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            item, place = ragged(low, high - low), np.repeat(at, high - low)
            text = np.searchsorted(w.first, place, "right") - 1
            _, head = np.unique(text * np.int64(len(ids)) + item, return_index=True)
            out += [(int(text[i]), ids[item[i]], int(place[i] - w.first[text[i]]), n) for i in head]
        return out

    def _spot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def _has(self, pair: np.ndarray) -> np.ndarray:
        """Positions of pairs (item and word code as one number) that occur."""
        at = np.flatnonzero(self.paired[self._spot(pair)])
        return at[_among(pair[at], self.counted)]

    def codes(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
            hit = self.vocabulary[place] == h[at]
            out[at[hit]] = place[hit] + 1
        return out

    def _table(
        self, rng: np.random.Generator, step: int, sampled: list[int], group: np.ndarray, start: np.ndarray,
    ) -> tuple[Walk, np.ndarray]:
        """The walk over the items of ``group``, and whether it begins with each word; ``start`` counts from the end at which it begins."""
        start = start if step > 0 else self.size[group] - 1 - start
        h = np.concatenate([self.items[i] for i in group])
        ends = np.cumsum(self.size[group])
        heads = ends - self.size[group]
        seed = np.uint64(rng.integers(1, 2**63))
        code, at = self.codes(h), heads + start
        key, outputs, begun = np.zeros(len(group), np.uint64), np.zeros(len(group), np.int64), []
        for j in range(sampled[-1] + 1):
            inside = np.flatnonzero((at >= heads) & (at < ends))
            if j in sampled:
                key[inside] = _grown(key[inside], code[at[inside]])
                outputs[inside] += 1
                begun.append(np.unique(key[inside]))
            at[inside] += step * _bit(h[at[inside]], seed, j)
        begins = np.zeros(len(self.vocabulary) + 1, bool)
        begins[code[heads + start]] = True
        whole = []
        for k in range(len(sampled)):
            here = np.flatnonzero(outputs == k + 1)
            here = here[np.argsort(key[here], kind="stable")]
            whole.append((key[here], group[here].astype(np.int32), start[here].astype(np.int32)))
        return Walk(step, sampled, seed, begun, whole), begins

    def candidates(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, position at which the item would start) of every hit, a repetition at a time."""
        if not len(h) or not self.walks:
            return
        code = self.codes(h)
        known = np.flatnonzero(code)
        begins = self.first[code[known]]
        for r, x in enumerate(self.walks):
            start = known[(begins[:, r >> 3] >> (r & 7)) & 1 == 1]
            at, key = start, np.zeros(len(start), np.uint64)
            output = 0
            # Words outside the vocabulary share their bits: no item has them, so only the bits matter.
            bits = mixed(self.word ^ x.seed).astype(np.uint8)
            for j in range(x.sampled[-1] + 1):
                here = code[at]
                if j in x.sampled:
                    key = _grown(key, here)
                    if output:
                        alive = np.flatnonzero(_among(key, x.begun[output]))
                        start, at, key, here = start[alive], at[alive], key[alive], here[alive]
                    keys, item, offset = x.whole[output]
                    if len(keys) and len(key):
                        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                        which = ragged(low, high - low)
                        if len(which):
                            yield item[which].astype(np.int64), np.repeat(start, high - low) - offset[which]
                    output += 1
                if not len(at):
                    break
                at = np.clip(at + x.step * ((bits[here] >> j) & 1).astype(np.int64), 0, len(h) - 1)

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """All candidates once, sorted by item and position."""
        before, span = int(self.size.max(initial=0)), len(h) + int(self.size.max(initial=0))
        seen = [item * span + start + before for item, start in self.candidates(h)]
        both = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        item, start = np.divmod(both[np.flatnonzero(np.diff(both, prepend=-1))], max(1, span))
        return np.stack([item, start - before], 1)

    def plausible(self, h: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Pairs whose window has as many of the item's words, repeats counted, as the allowed edits must leave; loses none.

        A walk in step begins at most the allowed edits before or after where the item begins, and so does the item's end.
        """
        code, width = self.codes(h), len(self.vocabulary) + 1
        kept = [pairs[:0]]
        for at in range(0, len(pairs), 20_000):
            part = pairs[at:at + 20_000]
            item, low, size = self._windows(part, len(h))
            many = self._hits(item, low, size, code, width) >= self.size[item] - self.edits[item]
            part, item, low, size = part[many], item[many], low[many], size[many]
            place, pair = ragged(low, size), np.repeat(np.arange(len(item)), size)
            hit = self._has(item[pair] * width + code[place])
            held, n = np.unique(pair[hit] * width + code[place[hit]], return_counts=True)
            pair, word = held // width, held % width
            n = np.minimum(n, self.counts[np.searchsorted(self.counted, item[pair] * width + word)])
            common = np.bincount(pair, n, minlength=len(item))
            kept.append(part[common >= self.size[item] - self.edits[item]])
        return np.concatenate(kept)

    def _windows(self, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, start = pairs.T
        edits = self.edits[item]
        low = np.clip(start - edits, 0, n)
        return item, low, np.clip(start + self.size[item] + edits, 0, n) - low

    def _hits(self, item: np.ndarray, low: np.ndarray, size: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
        """Words of each window that its item has. Windows of one item overlap; each place is looked up once for all of them."""
        if not len(item):
            return np.zeros(0, np.int64)
        high = low + size
        apart = np.concatenate([[True], (item[1:] != item[:-1]) | (low[1:] > high[:-1])])
        head, stretch = np.flatnonzero(apart), np.cumsum(apart) - 1
        begin, length = low[head], high[np.append(head[1:], len(item)) - 1] - low[head]
        place, owner = ragged(begin, length), np.repeat(item[head], length)
        known = np.flatnonzero(code[place])
        hit = np.zeros(len(place) + 1, np.int64)
        hit[known[self._has(owner[known] * width + code[place[known]])] + 1] = 1
        running = np.cumsum(hit)
        base = (np.cumsum(length) - length)[stretch] + low - begin[stretch]
        return running[base + size] - running[base]


def _run_hash(run: np.ndarray) -> int:
    """Hash of a whole run of words, as ``grams`` gives it for that many words."""
    return int(grams(run, len(run))[0])


def _bit(word: np.ndarray, seed: np.uint64, j: int) -> np.ndarray:
    """The walk's random bit for each word at step ``j``."""
    return (mixed(word ^ seed) >> np.uint64(j)).astype(np.int64) & 1


def _grown(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mixed(key * np.uint64(0x100000001B3) + code.astype(np.uint64) + np.uint64(1))


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def nearest_substring(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, first, last + 1): the substring of ``text`` with the least word edit distance to ``item``, the first such end."""
    m = len(text)
    place = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, np.int64), place.copy()
    for k, word in enumerate(item.tolist(), 1):
        change = np.append(k, cost[:-1] + (text != np.uint64(word)))
        origin = np.append(0, begin[:-1])
        drop = cost + 1
        origin = np.where(drop < change, begin, origin)
        best = np.minimum(change, drop)
        run = np.minimum.accumulate(best - place)
        source = np.maximum.accumulate(np.where(best - place == run, place, 0))
        cost, begin = run + place, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def _search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    trimmed()
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(*utf8(part.column("text")), LETTERS_DIGITS)
            found: dict[tuple[int, int], tuple] = {}
            pairs = index.plausible(w.hashes, index.pairs(w.hashes))
            checked: tuple[int, int, int] = (-1, -1, -1)
            for item, at in pairs.tolist():
                body = index.items[item]
                n, slack = len(body), int(index.distance * len(body)) + 1
                doc = int(np.searchsorted(w.first, min(max(at + n // 2, 0), len(w.hashes) - 1), "right")) - 1
                # Starts come sorted: one window answers for those that lie within its slack.
                if checked[:2] == (item, doc) and at <= checked[2] + slack:
                    continue
                checked = (item, doc, at)
                low, high = int(w.first[doc]), int(w.first[doc + 1])
                a, b = max(low, at - slack), min(high, at + n + 3 * slack)
                if a >= b:
                    continue
                far, first, last = nearest_substring(body, w.hashes[a:b])
                if far <= index.distance * n:
                    row = (far, a + first - low, a + last - 1 - low)
                    found[doc, item] = min(found.get((doc, item), row), row)
            short = index.short_hits(w)
            if found or short:
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[d], index.ids[i], x, y, far, len(index.items[i])) for (d, i), (far, x, y) in sorted(found.items())]
                rows += [(ids[d], item, x, x + n - 1, 0, n) for d, item, x, n in short]
                out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                if "key" in part.schema.names:
                    out = out.append_column("key", part.column("key").take(pa.array([d for d, _ in sorted(found)] + [d for d, *_ in short])))
                yield out


def find_leaks(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE, recall: float = RECALL,
               key: str | None = None) -> DataFrame:
    """A row for each document and benchmark item found in it: place (word positions), word edit distance, words of the item.

    Input: docs doc_id, text; benchmark item_id, text (other columns are ignored). Words are runs of letters and digits,
    lower-case. An item is found if some stretch of the document is within ``distance`` edits a word of the item
    (0.2: a similarity of 0.8). Items of fewer than five words allow no edit and are matched exactly. Null and empty texts hold nothing;
    documents in several rows give rows each, and so do items in several rows or with null ids; of several places of one item the nearest,
    then first, is given.

    ``key`` names a binary column of docs that is given as ``key`` with each row, to tell documents apart where doc_id does not.

    Items go to the tasks in blocks of 1 MB of text. An index is at most some 40 times its text, whatever the items' length, so
    what is sent at once is bounded however large the benchmark is; each block is one pass over the documents, without a shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), F.lower("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    more = [F.col(key).alias("key")] if key else []
    rows = docs.select(F.col("doc_id").cast("bigint"), F.lower("text").alias("text"), *more)
    schema = f"{SCHEMA}, key binary" if key else SCHEMA
    out = None
    for k in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in held], [r["text"] for r in held], distance, recall))
        found = rows.mapInArrow(lambda it, index=index: _search(it, index.value), schema)
        out = found if out is None else out.union(found)
    return out
