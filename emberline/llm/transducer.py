"""Token counts by a byte-level BPE tokenizer compiled to deterministic finite-state transducers.

Two transducers run one after the other.

* The *splitter* reads character classes and marks where pre-tokens start. Its few states are written out in full,
  so the map from entering to leaving state of any chunk is a short vector. Chunks are run side by side for all
  entering states at once (until their maps become constant), maps are composed by a parallel prefix scan, and a second run
  from the true states emits the marks.
* The *merger* reads bytes and, on each transition, emits by how much the number of tokens of the pre-token so far
  changes. Its states are made when first needed: a state is the part of the pre-token that may still grow into a
  longer token, with the last token and the relative count at each place in it. The last token of a prefix is the one
  suffix token that the merge rules leave standing next to its predecessor, so the state decides the next step. Chunks
  run side by side here too; a chunk that starts inside a pre-token is first run from the start state, and its map is
  completed at the state its predecessor leaves, up to the place where both runs meet.

The sum of the emissions of a text is its number of tokens.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .textarrays import slices, utf8
from .tokens import _byte_letters, forget

BLOCK = 1 << 20
LANES = 2048
TRANSITIONS = 1 << 19
LETTER, ENDING, R_OR_V, E, L, NUMBER, SIGN, APOSTROPHE, SPACE, BLANK, END = range(11)
CLASSES = 11
START, IN_WORD, IN_NUMBER, IN_SIGNS, ONE_SPACE, LAST_SPACE, ONE_BLANK, LAST_BLANK, QUOTE, QUOTE_E, QUOTE_L = range(11)
STATES = 11
CUT, CUT_BEFORE_LAST = 1, 2
_FRESH = {NUMBER: IN_NUMBER, SIGN: IN_SIGNS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK}

_loaded: dict[tuple, "Compiled"] = {}


def _splitter_step(state: int, kind: int) -> tuple[int, int]:
    """Next state and marks: CUT before this character, CUT_BEFORE_LAST before the one ahead of it."""
    letter = kind <= L
    fresh = IN_WORD if letter else _FRESH.get(kind, START)
    joined = IN_SIGNS if kind == APOSTROPHE else fresh
    if state in (QUOTE_E, QUOTE_L):
        if kind == (E if state == QUOTE_E else L):
            return START, 0
        # No contraction: the apostrophe stands alone and the letter after it began a word.
        after, marks = _splitter_step(IN_WORD, kind)
        return after, marks | CUT_BEFORE_LAST
    if kind == END:
        return START, 0
    if state in (ONE_SPACE, LAST_SPACE, ONE_BLANK, LAST_BLANK):
        if kind in (SPACE, BLANK):
            return (LAST_SPACE if kind == SPACE else LAST_BLANK), 0
        split = CUT_BEFORE_LAST if state in (LAST_SPACE, LAST_BLANK) else 0
        return (joined, split) if state in (ONE_SPACE, LAST_SPACE) else (fresh, split | CUT)
    if state == QUOTE:
        if kind in (ENDING, R_OR_V, L):
            return {ENDING: START, R_OR_V: QUOTE_E, L: QUOTE_L}[kind], 0
        return (IN_SIGNS, 0) if kind in (SIGN, APOSTROPHE) else (fresh, CUT)
    stays = {IN_WORD: letter, IN_NUMBER: kind == NUMBER, IN_SIGNS: kind in (SIGN, APOSTROPHE)}.get(state, False)
    return (state, 0) if stays else (fresh, CUT)


_STEPS = [_splitter_step(s, k) for s in range(STATES) for k in range(CLASSES)]
_NEXT = np.array([s for s, _ in _STEPS], np.intp)
_MARK = np.array([m for _, m in _STEPS], np.uint8)


def character_runs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """First code point and class of every run of code points of one class, as the library's own pre-tokenizer sees them."""
    from tokenizers import Tokenizer

    _byte_level(path)
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    # Consecutive code points of one class are one pre-token, so borders of runs come cheap; ASCII goes one by one.
    heads = list(range(0x80))
    for low, high in ((0x80, 0xD800), (0xE000, 0x40000), (0x40000, 0x80000), (0x80000, 0xC0000), (0xC0000, 0x110000)):
        heads += [low + start for _, (start, _) in split("".join(map(chr, range(low, high))))]
    ends = np.append(heads[1:], 0x110000)
    kind = np.full(0x110000, BLANK, np.uint8)
    for known, first in ((LETTER, "a"), (NUMBER, "1"), (SIGN, "!")):
        # "a" and a character are one pre-token exactly if that character is a letter, and so on.
        spans = {tuple(span) for _, span in split("".join(f"\n{first}{chr(c)}" for c in heads))}
        for i, (start, end) in enumerate(zip(heads, ends)):
            if (3 * i + 1, 3 * i + 3) in spans:
                kind[start:end] = known
    for special, letters in ((ENDING, "stmd"), (R_OR_V, "rv"), (E, "e"), (L, "l"), (APOSTROPHE, "'"), (SPACE, " ")):
        kind[[ord(c) for c in letters]] = special
    first = np.flatnonzero(np.diff(kind, prepend=255))
    return first, kind[first]


def _byte_level(path: str) -> dict:
    """The file's content; refused unless it is plain byte-level BPE with the usual split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
             and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]))
    if not plain:
        raise ValueError(f"not a byte-level BPE tokenizer: {path}")
    return spec


class Transitions:
    """Open-addressing table (state, byte) -> (next state, emission), looked up for many pairs at once."""

    def __init__(self):
        self.size, self.used = 1 << 14, 0
        self._empty()

    def _empty(self) -> None:
        self.key = np.full(self.size, -1, np.int64)
        self.value = np.zeros(self.size, np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.size.bit_length() + 1)).astype(np.intp)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the positions in ``key`` that are not known yet."""
        at = self._place(key)
        seen = self.key[at]
        value = self.value[at]
        off = np.flatnonzero(seen != key)
        unknown = []
        while len(off):
            empty = seen[off] == -1
            unknown.append(off[empty])
            off = off[~empty]
            at[off] = (at[off] + 1) & (self.size - 1)
            seen[off], value[off] = self.key[at[off]], self.value[at[off]]
            off = off[seen[off] != key[off]]
        return value, np.concatenate(unknown) if unknown else np.zeros(0, np.intp)

    def add(self, key: int, value: int) -> None:
        if 2 * (self.used + 1) > self.size:
            keys, values = self.key[self.key >= 0], self.value[self.key >= 0]
            self.size *= 2
            self._empty()
            for k, v in zip(keys.tolist(), values.tolist()):
                self._put(k, v)
        self._put(key, value)
        self.used += 1

    def _put(self, key: int, value: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.size.bit_length() + 1)
        while self.key[at] != -1:
            at = (at + 1) & (self.size - 1)
        self.key[at], self.value[at] = key, value


class Compiled:
    """Both transducers of one tokenizer file, in one worker."""

    def __init__(self, path: str, first: np.ndarray, kinds: np.ndarray):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = _byte_level(path)
        self.kind = np.repeat(kinds, np.diff(np.append(first, 0x110000)))
        special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self.letters = _byte_letters()
        back = {c: bytes([b]) for b, c in self.letters.items()}
        added = {t["content"] for t in spec["added_tokens"]}
        self.model = Tokenizer.from_file(path).model
        # Tokens that merging never leaves standing whole cannot be emitted.
        whole = {t: i for t, i in spec["model"]["vocab"].items() if t not in added and [x.id for x in self.model.tokenize(t)] == [i]}
        self.shown = {i: t for t, i in whole.items()}
        self.token = {b"".join(map(back.__getitem__, t)): i for t, i in whole.items()}
        self.prefix = {t[:k] for t in self.token for k in range(1, len(t))}
        self.clear()

    def clear(self) -> None:
        self.transitions = Transitions()
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.pairs: dict[int, bool] = {}
        self._state((b"", ((-1, 0),)))

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _stand(self, a: int, b: int) -> bool:
        """Whether the merge rules leave tokens a and b standing side by side."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = self.pairs[a << 32 | b] = [t.id for t in self.model.tokenize(self.shown[a] + self.shown[b])] == [a, b]
        return known

    def _make(self, key: int) -> None:
        """The transition of a state on a byte: (state << 8 | byte) -> (next << 8 | emission + 128)."""
        tail, history = self.states[key >> 8]
        tail += bytes([key & 255])
        for at in range(len(tail)):
            found = self.token.get(tail[at:]) if history[at] else None
            if found is not None and (history[at][0] < 0 or self._stand(history[at][0], found)):
                break
        else:
            raise ValueError("no token ends here: not a BPE vocabulary over all bytes")
        change = history[at][1] + 1
        keep = next(k for k in range(len(tail) + 1) if k == len(tail) or tail[k:] in self.prefix)
        # Places where no token can start any more need not be told apart.
        left = enumerate((*history, (found, change))[keep:], keep)
        after = self._state((tail[keep:], tuple((p[0], p[1] - change) if i == len(tail) or p and tail[i:] in self.prefix else None for i, p in left)))
        self.transitions.add(key, after << 8 | change + 128)

    def _values(self, key: np.ndarray) -> np.ndarray:
        value, unknown = self.transitions.find(key)
        if len(unknown):
            for k in np.unique(key[unknown]).tolist():
                self._make(k)
            value[unknown] = self.transitions.find(key[unknown])[0]
        return value

    # --- splitter ---

    def marks(self, kind: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Marks and states after each character class, entering in ``state``."""
        n = len(kind)
        lanes = max(1, min(LANES, n // 32))
        steps = -(-n // lanes)
        rows = np.full(lanes * steps, END, np.intp)
        rows[:n] = kind
        rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
        entering = self._compose(self._maps(rows), state)
        marks, states = np.empty((steps, lanes), np.uint8), np.empty((steps, lanes), np.uint8)
        for i in range(steps):
            at = entering * CLASSES + rows[i]
            marks[i], entering = _MARK[at], _NEXT[at]
            states[i] = entering
        return marks.T.ravel()[:n], states.T.ravel()[:n]

    @staticmethod
    def _maps(rows: np.ndarray) -> np.ndarray:
        """Leaving state of each lane for every entering state."""
        maps = np.repeat(np.arange(STATES)[:, None], rows.shape[1], axis=1)
        for i in range(len(rows)):
            maps = _NEXT[maps * CLASSES + rows[i]]
            if i % 16 == 15 and len(maps) > 1 and (maps == maps[0]).all():
                maps = maps[:1]  # every lane's map is constant by now
        return np.ascontiguousarray(np.broadcast_to(maps, (STATES, rows.shape[1])))

    @staticmethod
    def _compose(maps: np.ndarray, state: int) -> np.ndarray:
        """Entering state of each lane: the maps of all lanes before it, composed by a prefix scan over doubling distances."""
        lanes, far = maps.shape[1], 1
        while far < lanes:
            later = np.take_along_axis(maps[:, far:], maps[:, :-far], axis=0)
            maps = np.concatenate([maps[:, :far], later], axis=1)
            far *= 2
        return np.concatenate([[state], maps[state, :-1]]).astype(np.intp)

    # --- merger ---

    def emissions(self, data: np.ndarray, cut: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Change of the number of tokens at each byte, and the state left; ``cut`` marks bytes that start a pre-token."""
        n = len(data)
        lanes = max(1, min(LANES, n // 32))
        steps = -(-n // lanes)
        pad = lanes * steps - n
        rows = np.ascontiguousarray(np.append(data, np.zeros(pad, np.uint8)).reshape(lanes, steps).T).astype(np.int64)
        first = np.ascontiguousarray(np.append(cut, np.zeros(pad, bool)).reshape(lanes, steps).T)
        after, change = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int8)
        entered = np.zeros(lanes, np.int64)
        entered[0] = state
        now = entered.copy()
        for i in range(steps):
            now[first[i]] = 0
            value = self._values(now << 8 | rows[i])
            now = value >> 8
            after[i], change[i] = now, (value & 255) - 128
        while True:
            needed = np.concatenate([[state], after[-1, :-1]])
            lane = np.flatnonzero((needed != entered) & ~first[0])
            if not len(lane):
                break
            now = entered[lane] = needed[lane]
            for i in range(steps):
                open_ = ~first[i, lane]
                lane, now = lane[open_], now[open_]
                if not len(lane):
                    break
                value = self._values(now << 8 | rows[i, lane])
                now = value >> 8
                change[i, lane] = (value & 255) - 128
                apart = now != after[i, lane]
                after[i, lane] = now
                lane, now = lane[apart], now[apart]
        flat = after.T.ravel()
        return change.T.ravel()[:n], int(flat[n - 1])

    # --- texts ---

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every text; null is empty."""
        data, offsets = utf8(column)
        total = np.zeros(len(offsets) - 1, np.int64)
        special = np.zeros(len(data), bool)
        if self.special:
            for hit in self.special.finditer(data.tobytes()):
                self._special(hit.start(), hit.end(), offsets, special, total)
        split, merge, a = START, 0, 0
        if self.transitions.used > TRANSITIONS:
            self.clear()
        while a < len(data):
            b = min(a + BLOCK, len(data))
            while b < len(data) and data[b] & 0xC0 == 0x80:
                b += 1
            change, split, merge = self._block(data, offsets, special, a, b, split, merge)
            running = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
            total += np.diff(running[np.clip(offsets, a, b) - a])
            a = b
        return np.diff(offsets), total

    def _special(self, start: int, end: int, offsets: np.ndarray, special: np.ndarray, total: np.ndarray) -> None:
        """Note a reserved string; one that only the end of a text and the start of the next make up does not count."""
        text = np.searchsorted(offsets, start, "right") - 1
        if end <= offsets[text + 1]:
            special[start:end] = True
            total[text] += 1

    def _block(self, data, offsets, special, a, b, split, merge):
        part, ahead = data[a:b], b
        while ahead < len(data) and (ahead == b or data[ahead] & 0xC0 == 0x80):
            ahead += 1
        points = np.frombuffer(data[a:ahead].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data[a:ahead] & 0xC0) != 0x80)
        kind = self.kind[points]
        kind[special[a:ahead][lead]] = END
        ends = offsets[(offsets > a) & (offsets <= b)] - a
        place = np.arange(len(lead)) + np.searchsorted(ends, lead, "right")
        rows = np.full(len(lead) + len(ends), END, np.uint8)
        rows[place] = kind
        marks, states = self.marks(rows, split)
        own = len(rows) - (ahead > b)
        split = int(states[own - 1])
        cut = np.zeros(len(rows) + 1, bool)
        cut[:-1] = (marks & CUT) > 0
        cut[:-2] |= (marks[1:] & CUT_BEFORE_LAST) > 0
        first = np.zeros(len(part), bool)
        mine = lead < len(part)
        first[lead[mine]] = cut[place[mine]]
        change, merge = self.emissions(part, first, merge)
        change[special[a:b]] = 0
        return change, split, merge


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens): a row a row of ``docs`` (doc_id, text).

    ``path`` is a byte-level BPE file of the tokenizers library; counts are those of ``encode(text,
    add_special_tokens=False)`` with its defaults, so reserved strings inside a text count one token each. A null
    text is an empty one: 0 bytes, 0 tokens. Repeated and null doc_ids keep their rows. Texts are whole, of any
    length; work goes in blocks of 1 MB that hand their states on. Nothing is shuffled.

    A worker keeps the states it has met, about half a million transitions (some 350 MB), and then starts anew; results do not depend on it.
    """
    ship(docs.sparkSession)
    first, kinds = character_runs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        if path not in _loaded:
            _loaded[path] = Compiled(path, first, kinds)
        for batch in batches:
            for part in slices(batch, "text"):
                size, n = _loaded[path].counts(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
