"""Token ids by the tokenizers library, each distinct pre-token encoded once.

Running the library over whole texts costs about 8 microseconds a word. Here numpy
finds the borders of pre-tokens for all texts of a slice at once, Arrow codes the
distinct ones, and only pre-tokens not met before reach the library's BPE model.
Texts beyond plain Latin script, or with special tokens, go through the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import ragged, trimmed, utf8

END_ID = 1
CACHE = 400_000
SLICE = 3 << 20
SPACE, BLANK, LETTER, DIGIT, SIGN, ODD = range(6)

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, loaded once a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Encoder(path)
    return _loaded[path]


def forget() -> None:
    """Drop loaded encoders and their caches: operators without tokens call this, as workers live on from stage to stage."""
    _loaded.clear()
    trimmed()


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _byte_classes() -> np.ndarray:
    kind = np.full(256, ODD, np.int8)
    kind[0x21:0x7F] = SIGN
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[[9, 10, 11, 12, 13]] = BLANK
    kind[0x20] = SPACE
    return kind


def _pair_classes() -> np.ndarray:
    """Class of two-byte characters U+0080 to U+024F by lead byte (from 0xC2) and second byte."""
    kind = np.full((8, 256), LETTER, np.int8)
    kind[0, :] = SIGN
    kind[0, 0x80:0xA1] = ODD
    kind[0, [0xAA, 0xB5, 0xBA]] = LETTER
    kind[0, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
    kind[1, [0x97, 0xB7]] = SIGN
    kind[7, 0x90:] = ODD
    return kind


_KIND, _PAIR = _byte_classes(), _pair_classes()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Sequence

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = Sequence([])
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}  # ids as bytes: a third of the memory of lists

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts and the n+1 offsets of each text; null is empty."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        odd = np.zeros(len(column), bool)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        data, offsets = utf8(column)
        odd |= self._odd_texts(data, offsets)
        plain = pc.if_else(pa.array(odd), "", column) if odd.any() else column
        if self.words:
            plain = pc.utf8_lower(plain)
        data, offsets = utf8(plain)
        cuts = self._cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        ids = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        start, index = np.cumsum(length) - length, coded.indices.to_numpy()
        each = length[index]
        out = flat[ragged(start[index], each)]
        ends = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(cuts, offsets)]
        return self._mend(column, odd, out, ends) if odd.any() else (out, ends)

    @staticmethod
    def _kinds(data: np.ndarray) -> np.ndarray:
        """Class of each byte; both bytes of a two-byte character have its class."""
        kind = _KIND[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        if len(lead):
            kind[lead] = kind[lead + 1] = _PAIR[data[lead] - 0xC2, data[lead + 1]]
        return kind

    def _odd_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self._kinds(data) == ODD)
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, at, "right") - 1] = True
        return odd

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which a pre-token starts; every byte lies in exactly one."""
        if not len(data):
            return np.zeros(0, np.int64)
        kind = self._kinds(data)
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        blank = kind <= BLANK
        group = np.where(blank, BLANK, kind)
        cut = first[:-1].copy()
        cut[1:] |= group[1:] != group[:-1]
        if self.words:
            cut |= (kind == DIGIT) & ((data & 0xC0) != 0x80)
        else:
            last = blank & ~first[1:]
            last[:-1] &= ~blank[1:]
            cut |= last
            joined = np.flatnonzero(last & (kind == SPACE)) + 1
            cut[joined] = False
        self._contractions(data, kind, first, cut)
        return np.flatnonzero(cut)

    def _contractions(self, data, kind, first, cut) -> None:
        """'s 't 're 've 'm 'll 'd are pre-tokens of their own where one starts at the apostrophe."""
        for at in np.flatnonzero(data[:-1] == 0x27).tolist():
            before = None if first[at] else kind[at - 1]
            if before == SIGN and not cut[at] or before == SPACE and not self.words:
                continue
            tail = bytes(data[at + 1:at + 3])
            size = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if not size or first[at + 1:at + 1 + size].any():
                continue
            cut[at], cut[at + 1:at + 1 + size] = True, False
            if at + 1 + size < len(data):
                cut[at + 1 + size] |= not blank_joined(kind, at + 1 + size)

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        if len(known) >= CACHE:
            known.clear()
        new = [p for p in pieces if p not in known]
        if self.words:
            known.update((p, b"") for p in new if p.isspace())
            new = [p for p in new if not p.isspace()]
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            shown = "\0".join(part).encode("utf-8").decode("latin-1").translate(self.letters).split(self.letters[0])
            done = self.bare.encode(shown, is_pretokenized=True, add_special_tokens=False)
            ids, size = np.array(done.ids, np.uint32).tobytes(), np.bincount(np.array(done.word_ids, np.int64), minlength=len(part))
            end = (4 * np.cumsum(size)).tolist()
            begin = [0, *end[:-1]]
            known.update((p, ids[a:b]) for p, a, b in zip(part, begin, end))
        return [known[p] for p in pieces]

    def _mend(self, column, odd, out, ends):
        texts = column.filter(pa.array(odd)).to_pylist()
        whole = iter(e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False))
        parts = [np.array(next(whole), np.uint32) if o else out[ends[i]:ends[i + 1]] for i, o in enumerate(odd)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def blank_joined(kind: np.ndarray, at: int) -> bool:
    """Whether the character after a contraction is white space, whose own borders are already right."""
    return kind[at] <= BLANK


def with_end(ids: np.ndarray, ends: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end`` appended to each."""
    n = len(ends) - 1
    moved = ends + np.arange(n + 1)
    out = np.empty(len(ids) + n, np.uint32)
    last = np.zeros(len(out), bool)
    last[moved[1:] - 1] = True
    out[last], out[~last] = end, ids
    return out, moved
