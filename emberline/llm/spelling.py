"""Spelling variants: words one edit apart, found with a bit-sliced position index.

For every (position, letter) the index holds a bit set over its words: which of them have that letter there. A query
word walks through its letters and keeps four sets, each updated for 64 words by one machine operation:

* ``same``: words that agree with all letters so far,
* ``other``: one letter was replaced; later letters stand at the same position,
* ``less``: the query has one letter more; later letters stand one position earlier in the word,
* ``more``: the word has one letter more; later letters stand one position later.

The end of a word counts as a letter, so the last step reads off the words that are exactly one edit away.

Words meet only where they can be near: of two words one edit apart, with ``m`` the length of the shorter, either the first
or the last m // 2 letters agree. Words are dealt by these halves, a group (or a part of a large one, against
each other part) is a stretch of the index, and a query looks at the 64-word blocks of its stretch only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import ship, written

LETTERS = "[a-zÀ-ÿ]+"
PART_WORDS = 16_384
TASK_ROWS = 1 << 16
INDEX_BYTES = 32 << 20
CHUNK = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAIRS = "word string, near string, near_n bigint"


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: a row a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) of every whole text; A-Z in lower case.

    A null text, or one without letters, gives no row; rows that repeat count again. Other columns are left behind.
    """
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """word, n: distinct words of at least ``shortest`` letters (2 or more) that occur ``least`` times or more. Nulls do not count."""
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _halves(word: Column, shortest: int) -> Column:
    """What a word is dealt by: for each length m that the shorter word of a pair can have, its first and last m // 2 letters."""
    size = F.length(word)
    both = [F.struct(m.cast("int").alias("m"), F.lit(last).alias("last"),
                     F.xxhash64(m, F.lit(last), F.right(word, (m / 2).cast("int")) if last else F.left(word, (m / 2).cast("int"))).alias("key"))
            for m in (size, size - 1) for last in (False, True)]
    return F.filter(F.array(*both), lambda h: h["m"] >= shortest)


def near_pairs(words: DataFrame, shortest: int = 6) -> DataFrame:
    """word, near, near_n: every ordered pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    ``words`` (word, n) are distinct and have at least ``shortest`` (2 or more) code points. No pair is lost: a group of more than
    ``PART_WORDS`` words is split into parts and every pair of parts is a task's group.
    """
    ship(words.sparkSession)
    total = words.count()
    entries = words.select("word", "n", F.explode(_halves(F.col("word"), shortest)).alias("h")).select("word", "n", "h.*")
    heavy = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > PART_WORDS)
    parts = heavy.select("key", F.ceil(F.col("size") / PART_WORDS).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    cells = F.array_distinct(F.concat(F.transform(every, lambda j: cell(F.col("own"), j)), F.transform(every, lambda i: cell(i, F.col("own")))))
    placed = entries.join(parts, "key", "left").fillna(1, ["parts"]).withColumn("own", own).withColumn("c", F.explode(cells))
    tasks = max(1, -(-4 * total // TASK_ROWS), min(2 * words.sparkSession.sparkContext.defaultParallelism, total // 1024))
    group = F.xxhash64("key", "c.i", "c.j")
    dealt = placed.select(
        group.alias("key"), "m", "last", (F.col("c.i") == F.col("own")).alias("indexed"), (F.col("c.j") == F.col("own")).alias("asked"),
        "word", "n", F.pmod(F.xxhash64(group, "m", "last"), F.lit(tasks)).cast("int").alias("task"))
    return dealt.groupBy("task").applyInPandas(_near_in_task, _PAIRS)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _near_in_task(rows: pd.DataFrame) -> pd.DataFrame:
    """Near pairs inside each (key, m, last) group of a task."""
    rows = rows.sort_values(["m", "last", "key", "indexed"], kind="stable").reset_index(drop=True)
    group = (rows[["m", "last", "key"]] != rows[["m", "last", "key"]].shift()).any(axis=1).cumsum().to_numpy() - 1
    found = []
    # Groups in order of length, so a stretch of the index is no wider than its longest word needs.
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(rows)))
    at = 0
    while at < len(starts):
        end, held = at, 0
        while end < len(starts):
            more = (held + sizes[end] + 63) // 64 * (int(rows["m"].iat[starts[end]]) + 4) * 64 * 8
            if end > at and more > INDEX_BYTES:
                break
            held += sizes[end]
            end += 1
        part = slice(starts[at], starts[at] + held)
        found += _near_in_stretch(rows.iloc[part], group[part])
        at = end
    return pd.concat(found) if found else pd.DataFrame({"word": pd.Series(dtype=str), "near": pd.Series(dtype=str), "near_n": pd.Series(dtype="int64")})


class PositionIndex:
    """Bit sets over words, 64 words a block: ``bits[block, position, letter]``; letter 0 is the end of the word."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, alphabet: int):
        """Word w has the letter numbers ``letters[starts[w]:starts[w] + sizes[w]]``, 1 or more each."""
        self.blocks, self.alphabet = -(-len(starts) // 64), alphabet
        self.positions = int(sizes.max(initial=0)) + 3
        word = np.repeat(np.arange(len(starts)), sizes + 1)
        position = _ragged(sizes + 1)
        ends = position == np.repeat(sizes, sizes + 1)
        letter = np.zeros(len(word), np.int64)
        letter[~ends] = letters[(np.repeat(starts, sizes + 1) + position)[~ends]]
        place = ((word // 64) * self.positions + position) * alphabet + letter
        order = np.argsort(place, kind="stable")
        place, bit = place[order], (np.uint64(1) << (word % 64).astype(np.uint64))[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.bits = np.zeros(self.blocks * self.positions * alphabet, np.uint64)
        if len(first):
            self.bits[place[first]] = np.bitwise_or.reduceat(bit, first)

    def _at(self, block: np.ndarray, position: np.ndarray | int, letter: np.ndarray | int) -> np.ndarray:
        return self.bits[(block * self.positions + position) * self.alphabet + letter]

    def near(self, letters, starts, sizes, block, among, half) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each (query word, block): words with one letter replaced, one less, one more, and those that share its first ``half`` letters.

        ``among`` says which words of the block take part. Queries come longest first.
        """
        same, other, less, more, begun = among.copy(), np.zeros_like(among), np.zeros_like(among), np.zeros_like(among), among.copy()
        for i in range(min(int(sizes.max(initial=0)), self.positions)):
            n = int(np.searchsorted(-sizes, -i, "left"))  # the queries longer than i
            letter = letters[starts[:n] + i]
            here = self._at(block[:n], i, letter)
            ahead = self._at(block[:n], i + 1, letter) if i + 1 < self.positions else np.zeros(n, np.uint64)
            before = self._at(block[:n], i - 1, letter) if i else np.zeros(n, np.uint64)
            other[:n] = other[:n] & here | same[:n] & ~here
            less[:n] = less[:n] & before | same[:n]
            more[:n] = (more[:n] | same[:n]) & ahead
            same[:n] &= here
            reached = half[:n] == i + 1
            begun[:n][reached] = same[:n][reached]
        ended = lambda position: np.where(
            position < self.positions, self._at(block, np.minimum(position, self.positions - 1), 0), np.uint64(0))
        return other & ended(sizes), less & ended(sizes - 1), (more | same) & ended(sizes + 1), begun


def _near_in_stretch(rows: pd.DataFrame, group: np.ndarray) -> list[pd.DataFrame]:
    words, m, last = rows["word"].to_numpy(), rows["m"].to_numpy(), rows["last"].to_numpy()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    alphabet, letters = np.unique(points, return_inverse=True)
    letters, starts = letters + 1, np.cumsum(sizes) - sizes
    held = np.flatnonzero(rows["indexed"].to_numpy())
    asked = np.flatnonzero(rows["asked"].to_numpy())
    if not len(held) or not len(asked):
        return []
    index = PositionIndex(letters, starts[held], sizes[held], len(alphabet) + 1)
    # The stretch of the index that a query's group covers, and its blocks.
    low, high = np.searchsorted(group[held], group[asked], "left"), np.searchsorted(group[held], group[asked], "right")
    asked, low, high = (x[high > low] for x in (asked, low, high))
    order = np.argsort(-sizes[asked], kind="stable")
    asked, low, high = asked[order], low[order], high[order]
    blocks = (high - 1) // 64 - low // 64 + 1
    found, near_n = [], rows["n"].to_numpy()
    ends = np.cumsum(blocks)
    at = 0
    while at < len(asked):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        query = np.repeat(np.arange(at, stop), blocks[at:stop])
        block = low[query] // 64 + _ragged(blocks[at:stop])
        word = asked[query]
        among = _range_bits(np.maximum(low[query] - 64 * block, 0), np.minimum(high[query] - 64 * block, 64))
        other, less, more, begun = index.near(letters, starts[word], sizes[word], block, among, m[word] // 2)
        # Pairs count where m is the length of the shorter word, and among last halves only if first halves differ.
        hit = np.where(m[word] == sizes[word], other | more, less) & np.where(last[word], ~begun, ~np.uint64(0))
        rows_hit = np.flatnonzero(hit)
        set_bits = np.unpackbits(hit[rows_hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, bit = np.nonzero(set_bits)
        near = held[64 * block[rows_hit[r]] + bit]
        found.append(pd.DataFrame({"word": words[word[rows_hit[r]]], "near": words[near], "near_n": near_n[near]}))
        at = stop
    return found


def _range_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with bits low to high - 1 set (0 <= low < high <= 64)."""
    full = ~np.uint64(0)
    return (full << low.astype(np.uint64)) & (full >> (64 - high).astype(np.uint64))


def group_variants(words: DataFrame, factor: int = 5, shortest: int = 6) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n).

    A word's form is its near word (one edit away) of largest n, ties to the smallest in code-point order, if that n is at least
    ``factor`` (2 or more) times the word's; else null. The root is where following forms ends, the word itself
    where it has no form. ``n_near`` counts all near words. An empty table gives an empty result.
    """
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "vocabulary")
    best = near_pairs(words, shortest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    formed = F.col("b.m").isNotNull() & (-F.col("b.m") >= factor * F.col("n"))
    forms = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(formed, F.col("b.near")).alias("form"),
        F.when(formed, -F.col("b.m")).cast("bigint").alias("form_n")), "forms")
    roots = _roots(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: the ends of chains of links (word, root). Each step doubles the length of what is followed; n grows along a chain, so there are no rings."""
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = written(links.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not links.agg(F.max("moved")).first()[0]:
            return links.select("word", "root")
        links = links.drop("moved")
