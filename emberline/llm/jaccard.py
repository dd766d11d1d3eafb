"""Near-duplicate join on word n-gram Jaccard similarity, by a MinHash LSH forest.

A text is a leaf in every tree: its path are ``DEPTH`` labels, each the minimum of a hash over its shingles. The leaves of all
trees are one table sorted by (tree, path), so a node of a trie is a run of neighbours with a common prefix. Matching starts at full
depth, and prefixes are shortened by one label a level. A text leaves the ascent at the longest prefix with which a partner is met in some tree
with the target recall, whatever its hashes: ``stop_lengths`` works that out from the least similarity at the threshold or above that a text of so
many shingles can have with any other at all. Two texts are candidates if they share a prefix of the longer of their two lengths in some tree.
Runs are linked to their first leaf; the linked sets are then compared exactly, tile by tile, on the shingles of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import ship, written
from .textarrays import LETTERS_DIGITS, Words, grams, mixed, slices, utf8, whole_grams, words
from .tokens import forget

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 8
RECALL = 0.999
TILE_DOCS, TILE_BYTES = 256, 4 << 20
LABEL_BYTES = 2
_SIGNED = "did bigint, key binary, n_words bigint, n_bytes bigint, stop int, signature binary"
_LINKED = "a bigint, b bigint, border binary"
_VERIFIED = "comp bigint, tiled boolean, node bigint, root bigint, links bigint"


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten from full depth until a pair at the threshold shares a prefix of that length in some tree with the target recall."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def least_similarity(n: int, threshold: Fraction) -> Fraction:
    """The smallest Jaccard similarity, at the threshold or above, that a set of ``n`` can have with any set.

    The union of the two has ``n + extra`` members; at least ``ceil(threshold * union)`` must be common, at most n.
    """
    unions = range(n, floor(n / threshold) + 1)
    return min(Fraction(ceil(threshold * u), u) for u in unions)


def stop_lengths(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Prefix length at which a text of n shingles leaves the ascent; the last entry holds for all larger n.

    From the size on at which some union is a multiple of the threshold's denominator, the least similarity is the threshold itself.
    """
    share = Fraction(threshold).limit_denominator(10**6)
    always = min(4096, ceil(share.denominator / (1 / share - 1)) + 1) if share < 1 else 1
    least = [float(least_similarity(n, share)) for n in range(1, always)]
    return np.array([depth, *(prefix_length(x, recall, trees, depth) for x in least), prefix_length(threshold, recall, trees, depth)], np.int32)


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams of all texts and the offsets of each text; a shorter text is one shingle, an empty one has none."""
    all_grams = grams(w.hashes, n)
    use = whole_grams(w, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    for d in short.tolist():
        a, b = int(w.first[d]), int(w.first[d + 1])
        use[a] = True
        all_grams[a] = grams(w.hashes[a:b], b - a)[0] ^ np.uint64(b - a)
    ends = np.concatenate([[0], np.cumsum(use)])[w.first]
    return all_grams[use], ends


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sign(batches: Iterator[pa.RecordBatch], n: int, trees: int, depth: int, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
    forget()
    factor = _factors(trees * depth).reshape(trees, depth)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            data, offsets = utf8(part.column("text"))
            w = words(data, offsets, LETTERS_DIGITS)
            sh, ends = shingles(w, n)
            size = np.diff(ends)
            full = np.flatnonzero(size)
            labels = np.zeros((part.num_rows, trees, depth), ">u2")
            for t in range(trees if len(full) else 0):
                for k in range(depth):
                    labels[full, t, k] = mixed(np.minimum.reduceat(sh * factor[t, k], ends[:-1][full])) >> np.uint64(48)
            for d in np.flatnonzero((size > 1) & (size < len(stops) - 1)).tolist():
                size[d] = len(np.unique(sh[ends[d]:ends[d + 1]]))
            stop = stops[np.minimum(size, len(stops) - 1)]
            width = trees * depth * LABEL_BYTES
            signature = pa.Array.from_buffers(pa.binary(width), part.num_rows, [None, pa.py_buffer(labels.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("did"), part.column("key"), pa.array(w.counts, pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(stop, pa.int32()), signature],
                ["did", "key", "n_words", "n_bytes", "stop", "signature"])


def _climb(batches: Iterator[pa.RecordBatch], levels: list[int], depth: int) -> Iterator[pa.RecordBatch]:
    """Edges of the candidates in one stretch of the sorted leaves (tree, path, node, stop), a run being linked to its first leaf.

    At a level only texts that have not left yet take part. A pair that goes on to a shorter level is linked there, so each level links
    those of which one leaves at it. The first and last leaf of the stretch at each level are named with their prefix, since their runs may reach on.
    """
    width = depth * LABEL_BYTES
    heads: dict[int, tuple[np.ndarray, int, int]] = {}
    lasts: dict[int, tuple[np.ndarray, int]] = {}
    borders: list[tuple[int, bytes]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path").cast(pa.binary(width))
        path = np.frombuffer(path.buffers()[1], np.uint8, batch.num_rows * width, path.offset * width).reshape(-1, width)
        path = np.concatenate([batch.column("tree").to_numpy()[:, None].astype(np.uint8), path], 1)
        node, stop = batch.column("node").to_numpy(), batch.column("stop").to_numpy()
        found = []
        for level in levels:
            at = np.flatnonzero(stop <= level)
            if not len(at):
                continue
            prefix, ids, ends = path[at, :1 + level * LABEL_BYTES], node[at], stop[at]
            if level in heads:
                first, head, head_stop = heads[level]
                prefix, ids, ends = np.concatenate([first[None], prefix]), np.append(head, ids), np.append(head_stop, ends)
            else:
                borders.append((int(ids[0]), bytes([level]) + prefix[0].tobytes()))
            new = np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(1)])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            use = ~new & (np.maximum(ends, ends[head]) == level)
            found.append((ids[use], ids[head[use]]))
            heads[level] = prefix[-1].copy(), int(ids[head[-1]]), int(ends[head[-1]])
            lasts[level] = prefix[-1].copy(), int(ids[-1])
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield _edges(a, b, pa.nulls(len(a), pa.binary()))
    borders += [(last, bytes([level]) + prefix.tobytes()) for level, (prefix, last) in lasts.items()]
    nodes = np.array([x[0] for x in borders], np.int64)
    yield _edges(nodes, nodes, pa.array([x[1] for x in borders], pa.binary()))


def _edges(a: np.ndarray, b: np.ndarray, border: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), border], ["a", "b", "border"])


def candidates(nodes: DataFrame, trees: int, depth: int, stops: np.ndarray) -> DataFrame:
    """a, b: edges that connect all texts which are candidates of each other; ``nodes`` has node, stop and signature.

    The leaves are dealt by ranges of (tree, path, node), so a prefix that a third of all texts share spreads over tasks;
    runs that cross from one range to the next are joined by the prefixes at the ranges' ends, a few rows a range.
    """
    levels = sorted({int(x) for x in stops}, reverse=True)
    width = depth * LABEL_BYTES
    leaves = nodes.select("node", "stop", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("path"), "node", "stop")
    forest = leaves.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = written(forest.mapInArrow(lambda it: _climb(it, levels, depth), _LINKED), "forest")
    inside = found.where("border is null").select("a", "b")
    ends = found.where("border is not null").select("a", "border")
    heads = ends.groupBy("border").agg(F.min("a").alias("b"))
    return inside.union(ends.join(heads, "border").select("a", "b")).where("a <> b")


def linked(sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with similarity at the threshold or above, counted exactly in integers.

    With ``side`` (0 or 1 a text) only pairs of different sides count.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    value, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    often = np.bincount(place, minlength=len(value)) > 1
    use = often[place]
    place, owner = (np.cumsum(often) - 1)[place[use]], owner[use]
    common = np.zeros((m, m))
    step = max(1, (16 << 20) // max(1, 4 * m))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for at in range(0, int(often.sum()), step):
        a, b = np.searchsorted(place, [at, at + step])
        block = np.zeros((m, min(step, int(often.sum()) - at)), np.float32)
        block[owner[a:b], place[a:b] - at] = 1
        common += block @ block.T
    share = Fraction(threshold).limit_denominator(10**6)
    union = size[:, None] + size[None, :] - common
    near = common * share.denominator >= union * share.numerator
    np.fill_diagonal(near, False)
    return near if side is None else near & (side[:, None] != side[None, :])


def roots(near: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each text."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _verify(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (comp, low, high, node); one such run is held at a time."""
    held: list[tuple] = []
    key = None
    done: list[tuple] = []

    def settle() -> None:
        comp, low, high = key
        tile = np.array([r[0] for r in held])
        sets = [r[3] for r in held]
        near = linked(sets, None if low == high else (tile == high).astype(int), threshold)
        copies = np.array([r[2] for r in held])
        links, root = near @ copies, roots(near)
        nodes = [r[1] for r in held]
        tiled = held[0][4] > 1
        done.extend((comp, tiled, nodes[i], nodes[root[i]], int(links[i])) for i in range(len(nodes)))

    for batch in batches:
        for part in slices(batch, "text"):
            w = words(*utf8(part.column("text")), LETTERS_DIGITS)
            sh, ends = shingles(w, n)
            cols = (part.column(c).to_pylist() for c in ("comp", "low", "high", "tile", "node", "copies", "tiles"))
            for i, (comp, low, high, tile, node, copies, tiles) in enumerate(zip(*cols)):
                if key != (comp, low, high):
                    if held:
                        settle()
                    held, key = [], (comp, low, high)
                held.append((tile, node, copies, np.unique(sh[ends[i]:ends[i + 1]]), tiles))
        if len(done) > 5000:
            yield _batch(done)
            done = []
    if held:
        settle()
    yield _batch(done)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ["comp", "tiled", "node", "root", "links"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    Input: doc_id, text (other columns are ignored). Words are runs of letters and digits, lower-case. Two texts are
    linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; a text of fewer words is one
    shingle. ``class_id`` is the smallest doc_id that can be reached over links, ``n_links`` the number of other rows linked to
    the row, copies included. Texts without words (null, empty, signs only) have a class of their own and no links;
    null doc_ids take part and are named last.

    Exact copies are one node with a weight. Large linked sets are split into tiles of bounded size and all pairs of
    tiles are compared, each in a group of its own, so a hot group spreads over tasks; only sums and a
    forest of links leave a tile.
    """
    signed, named = _named(docs, threshold, n, recall)
    alone = signed.where("n_words = 0").select(F.col("did").alias("doc_id"), F.col("did").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    classes = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(classes, "root").select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.where("n_words > 0").select("did", "key").join(named, "key").select(F.col("did").alias("doc_id"), "class_id", "n_links").union(alone)


def text_key(text: Column) -> Column:
    """Equal for equal texts, whatever their case; null is as empty."""
    return F.unhex(F.md5(F.coalesce(F.lower(text), F.lit("")).cast("binary")))


def class_firsts(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """first_id, key: of each class of ``near_classes`` the text that stands for it, by its smallest doc_id (null last) and ``text_key``.

    Classes are told apart by their texts, so one doc_id on several texts, or none, mixes no classes. Texts without words stand for themselves.
    """
    signed, named = _named(docs, threshold, n, recall)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "key")).alias("f"))
    alone = signed.where("n_words = 0").select(F.col("did").alias("first_id"), "key").distinct()
    return first.select("f.first_id", "f.key").union(alone)


def _named(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and a row for each text with words: key, node, first_id, copies, links, root (one for each class)."""
    spark = docs.sparkSession
    ship(spark)
    stops = stop_lengths(threshold, recall, TREES, DEPTH)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("did"), F.lower("text").alias("text"))
    rows = rows.withColumn("key", text_key(F.col("text")))
    signed = written(rows.mapInArrow(lambda it: _sign(it, n, TREES, DEPTH, stops), _SIGNED), "signatures")

    texts = signed.where("n_words > 0").groupBy("key").agg(
        F.min("did").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("n_bytes").alias("n_bytes"), F.first("stop").alias("stop"),
        F.first("signature").alias("signature"))
    nodes = written(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    comps = written(components(candidates(nodes, TREES, DEPTH, stops)).select("node", F.col("root").alias("comp")), "candidates")

    members = comps.join(nodes.drop("signature", "stop"), "node")
    tiles = members.groupBy("comp").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE_DOCS, F.sum("n_bytes") / TILE_BYTES)).cast("int").alias("tiles"))
    placed = members.join(tiles, "comp").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # One row of documents stands for all copies; its id joins in so that copies of one text spread.
    chosen = rows.select("did", "key", "text").join(placed, (rows["key"] == placed["key"]) & rows["did"].eqNullSafe(placed["first_id"]))
    chosen = chosen.select("comp", "node", "copies", "tile", "tiles", "text").dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = chosen.withColumn("other", other).select(
        "comp", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "copies", "tiles", "text")
    dealt = paired.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high", "node")
    verified = written(dealt.mapInArrow(lambda it: _verify(it, n, threshold), _VERIFIED), "verified")

    bridges = components(verified.where("tiled").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    links = links.join(bridges.withColumnRenamed("root", "far"), "node", "left").select("node", "links", F.coalesce("far", "root").alias("root"))
    named = nodes.select("key", "node", "first_id", "copies").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return signed, named
