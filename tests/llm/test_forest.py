"""The LSH forest against a plain trie matcher."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import graph, jaccard

TREES, DEPTH, STOPS = 3, 4, np.array([4, 3, 2], np.int32)


def plain_roots(leaves):
    """Smallest node reachable from each over pairs that share, in some tree, a prefix of the longer of their lengths."""
    root = {n: n for n, _, _ in leaves}
    changed = True
    while changed:
        changed = False
        for a, stop_a, paths_a in leaves:
            for b, stop_b, paths_b in leaves:
                k = max(stop_a, stop_b)
                if root[a] > root[b] and any(x[:k] == y[:k] for x, y in zip(paths_a, paths_b)):
                    root[a], changed = root[b], True
    return root


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_forest_links_what_plain_tries_link(spark, ranges):
    rng = random.Random(ranges)
    leaves = [(i, rng.choice([2, 3, 4]), [tuple(rng.choice([0, 0, 0, 1, 255, 65535]) for _ in range(DEPTH)) for _ in range(TREES)]) for i in range(90)]
    leaves += [(i, rng.choice([2, 3, 4]), [(7, 7, 7, 7)] * TREES) for i in range(200, 230)]
    leaves += [(i, 2, [tuple(rng.randrange(65536) for _ in range(DEPTH)) for _ in range(TREES)]) for i in range(300, 330)]
    rows = [(n, stop, np.array(paths, ">u2").tobytes()) for n, stop, paths in leaves]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        nodes = spark.createDataFrame(rows, "node bigint, stop int, signature binary")
        edges = jaccard.candidates(nodes, TREES, DEPTH, STOPS)
        got = {r.node: r.root for r in graph.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {n: got.get(n, n) for n, _, _ in leaves} == plain_roots(leaves)


def test_forest_of_no_leaves(spark):
    nodes = spark.createDataFrame([], "node bigint, stop int, signature binary")
    assert jaccard.candidates(nodes, TREES, DEPTH, STOPS).count() == 0


def test_least_similarity_by_all_pairs_of_sets():
    share = Fraction(4, 5)
    for n in range(1, 40):
        reach = [Fraction(c, n + extra) for c in range(1, n + 1) for extra in range(2 * n)]
        assert jaccard.least_similarity(n, share) == min(x for x in reach if x >= share)
    stops = jaccard.stop_lengths()
    assert stops[1] == jaccard.DEPTH and stops[-1] == jaccard.prefix_length() and (stops >= jaccard.prefix_length()).all()


def test_recall_at_the_threshold(spark):
    """Pairs at exactly 0.8, of many sizes, so that every stop length is met."""
    rng, rows = random.Random(5), []
    for i in range(400):
        common = 4 * rng.choice([1, 2, 3, 5, 20])
        own = [f"w{i}x{k}" for k in range(common + 4)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, *(f"n{i}x{k}" for k in range(common // 4))]))]
    got = jaccard.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).where(F.col("doc_id") % 2 == 1)
    assert got.where("n_links = 1 and class_id = doc_id - 1").count() >= 399
