"""Exact top-k search by tiled matrix products.

Candidates lie in shards and queries in blocks; every (block, shard) pair is one
group. A group multiplies its matrices tile by tile, keeps the best k of each query a
tile, and the short lists are merged up a tree of groups. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import ship

SHARD_ROWS = 8192
BLOCK_ROWS = 8192
TILE = 1024
FAN_IN = 16
_KINDS = {"query_id": "int64", "vec_id": "int64", "score": "int64", "shard": "int32", "block": "int32"}
_FOUND = "query_id bigint, vec_id bigint, score bigint, shard int, block int"


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of every component; vectors (or ids) that are null or hold null, NaN or infinite components go."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vector).isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(sound).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def best_of_tile(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of every row; ties go to the smaller column."""
    if score.shape[1] > k:
        bar = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
        row, col = np.nonzero(score >= bar)
    else:
        row, col = (x.ravel() for x in np.indices(score.shape))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    head = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - head < k
    return row[keep], col[keep]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum stays below 2^53, else in integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * max(1, q.shape[1])
    if bound < 2**53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    if bound >= 2**63:
        raise ValueError("inner products do not fit 64 bits")
    return q @ c.T


def _search(k: int):
    def run(key, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        if not len(queries) or not len(shard):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _KINDS.items()})
        shard = shard.rename(columns={"c_id": "vec_id", "c_v": "v"}).sort_values("vec_id", kind="stable")
        for size, part in shard.groupby(shard["v"].map(len), sort=False):
            asked = queries[queries["v"].map(len) == size]
            if not len(asked):
                continue
            qid, q = asked["vec_id"].to_numpy(), np.array(asked["v"].tolist(), np.int64).reshape(len(asked), size)
            cid, c = part["vec_id"].to_numpy(), np.array(part["v"].tolist(), np.int64).reshape(len(part), size)
            for a in range(0, len(q), TILE):
                best: list[tuple] = []
                for b in range(0, len(c), TILE):
                    score = _products(q[a:a + TILE], c[b:b + TILE]).astype(np.float64 if np.abs(c).max(initial=0) < 2**20 else object)
                    own = qid[a:a + TILE, None] == cid[None, b:b + TILE]
                    score[own] = -np.inf
                    row, col = best_of_tile(score, k + 1 if own.any() else k)
                    kept = ~own[row, col]
                    row, col = row[kept], col[kept]
                    best.append((row, cid[b:b + TILE][col], score[row, col].astype(np.int64)))
                row, vec, score = (np.concatenate(x) for x in zip(*best))
                order = np.lexsort((vec, -score, row))
                row, vec, score = row[order], vec[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                found.append(pd.DataFrame({"query_id": qid[a + row[keep]], "vec_id": vec[keep], "score": score[keep]}))
        out = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return out.assign(shard=int(key[1]), block=int(key[0])).astype(_KINDS)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products; ties go to the smaller vec_id.

    Both inputs: vec_id, v (array of integers), as ``quantised`` gives them. Candidates with the query's own id take
    no part, nor do those of another length. Rows that repeat a candidate's id are scored each; rows that repeat a
    query's id are one query (the smallest vector). Fewer than k candidates give fewer rows, an empty table none.

    Work is queries times candidates, as an exact search must be; rows moved are those of either side times the
    number of blocks or shards of the other, with thousands of rows a block.
    """
    ship(candidates.sparkSession)
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = candidates.select(F.lit(0).alias("s")).union(asked.select(F.lit(1))).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in sizes}
    shards, blocks = max(1, -(-n.get(0, 0) // SHARD_ROWS)), max(1, -(-n.get(1, 0) // BLOCK_ROWS))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Both sides may come from one table; names of their own keep the columns apart.
    dealt = candidates.select(F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), spread(blocks).alias("c_block"),
                              F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("c_shard"))
    posed = asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), spread(shards).alias("shard"))
    found = posed.groupBy("block", "shard").cogroup(dealt.groupBy("c_block", "c_shard")).applyInPandas(_search(k), _FOUND)
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > 1:
        shards = -(-shards // FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        row = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))
        found = found.withColumn("rank", row).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
