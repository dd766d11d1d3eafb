"""Hard-negative mining by Kronecker-packed products.

Components are integers. Those of several candidates are biased to be non-negative and laid side by
side in separate bit fields of one wide integer; one multiplication by an anchor's (biased) component
then serves all of them. A field is wide enough for the whole sum over the dimensions, so no field ever
carries into the next, and shifting, masking and taking the biases out again gives the exact scores.

Wide integers live in the 53 exact bits of a double wherever a field fits (matrix products then run as fast as
the machine can), else in Python integers of any width.

Anchors lie in blocks and candidates in shards, both bounded in bytes; a (block, shard) pair is a task's group.
One round finds each anchor's best positives, a second one the best negatives inside the bounds that each
positive sets. Only the best few of an anchor (or anchor and positive) leave a group, so labels never
decide where a row goes and a hot label costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import ship, written

GROUP_BYTES = 64 << 20
LEAST_ROWS = 512
EXACT_BITS = 53
WIDE_FIELDS = 8
ROWS, COLS = 512, 4096
_LOWEST = np.iinfo(np.int64).min
_ROWS = "vec_id bigint, label bigint, dims int, v binary"


def _binary(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """floor(scale * x) of each vector as little-endian int32, or int64 where one component needs it."""
    for batch in batches:
        vectors = batch.column("x")
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(pc.cast(pc.list_flatten(vectors), pa.float64()).to_numpy(zero_copy_only=False) * scale)
        if len(flat) and np.abs(flat).max() >= 2.0**62:
            raise ValueError("components do not fit 64 bits")
        whole, ends = flat.astype(np.int64), np.cumsum(sizes)
        parts = [whole[e - s:e] for s, e in zip(sizes, ends)]
        raw = [p.astype("<i4" if not len(p) or np.abs(p).max() < 2**31 else "<i8").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())],
            ["vec_id", "label", "dims", "v"])


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, dims, v: a row a vec_id, with floor(scale * x) of its components as packed integers.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat
    an id the smallest (label, vector) counts. Other columns are left behind.
    """
    ship(vectors.sparkSession)
    x = F.col(vector).cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"))
    packed = rows.mapInArrow(lambda it: _binary(it, scale), _ROWS)
    one = packed.groupBy("vec_id").agg(F.min(F.struct("label", "dims", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.dims", "r.v")


def matrix(raw: pd.Series, dims: int) -> np.ndarray:
    """Rows of packed components as one int64 matrix."""
    wide = raw.map(len).to_numpy() > 4 * dims
    out = np.zeros((len(raw), dims), np.int64)
    for kind, rows in (("<i4", ~wide), ("<i8", wide)):
        if dims and rows.any():
            out[rows] = np.frombuffer(b"".join(raw[rows]), kind).reshape(-1, dims)
    return out


class Packed:
    """Candidates in bit fields of wide integers, ready to be multiplied with biased anchors of components up to ``top``."""

    def __init__(self, candidates: np.ndarray, low: int, top: int):
        """``low``: the anchors' smallest component (their bias); ``top``: their largest once biased."""
        n, dims = candidates.shape
        self.n, self.dims, self.low = n, dims, int(low)
        self.bias = int(candidates.min(initial=0))
        ceiling = int(candidates.max(initial=0)) - self.bias
        self.width = max(1, (max(1, dims) * int(top) * ceiling).bit_length())
        self.doubles = self.width <= EXACT_BITS
        self.fields = EXACT_BITS // self.width if self.doubles else WIDE_FIELDS
        self.sums = candidates.sum(1) if self.doubles else np.array([sum(map(int, c)) for c in candidates], object)
        self.stride = -(-n // self.fields)
        kind = np.float64 if self.doubles else object
        padded = np.zeros((self.stride * self.fields, dims), np.int64 if self.doubles else object)
        padded[:n] = (candidates if self.doubles else candidates.astype(object)) - self.bias
        lanes = padded.reshape(self.fields, self.stride, dims)
        self.words = np.zeros((self.stride, dims), kind)
        for field in range(self.fields):
            self.words += lanes[field].astype(kind) * (1 << (field * self.width))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of ``anchors`` with all candidates, one multiplication a wide integer."""
        biased = (anchors if self.doubles else anchors.astype(object)) - self.low
        total = biased.sum(1) if self.dims else np.zeros(len(anchors), np.int64)
        product = biased.astype(self.words.dtype) @ self.words.T if self.dims else np.zeros((len(anchors), self.stride), np.int64)
        if self.doubles:
            product = product.astype(np.int64)
        mask = (1 << self.width) - 1
        field = [(product >> (f * self.width)) & mask for f in range(self.fields)]
        out = np.concatenate(field, axis=1)[:, :self.n]
        # sum (a - la)(c - lc) = sum ac - lc sum (a - la) - la sum c
        out = out + self.bias * total[:, None] + self.low * self.sums[None, :]
        if not self.doubles and out.size:
            if max(abs(int(out.max())), abs(int(out.min()))) >= 2**63:
                raise ValueError("inner products do not fit 64 bits")
            out = out.astype(np.int64)
        return out


class Best:
    """The k best (score, then smaller id) of each row, offered tile by tile in ascending id order."""

    def __init__(self, rows: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.bar = np.full(rows, _LOWEST) if least is None else least.copy()
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        hit = allowed & (score >= self.bar[:, None])
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
        if len(many):
            own = np.where(hit[many], score[many], _LOWEST)
            self.bar[many] = np.maximum(self.bar[many], np.partition(own, own.shape[1] - self.k, axis=1)[:, -self.k])
            hit[many] &= score[many] >= self.bar[many][:, None]
        row, col = np.nonzero(hit)
        if not len(row):
            return
        row, vec, score = (np.concatenate(x) for x in ((self.row, row), (self.vec, ids[col]), (self.score, score[row, col])))
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = place < self.k
        self.row, self.vec, self.score = row[keep], vec[keep], score[keep]
        full = place[keep] == self.k - 1
        # Later ids are larger, so a tie with the last one kept comes too late.
        self.bar[self.row[full]] = self.score[full] + 1


def _tiles(anchors: pd.DataFrame, shard: pd.DataFrame):
    """(anchor rows, ids and labels of candidates, scores) a tile, candidates in ascending id order for each anchor tile."""
    shard = shard.rename(columns=lambda c: c.removeprefix("c_")).sort_values("vec_id")
    for dims, part in shard.groupby("dims", sort=False):
        asked = anchors[anchors["dims"] == dims].reset_index(drop=True)
        if not len(asked):
            continue
        a, c = matrix(asked["v"], dims), matrix(part["v"], dims)
        low = int(a.min(initial=0))
        top = int(a.max(initial=0)) - low
        ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
        packed = [Packed(c[at:at + COLS], low, top) for at in range(0, len(c), COLS)]
        for at in range(0, len(a), ROWS):
            yield asked.iloc[at:at + ROWS], (
                (ids[COLS * i:COLS * (i + 1)], labels[COLS * i:COLS * (i + 1)], p.scores(a[at:at + ROWS])) for i, p in enumerate(packed))


def _positives(k: int):
    def run(anchors: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        for asked, tiles in _tiles(anchors, shard):
            own, label = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
            best = Best(len(asked), k)
            for ids, labels, score in tiles:
                best.offer(score, (label[:, None] == labels[None]) & (own[:, None] != ids[None]), ids)
            found.append(pd.DataFrame({"anchor_id": own[best.row], "positive_id": best.vec, "positive_score": best.score}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "positive_id", "positive_score")})

    return run


def _negatives(k: int, low: int, high: int):
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(anchors: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        found = []
        for asked, tiles in _tiles(anchors, shard):
            own, label = asked["vec_id"].to_numpy(), asked["label"].to_numpy()
            counts = asked["positives"].map(len).to_numpy()
            slots = int(counts.max(initial=0))
            pid, pscore = (np.zeros((len(asked), slots), object) for _ in range(2))
            for i, pairs in enumerate(asked["positives"]):
                for j, p in enumerate(pairs):
                    pid[i, j], pscore[i, j] = int(p["positive_id"]), int(p["positive_score"])
            # low * p <= 100 * n <= high * p, in whole numbers of any size.
            least, most = -((-low * pscore) // 100), (high * pscore) // 100
            absent = np.arange(slots)[None] >= counts[:, None]
            least[absent], most[absent] = 1, 0
            least, most = least.astype(np.int64), most.astype(np.int64)
            best = [Best(len(asked), k, least[:, j]) for j in range(slots)]
            for ids, labels, score in tiles:
                other = label[:, None] != labels[None]
                for j in range(slots):
                    best[j].offer(score, other & (score <= most[:, j:j + 1]), ids)
            for j in range(slots):
                r = best[j].row
                found.append(pd.DataFrame(dict(zip(names, (
                    own[r], pid[r, j].astype(np.int64), pscore[r, j].astype(np.int64), best[j].vec, best[j].score)))))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})

    return run


def _parts(rows: int, size: int, tasks: int) -> int:
    """Number of parts of bounded bytes; small sides still give every task some rows."""
    return max(1, -(-size // GROUP_BYTES), min(tasks, rows // LEAST_ROWS))


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` are those of ``quantised``; ``anchors`` says which rows of it are anchors, all rows are candidates. A
    score is the integer inner product with the anchor; higher ones come first, ties by smaller vec_id. An
    anchor's positives are its first ``positives`` other rows of the same label; each positive p has the first
    ``negatives`` rows of other labels with ``low`` * score(p) <= 100 * score <= ``high`` * score(p). An anchor with no
    other row of its label, or a positive without such a row (always one with a score below 0), gives no row; an empty table none.
    Vectors of another length than the anchor's take no part for it.

    Work is anchors times candidates, as in any exact search; moved are anchors times shards and candidates times blocks.
    """
    spark = vectors.sparkSession
    rows = written(vectors.withColumn("anchor", F.coalesce(anchors, F.lit(False))), "vectors")
    size = F.octet_length("v") + 24
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count_if("anchor").alias("an"),
                 F.coalesce(F.sum(F.when(F.col("anchor"), size)), F.lit(0)).alias("ab")).first()
    shards, blocks = _parts(n["n"], n["b"], 2 * spark.sparkContext.defaultParallelism), _parts(0, n["ab"], 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    dealt = rows.select(*[F.col(c).alias(f"c_{c}") for c in ("vec_id", "label", "dims", "v")], part(shards).alias("c_shard"),
                        every(blocks).alias("c_block")).groupBy("c_block", "c_shard")
    asked = rows.where("anchor").select("vec_id", "label", "dims", "v", part(blocks).alias("block"))

    pairs = asked.withColumn("shard", every(shards)).groupBy("block", "shard").cogroup(dealt).applyInPandas(
        _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    kept = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = written(kept.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")

    bounded = asked.join(lists, asked["vec_id"] == lists["anchor_id"]).drop("anchor_id").withColumn("shard", every(shards))
    triples = bounded.groupBy("block", "shard").cogroup(dealt).applyInPandas(
        _negatives(negatives, low, high),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = triples.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
