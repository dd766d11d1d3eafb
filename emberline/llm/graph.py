"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for edges (a, b) of long node numbers.

    Alternating large-star and small-star steps: each step points neighbours at the smallest node known, so long
    chains shrink by halves and stars settle at once. Only counts and hash sums come to the driver; every
    round is written to the shared folder.
    """
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == last or not seen["n"]:
            break
        last = seen
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b")
                          .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    leaves = current.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return leaves.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
