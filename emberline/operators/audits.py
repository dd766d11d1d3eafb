"""Pairing, completeness and catalogue checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def misaligned_samples(images: DataFrame, goes: DataFrame, keys: Sequence[str] = ("fire_id", "window_idx")) -> DataFrame:
    """Samples present on one side only; empty when both sides line up.

    Both sides are reduced to a flag per key and added up, which needs one
    shuffle of partial counts where a full outer join would need two full sides.
    """
    sides = images.select(*keys, F.lit(1).alias("i"), F.lit(0).alias("g")).unionByName(
        goes.select(*keys, F.lit(0).alias("i"), F.lit(1).alias("g"))
    )
    both = sides.groupBy(*keys).agg(F.sum("i").alias("images"), F.sum("g").alias("goes"))
    return both.where(F.col("images") != F.col("goes"))


def require_aligned(images: DataFrame, goes: DataFrame, keys: Sequence[str] = ("fire_id", "window_idx")) -> None:
    """Raise when a sample lacks its counterpart."""
    if not misaligned_samples(images, goes, keys).isEmpty():
        raise ValueError("image samples and GOES samples do not line up")


def pair_status(files: DataFrame, kinds: Sequence[str] = ("img", "label"), sample: str = "sample_id") -> DataFrame:
    """Per sample: which kinds exist and whether the set is complete."""
    flags = {k: F.max((F.col("kind") == k).cast("int")) for k in kinds}
    return files.groupBy(sample).agg(*[v.alias(f"has_{k}") for k, v in flags.items()]).withColumn(
        "is_pair", F.least(*[F.col(f"has_{k}") for k in kinds]) == 1
    )


def orphans(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("img", "label")) -> DataFrame:
    """Halves without their counterpart, on either side. Reported only; nothing is deleted."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    kind = F.when(F.col("l") == 1, names[0]).otherwise(names[1])
    return seen.where(F.col("l") != F.col("r")).select(key, kind.alias("kind"))


def with_artifacts(cases: DataFrame, artifacts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases whose artifacts exist."""
    return cases.join(artifacts.select(*keys), list(keys), "left_semi")


def complete_windows(catalog: DataFrame) -> DataFrame:
    """(ts_length, interval) pairs with image and label for train or for val."""
    def has(split: str, kind: str):
        return F.max(((F.col("split") == split) & (F.col("kind") == kind)).cast("int")) == 1

    return (
        catalog.groupBy("ts_length", "interval")
        .agg((has("train", "img") & has("train", "label")).alias("has_train"),
             (has("val", "img") & has("val", "label")).alias("has_val"))
        .where("has_train or has_val")
    )


def choose_window(catalog: DataFrame, ts_length: int, interval: int) -> DataFrame:
    """The preferred pair when complete, else the smallest complete one."""
    preferred = (F.col("ts_length") == ts_length) & (F.col("interval") == interval)
    rank = F.struct((~preferred).alias("other"), "ts_length", "interval")
    best = complete_windows(catalog).agg(
        F.min_by(F.struct("ts_length", "interval", "has_train", "has_val"), rank).alias("b")
    )
    return best.where("b is not null").select("b.*")


def inventory(scenes: DataFrame, catalog: DataFrame, test_files: DataFrame, *, aux: str = "aux") -> DataFrame:
    """One row: fires, fires with auxiliary layers, prepared splits and complete test pairs.

    Each part reduces to one row first; joining one-row frames costs nothing.
    """
    raw = scenes.groupBy("fire_id").agg(F.max((F.col("source") == aux).cast("int")).alias("a")).agg(
        F.count(F.lit(1)).alias("raw_fire_count"), F.coalesce(F.sum("a"), F.lit(0)).alias("firepred_count")
    )
    prepared = complete_windows(catalog).agg(
        F.coalesce(F.bool_or("has_train"), F.lit(False)).alias("has_prepared_train"),
        F.coalesce(F.bool_or("has_val"), F.lit(False)).alias("has_prepared_val"),
    )
    pairs = pair_status(test_files).agg(F.count_if("is_pair").alias("prepared_test_count"))
    return (
        raw.join(F.broadcast(prepared), F.lit(True))
        .join(F.broadcast(pairs), F.lit(True))
        .withColumns(
            {
                "has_firepred": F.col("firepred_count") > 0,
                "has_prepared_test": F.col("prepared_test_count") > 0,
            }
        )
    )
