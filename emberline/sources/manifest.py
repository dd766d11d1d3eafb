"""Scene manifests: which files exist, what fire, sensor and time they belong to.

Listing reads file metadata only (the content column is pruned). On a large
archive keep the manifest as a table and list new directories into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.timeparse import day_of_year_date, timestamp_from_name


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and modification time of every file below ``root``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def parse_scene_paths(paths: DataFrame, policy: str = "default", suffixes: Sequence[str] = K.RASTER_SUFFIXES) -> DataFrame:
    """…/<fire>/<source>/<file> rasters to fire_id, source, file_name and ts; other files are left out."""
    pattern = r"([^/]+)/([^/]+)/([^/]+\.(?i:" + "|".join(suffixes) + r"))$"
    name = F.regexp_extract("path", pattern, 3)
    return (
        paths.where(F.col("path").rlike(pattern))
        .withColumns(
            {
                "fire_id": F.regexp_extract("path", pattern, 1),
                "source": F.lower(F.regexp_extract("path", pattern, 2)),
                "file_name": name,
                "ts": timestamp_from_name(name, policy),
            }
        )
    )


def scene_manifest(spark: SparkSession, root: str, policy: str = "default") -> DataFrame:
    return parse_scene_paths(list_files(spark, root), policy)


def parse_raw_paths(paths: DataFrame) -> DataFrame:
    """…/<year>/<day of year>/…/<file>.nc to file_name and day."""
    pattern = r"/(\d{4})/(\d{3})/(?:.*/)?([^/]+\.nc)$"
    year = F.regexp_extract("path", pattern, 1).cast("int")
    doy = F.regexp_extract("path", pattern, 2).cast("int")
    return paths.where(F.col("path").rlike(pattern)).withColumns(
        {"file_name": F.regexp_extract("path", pattern, 3), "day": day_of_year_date(year, doy)}
    )


def raw_goes_manifest(spark: SparkSession, root: str) -> DataFrame:
    return parse_raw_paths(list_files(spark, root, "*.nc"))


def resolve_event_dir(dirs: DataFrame, fires: DataFrame, root: str) -> DataFrame:
    """One directory per fire: ``root/id``, else the first ``root/<year>/id``, else any deeper match."""
    base = root.rstrip("/")
    below = F.substr(F.col("dir"), F.lit(len(base) + 2))
    named = dirs.where(F.col("dir").startswith(base + "/")).select(
        F.element_at(F.split("dir", "/"), -1).alias("fire_id"), "dir",
        F.least(F.size(F.split(below, "/")), F.lit(3)).alias("rank"),
    )
    best = named.groupBy("fire_id").agg(F.min(F.struct("rank", "dir")).alias("b"))
    return fires.select("fire_id").join(best, "fire_id", "left").select("fire_id", F.col("b.dir").alias("event_dir"))


def resolve_event_sources(dirs: DataFrame, fires: DataFrame, leaves: Sequence[str]) -> DataFrame:
    """All leaf directories of each fire, matched on a path segment, else on part of the parent path.

    The exact match is an equi-join on path segments. For fires left without
    one, each parent path lists its substrings of the lengths those ids have, and
    "contains" becomes an equi-join too. Path lengths bound that fan-out.
    """
    leaf_dirs = dirs.withColumn("source", F.element_at(F.split("dir", "/"), -1)).where(F.col("source").isin(*leaves))
    ids = fires.select("fire_id").distinct()
    parts = leaf_dirs.select("dir", "source", F.explode(F.array_distinct(F.split("dir", "/"))).alias("fire_id"))
    exact = parts.join(ids, "fire_id", "left_semi")
    rest = ids.join(exact.select("fire_id").distinct(), "fire_id", "left_anti")
    sized = rest.withColumn("__len", F.length("fire_id"))
    lengths = sized.groupBy().agg(F.collect_set("__len").alias("__lens"))  # distinct id lengths: a handful
    parent = F.regexp_replace("dir", r"/[^/]+$", "")
    pieces = (
        leaf_dirs.join(F.broadcast(lengths), F.lit(True))
        .withColumn("__parent", parent)
        .withColumn("__len", F.explode("__lens"))
        .where(F.length("__parent") >= F.col("__len"))
        .select(
            "dir", "source",
            F.explode(F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.length("__parent") - F.col("__len") + 1),
                lambda i: F.substr(F.col("__parent"), i, F.col("__len")),
            ))).alias("fire_id"),
        )
    )
    loose = pieces.join(rest, "fire_id", "left_semi")
    return exact.withColumn("match", F.lit("segment")).unionByName(loose.withColumn("match", F.lit("substring")))


def prepared_catalog(files: DataFrame, task: str) -> DataFrame:
    """Prepared train and val arrays from their file names: split, kind, ts_length, interval."""
    pattern = rf"^{task}_(train|val)_(img|label)_seqtoseq_alll_(\d+)i_(\d+)\.npy$"
    return files.where(F.col("file_name").rlike(pattern)).select(
        "file_name",
        F.regexp_extract("file_name", pattern, 1).alias("split"),
        F.regexp_extract("file_name", pattern, 2).alias("kind"),
        F.regexp_extract("file_name", pattern, 3).cast("int").alias("ts_length"),
        F.regexp_extract("file_name", pattern, 4).cast("int").alias("interval"),
    )


def prepared_test_files(files: DataFrame, task: str, ts_length: int, interval: int) -> DataFrame:
    """Prepared test arrays: sample id and kind."""
    pattern = rf"^{task}_(.+)_(img|label)_seqtoseql_{ts_length}i_{interval}\.npy$"
    return files.where(F.col("file_name").rlike(pattern)).select(
        "file_name",
        F.regexp_extract("file_name", pattern, 1).alias("sample_id"),
        F.regexp_extract("file_name", pattern, 2).alias("kind"),
    )
