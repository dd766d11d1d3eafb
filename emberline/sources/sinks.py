"""Writers. All are partitioned and re-runnable; none funnels data through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bbox_ring

DATASET_KEYS = ("task", "split", "ts_length", "interval")


def write_dataset(df: DataFrame, path: str, *, task: str, ts_length: int, interval: int) -> None:
    """Samples under task/split/ts_length/interval. Re-running replaces only the partitions it writes."""
    stamped = df.withColumns({"task": F.lit(task), "ts_length": F.lit(ts_length), "interval": F.lit(interval)})
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*DATASET_KEYS)
        .parquet(path)
    )


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Rows with differing columns together, columns in alphabetical order, gaps NULL."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def write_csv_report(reports: Sequence[DataFrame], path: str) -> None:
    union_reports(reports).write.mode("overwrite").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def geojson_features(bboxes: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON polygon feature per bbox row, as text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(bbox_ring()).alias("coordinates")).alias("geometry"),
    )
    return bboxes.select(F.to_json(feature).alias("value"))


def write_geojson(bboxes: DataFrame, properties: Sequence[str], path: str) -> None:
    """Newline-delimited GeoJSON: each task writes its own features."""
    geojson_features(bboxes, properties).write.mode("overwrite").text(path)


def feature_names(df_session, names: Sequence[str]) -> DataFrame:
    """(feature_index, feature_name) sidecar rows."""
    one = df_session.range(1)
    return one.select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("feature_index", "feature_name"))


def append_runs(runs: DataFrame, path: str, batch: str) -> None:
    """Add a batch of runs to the history table below ``path``, partitioned by batch and task.

    A batch replaces itself: written again, after a retry or a replay, it changes nothing, and no other batch is touched.
    """
    (
        runs.withColumn("batch", F.lit(batch)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch", "task")
        .parquet(path)
    )


def _typed(df: DataFrame, like: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in like.items()})


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_dataset`` wrote; filters on task, split, ts_length and interval read their folders only."""
    return _typed(spark.read.parquet(path), {"task": "string", "split": "string", "ts_length": "int", "interval": "int"})


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The history that ``append_runs`` has gathered, with each run's batch."""
    return _typed(spark.read.parquet(path), {"batch": "string", "task": "string"})
