"""Readers for fire tables, boxes, thresholds, feature sets and run history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas
from ..operators.ordered import nth_value


def _csv(spark: SparkSession, schema, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(
        paths if isinstance(paths, str) else list(paths)
    )


def union_years(train: DataFrame, test: DataFrame) -> DataFrame:
    """Fire tables of both generations in one; columns a table lacks are NULL, ids are text."""
    return train.unionByName(test, allowMissingColumns=True).withColumn("Id", F.col("Id").cast("string"))


def load_fires(spark: SparkSession, train: Sequence[str], test: Sequence[str] = ()) -> DataFrame:
    """Fire tables with differing headers as one DataFrame, with ``is_test``."""
    out = _csv(spark, schemas.FIRES, train).withColumn("is_test", F.lit(False))
    if test:
        out = union_years(out, _csv(spark, schemas.FIRES_TEST, test).withColumn("is_test", F.lit(True)))
    return out


def load_bboxes(spark: SparkSession, path: str, *, fire_id: str | None = None, index: int | None = None) -> DataFrame:
    """The bbox table, or one row of it by id or by position in file order."""
    boxes = _csv(spark, schemas.BBOXES, path)
    if fire_id is not None:
        return boxes.where(F.col("Id") == fire_id)
    if index is None:
        return boxes
    return nth_row(boxes.withColumn("__pos", F.monotonically_increasing_id()), "__pos", index).drop("__pos")


def nth_row(df: DataFrame, order: str, index: int) -> DataFrame:
    """The row at 0-based position ``index`` of a unique ``order`` column, none beyond the end: found from counts of ranges,
    so that the rows before it are not sorted (``ordered.nth_value``)."""
    return df.join(F.broadcast(nth_value(df, order, index)), order).select(*df.columns)


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Day and night heat thresholds: one row per named fire and position 0..9."""
    return _csv(spark, schemas.THRESHOLDS, path)


def feature_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, c, list(g), s) for t, n, c, g, s in K.FEATURE_SETS], schemas.FEATURE_SETS)


def flatten_history(states: DataFrame, task: str | None = None) -> DataFrame:
    """State documents to one row per run. A document stored for another task counts as empty."""
    docs = states if task is None else states.where(F.col("task") == task)
    return docs.select("task", F.posexplode("history").alias("pos", "h")).select(
        "task",
        (F.col("pos") + 1).alias("step"),
        "h.timestamp",
        F.col("h.plan.tool_name").alias("tool_name"),
        F.col("h.plan.rationale").alias("rationale"),
        F.col("h.plan.params").alias("params"),
        F.col("h.result.status").alias("status"),
        F.col("h.result.return_code").alias("return_code"),
        F.col("h.result.stdout").alias("stdout"),
        F.col("h.result.stderr").alias("stderr"),
        F.col("h.result.command").alias("command"),
        F.col("h.result.started_at").alias("started_at"),
        F.col("h.result.finished_at").alias("finished_at"),
        F.col("h.evaluation.decision").alias("decision"),
        F.col("h.evaluation.summary").alias("summary"),
        F.col("h.evaluation.metrics").alias("metrics"),
    )


def load_runs(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """Run history from JSON state files."""
    return flatten_history(spark.read.schema(schemas.RUN_STATE).option("multiLine", True).json(path), task)
