"""Queries: tables written below the shared folder, written again in part, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.ordered import shared_folder
from ..sources import sinks
from . import fixtures as X
from .registry import query
from .windowing import IT, TS, _day_frames, _window_sql

_SPLIT = "CASE CAST(fire_id AS BIGINT) % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


@query(f"""
SELECT 'pred' AS task, split, {TS} AS ts_length, {IT} AS "interval", fire_id, window_idx, step,
  CASE WHEN split = 'val' THEN 'again ' ELSE '' END || file_name AS file_name
FROM (SELECT *, {_SPLIT} AS split FROM ({_window_sql("drop", 1)}))
UNION ALL
SELECT 'pred', 'train', {TS}, {IT + 1}, fire_id, CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'other interval' FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS fire_id
  FROM events WHERE event_type = 'view')
""")
def dataset_rewrite(spark, sf_dir):
    """A dataset of three splits, one split written again and another interval beside it: only the parts written change."""
    path = shared_folder(spark, "dataset")
    fire = F.col("fire_id").cast("bigint") % 5
    split = F.when(fire == 0, "val").when(fire == 1, "test").otherwise("train")
    frames = _day_frames(spark, sf_dir)
    samples = W.cut_windows(frames, TS, IT, "drop").select("fire_id", "window_idx", "step", "file_name").withColumn("split", split)
    sinks.write_dataset(samples, path, task="pred", ts_length=TS, interval=IT)
    again = samples.where("split = 'val'").withColumn("file_name", F.concat(F.lit("again "), "file_name"))
    sinks.write_dataset(again, path, task="pred", ts_length=TS, interval=IT)
    other = frames.select("fire_id").distinct().select(
        "fire_id", F.lit(0).alias("window_idx"), F.lit(0).alias("step"), F.lit("other interval").alias("file_name"), F.lit("train").alias("split"))
    sinks.write_dataset(other, path, task="pred", ts_length=TS, interval=IT + 1)
    return sinks.read_dataset(spark, path).select("task", "split", "ts_length", "interval", "fire_id", "window_idx", "step", "file_name")


@query(f"""
WITH {X.RUNS} SELECT CASE WHEN step % 3 = 0 THEN 'night' ELSE 'day' END AS batch, task, CAST(step AS INTEGER) AS step, key, tool_name FROM runs
""")
def history_append(spark, sf_dir):
    """Run history gathered in two batches, one of them replayed: no run is there twice."""
    path = shared_folder(spark, "history")
    runs = X.runs(spark, sf_dir).select("task", "step", "key", "tool_name")
    parts = {"night": runs.where("step % 3 = 0"), "day": runs.where("step % 3 <> 0")}
    for batch in ("night", "day", "night"):
        sinks.append_runs(parts[batch], path, batch)
    return sinks.read_runs(spark, path).select("batch", "task", "step", "key", "tool_name")


@query(f"WITH {X.RUNS} SELECT task, count(*) AS steps, count(DISTINCT tool_name) AS tools, max(step)::INTEGER AS last_step FROM runs GROUP BY task")
def json_summary(spark, sf_dir):
    """A summary per task written as JSON lines and read back."""
    path = shared_folder(spark, "summary")
    out = X.runs(spark, sf_dir).groupBy("task").agg(
        F.count(F.lit(1)).alias("steps"), F.count_distinct("tool_name").alias("tools"), F.max("step").cast("int").alias("last_step"))
    sinks.write_json_summary(out, path)
    return spark.read.schema(out.schema).json(path)
