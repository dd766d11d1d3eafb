"""Fire-domain views over the driver tables, in Spark and in SQL.

Every view is a projection of a whole table; the SQL strings are common table
expressions that build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import block_segment
from ..operators.pixels import explode_tile
from ..operators.scenes import frame_index

BURN_LEVEL = 0.15
TILE_SIDE = 8
VEC_BLOCK = 256


_SCHEMAS = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
              "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the known schema spares a job that would read file footers."""
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --- scenes over events -----------------------------------------------------------

_SOURCES = {"view": "viirs_day", "click": "mask", "purchase": "frp", "signup": "viirs_night"}


def scenes(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """One scene per event: user = fire, event type = sensor. Named sources filter at the scan."""
    source = F.lit("rejected")
    for kind, name in _SOURCES.items():
        source = F.when(F.col("event_type") == kind, name).otherwise(source)
    events = table(spark, sf_dir, "events")
    if sources:
        events = events.where(F.col("event_type").isin(*[k for k, v in _SOURCES.items() if v in sources]))
    return events.select(
        F.col("user_id").cast("string").alias("fire_id"),
        source.alias("source"),
        "ts",
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("file_name"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("code"),
    )


SCENES = """
scenes AS (
  SELECT CAST(user_id AS VARCHAR) AS fire_id,
         CASE event_type WHEN 'view' THEN 'viirs_day' WHEN 'click' THEN 'mask' WHEN 'purchase' THEN 'frp'
              WHEN 'signup' THEN 'viirs_night' ELSE 'rejected' END AS source,
         ts, 'ev_' || CAST(event_id AS VARCHAR) AS file_name, value,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS code
  FROM events)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene measures where each mask or FRP scene is a single pixel."""
    code = F.col("code")
    fire = code.between(10, 15) | code.between(20, 25) | code.between(30, 35)
    is_mask, is_frp = F.col("source") == "mask", F.col("source") == "frp"
    return scenes(spark, sf_dir, "mask", "frp").select(
        "fire_id", "ts", F.col("source").alias("kind"),
        F.when(is_mask, (code > 0).cast("double")).alias("coverage"),
        F.when(is_mask, fire.cast("double")).alias("active_pixel_count"),
        F.when(is_mask, fire.cast("double")).alias("mask_coverage"),
        F.when(is_frp, F.greatest(F.col("value"), F.lit(0.0))).alias("frp_mean"),
        F.when(is_frp, F.greatest(F.col("value"), F.lit(0.0))).alias("frp_max"),
    )


MEASURES = SCENES + """,
measures AS (
  SELECT fire_id, ts, source AS kind, code, value,
         CASE WHEN code BETWEEN 10 AND 15 OR code BETWEEN 20 AND 25 OR code BETWEEN 30 AND 35 THEN 1.0 ELSE 0.0 END AS hot,
         CASE WHEN code > 0 THEN 1.0 ELSE 0.0 END AS cov,
         CASE WHEN value > 0 THEN value ELSE 0.0 END AS frp
  FROM scenes WHERE source IN ('mask', 'frp'))"""


# --- tiles over embeddings ------------------------------------------------------------

def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8×8 tile per vector: label = fire, frame by vector id."""
    raw = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("fire_id"), "vec_id", "embedding"
    )
    return frame_index(raw, order=["vec_id"], segment=block_segment("vec_id", VEC_BLOCK))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_tile(tiles(spark, sf_dir), "embedding", TILE_SIDE).withColumn("v", F.col("v").cast("double"))


TILES = """
tiles AS (
  SELECT CAST(label AS VARCHAR) AS fire_id, vec_id, embedding,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
         count(*) OVER (PARTITION BY label) AS n_frames
  FROM embeddings)"""

PIXELS = TILES + """,
px AS (
  SELECT fire_id, vec_id, frame, n_frames, (p - 1) // 8 AS r, (p - 1) % 8 AS c, CAST(embedding[p] AS DOUBLE) AS v
  FROM tiles, range(1, 65) AS g(p))"""


# --- fires over customer and supplier -----------------------------------------------------

def fires(spark: SparkSession, sf_dir: str, source: str = "supplier") -> DataFrame:
    key = F.col("s_suppkey" if source == "supplier" else "c_custkey")
    return table(spark, sf_dir, source).select(
        key.cast("string").alias("fire_id"),
        key.alias("key"),
        (25.0 + key % 25).cast("double").alias("lat"),
        (-124.0 + key % 57).cast("double").alias("lon"),
    )


FIRES = """
fires AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS fire_id, s_suppkey AS key,
         CAST(25.0 + s_suppkey % 25 AS DOUBLE) AS lat, CAST(-124.0 + s_suppkey % 57 AS DOUBLE) AS lon
  FROM supplier)"""

CUSTOMER_FIRES = """
fires AS (
  SELECT CAST(c_custkey AS VARCHAR) AS fire_id, c_custkey AS key,
         CAST(25.0 + c_custkey % 25 AS DOUBLE) AS lat, CAST(-124.0 + c_custkey % 57 AS DOUBLE) AS lon
  FROM customer)"""


def dated_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fires with a date range around January 2024; every fiftieth has blank dates."""
    k = F.col("key")
    start = F.date_add(F.lit("2023-12-27").cast("date"), (k % 30).cast("int"))
    base = fires(spark, sf_dir, "customer").withColumn("start_date", F.when(k % 50 != 0, start))
    return base.withColumn("end_date", F.date_add("start_date", (k % 17).cast("int")))


DATED_FIRES = CUSTOMER_FIRES + """,
dated AS (
  SELECT *, CASE WHEN key % 50 <> 0 THEN DATE '2023-12-27' + CAST(key % 30 AS INTEGER) END AS start_date,
         CASE WHEN key % 50 <> 0 THEN DATE '2023-12-27' + CAST(key % 30 AS INTEGER) + CAST(key % 17 AS INTEGER) END AS end_date
  FROM fires)"""


# --- predictions over lineitem ----------------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored pixels; line 7 is unlabelled."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("case_id"),
        F.year("l_shipdate").alias("frame"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.round(F.col("l_discount") * 10, 6).alias("prob"),
        F.when(F.col("l_linenumber") == 7, -1).when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("label"),
    )


PREDICTIONS = """
predictions AS (
  SELECT l_returnflag AS case_id, CAST(year(l_shipdate) AS INTEGER) AS frame, l_orderkey AS order_id, l_linenumber AS line,
         round(l_discount * 10, 6) AS prob,
         CASE WHEN l_linenumber = 7 THEN -1 WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS label
  FROM lineitem)"""


# --- run history over orders ----------------------------------------------------------------------

# The log of a run depends on the order's key: metric lines, summaries and failures of each kind.
_LOGS = (
    "Validation IoU: {b}, Dice: {a}",
    "model F1 Score: {a} and iou score: {b}",
    "Model Test F1 Score: {a} and Test IoU Score: {b}",
    "F1 Score: {b} then F1 Score: {a}, iou 5",
    "CUDA OOM while training",
    "FileNotFoundError: dataset_train missing",
    "size mismatch for layer",
    "No enough TS",
    "empty file list",
    "Mean IoU: .5",
    "segmentation fault",
    "accuracy={a}",
)
_TOOLS = (
    "run_spatial_model", "run_spatial_temp_model", "run_spatial_temp_model_pred", "run_seq_model",
    "dataset_gen_pred", "dataset_gen_afba",
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: status = task, step by order key within it; log, code and parameters derived from the key."""
    raw = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    a = F.printf(F.lit("%.4f"), (key * 37 % 10000) / 10000.0)
    b = F.printf(F.lit("%.4f"), (key * 53 % 10000) / 10000.0)
    log = F.lit(None).cast("string")
    for i, text in enumerate(_LOGS):
        log = F.when(key % len(_LOGS) == i, F.replace(F.replace(F.lit(text), F.lit("{a}"), a), F.lit("{b}"), b)).otherwise(log)
    tool = F.get(F.array(*[F.lit(t) for t in _TOOLS]), ((key * 7 + F.floor(key / 12)) % len(_TOOLS)).cast("int"))
    base = raw.select(
        F.col("o_orderstatus").alias("task"),
        key.alias("key"),
        tool.alias("tool_name"),
        F.col("o_orderpriority").alias("priority"),
        "o_orderdate",
        log.alias("log"),
        F.when((key % 12).isin(4, 5, 6, 7, 8, 10), F.when(key % 24 == 10, -9).otherwise(1)).otherwise(0).alias("return_code"),
        F.create_map(
            F.lit("ts_length"), (key % 5 + 4).cast("string"),
            F.lit("model"), F.col("o_orderpriority"),
            F.lit("batch_size"), F.when(key % 3 == 0, "2").otherwise("4"),
        ).alias("params"),
    )
    step = frame_index(base, keys=["task"], order=["key"], segment=block_segment("key", 4096), total=None)
    return step.withColumn("step", F.col("frame") + 1).drop("frame")


def _log_sql() -> str:
    whens = []
    for i, text in enumerate(_LOGS):
        whens.append(f"WHEN {i} THEN replace(replace('{text}', '{{a}}', a), '{{b}}', b)")
    return f"CASE o_orderkey % {len(_LOGS)} " + " ".join(whens) + " END"


def _tool_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOOLS))
    return f"CASE (o_orderkey * 7 + o_orderkey // 12) % {len(_TOOLS)} {whens} END"


RUNS = f"""
keyed AS (
  SELECT *, printf('%.4f', (o_orderkey * 37 % 10000) / 10000.0) AS a, printf('%.4f', (o_orderkey * 53 % 10000) / 10000.0) AS b
  FROM orders),
runs AS (
  SELECT o_orderstatus AS task, o_orderkey AS key, {_tool_sql()} AS tool_name, o_orderpriority AS priority, o_orderdate,
         {_log_sql()} AS log,
         CASE WHEN o_orderkey % 12 IN (4, 5, 6, 7, 8, 10) THEN CASE WHEN o_orderkey % 24 = 10 THEN -9 ELSE 1 END ELSE 0 END AS return_code,
         CAST(o_orderkey % 5 + 4 AS VARCHAR) AS ts_length, o_orderpriority AS model,
         CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '4' END AS batch_size,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS step
  FROM keyed)"""
