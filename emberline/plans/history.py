"""Queries: run history, checkpoints, catalogues and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as C
from ..operators import audits as A
from ..operators import runlog as R
from ..operators import scenes as S
from ..operators.ordered import cut_lineage
from ..sources import manifest as MF
from . import fixtures as X
from .registry import query

_R = X.RUNS


def _last_metric(name: str) -> str:
    """Last in-range reading of a metric in the log, by SQL list functions."""
    pairs = f"list_zip(regexp_extract_all(log, '{K.METRIC_RE}', 1), regexp_extract_all(log, '{K.METRIC_RE}', 2))"
    keep = f"list_filter({pairs}, lambda p: lower(p[1]) = '{name}' AND CAST(p[2] AS DOUBLE) BETWEEN 0 AND 1)"
    return f"CAST({keep}[-1][2] AS DOUBLE)"


_METRICS = _R + """,
m AS (SELECT *, """ + ", ".join(f"{_last_metric(n)} AS m_{n}" for n in K.BOUNDED_METRICS) + """ FROM runs)"""

_SUMMARY = _METRICS + f""",
t AS (SELECT *, coalesce(
        CASE WHEN regexp_matches(log, '{K.TEST_SUMMARY_RES[0]}') THEN [regexp_extract(log, '{K.TEST_SUMMARY_RES[0]}', 1), regexp_extract(log, '{K.TEST_SUMMARY_RES[0]}', 2)] END,
        CASE WHEN regexp_matches(log, '{K.TEST_SUMMARY_RES[1]}') THEN [regexp_extract(log, '{K.TEST_SUMMARY_RES[1]}', 1), regexp_extract(log, '{K.TEST_SUMMARY_RES[1]}', 2)] END) AS ts FROM m),
scored AS (SELECT *, CASE WHEN return_code <> 0 OR tool_name LIKE 'dataset_gen_%' THEN NULL WHEN tool_name = 'run_spatial_temp_model_pred' THEN CAST(ts[1] AS DOUBLE) ELSE m_f1 END AS f1,
   CASE WHEN return_code <> 0 OR tool_name LIKE 'dataset_gen_%' THEN NULL WHEN tool_name = 'run_spatial_temp_model_pred' THEN CAST(ts[2] AS DOUBLE) ELSE m_iou END AS iou,
   CASE WHEN return_code <> 0 OR tool_name LIKE 'dataset_gen_%' OR tool_name = 'run_spatial_temp_model_pred' THEN NULL ELSE m_dice END AS dice,
   CASE WHEN return_code <> 0 OR tool_name LIKE 'dataset_gen_%' OR tool_name = 'run_spatial_temp_model_pred' THEN NULL ELSE m_accuracy END AS accuracy FROM t),
p AS (SELECT *, coalesce(f1, iou, dice, accuracy) AS score,
             CASE WHEN f1 IS NOT NULL THEN 'f1' WHEN iou IS NOT NULL THEN 'iou' WHEN dice IS NOT NULL THEN 'dice' WHEN accuracy IS NOT NULL THEN 'accuracy' END AS metric FROM scored),
b AS (SELECT *, max(score) OVER (PARTITION BY task, tool_name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM p)"""


def _metric(name: str):
    return F.round(F.try_element_at("metrics", F.lit(name)), 6).alias(name)


@query(f"WITH {_METRICS} SELECT key, " + ", ".join(f"round(m_{n}, 6) AS {n}" for n in K.BOUNDED_METRICS) + " FROM m")
def log_metrics(spark, sf_dir):
    """Metrics read from log text, last reading wins, out-of-range readings dropped."""
    rows = X.runs(spark, sf_dir).withColumn("metrics", R.log_metrics(F.col("log")))
    return rows.select("key", *[_metric(n) for n in K.BOUNDED_METRICS])


@query(f"WITH {_SUMMARY} SELECT key, round(CAST(ts[1] AS DOUBLE), 6) AS f1, round(CAST(ts[2] AS DOUBLE), 6) AS iou FROM t")
def log_test_summary(spark, sf_dir):
    """Held-out test scores from summary lines."""
    s = R.test_summary(F.col("log"))
    return X.runs(spark, sf_dir).select("key", F.round(s["f1"], 6).alias("f1"), F.round(s["iou"], 6).alias("iou"))


_FAIL = """CASE WHEN return_code = 0 THEN NULL WHEN return_code = -9 THEN '{killed}' WHEN log ILIKE '%No valid prediction sequences were generated%' OR log ILIKE '%empty file list%' THEN '{no_data}'
 WHEN regexp_matches(log, '(?is)(FileNotFoundError|No such file or directory).*(dataset_train|dataset_val|dataset_test)') THEN '{no_dataset}'
 WHEN regexp_matches(log, '(?i)(out of memory|cuda oom|cudnn_status_alloc_failed)') THEN '{oom}' WHEN log ILIKE '%No enough TS%' THEN '{short}'
 WHEN regexp_matches(log, '(?i)(shape|size mismatch|expected.*channels|band)') THEN '{shape}' ELSE '{other}' END"""
_DECISION = _FAIL.format(killed="needs_resource_review", no_data="needs_data_filtering", no_dataset="needs_dataset_generation", oom="retry_with_smaller_batch",
                         short="retry_with_shorter_sequence", shape="needs_debug", other="needs_debug")
_REASON = _FAIL.format(killed="killed", no_data="no_data", no_dataset="no_dataset", oom="out_of_memory", short="short_series", shape="shape", other="unknown")


@query(f"WITH {_R} SELECT key, {_DECISION} AS decision, {_REASON} AS reason FROM runs")
def failure_class(spark, sf_dir):
    """Failures sorted into decisions by return code and text."""
    code, log = F.col("return_code"), F.col("log")
    return X.runs(spark, sf_dir).select("key", R.failure_decision(code, log).alias("decision"), R.failure_reason(code, log).alias("reason"))


_FULL = _SUMMARY + f""",
d AS (SELECT *, coalesce({_DECISION}, CASE WHEN tool_name LIKE 'dataset_gen_%' THEN 'continue' WHEN score IS NULL THEN 'needs_review'
   WHEN score < 0.3 AND tool_name = 'run_spatial_model' THEN 'retry_with_spatiotemporal'
   WHEN score < 0.3 AND tool_name IN ('run_spatial_temp_model', 'run_spatial_temp_model_pred', 'run_seq_model') THEN 'retry_with_longer_sequence'
   WHEN iou < 0.6 AND tool_name = 'run_spatial_model' THEN 'retry_with_spatiotemporal'
   WHEN iou < 0.6 AND tool_name IN ('run_spatial_temp_model', 'run_spatial_temp_model_pred', 'run_seq_model') THEN 'needs_experiment_upgrade'
   WHEN score <= previous_best + 0.01 THEN 'needs_experiment_upgrade' ELSE 'complete' END) AS decision FROM b)"""


def _decided(spark, sf_dir):
    return R.decide(X.runs(spark, sf_dir))


@query(f"WITH {_FULL} SELECT key, CAST(step AS INTEGER) AS step, round(score, 6) AS score, round(previous_best, 6) AS previous_best, decision FROM d")
def run_decisions(spark, sf_dir):
    """Every run evaluated: primary score, previous best of its tool, decision."""
    return _decided(spark, sf_dir).select("key", "step", F.round("score", 6).alias("score"), F.round("previous_best", 6).alias("previous_best"), "decision")


@query(f"WITH {_FULL} SELECT task, tool_name, round(max(score), 6) AS best_score FROM d WHERE score IS NOT NULL GROUP BY ALL")
def best_score_by_tool(spark, sf_dir):
    scored = R.with_run_metrics(X.runs(spark, sf_dir))
    out = R.best_by_tool(scored, R.primary_metric(F.col("metrics"))["value"])
    return out.withColumn("best_score", F.round("best_score", 6))


@query(f"WITH {_R} SELECT task, count(*) AS history_length FROM runs GROUP BY task")
def history_length(spark, sf_dir):
    return R.history_length(X.runs(spark, sf_dir))


@query(f"WITH {_FULL} SELECT key, metric, round(score, 6) AS score FROM d WHERE score IS NOT NULL")
def primary_metric(spark, sf_dir):
    """Name and value of each run's primary metric."""
    m = R.primary_metric(F.col("metrics"))
    rows = R.with_run_metrics(X.runs(spark, sf_dir)).select("key", m["name"].alias("metric"), F.round(m["value"], 6).alias("score"))
    return rows.where(F.col("score").isNotNull())


@query("""
SELECT o_orderkey AS key, CASE WHEN v BETWEEN 0 AND 1 THEN round(v, 6) END AS f1, round(v, 6) AS loss FROM (SELECT o_orderkey, o_totalprice / 300007 AS v FROM orders)
""")
def valid_metrics(spark, sf_dir):
    """Bounded metrics outside 0..1 dropped, others kept."""
    v = F.col("o_totalprice") / 300007
    m = R.valid_metrics(F.create_map(F.lit("f1"), v, F.lit("loss"), v))
    return X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.round(F.try_element_at(m, F.lit("f1")), 6).alias("f1"), F.round(F.try_element_at(m, F.lit("loss")), 6).alias("loss")
    )


_DELTA = _SUMMARY + """,
n AS (SELECT *, last_value(metric IGNORE NULLS) OVER w AS pm, last_value(score IGNORE NULLS) OVER w AS ps FROM p
      WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_DELTA} SELECT key, round(ps, 6) AS prev_value, pm AS prev_name, round(CASE WHEN pm = metric THEN score - ps END, 6) AS delta FROM n")
def metric_delta(spark, sf_dir):
    """Change since the last step with the same metric."""
    scored = R.with_run_metrics(X.runs(spark, sf_dir))
    out = R.metric_delta(scored, R.primary_metric(F.col("metrics")))
    return out.select("key", F.round("prev_metric_value", 6).alias("prev_value"), F.col("prev_metric_name").alias("prev_name"), F.round("delta", 6).alias("delta"))


@query(f"""
WITH {_R},
l AS (SELECT *, lag(ts_length) OVER w AS a, lag(model) OVER w AS b, lag(batch_size) OVER w AS c, lag(tool_name) OVER w AS t FROM runs WINDOW w AS (PARTITION BY task ORDER BY step))
SELECT key, t AS prev_tool, CASE WHEN t IS NULL THEN NULL ELSE concat_ws(', ', CASE WHEN batch_size <> c THEN 'batch_size=' || batch_size END,
   CASE WHEN model <> b THEN 'model=' || model END, CASE WHEN ts_length <> a THEN 'ts_length=' || ts_length END) END AS changed FROM l
""")
def changed_params(spark, sf_dir):
    """Parameters that differ from the previous step."""
    out = R.changed_params(X.runs(spark, sf_dir))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("changed"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ")
    return out.select("key", "prev_tool", text.alias("changed"))


@query(f"WITH {_R} SELECT task, CAST(arg_max(ts_length, step) AS INTEGER) AS ts_length, 1 AS interval FROM runs GROUP BY task")
def last_window_choice(spark, sf_dir):
    return R.last_window_choice(X.runs(spark, sf_dir))


@query(f"""
WITH {_FULL}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, step) AS i FROM d WHERE score IS NOT NULL)
SELECT task, CAST(step AS INTEGER) AS step, tool_name, round(score, 6) AS score FROM r WHERE i = 1
""")
def best_run(spark, sf_dir):
    """Best run of each task, the earliest on ties."""
    scored = R.with_run_metrics(X.runs(spark, sf_dir)).select("task", "step", "tool_name", R.primary_metric(F.col("metrics"))["value"].alias("score"))
    return R.best_run(scored, F.col("score")).withColumn("score", F.round("score", 6))


_REASONING = _FULL + """,
o AS (SELECT *, last_value(metric IGNORE NULLS) OVER w AS pm, last_value(score IGNORE NULLS) OVER w AS ps, lag(decision) OVER v AS pd, lag(tool_name) OVER v AS pt FROM d
      WINDOW w AS (PARTITION BY task ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY task ORDER BY step))"""


@query(f"""
WITH {_REASONING}
SELECT key, CASE WHEN score IS NULL THEN 'no_metric' WHEN pd = 'needs_debug' AND pt = tool_name THEN 'first_after_debug' WHEN ps IS NULL THEN 'first_result'
  WHEN metric <> pm THEN 'metric_changed' WHEN score > ps THEN 'improved' WHEN score < ps THEN 'reduced' ELSE 'no_change' END AS outcome FROM o
""")
def run_reasoning(spark, sf_dir):
    """What each step did to the primary metric."""
    decided = cut_lineage(_decided(spark, sf_dir).select("task", "step", "key", "tool_name", "decision", "metrics"))
    return R.reasoning_table(decided).select("key", "outcome")


_RATIONALE = "CASE key % 5 WHEN 0 THEN 'Retry with a Smaller Batch' WHEN 1 THEN 'upgrade the model' WHEN 2 THEN 'probe first' WHEN 3 THEN 'longer temporal window' ELSE 'resource limits hit' END"


def _reported(spark, sf_dir):
    k = F.col("key") % 5
    rationale = F.when(k == 0, "Retry with a Smaller Batch").when(k == 1, "upgrade the model").when(k == 2, "probe first").when(k == 3, "longer temporal window").otherwise("resource limits hit")
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    seconds = (F.col("key") * 97 % 9000).cast("int")
    end = F.date_format(F.col("o_orderdate") + F.make_dt_interval(secs=seconds), "yyyy-MM-dd'T'HH:mm:ss")
    return _decided(spark, sf_dir).withColumns({"rationale": rationale, "started_at": F.concat(start, F.lit("Z")), "finished_at": F.concat(end, F.lit("+00:00"))})


_STRATEGY = f"""CASE WHEN decision IN ('needs_resource_review', 'retry_with_smaller_batch') OR key % 5 IN (0, 4) THEN 'resource_fallback' WHEN tool_name LIKE 'dataset_gen_%' THEN 'dataset_prep'
  WHEN decision = 'needs_debug' THEN 'debug_recovery' WHEN key % 5 IN (1, 3) THEN 'performance_upgrade' ELSE 'baseline_or_retry' END"""
_DURATION = """CASE WHEN s >= 3600 THEN printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END"""


@query(f"""
WITH {_FULL}
SELECT task, CAST(step AS INTEGER) AS step, tool_name, {_STRATEGY} AS strategy, {_DURATION} AS duration,
       'model=' || model || ', ts_length=' || ts_length || ', batch_size=' || batch_size AS key_params, decision,
       CASE WHEN coalesce(f1, iou, dice, accuracy) IS NULL THEN '-' ELSE concat_ws(', ', 'f1=' || printf('%.4f', f1), 'iou=' || printf('%.4f', iou), 'dice=' || printf('%.4f', dice), 'accuracy=' || printf('%.4f', accuracy)) END AS metrics
FROM (SELECT *, key * 97 % 9000 AS s FROM d)
""")
def comparison_report(spark, sf_dir):
    """The report table: strategy, duration, parameters, decision and metrics of each step."""
    return R.comparison_table(_reported(spark, sf_dir))


@query(f"""
WITH {_REASONING},
q AS (SELECT *, lag(ts_length) OVER w AS pts, lag(model) OVER w AS pmodel, lag(batch_size) OVER w AS pbatch, {_STRATEGY} AS strategy, {_RATIONALE} AS rationale,
  printf('%.4f', score) AS value, printf('%.4f', abs(score - ps)) AS delta FROM o WINDOW w AS (PARTITION BY task ORDER BY step)),
c AS (SELECT *, concat_ws(', ', CASE WHEN ts_length <> pts THEN 'ts_length=' || ts_length END, CASE WHEN model <> pmodel THEN 'model=' || model END,
  CASE WHEN batch_size <> pbatch THEN 'batch_size=' || batch_size END) AS changed FROM q)
SELECT key, 'Step ' || step || ': [' || strategy || '] ' || tool_name || CASE
  WHEN score IS NULL THEN ' was chosen because ' || rationale || ' Decision: ' || decision || '.'
  WHEN pd = 'needs_debug' AND pt = tool_name THEN ' produced the first usable metric after a prior debug failure, yielding ' || metric || '=' || value || '.'
  WHEN ps IS NULL THEN ' established the first measurable result with ' || metric || '=' || value || '.'
  WHEN metric <> pm THEN ' changed the primary metric from ' || pm || ' to ' || metric || '; the latest usable score was ' || metric || '=' || value || '.'
  WHEN score > ps THEN ' improved ' || metric || ' by ' || delta || CASE WHEN pt IS NULL THEN '.' WHEN changed <> '' THEN ' after changing ' || changed || '.'
    WHEN pt <> tool_name THEN ' after switching from ' || pt || '.' ELSE ' after re-running the same configuration.' END
  WHEN score < ps THEN ' reduced ' || metric || ' by ' || delta || ', suggesting the latest change was not helpful.'
  ELSE ' produced no material change in ' || metric || '; the configuration likely plateaued.' END AS line FROM c
""")
def reasoning_lines(spark, sf_dir):
    """The report's sentence on each step, with the metric's change and the parameters changed before it."""
    return R.reasoning_lines(cut_lineage(_reported(spark, sf_dir).select(
        "task", "step", "key", "tool_name", "decision", "metrics", "rationale", "params"))).select("key", "line")


@query(f"""
WITH {_R}, e AS (SELECT task, arg_min(o_orderdate, step) AS a, arg_max(o_orderdate + to_seconds(key * 97 % 9000), step) AS z FROM runs GROUP BY task),
t AS (SELECT task, greatest(0, epoch(z)::BIGINT - epoch(a)::BIGINT) AS s FROM e)
SELECT task, {_DURATION} AS total_runtime FROM t
""")
def total_runtime(spark, sf_dir):
    """First start to last finish of each task."""
    return R.total_runtime(_reported(spark, sf_dir))


@query(f"""
WITH {_FULL}, e AS (SELECT task, count(*) AS history_length, arg_min(o_orderdate, step) AS a, arg_max(o_orderdate + to_seconds(key * 97 % 9000), step) AS z FROM runs GROUP BY task),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, step) AS i FROM d WHERE score IS NOT NULL),
u AS (SELECT *, greatest(0, epoch(z)::BIGINT - epoch(a)::BIGINT) AS s FROM e)
SELECT u.task, history_length, {_DURATION} AS total_runtime, CAST(step AS INTEGER) AS best_step, tool_name, {_RATIONALE} AS rationale, decision,
       metric || '=' || printf('%.4f', score) AS best_metric FROM u JOIN r ON r.task = u.task AND i = 1
""")
def report_summary(spark, sf_dir):
    """Head of the report: steps, best run, total runtime."""
    return R.summary_table(_reported(spark, sf_dir))


@query(f"WITH {_FULL} SELECT task, tool_name, round(arg_max_null(score, step), 6) AS latest_score FROM d GROUP BY ALL")
def latest_score_by_tool(spark, sf_dir):
    """Score of each tool's last run."""
    scored = R.with_run_metrics(X.runs(spark, sf_dir))
    out = R.latest_by_tool(scored, R.primary_metric(F.col("metrics"))["value"])
    return out.withColumn("latest_score", F.round("latest_score", 6))


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 9 AS VARCHAR) END AS ts FROM orders
""")
def flag_value(spark, sf_dir):
    """Value after a flag in a command; NULL when the flag is last or absent."""
    k = F.col("o_orderkey")
    full = F.array(F.lit("python"), F.lit("-ts"), (k % 9).cast("string"), F.lit("-b"))
    command = F.when(k % 3 < 2, full).otherwise(F.array(F.lit("python"), F.lit("-ts")))
    return X.table(spark, sf_dir, "orders").select(k.alias("key"), R.flag_value(command, "-ts").alias("ts"))


@query("SELECT doc_id, length(right(text, 12000)) AS kept, md5(right(text, 12000)) AS digest FROM documents")
def log_tail(spark, sf_dir):
    """The last 12 000 characters of each log."""
    tail = R.log_tail(F.col("text"), K.LOG_TAIL_CHARS)
    return X.table(spark, sf_dir, "documents").select("doc_id", F.length(tail).cast("bigint").alias("kept"), F.md5(tail).alias("digest"))


# --- checkpoints -----------------------------------------------------------------------------

_CKPT = "'model_mode_' || o_orderstatus || '_checkpoint_epoch_' || o_orderkey || '_nc_8_ts_6.pth'"


def _checkpoints(spark, sf_dir):
    path = F.concat(F.lit("/ckpt/model_mode_"), F.col("o_orderstatus"), F.lit("_checkpoint_epoch_"), F.col("o_orderkey").cast("string"), F.lit("_nc_8_ts_6.pth"))
    return X.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), path.alias("path"), C.artifact_epoch(path).alias("epoch"), (F.col("o_totalprice") / 1e6).alias("val_loss")
    )


@query(f"SELECT {_CKPT} AS name, CAST(o_orderkey AS INTEGER) AS epoch FROM orders")
def artifact_epochs(spark, sf_dir):
    """Epoch numbers parsed from checkpoint names."""
    return _checkpoints(spark, sf_dir).select(F.regexp_replace("path", "^/ckpt/", "").alias("name"), "epoch")


@query("""
SELECT run, epoch, rank FROM (SELECT o_custkey AS run, CAST(o_orderkey AS INTEGER) AS epoch, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 1e6, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3
""")
def topn_checkpoints(spark, sf_dir):
    """Three lowest-loss checkpoints of each run."""
    return R.top_checkpoints(_checkpoints(spark, sf_dir), 3).select("run", "epoch", "rank")


@query("SELECT o_custkey AS run, CAST(max(o_orderkey) AS INTEGER) AS epoch FROM orders GROUP BY 1")
def latest_checkpoint(spark, sf_dir):
    return R.latest_checkpoint(_checkpoints(spark, sf_dir)).select("run", "epoch")


@query("""
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':3'), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
SELECT doc_id, position, position // 32 AS batch FROM h WHERE position // 32 < n // 32
""")
def epoch_batches(spark, sf_dir):
    """Samples in a seeded order, cut into whole batches of 32."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    return R.epoch_batches(docs, "doc_id", 32, 3).select("doc_id", "position", "batch")


# --- catalogues and audits -----------------------------------------------------------------------

def _prepared(spark, sf_dir):
    k = F.col("o_orderkey")
    split = F.when(k % 2 == 0, "train").otherwise("val")
    kind = F.when(F.col("o_custkey") % 3 == 0, "img").otherwise("label")
    name = F.concat_ws("_", F.lit("pred"), split, kind, F.lit("seqtoseq_alll"), F.concat((k % 13 + 2).cast("string"), F.lit("i")), F.concat((k % 3 + 1).cast("string"), F.lit(".npy")))
    other = F.concat(F.lit("pred_test_"), k.cast("string"), F.lit(".npy"))
    return X.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", other).otherwise(name).alias("file_name"))


_CATALOG = """
c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split, CASE WHEN o_custkey % 3 = 0 THEN 'img' ELSE 'label' END AS kind,
             CAST(o_orderkey % 13 + 2 AS INTEGER) AS ts_length, CAST(o_orderkey % 3 + 1 AS INTEGER) AS interval FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT ts_length, interval, count(DISTINCT kind) FILTER (split = 'train') = 2 AS has_train, count(DISTINCT kind) FILTER (split = 'val') = 2 AS has_val FROM c GROUP BY ALL)"""


@query(f"WITH {_CATALOG} SELECT split, kind, ts_length, interval, count(*) AS files FROM c GROUP BY ALL")
def prepared_catalog(spark, sf_dir):
    """Prepared arrays from their names."""
    return MF.prepared_catalog(_prepared(spark, sf_dir), "pred").groupBy("split", "kind", "ts_length", "interval").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {_CATALOG} SELECT ts_length, interval, has_train, has_val FROM w WHERE has_train OR has_val")
def complete_windows(spark, sf_dir):
    return A.complete_windows(MF.prepared_catalog(_prepared(spark, sf_dir), "pred"))


@query(f"WITH {_CATALOG} SELECT ts_length, interval, has_train, has_val FROM w WHERE has_train OR has_val ORDER BY NOT (ts_length = 6 AND interval = 1), ts_length, interval LIMIT 1")
def preferred_dataset(spark, sf_dir):
    """Preferred (6, 1) when complete, else the smallest complete pair."""
    return A.choose_window(MF.prepared_catalog(_prepared(spark, sf_dir), "pred"), 6, 1)


_PAIRS = """
f AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'img' AS kind FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'label' FROM labels),
s AS (SELECT sample_id, CAST(bool_or(kind = 'img') AS INTEGER) AS has_img, CAST(bool_or(kind = 'label') AS INTEGER) AS has_label FROM f GROUP BY 1)"""


def _test_files(spark, sf_dir):
    def names(t, kind):
        return X.table(spark, sf_dir, t).select(F.concat(F.lit("pred_"), F.col("doc_id").cast("string"), F.lit(f"_{kind}_seqtoseql_6i_1.npy")).alias("file_name"))

    return MF.prepared_test_files(names("documents", "img").unionByName(names("labels", "label")), "pred", 6, 1)


@query(f"WITH {_PAIRS} SELECT sample_id, has_img, has_label, has_img = 1 AND has_label = 1 AS is_pair FROM s")
def pair_audit(spark, sf_dir):
    """Image and label of each test sample."""
    return A.pair_status(_test_files(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT sample_id, CASE WHEN has_img = 1 THEN 'img' ELSE 'label' END AS kind FROM s WHERE has_img + has_label = 1")
def orphans(spark, sf_dir):
    """Samples with only one half."""
    files = _test_files(spark, sf_dir)
    return A.orphans(files.where("kind = 'img'"), files.where("kind = 'label'"), "sample_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def cases_with_artifacts(spark, sf_dir):
    """Cases whose artifacts exist."""
    return A.with_artifacts(X.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), X.table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def exclude_fires(spark, sf_dir):
    """Cases without the excluded ids."""
    excluded = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return S.exclude_fires(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), excluded, "doc_id")


@query("""
WITH i AS (SELECT user_id AS fire_id, count(*) AS images FROM events WHERE event_type = 'view' GROUP BY 1), g AS (SELECT user_id AS fire_id, count(*) AS goes FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT coalesce(i.fire_id, g.fire_id) AS fire_id, coalesce(images, 0) AS images, coalesce(goes, 0) AS goes FROM i FULL JOIN g ON i.fire_id = g.fire_id WHERE coalesce(images, 0) <> coalesce(goes, 0)
""")
def sample_alignment(spark, sf_dir):
    """Samples whose image and GOES counts differ."""
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("fire_id"), "event_type")
    return A.misaligned_samples(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["fire_id"])


@query(f"""
WITH {X.SCENES}, {_CATALOG}, {_PAIRS}
SELECT (SELECT count(DISTINCT fire_id) FROM scenes) AS raw_fire_count, (SELECT count(DISTINCT fire_id) FROM scenes WHERE source = 'frp') AS firepred_count,
       (SELECT bool_or(has_train) FROM w) AS has_prepared_train, (SELECT bool_or(has_val) FROM w) AS has_prepared_val,
       (SELECT count(*) FROM s WHERE has_img = 1 AND has_label = 1) AS prepared_test_count, true AS has_firepred, true AS has_prepared_test
""")
def inventory_snapshot(spark, sf_dir):
    """One-row inventory: fires, auxiliary layers, prepared splits, test pairs."""
    return A.inventory(X.scenes(spark, sf_dir), MF.prepared_catalog(_prepared(spark, sf_dir), "pred"), _test_files(spark, sf_dir), aux="frp")


@query("""
SELECT o_orderstatus AS task, CAST(pos AS INTEGER) AS step, key, CASE WHEN key % 2 = 0 THEN 'a' ELSE 'b' END AS tool_name, CAST(key % 5 AS VARCHAR) AS ts_length, round(score, 6) AS f1
FROM (SELECT o_orderstatus, o_custkey, o_orderkey AS key, o_totalprice / 600011 AS score, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) AS pos FROM orders)
""")
def history_documents(spark, sf_dir):
    """Runs packed into per-customer state documents as JSON, then read back with the state schema."""
    from .. import schemas
    from ..sources.tables import flatten_history

    k = F.col("o_orderkey")
    entry = F.struct(
        k.cast("string").alias("timestamp"),
        F.struct(F.when(k % 2 == 0, "a").otherwise("b").alias("tool_name"), F.lit("r").alias("rationale"), F.create_map(F.lit("ts_length"), (k % 5).cast("string")).alias("params")).alias("plan"),
        F.struct(F.lit("success").alias("status"), F.lit(0).alias("return_code")).alias("result"),
        F.struct(F.lit("complete").alias("decision"), F.create_map(F.lit("f1"), F.col("o_totalprice") / 600011).alias("metrics")).alias("evaluation"),
    )
    docs = X.table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_custkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(k.alias("k"), entry.alias("e"))), lambda a, b: (a["k"] - b["k"]).cast("int")), lambda s: s["e"]
        ).alias("history")
    )
    text = docs.select(F.to_json(F.struct(F.col("o_orderstatus").alias("task"), "history")).alias("j"))
    states = text.select(F.from_json("j", schemas.RUN_STATE).alias("s")).select("s.*")
    return flatten_history(states).select(
        "task", "step", F.col("timestamp").cast("bigint").alias("key"), "tool_name", F.col("params")["ts_length"].alias("ts_length"), F.round(F.col("metrics")["f1"], 6).alias("f1")
    )


@query("""
SELECT * FROM (SELECT CAST(c_custkey AS VARCHAR) AS event_id, NULL::BIGINT AS frp, round(c_acctbal, 2) AS mask, 'customer' AS source FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS BIGINT), NULL, 'supplier' FROM supplier)
""")
def union_reports(spark, sf_dir):
    """Reports with differing columns as one table, columns sorted."""
    from ..sources.sinks import union_reports as unite

    a = X.table(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.round("c_acctbal", 2).alias("mask"), F.col("c_custkey").cast("string").alias("event_id"))
    b = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("event_id"), F.col("s_nationkey").cast("bigint").alias("frp"), F.lit("supplier").alias("source"))
    return unite([a, b])
