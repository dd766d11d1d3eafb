"""Run-history analytics: log parsing, decisions, comparisons, best runs.

A task may hold most of the history, so everything that looks back over steps
is a segmented scan, and every "best of" is a map-side aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .ordered import Lookup, Scan, block_segment, neighbour, neighbours, segmented_scan

STEP_BLOCK = 65536


# --- metrics in text ------------------------------------------------------------

def valid_metrics(metrics: Column) -> Column:
    """Drop bounded metrics outside 0..1."""
    return F.map_filter(metrics, lambda k, v: ~k.isin(*K.BOUNDED_METRICS) | v.between(0.0, 1.0))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def log_metrics(text: Column) -> Column:
    """Metrics named in a log, lower-cased; out-of-range readings drop, the last reading of a name wins."""
    hits = F.regexp_extract_all(text, F.lit(K.METRIC_RE), F.lit(0))
    pairs = F.transform(
        hits,
        lambda h: F.struct(
            F.lower(F.regexp_extract(h, K.METRIC_RE, 1)).alias("n"),
            F.regexp_extract(h, K.METRIC_RE, 2).cast("double").alias("v"),
        ),
    )
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n in K.BOUNDED_METRICS])

    def read(acc: Column, p: Column) -> Column:
        ok = p["v"].between(0.0, 1.0)
        return F.struct(*[F.when(ok & (p["n"] == n), p["v"]).otherwise(acc[n]).alias(n) for n in K.BOUNDED_METRICS])

    def as_map(acc: Column) -> Column:
        entries = [c for n in K.BOUNDED_METRICS for c in (F.lit(n), acc[n])]
        return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())

    return F.aggregate(pairs, none, read, as_map)


def test_summary(text: Column) -> Column:
    """(f1, iou) of a held-out test summary line; NULL when none or when a value is out of range."""
    def scores(pattern: str) -> Column:
        def parse(line: Column) -> Column:
            return F.when(
                F.length(line) > 0,
                F.struct(
                    F.regexp_extract(line, pattern, 1).cast("double").alias("f1"),
                    F.regexp_extract(line, pattern, 2).cast("double").alias("iou"),
                ),
            )
        return _bind(F.regexp_extract(text, pattern, 0), parse)

    def in_range(s: Column) -> Column:
        return F.when(s["f1"].between(0.0, 1.0) & s["iou"].between(0.0, 1.0), s)

    return _bind(F.coalesce(*[scores(p) for p in K.TEST_SUMMARY_RES]), in_range)


def primary_metric(metrics: Column) -> Column:
    """(name, value) of the first bounded metric present, else of the largest metric left."""
    def usable(e: Column) -> Column:
        return ~e["key"].isin(*K.BOUNDED_METRICS) | e["value"].between(0.0, 1.0)

    def ranked(e: Column) -> Column:
        rank = F.lit(0)
        for i, name in enumerate(K.BOUNDED_METRICS):
            rank = F.when(e["key"] == name, F.lit(len(K.BOUNDED_METRICS) - i)).otherwise(rank)
        return F.struct(rank.alias("rank"), e["value"].alias("value"), e["key"].alias("name"))

    best = F.array_max(F.transform(F.filter(F.map_entries(metrics), usable), ranked))
    return _bind(best, lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), b["value"].alias("value"))))


def log_tail(text: Column, chars: int) -> Column:
    """The last ``chars`` characters; ``constants.LOG_TAIL_CHARS`` is the customary length."""
    return F.right(text, F.lit(chars))


def flag_value(command: Column, flag: str) -> Column:
    """The argument after ``flag``; NULL when the flag is absent or last."""
    at = F.array_position(command, flag)
    return F.when(at > 0, F.get(command, at.cast("int")))


# --- decisions ---------------------------------------------------------------------

def failure_decision(return_code: Column, text: Column) -> Column:
    """Decision for a failed run; the order of the tests matters. NULL when it did not fail."""
    return F.when(return_code == 0, F.lit(None).cast("string")).otherwise(
        F.when(return_code == -9, "needs_resource_review")
        .when(text.rlike(K.NO_DATA_RE), "needs_data_filtering")
        .when(text.rlike(K.NO_DATASET_RE), "needs_dataset_generation")
        .when(text.rlike(K.OUT_OF_MEMORY_RE), "retry_with_smaller_batch")
        .when(text.rlike(K.SHORT_SERIES_RE), "retry_with_shorter_sequence")
        .otherwise("needs_debug")
    )


def failure_reason(return_code: Column, text: Column) -> Column:
    """What kind of failure the decision rests on; tells shape mismatches from unknown ones."""
    return F.when(return_code == 0, F.lit(None).cast("string")).otherwise(
        F.when(return_code == -9, "killed")
        .when(text.rlike(K.NO_DATA_RE), "no_data")
        .when(text.rlike(K.NO_DATASET_RE), "no_dataset")
        .when(text.rlike(K.OUT_OF_MEMORY_RE), "out_of_memory")
        .when(text.rlike(K.SHORT_SERIES_RE), "short_series")
        .when(text.rlike(K.SHAPE_RE), "shape")
        .otherwise("unknown")
    )


def with_run_metrics(runs: DataFrame, text: str = "log") -> DataFrame:
    """Metrics read from each finished run's log: the test summary for growth runs, all metrics otherwise."""
    empty = F.create_map().cast("map<string,double>")
    from_summary = _bind(
        test_summary(F.col(text)),
        lambda s: F.when(s.isNotNull(), F.create_map(F.lit("f1"), s["f1"], F.lit("iou"), s["iou"])).otherwise(empty),
    )
    is_growth = F.col("tool_name") == K.PREDICTION_TOOL
    scored = (F.col("return_code") == 0) & ~F.col("tool_name").startswith(K.DATASET_TOOL_PREFIX)
    metrics = (
        F.when(~scored, empty).when(is_growth, from_summary).otherwise(log_metrics(F.col(text)))
    )
    return runs.withColumn("metrics", metrics)


def previous_best(runs: DataFrame, score: Column, name: str = "previous_best") -> DataFrame:
    """Best earlier score of the same task and tool (NULL before the first)."""
    return segmented_scan(
        runs, ["task", "tool_name"], block_segment("step", STEP_BLOCK), ["step"],
        {name: Scan("max", score, inclusive=False)},
    )


def decide(runs: DataFrame, text: str = "log") -> DataFrame:
    """Evaluate every run: metrics, primary score, previous best of its tool, decision.

    A primary score of 0 counts as a score.
    """
    scored = with_run_metrics(runs, text).withColumn("score", primary_metric(F.col("metrics"))["value"])
    ranked = previous_best(scored, F.col("score"))
    score, tool, iou = F.col("score"), F.col("tool_name"), F.try_element_at("metrics", F.lit("iou"))
    spatial, temporal = tool == K.SPATIAL_TOOL, tool.isin(*K.TEMPORAL_TOOLS)
    weak, below = score < K.METRIC_FLOOR, F.coalesce(iou < K.TARGET_IOU, F.lit(False))
    flat = F.coalesce(score <= F.col("previous_best") + K.IMPROVEMENT_MARGIN, F.lit(False))
    success = (
        F.when(tool.startswith(K.DATASET_TOOL_PREFIX), "continue")
        .when(score.isNull(), "needs_review")
        .when(weak & spatial, "retry_with_spatiotemporal")
        .when(weak & temporal, "retry_with_longer_sequence")
        .when(below & spatial, "retry_with_spatiotemporal")
        .when(below & temporal, "needs_experiment_upgrade")
        .when(flat, "needs_experiment_upgrade")
        .otherwise("complete")
    )
    return ranked.withColumn("decision", F.coalesce(failure_decision(F.col("return_code"), F.col(text)), success))


# --- looking back over steps ---------------------------------------------------------

def _metric_lookup(runs: DataFrame, metric: Column, *others: Lookup) -> DataFrame:
    """Current and previous primary metric of each step, with further lookups in the same scan."""
    marked = runs.withColumn("__metric", metric).withColumns(
        {"metric_name": F.col("__metric.name"), "metric_value": F.col("__metric.value")}
    ).drop("__metric")
    previous = Lookup(
        {"prev_metric_name": F.col("metric_name"), "prev_metric_value": F.col("metric_value")},
        where=F.col("metric_value").isNotNull(),
    )
    out = neighbours(marked, ["task"], block_segment("step", STEP_BLOCK), ["step"], [previous, *others])
    same = F.col("metric_name") == F.col("prev_metric_name")
    return out.withColumn("delta", F.when(same, F.col("metric_value") - F.col("prev_metric_value")))


def metric_delta(runs: DataFrame, metric: Column) -> DataFrame:
    """Change of the primary metric since the last step that had one, when its name is unchanged.

    ``metric`` is a (name, value) struct, NULL on steps without one.
    """
    return _metric_lookup(runs, metric)


def changed_params(runs: DataFrame) -> DataFrame:
    """Parameters that differ from the previous step's, with the new value (NULL when removed)."""
    entries = F.array_sort(F.map_entries("params"))
    out = neighbour(
        runs, ["task"], block_segment("step", STEP_BLOCK), ["step"],
        {"prev_tool": F.col("tool_name"), "__prev_entries": entries}, following=False,
    )
    prev = F.map_from_entries("__prev_entries")
    merged = F.map_zip_with(
        "params", F.coalesce(prev, F.create_map().cast("map<string,string>")),
        lambda k, new, old: F.struct(new.alias("new"), (~new.eqNullSafe(old)).alias("differs")),
    )
    changed = F.transform_values(F.map_filter(merged, lambda k, v: v["differs"]), lambda k, v: v["new"])
    has_prev = F.col("prev_tool").isNotNull()
    return out.withColumn("changed", F.when(has_prev, changed)).drop("__prev_entries")


def last_window_choice(runs: DataFrame) -> DataFrame:
    """Most recent (ts_length, interval) used by each task, (6, 1) when never set."""
    ts = F.try_element_at("params", F.lit("ts_length")).try_cast("int")
    it = F.coalesce(F.try_element_at("params", F.lit("interval")).try_cast("int"), F.lit(1))
    best = F.max_by(F.struct(ts.alias("ts_length"), it.alias("interval")), F.when(ts.isNotNull(), F.col("step")))
    default = F.struct(F.lit(K.DEFAULT_WINDOW[0]).alias("ts_length"), F.lit(K.DEFAULT_WINDOW[1]).alias("interval"))
    return runs.groupBy("task").agg(F.coalesce(best, default).alias("w")).select("task", "w.*")


# --- best runs and checkpoints -------------------------------------------------------

def best_by_tool(runs: DataFrame, score: Column) -> DataFrame:
    return runs.where(score.isNotNull()).groupBy("task", "tool_name").agg(F.max(score).alias("best_score"))


def latest_by_tool(runs: DataFrame, score: Column) -> DataFrame:
    """Score of each tool's most recent run, NULL when that run has none."""
    return runs.groupBy("task", "tool_name").agg(F.max_by(score, "step").alias("latest_score"))


def history_length(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task").agg(F.count(F.lit(1)).alias("history_length"))


def best_run(runs: DataFrame, score: Column) -> DataFrame:
    """Best-scoring run of each task; the earliest wins ties. One map-side aggregate, no ranking."""
    everything = F.struct(*[F.col(c) for c in runs.columns])
    order = F.struct(score.alias("s"), (-F.col("step")).alias("o"))
    return (
        runs.where(score.isNotNull()).groupBy("task").agg(F.max_by(everything, order).alias("r")).select("r.*")
    )


def top_checkpoints(checkpoints: DataFrame, n: int, *, keys: Sequence[str] = ("run",), loss: str = "val_loss",
                    tie: str = "epoch") -> DataFrame:
    """The n lowest-loss checkpoints of each run.

    ``row_number() <= n`` lets Spark keep only n rows per run in every task
    before the shuffle, so a run with many checkpoints stays cheap.
    """
    ranking = Window.partitionBy(*keys).orderBy(F.col(loss), F.col(tie))
    return checkpoints.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= n)


def latest_checkpoint(checkpoints: DataFrame, *, keys: Sequence[str] = ("run",), epoch: int | None = None) -> DataFrame:
    """The checkpoint of the highest epoch, or of exactly ``epoch``; the last path wins ties."""
    rows = checkpoints if epoch is None else checkpoints.where(F.col("epoch") == epoch)
    return rows.groupBy(*keys).agg(F.max(F.struct("epoch", "path")).alias("c")).select(*keys, "c.*")


# --- report text -----------------------------------------------------------------------

def strategy_label(decision: Column, rationale: Column, tool: Column) -> Column:
    text = F.lower(rationale)

    def mentions(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(text.contains(w), F.lit(False))
        return hit

    return (
        F.when(decision.isin(*K.RESOURCE_DECISIONS), "resource_fallback")
        .when(mentions(K.RESOURCE_WORDS), "resource_fallback")
        .when(tool.startswith(K.DATASET_TOOL_PREFIX), "dataset_prep")
        .when(decision == "needs_debug", "debug_recovery")
        .when(mentions(K.UPGRADE_WORDS), "performance_upgrade")
        .otherwise("baseline_or_retry")
    )


def parse_iso(text: Column) -> Column:
    """ISO time with or without zone; NULL when unreadable."""
    return text.try_cast("timestamp")


def duration_text(start: Column, end: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s`` between two timestamps, ``-`` when either is NULL."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    seconds = F.greatest(F.lit(0), F.floor(micros / 1e6).cast("long"))
    hours = F.floor(seconds / 3600)
    minutes = F.floor((seconds % 3600) / 60)
    secs = seconds % 60
    return (
        F.when(seconds.isNull() | micros.isNull(), F.lit("-"))
        .when(hours > 0, F.printf(F.lit("%dh %dm %ds"), hours, minutes, secs))
        .when(minutes > 0, F.printf(F.lit("%dm %ds"), minutes, secs))
        .otherwise(F.printf(F.lit("%ds"), secs))
    )


def _runtime() -> Column:
    return duration_text(parse_iso(F.min_by("started_at", "step")), parse_iso(F.max_by("finished_at", "step")))


def total_runtime(runs: DataFrame) -> DataFrame:
    """First step's start to last step's end, per task."""
    return runs.groupBy("task").agg(_runtime().alias("total_runtime"))


def _in_order(entries: Column, preferred: Sequence[str], render) -> Column:
    """Entries as ``a, b, c``: preferred keys first, the rest by name."""
    rank = F.array(*[F.lit(p) for p in preferred])
    ranked = F.transform(
        entries,
        lambda e: F.struct(
            F.when(F.array_position(rank, e["key"]) > 0, F.array_position(rank, e["key"]))
            .otherwise(F.lit(len(preferred) + 1)).alias("r"),
            e["key"].alias("k"), render(e).alias("t"),
        ),
    )
    return F.transform(F.array_sort(ranked), lambda s: s["t"])


def format_params(params: Column) -> Column:
    """``key=value`` pairs in the preferred order, ``-`` when empty."""
    parts = _in_order(F.map_entries(params), K.PARAM_ORDER, lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.when(F.size(params) > 0, F.array_join(parts, ", ")).otherwise(F.lit("-"))


def format_metrics(metrics: Column) -> Column:
    """Valid metrics to 4 decimals in the preferred order, then invalid ones as ``suspect_*``."""
    good = valid_metrics(metrics)
    bad = F.map_filter(metrics, lambda k, v: k.isin(*K.BOUNDED_METRICS) & ~v.between(0.0, 1.0))

    def render(prefix: str):
        return lambda e: F.concat(F.lit(prefix), e["key"], F.lit("="), F.printf(F.lit("%.4f"), e["value"]))

    parts = F.concat(
        _in_order(F.map_entries(good), K.BOUNDED_METRICS, render("")),
        _in_order(F.map_entries(bad), K.BOUNDED_METRICS, render("suspect_")),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.lit("-"))


def comparison_table(runs: DataFrame) -> DataFrame:
    """Report rows: step, tool, strategy, duration, parameters, decision, metrics."""
    return runs.select(
        "task", "step", "tool_name",
        strategy_label(F.col("decision"), F.col("rationale"), F.col("tool_name")).alias("strategy"),
        duration_text(parse_iso(F.col("started_at")), parse_iso(F.col("finished_at"))).alias("duration"),
        format_params(F.col("params")).alias("key_params"),
        "decision",
        format_metrics(F.col("metrics")).alias("metrics"),
    )


def summary_table(runs: DataFrame) -> DataFrame:
    """Report head per task in one aggregate: steps, best run with its metric, rationale and decision, total runtime."""
    metric = primary_metric(F.col("metrics"))
    scored = runs.withColumn("__metric", metric).withColumn("__scored", F.col("__metric.value").isNotNull())
    order = F.when(F.col("__scored"), F.struct(F.col("__metric.value").alias("v"), (-F.col("step")).alias("s")))
    best = F.struct(
        F.col("step").alias("best_step"), "tool_name", "rationale", "decision",
        F.concat(F.col("__metric.name"), F.lit("="), F.printf(F.lit("%.4f"), F.col("__metric.value"))).alias("best_metric"))
    return scored.groupBy("task").agg(
        F.count(F.lit(1)).alias("history_length"), _runtime().alias("total_runtime"), F.max_by(best, order).alias("__best"),
    ).select("task", "history_length", "total_runtime", "__best.*")


def reasoning_table(runs: DataFrame) -> DataFrame:
    """What each step did to the primary metric: first, improved, reduced, same, renamed, recovered or none."""
    before = Lookup({"prev_decision": F.col("decision"), "prev_step_tool": F.col("tool_name")})
    return _with_outcome(_metric_lookup(runs, primary_metric(F.col("metrics")), before))


def _with_outcome(with_prev: DataFrame) -> DataFrame:
    recovered = (F.col("prev_decision") == "needs_debug") & (F.col("prev_step_tool") == F.col("tool_name"))
    outcome = (
        F.when(F.col("metric_value").isNull(), "no_metric")
        .when(F.coalesce(recovered, F.lit(False)), "first_after_debug")
        .when(F.col("prev_metric_value").isNull(), "first_result")
        .when(F.col("metric_name") != F.col("prev_metric_name"), "metric_changed")
        .when(F.col("delta") > 0, "improved")
        .when(F.col("delta") < 0, "reduced")
        .otherwise("no_change")
    )
    return with_prev.withColumn("outcome", outcome)


def params_difference(old: Column, new: Column) -> Column:
    """``key=value`` of every key whose value differs, in the order in which keys are first seen, old ones first; NULL reads None.

    Both are arrays of map entries, which keep the order of their keys.
    """
    keys = F.array_distinct(F.concat(F.transform(old, lambda e: e["key"]), F.transform(new, lambda e: e["key"])))

    def of(entries: Column, key: Column) -> Column:
        return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]

    changed = F.filter(keys, lambda k: ~of(old, k).eqNullSafe(of(new, k)))
    return F.transform(changed, lambda k: F.concat(k, F.lit("="), F.coalesce(of(new, k), F.lit("None"))))


def reasoning_lines(runs: DataFrame) -> DataFrame:
    """One sentence a step: its strategy, what it did to the primary metric and, where that improved, after which change.

    Previous step, previous metric and previous parameters come from one scan. Templates are ``constants.REASONING_LINES``.
    """
    entries = F.map_entries(F.coalesce(F.col("params"), F.create_map().cast("map<string,string>")))
    before = Lookup({"prev_decision": F.col("decision"), "prev_step_tool": F.col("tool_name"), "prev_entries": entries})
    rows = _with_outcome(_metric_lookup(runs, primary_metric(F.col("metrics")), before))
    changed = params_difference(F.col("prev_entries"), entries)
    after = (
        F.when(F.col("prev_step_tool").isNull(), ".")
        .when(F.size(changed) > 0, F.concat(F.lit(" after changing "), F.array_join(changed, ", "), F.lit(".")))
        .when(F.col("prev_step_tool") != F.col("tool_name"), F.concat(F.lit(" after switching from "), F.col("prev_step_tool"), F.lit(".")))
        .otherwise(" after re-running the same configuration.")
    )
    number = lambda c: F.printf(F.lit("%.4f"), c)
    fields = {
        "step": F.col("step").cast("string"), "tool": F.col("tool_name"), "rationale": F.col("rationale"), "decision": F.col("decision"),
        "strategy": strategy_label(F.col("decision"), F.col("rationale"), F.col("tool_name")),
        "name": F.col("metric_name"), "value": number(F.col("metric_value")), "previous": F.col("prev_metric_name"),
        "delta": number(F.abs(F.col("delta"))), "after": after,
    }
    line = F.lit(None).cast("string")
    for outcome, template in K.REASONING_LINES.items():
        line = F.when(F.col("outcome") == outcome, _filled(template, fields)).otherwise(line)
    return rows.withColumn("line", line).drop("prev_entries")


def _filled(template: str, fields: dict[str, Column]) -> Column:
    """A template's text with its ``{fields}`` put in; a NULL field is empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[part], F.lit("")) if i % 2 else F.lit(part) for i, part in enumerate(parts)])


# --- batches -----------------------------------------------------------------------------

def epoch_batches(samples: DataFrame, key: str, batch_size: int, seed: int, *, buckets: int = 65536) -> DataFrame:
    """Shuffle samples for an epoch and cut whole batches; the remainder is dropped, as the reader of batches expects.

    The order is that of a hash of (key, seed), hence reproducible. Positions
    come from a segmented count over hash buckets; no task sees all samples.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashed = samples.withColumn("__h", digest)
    prefix = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long")
    bucket = F.floor(prefix / (2**32 // buckets))
    placed = segmented_scan(
        hashed, [], bucket, ["__h", key],
        {"position": Scan("sum", F.lit(1), inclusive=False), "__total": Scan("total", F.lit(1))},
    )
    batch = F.floor(F.col("position") / batch_size)
    return (
        placed.withColumn("batch", batch)
        .where(F.col("batch") < F.floor(F.col("__total") / batch_size))
        .drop("__h", "__total")
    )
