from pyspark.sql import functions as F

from emberline.operators import runlog as R


def _metrics(spark, text):
    return spark.range(1).select(R.log_metrics(F.lit(text)).alias("m")).first().m


def test_metric_text(spark):
    assert _metrics(spark, "Mean IoU: .5") == {}
    assert _metrics(spark, "F1 Score: 0.05 then F1 Score: 0.07, iou 5") == {"f1": 0.07}
    assert _metrics(spark, "DICE=0.5\nAccuracy: 1") == {"dice": 0.5, "accuracy": 1.0}
    assert _metrics(spark, "") == {}


def test_summaries(spark):
    def read(text):
        return spark.range(1).select(R.test_summary(F.lit(text)).alias("s")).first().s

    assert tuple(read("model F1 Score: 0.4 and iou score: 0.3")) == (0.4, 0.3)
    assert tuple(read("x Model Test F1 Score: 0.4 and Test IoU Score: 0.25 y")) == (0.4, 0.25)
    assert read("model F1 Score: 4 and iou score: 0.3") is None
    assert read("IoU: 0.3") is None


def test_failure_order(spark):
    def decide(code, text):
        return spark.range(1).select(R.failure_decision(F.lit(code), F.lit(text)).alias("d")).first().d

    assert decide(0, "CUDA OOM") is None
    assert decide(-9, "CUDA OOM") == "needs_resource_review"
    assert decide(1, "empty file list") == "needs_data_filtering"  # before the short-series rule
    assert decide(1, "No enough TS") == "retry_with_shorter_sequence"
    assert decide(1, "FileNotFoundError:\n dataset_val/x") == "needs_dataset_generation"
    assert decide(1, "boom") == "needs_debug"


def _runs(spark, rows):
    return spark.createDataFrame(rows, "task string, step int, tool_name string, return_code int, log string")


def test_decisions(spark):
    rows = [
        ("t", 1, "dataset_gen_pred", 0, ""),
        ("t", 2, "run_spatial_model", 0, "f1: 0.1"),
        ("t", 3, "run_seq_model", 0, "f1: 0.2"),
        ("t", 4, "run_spatial_temp_model", 0, "f1: 0.7 iou: 0.5"),
        ("t", 5, "run_spatial_temp_model", 0, "f1: 0.8 iou: 0.7"),
        ("t", 6, "run_spatial_temp_model", 0, "f1: 0.805 iou: 0.7"),
        ("t", 7, "run_spatial_temp_model_pred", 0, "f1: 0.9"),
        ("t", 8, "run_spatial_temp_model", 1, "CUDA OOM"),
        ("t", 9, "run_seq_model", 0, "f1: 0.0"),
    ]
    got = {r.step: r.decision for r in R.decide(_runs(spark, rows)).collect()}
    assert got == {
        1: "continue", 2: "retry_with_spatiotemporal", 3: "retry_with_longer_sequence", 4: "needs_experiment_upgrade",
        5: "complete", 6: "needs_experiment_upgrade", 7: "needs_review", 8: "retry_with_smaller_batch",
        9: "retry_with_longer_sequence",
    }


def test_primary_metric(spark):
    df = spark.createDataFrame(
        [(1, {"iou": 0.2, "loss": 9.0}), (2, {"f1": 7.0, "loss": 3.0, "x": 4.0}), (3, {}), (4, {"f1": 0.0, "iou": 0.5})],
        "i int, m map<string,double>")
    got = {r.i: r.p and tuple(r.p) for r in df.select("i", R.primary_metric(F.col("m")).alias("p")).collect()}
    assert got == {1: ("iou", 0.2), 2: ("x", 4.0), 3: None, 4: ("f1", 0.0)}


def test_texts(spark):
    row = spark.createDataFrame(
        [({"f1": 0.5, "iou": 3.0, "z": 1.0}, {"zeta": "1", "batch_size": "4", "model": "m"})],
        "m map<string,double>, p map<string,string>",
    ).select(
        R.format_metrics(F.col("m")).alias("m"), R.format_params(F.col("p")).alias("p"),
        R.duration_text(R.parse_iso(F.lit("2026-01-01T00:00:00Z")), R.parse_iso(F.lit("2026-01-01T01:02:03.9+00:00"))).alias("d"),
        R.duration_text(R.parse_iso(F.lit("never")), R.parse_iso(F.lit("2026-01-01"))).alias("none"),
        R.duration_text(R.parse_iso(F.lit("2026-01-01T00:02:00Z")), R.parse_iso(F.lit("2026-01-01T00:00:00Z"))).alias("back"),
    ).first()
    assert row.m == "f1=0.5000, z=1.0000, suspect_iou=3.0000"
    assert row.p == "model=m, batch_size=4, zeta=1"
    assert (row.d, row.none, row.back) == ("1h 2m 3s", "-", "0s")


def test_last_window_default(spark):
    df = spark.createDataFrame(
        [("a", 1, {"ts_length": "8", "interval": "3"}), ("a", 2, {"x": "1"}), ("b", 1, {"x": "1"}), ("c", 1, {"ts_length": "4"})],
        "task string, step int, params map<string,string>")
    got = {r.task: (r.ts_length, r.interval) for r in R.last_window_choice(df).collect()}
    assert got == {"a": (8, 3), "b": (6, 1), "c": (4, 1)}


def test_exact_epoch(spark):
    df = spark.createDataFrame([(1, 2, "p2"), (1, 10, "p10")], "run int, epoch int, path string")
    assert R.latest_checkpoint(df).first().path == "p10"
    assert R.latest_checkpoint(df, epoch=2).first().path == "p2"


def test_batches_drop_the_remainder(spark):
    df = spark.range(103)
    out = R.epoch_batches(df, "id", 10, seed=1).collect()
    assert len(out) == 100 and {r.batch for r in out} == set(range(10))
    assert [r.id for r in out] != sorted(r.id for r in out)
    again = R.epoch_batches(df, "id", 10, seed=1).collect()
    assert {(r.id, r.position) for r in out} == {(r.id, r.position) for r in again}
