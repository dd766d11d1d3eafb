"""Rules for NaN, short vectors, sparse rasters, missing thresholds and undated scenes."""

import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import channels as C
from emberline.operators import conformal, metrics, pixels, scenes
from emberline.operators import windows as W

NAN = float("nan")


def test_nan_is_no_fire(spark):
    df = spark.createDataFrame([(NAN,), (1.0,), (0.0,), (None,)], "y double")
    assert [r[0] for r in df.select(C.binary_target(F.col("y"))).collect()] == [[0, 0], [0, 1], [1, 0], [None, None]]
    got = pixels.mean_over_time(spark.createDataFrame([("a", NAN), ("b", 3.0)], "k string, logit double"), ["k"]).collect()
    assert {r.k: r.pred for r in got} == {"a": 0, "b": 1}


def test_thresholds(spark):
    bands = "fire_id string, frame int, i4_day double, i5_day double, i4_night double, i5_night double"
    px = spark.createDataFrame([("a", 0, NAN, 0.0, 0.0, 0.0), ("a", 10, 9.0, 0.0, 0.0, 0.0)], bands)
    th = spark.createDataFrame([("a", p, 5.0, 5.0, 5.0, 5.0) for p in range(10)],
                               "fire_id string, pos int, day_i4 double, day_i5 double, night_i4 double, night_i5 double")
    assert {r.frame: r.af for r in W.threshold_label(px, th).collect()} == {0: 0, 10: 1}
    with pytest.raises(Exception, match="no thresholds for fire"):
        W.threshold_label(px.withColumn("fire_id", F.lit("b")), th).collect()


def test_one_night_band_is_refused(spark):
    df = spark.createDataFrame([([1.0] * 6, [2.0])], "d array<float>, n array<float>")
    with pytest.raises(Exception, match="night vector with 1 bands"):
        df.select(C.stack_day_night(F.col("d"), F.col("n"))).collect()


def test_sparse_raster_is_padded_whole(spark):
    fine = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 2.0)], "k string, row int, col int, v double")
    got = {(r.row, r.col): r.v for r in pixels.zero_pad(fine, ["k"], 2, 2).collect()}
    assert len(got) == 16 and got[0, 0] == 1.0 and got[1, 1] == 2.0 and sum(got.values()) == 3.0


def test_empty_calibration_is_refused(spark):
    none = spark.createDataFrame([], "q0 double, q1 double")
    with pytest.raises(Exception, match="empty calibration"):
        conformal.prediction_sets(spark.createDataFrame([(0.5,)], "prob double"), none).collect()


def test_absent_class_scores_one(spark):
    px = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "frame int, label int, pred int")
    row = metrics.class_scores(px, ["frame"], F.col("label") > 0, F.col("pred") > 0).first()
    assert row.iou_fire == 1.0 and row.mean_iou == 1.0 and not math.isnan(row.mean_dice)


def test_long_interval_is_refused(spark):
    px = spark.createDataFrame([("a", 0, 0, 3, 9)], "fire_id string, row int, col int, frame int, n_frames int")
    with pytest.raises(ValueError):
        W.growth_target(px, F.lit(True), F.lit(False), 2, 5)


def test_exclude_by_table(spark):
    fires = spark.createDataFrame([("a",), ("b",)], "fire_id string")
    assert [r[0] for r in scenes.exclude_fires(fires, fires.where("fire_id = 'a'")).collect()] == ["b"]
