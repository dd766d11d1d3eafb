import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import conformal as CP
from emberline.operators import metrics as M
from emberline.operators import pixels as P


def _q(spark, scores, alpha):
    df = spark.createDataFrame([(float(s),) for s in scores], "score double")
    rows = CP.conformal_quantile(df, alpha).collect()
    assert len(rows) == 1
    return rows[0].qhat


def test_conformal_rank(spark):
    assert _q(spark, range(100), 0.1) == 91
    assert _q(spark, range(10), 0.1) == 9
    assert _q(spark, [0.5] * 7, 0.3) == 0.5


def test_conformal_matches_order_statistic(spark):
    rng = random.Random(5)
    for _ in range(6):
        n = rng.randint(1, 300)
        scores = [round(rng.random() ** rng.choice([0.1, 1, 9]), rng.choice([1, 6])) for _ in range(n)]
        alpha = rng.choice([0.01, 0.1, 0.35, 0.8])
        level = min(math.ceil((n + 1) * (1 - alpha)) / n, 1.0)
        assert _q(spark, scores, alpha) == float(np.quantile(np.array(scores), level, method="higher"))


def test_conformal_guards(spark):
    empty = spark.createDataFrame([], "score double")
    assert CP.conformal_quantile(empty, 0.1).count() == 0
    for alpha in (0.0, 1.0, -1):
        with pytest.raises(ValueError):
            CP.conformal_quantile(empty, alpha)


def test_quantile_of_crowded_and_outlying_scores(spark):
    rng = np.random.default_rng(3)
    crowded = 0.5 + rng.random(4000) * 1e-9
    outlying = np.concatenate([-rng.random(500) * 100, 1 + rng.random(500) * 100, [0.0, 1.0, float("inf")]])
    for scores in (crowded, outlying):
        for alpha in (0.01, 0.4, 0.8, 0.999):
            rank = min(int(np.ceil((len(scores) + 1) * (1 - alpha))), len(scores) - 1)
            assert _q(spark, scores.tolist(), alpha) == np.sort(scores)[rank]


def test_absent_class_takes_the_global_quantile(spark):
    df = spark.createDataFrame([(i / 50, 1) for i in range(50)], "prob double, label int")
    row = CP.class_quantiles(df, 0.1).first()
    assert row.q0 == row.q1 and (row.n_pos, row.n_neg) == (50, 0)


def test_calibration_set_is_covered(spark):
    rng = random.Random(2)
    rows = [("c", rng.random(), int(rng.random() < 0.3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "case_id string, prob double, label int")
    report = CP.reliability(df, CP.class_quantiles(df, 0.1)).where("scope = 'global'").first()
    assert report.coverage >= 0.9 and report.num_pixels == 500


def test_no_confident_pixels_gives_nan_and_drops_out_of_macro(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.9, 1)], "case_id string, prob double, label int")
    q = spark.createDataFrame([(0.6, 0.6)], "q0 double, q1 double")
    report = CP.reliability(df, q)
    by_case = {r.case_id: r for r in report.where("scope = 'case'").collect()}
    assert math.isnan(by_case["a"].selective_f1) and by_case["b"].selective_f1 == 1.0
    macro = CP.macro_reliability(report).first()
    assert macro.selective_f1 == 1.0 and macro.num_test_cases == 2


@pytest.mark.parametrize("task,expected", [("pred", 0.0), ("af", 1.0), ("ba", 1.0)])
def test_nothing_to_find(spark, task, expected):
    df = spark.createDataFrame([("c", 0, False, False)], "case_id string, frame int, y boolean, p boolean")
    row = M.frame_scores(df, ["case_id", "frame"], F.col("y"), F.col("p"), zero_division=M.ZERO_DIVISION[task]).first()
    assert row.f1 == expected and row.iou == expected


def test_f1_follows_from_iou(spark):
    rng = random.Random(3)
    rows = [(f"c{i % 5}", 0, rng.random() < 0.4, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id string, frame int, y boolean, p boolean")
    for r in M.frame_scores(df, ["case_id"], F.col("y"), F.col("p"), zero_division=0.0).collect():
        assert math.isclose(r.f1, 2 * r.iou / (1 + r.iou))


def test_macro_rules(spark):
    fires = spark.createDataFrame(
        [("a", 0.8, 0.6, 5, 4, 0, 2), ("b", 0.0, 0.0, 3, 0, 1, 2)],
        "case_id string, f1 double, iou double, pred_positive long, label_positive long, zero_prediction_frames long, frames long")
    growth = M.macro_scores(fires, drop_empty=True).first()
    assert growth.f1 == 0.8 and growth.skipped_fires == 1 and growth.frames == 2
    listed = M.macro_scores(fires, drop_empty=False, listed=4).first()
    assert listed.f1 == 0.2 and listed.evaluated_fires == 2


def test_blank_and_ignored_pixels(spark):
    df = spark.createDataFrame([(-1, 1), (1, 1), (0, 0)], "label int, pred int")
    assert P.ignore_unlabelled(df).count() == 2
    assert sorted(map(tuple, P.blank_unlabelled(df).collect())) == [(0, 0), (0, 0), (1, 1)]


def test_standardise_matches_numpy(spark):
    rng = np.random.default_rng(1)
    tile = rng.normal(size=50)
    tile[[3, 9]] = np.nan
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(tile)], "scene string, i int, v double")
    got = np.array([r.v for r in P.standardise_scene(df, "v", ["scene"]).orderBy("i").collect()])
    filled = np.where(np.isnan(tile), np.nanmean(tile), tile)
    assert np.allclose(got, (filled - filled.mean()) / filled.std())
    flat = df.withColumn("v", F.lit(2.0))
    assert {r.v for r in P.standardise_scene(flat, "v", ["scene"]).collect()} == {0.0}
    assert {r.v for r in P.minmax_scene(flat, "v", ["scene"], constant="keep").collect()} == {2.0}


def test_accuracy_ties_take_the_first_class(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5, 0), ("a", 0.1, 0.9, 1)], "k string, p0 double, p1 double, y int")
    assert M.categorical_accuracy(df, ["k"], [F.col("p0"), F.col("p1")], F.col("y")).first().accuracy == 1.0


def test_batch_scoring(spark):
    df = spark.createDataFrame([("c", 0, 1, 2, 0.25)], "case_id string, frame int, row int, col int, v double")

    def predict(pdf):
        out = pdf[["case_id", "frame", "row", "col"]].copy()
        out["prob"], out["label"] = pdf["v"] * 2, 1
        return out

    assert M.score_batches(df, predict).first().prob == 0.5


def test_boxes_of_every_size(spark):
    day, rng = dt.date(2021, 1, 1), random.Random(7)
    boxes = [("none", day, day, 4.0, 1.0, 0.0, 1.0), ("point", day, day, 2.0, 2.0, 3.0, 3.0), ("all", day, day + dt.timedelta(days=900), -1e30, float("inf"), -1e9, 1e9),
             ("nan", day, day, float("nan"), 9.0, 0.0, 9.0), ("backwards", day, day - dt.timedelta(days=1), 0.0, 9.0, 0.0, 9.0), ("null", day, None, 0.0, 9.0, 0.0, 9.0)]
    for i in range(60):
        size, x, y = 2.0 ** rng.uniform(-6, 6), rng.uniform(-9, 9), rng.uniform(-9, 9)
        start = day + dt.timedelta(days=rng.randrange(5))
        boxes.append((f"b{i}", start, start + dt.timedelta(days=rng.choice([0, 1, 6, 40])), x, x + size, y, y + size * rng.choice([0.1, 1, 8])))
    fires = spark.createDataFrame(boxes, "fire_id string, start_date date, end_date date, x_min double, x_max double, y_min double, y_max double")
    rows = [(day + dt.timedelta(days=d), float(x), float(y) / 2) for d in range(0, 9) for x in range(-9, 10) for y in range(-18, 19)]
    rows += [(None, 0.0, 0.0), (day, None, 1.0)]
    out = P.clip_to_bounds(spark.createDataFrame(rows, "day date, x double, y double"), fires)
    want = {(f, d, x, y) for f, a, b, x0, x1, y0, y1 in boxes for d, x, y in rows if None not in (b, d, x) and a <= d <= b and x0 <= x <= x1 and y0 <= y <= y1}
    got = [(r.fire_id, r.day, r.x, r.y) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert P.clip_to_bounds(spark.createDataFrame(rows, "day date, x double, y double"), fires.limit(0)).count() == 0


_BOX = "fire_id string, start_date date, end_date date, x_min double, x_max double, y_min double, y_max double"


def test_boxes_without_extent_keep_cells_of_their_own(spark):
    day = dt.date(2021, 1, 1)
    boxes = [(f"b{i}", day + dt.timedelta(days=i), day + dt.timedelta(days=i), 500.0 + i, 500.0 + i, 0.0, 1.0) for i in range(50)]
    fires = spark.createDataFrame(boxes, _BOX)
    cells = P.list_cells(P.size_cells(fires)).select("__cd", "__cx").distinct()
    assert cells.select("__cd").distinct().count() == cells.select("__cx").distinct().count() == 50
    px = spark.createDataFrame([(b[1], b[3], 0.5) for b in boxes], "day date, x double, y double")
    assert P.clip_to_bounds(px, fires).count() == 50


def test_pixel_in_the_middle_cell_of_a_rounded_width(spark):
    day, far = dt.date(2021, 1, 1), 2.0**60
    boxes = [("a", day, day, -1e-300, 1.0, 0.0, 1.0), ("far", day, day, far, far, far, far + 1024), ("half", day, day, 0.0, math.nextafter(8, 9), 0.0, 0.0)]
    px = [(day, 0.5, 0.5), (day, far, far + 512), (day, 8.0, 0.0), (day, 5.0, 0.0)]
    out = P.clip_to_bounds(spark.createDataFrame(px, "day date, x double, y double"), spark.createDataFrame(boxes, _BOX))
    assert sorted((r.fire_id, r.x) for r in out.collect()) == [("a", 0.5), ("far", far), ("half", 5.0), ("half", 8.0)]


def _exchanged(plan):
    """Rows written by all exchanges below a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _exchanged(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _exchanged(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


def test_boxes_and_pixels_are_moved_once_a_block_not_once_a_cell(spark):
    day, rng = dt.date(2021, 1, 1), random.Random(3)
    boxes, px = [], []
    for i in range(500):
        x, y, start = rng.uniform(0, 500), rng.uniform(0, 900_000), day + dt.timedelta(days=rng.randrange(400))
        boxes.append((f"b{i}", start, start + dt.timedelta(days=i % 5), x, x + 5, y, y + 9000))
        px += [(start + dt.timedelta(days=j % 3), x + j, y + 2000 * j) for j in range(4)]
    out = P.clip_to_bounds(spark.createDataFrame(px, "day date, x double, y double"), spark.createDataFrame(boxes, _BOX))
    got = sorted((r.fire_id, r.day, r.x, r.y) for r in out.collect())
    assert got == sorted((f, d, x, y) for f, a, b, x0, x1, y0, y1 in boxes for d, x, y in px if a <= d <= b and x0 <= x <= x1 and y0 <= y <= y1)
    # One width of blocks: a pixel is moved once; a box once or twice an axis, then in a tile. With a row for each cell it was 9,458 rows.
    assert _exchanged(out._jdf.queryExecution().executedPlan()) < len(px) + 4 * len(boxes)


@pytest.mark.parametrize("shared", [False, True])
def test_tiles_of_a_few_boxes_and_blocks_that_share_a_home(spark, monkeypatch, shared):
    monkeypatch.setattr(P, "_TILE", 3)
    if shared:
        monkeypatch.setattr(P, "_home", lambda level: level.cast("long"))
    day, rng, tiny = dt.date(2021, 1, 1), random.Random(11), 5e-324
    boxes, big = [], 2.0**53
    for i in range(80):
        size, x, y, start = 2.0 ** rng.uniform(-3, 4), rng.uniform(-9, 9), rng.uniform(-9, 9), day + dt.timedelta(days=rng.randrange(30))
        boxes.append((f"b{i}", start, start + dt.timedelta(days=rng.randrange(12)), x, x + size, y, y + size))
    boxes += [("edge", day, day, big - 2, big, 0.0, 1.0), ("low", day, day, -big, 2 - big, 0.0, 1.0), ("tiny", day, day, -1.0, tiny, -tiny, 0.0), ("wide", day, day, -70.0, -tiny, -tiny, 99.0)]
    px = [(day + dt.timedelta(days=d), float(x), float(y)) for d in range(0, 42, 2) for x in range(-9, 10, 2) for y in range(-9, 10, 2)]
    px += [(day, big - 1, 0.5), (day, 1 - big, 0.5), (day, -tiny, -tiny), (day, -tiny, 0.0), (day, float("nan"), 0.0)]
    out = P.clip_to_bounds(spark.createDataFrame(px, "day date, x double, y double"), spark.createDataFrame(boxes, _BOX))
    got = sorted((r.fire_id, r.day, r.x, r.y) for r in out.collect())
    assert got == sorted((f, d, x, y) for f, a, b, x0, x1, y0, y1 in boxes for d, x, y in px if a <= d <= b and x0 <= x <= x1 and y0 <= y <= y1)
    tiles = P.tile_boxes(P.size_cells(spark.createDataFrame(boxes, _BOX)), 3)
    assert tiles.selectExpr("max(size(__all_fire_id))").first()[0] == 3


def test_clipped_keys_clip_equal_boxes_once(spark, monkeypatch):
    day = dt.date(2021, 1, 1)
    boxes = [(f"f{i}", day, day, float(i % 2) * 10, float(i % 2) * 10 + 3, -0.0 if i % 4 else 0.0, 2.0) for i in range(40)]
    boxes += [("f0", day, day, 20.0, 21.0, 0.0, 2.0), ("f41", day, None, 0.0, 3.0, 0.0, 2.0)]
    px = [("one", day, 1.0, 1.0), ("one", day, 2.0, 2.0), ("two", day, 13.0, 0.0), ("two", day, 9.0, 0.0), ("three", day, 20.5, 1.0)]
    seen, clip = [], P.clip_to_bounds
    monkeypatch.setattr(P, "clip_to_bounds", lambda pixels, fires, **k: seen.append(fires.count()) or clip(pixels, fires, **k))
    fires = spark.createDataFrame(boxes, _BOX)
    out = P.clipped_keys(spark.createDataFrame(px, "file string, day date, x double, y double"), fires, ["file"])
    got = sorted((r.fire_id, r.file) for r in out.collect())
    assert got == sorted([(f"f{i}", "two" if i % 2 else "one") for i in range(40)] + [("f0", "three")])
    assert seen == [4]
