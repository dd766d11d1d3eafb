import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from emberline.operators import datasets as D
from emberline.operators import windows as W

DAY = "fire_id string, ts timestamp_ntz, row int, col int, bands array<float>"


def _ts(day):
    return dt.datetime(2021, 7, day)


def _tables(spark):
    day, night, aux = [], [], []
    for d in range(1, 5):
        for row in (1, 2, 9):
            burning, perimeter = float(d >= 3 and row == 1), float(d >= 2 and row == 2)
            eight = d != 1
            day.append(("f", _ts(d), row, 2, [float(d * 10 + i) for i in range(6)] + [burning] + ([perimeter] if eight else [])))
            aux.append(("f", _ts(d), row, 2, [float(i) for i in range(19)]))
            if d != 2:
                night.append(("f", _ts(d), row, 2, [float(d), 5.0 - d]))
    return tuple(spark.createDataFrame(rows, DAY) for rows in (day, night, aux))


def _stack(spark, with_aux):
    day, night, aux = _tables(spark)
    scenes = day.select("fire_id", "ts", F.lit("x").alias("file_name")).distinct()
    return D.stack_pixels(scenes, day, night, aux if with_aux else None, offset=1, size=4)


def test_stack(spark):
    rows = {(r.frame, r.row): r for r in _stack(spark, True).collect()}
    assert sorted(rows) == [(f, r) for f in range(4) for r in (0, 1)]  # row 9 lies outside the crop
    assert all(r.n_frames == 4 and r.col == 1 and len(r.x) == 27 for r in rows.values())
    assert rows[1, 0].x[6:8] == [0.0, 0.0] and rows[2, 0].x[6:8] == [3.0, 2.0]
    assert rows[0, 1].perimeter == 0.0 and rows[1, 1].perimeter == 1.0 and rows[2, 0].af == 1.0


def test_growth(spark):
    stack = _stack(spark, True).cache()
    samples = {(r.window_idx, r.step, r.row): r.x for r in D.growth_samples(stack, 2, 1).collect()}
    assert sorted({k[:2] for k in samples}) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert samples[0, 0, 0][3] == 13.0 and samples[0, 0, 0][:3] == [10.0, 11.0, 12.0]
    # Window 1 starts at frame 1, but the first window already passed frame 2.
    assert samples[1, 0, 0][3] == 33.0 and samples[1, 0, 0][0] == 20.0
    assert samples[1, 0, 0][7] == 4.0
    causal = {(r.window_idx, r.step, r.row): r.x for r in D.growth_samples(stack, 2, 1, leakage="causal").collect()}
    assert causal[1, 0, 0][3] == 23.0
    grown = {(r.window_idx, r.row) for r in D.growth_labels(stack, 2, 1).collect() if r.growth}
    assert grown == {(0, 0)}
    stack.unpersist()


def test_mapping(spark):
    stack = _stack(spark, False)
    af = {(r.window_idx, r.step, r.row): r for r in D.mapping_samples(stack, "af", 2, 2).collect()}
    ba = {(r.window_idx, r.step, r.row): r for r in D.mapping_samples(stack, "ba", 2, 2).collect()}
    assert sorted({k[:2] for k in af}) == [(0, 0), (0, 1), (1, 0), (1, 1)] and set(af) == set(ba)
    assert af[1, 1, 0].x[7] == 1.0 and ba[1, 1, 0].x[7] == 4.0
    assert list(af[1, 0, 0].y) == [0.0, 1.0, 1.0] and list(af[0, 1, 1].y) == [1.0, 0.0, 0.0]


def test_perimeter_without_data(spark):
    stack = _stack(spark, False).withColumn("perimeter", F.when(F.col("frame") == 1, F.lit(float("nan"))).otherwise(F.col("perimeter")))
    for task in ("af", "ba"):
        planes = {(r.window_idx, r.step, r.row): r.y[0] for r in D.mapping_samples(stack, task, 2, 2).collect()}
        assert planes[0, 1, 1] == -1.0 and planes[0, 0, 1] == 0.0 and planes[1, 0, 1] == 1.0
    grown = {(r.window_idx, r.row) for r in D.growth_labels(stack, 2, 1, label_sel=F.lit(0)).collect() if r.growth}
    assert grown == {(0, 0), (0, 1)}


def test_samples_with_a_missing_frame_of_a_pixel(spark):
    stack = _stack(spark, True).where("NOT (row = 0 AND frame = 2)")
    samples = {(r.window_idx, r.step, r.row): r.x for r in D.growth_samples(stack, 2, 1).collect()}
    assert samples[1, 0, 0][3] == 23.0 and samples[1, 0, 0][0] == 20.0
    assert (1, 1, 0) not in samples and samples[1, 1, 1][3] == 33.0


def _reference_loop(frames, ts, interval, tail, ok):
    """The window loop in plain Python for one pixel: frames is [(heat, fire, perimeter)]; yields (window, step, top, so_far) and growth."""
    n, w, steps, growth = len(frames), 0, {}, {}
    top, union, base = 0.0, False, False
    length = ts + 1 if tail == "drop" else ts
    for start in range(0, n, interval):
        if start + ts >= n:
            if tail == "drop":
                break
            start = n - ts
        union, before = base, base
        for j in range(length):
            heat, fire, _ = frames[start + j]
            if not ok[start + j]:
                if j < ts:
                    steps[w, j] = (0.0, 0)
                continue
            top, union = max(top, heat), union or fire
            if j == interval - 1:
                base = union
            if j < ts:
                before, steps[w, j] = union, (top, int(union))
            else:
                growth[w] = int(union and not before)
        growth.setdefault(w, 0)
        w += 1
    return steps, growth


def test_skipped_frames_follow_the_window_loop(spark):
    rng = np.random.default_rng(4)
    ts, interval, n = 4, 2, 23
    rows, want_steps, want_growth = [], {"drop": {}, "clamp": {}}, {}
    ok = {fire: rng.random(n) > 0.3 for fire in "abcdef"}
    for fire in ok:
        for px in range(8):
            frames = [(float(np.round(rng.normal(0, 5), 3)), bool(rng.random() < 0.08), False) for _ in range(n)]
            rows += [(fire, k, n, px, 0, [h] * 8, float(f), 0.0) for k, (h, f, _) in enumerate(frames)]
            for tail in want_steps:
                steps, growth = _reference_loop(frames, ts, interval, tail, ok[fire])
                want_steps[tail] |= {(fire, px, *k): v for k, v in steps.items()}
                if tail == "drop":
                    want_growth |= {(fire, px, w): g for w, g in growth.items()}
    stack = spark.createDataFrame(rows, "fire_id string, frame int, n_frames int, row int, col int, x array<float>, af double, perimeter double")
    skipped = spark.createDataFrame([(f, k, n) for f in ok for k in range(n) if not ok[f][k]], "fire_id string, frame int, n_frames int")
    out = D.mapping_samples(stack, "ba", ts, interval, block=8, skipped=skipped)
    got = {(r.fire_id, r.row, r.window_idx, r.step): (r.x[3], int(r.y[1])) for r in out.collect()}
    assert got == {k: (pytest.approx(v[0], abs=1e-4), v[1]) for k, v in want_steps["clamp"].items()}
    union = W.carried_union(stack, {"burned": F.col("af") > 0}, ts, interval, "drop", skipped=skipped)
    assert {(r.fire_id, r.row, r.window_idx, r.step): r.burned for r in union.collect()} == {k: v[1] for k, v in want_steps["drop"].items()}
    for dense in (True, False):
        grown = D.growth_labels(stack, ts, interval, skipped=skipped, dense=dense)
        got = {(r.fire_id, r.row, r.window_idx): r.growth for r in grown.collect()}
        # All steps skipped: the loop then compares with an older window's last step, which is not followed.
        blind = {(f, w) for f in ok for w in range(n) if not ok[f][w * interval:w * interval + ts].any()}
        assert {k: v for k, v in got.items() if (k[0], k[2]) not in blind} == {
            k: v for k, v in want_growth.items() if (dense or v) and (k[0], k[2]) not in blind}


def test_skipped_scenes_in_the_stack(spark):
    day, night, aux = _tables(spark)
    scenes = day.select("fire_id", "ts", F.lit("x").alias("file_name")).distinct()
    broken = night.withColumn("bands", F.when(F.dayofmonth("ts") == 3, F.slice("bands", 1, 1)).otherwise(F.col("bands")))
    usable = F.dayofmonth("ts") != 3
    kept = D.stack_pixels(scenes, day, broken, aux, offset=1, size=4, usable=usable, skipped="reference")
    rows = {(r.frame, r.row): r.x for r in kept.collect()}
    assert set(rows[2, 0]) == {0.0} and len(rows[2, 0]) == 27 and rows[3, 0][0] == 40.0
    assert [tuple(r) for r in D.skipped_frames(scenes, usable).collect()] == [("f", 2, 4)]
    dropped = D.stack_pixels(scenes, day, broken, aux, offset=1, size=4, usable=usable, skipped="drop")
    rows = {(r.frame, r.row): r.x for r in dropped.collect()}
    assert sorted(rows) == [(f, r) for f in range(3) for r in (0, 1)] and rows[2, 0][0] == 40.0


def test_active_fire_test_blocks(spark):
    rows, scenes = [], []
    for fire, n in (("short", 7), ("even", 20), ("ragged", 13)):
        for k in range(n):
            ts = dt.datetime(2021, 7, 1) + dt.timedelta(days=k)
            rows.append((fire, ts, 2, 2, [float(k + 1)] * 3 + [310.0 if k == 6 else 200.0] + [float("nan")] * 2 + [0.0, 0.0]))
            scenes.append((fire, ts, f"f{k:03}", 7 if k == 5 else 8, 4, 4, None, None, None))
    manifest = spark.createDataFrame(scenes, "fire_id string, ts timestamp_ntz, file_name string, n_bands int, height int, width int, "
                                             "night_bands int, night_height int, night_width int")
    day = spark.createDataFrame(rows, DAY)
    th = spark.createDataFrame([(f, p, 300.0, 300.0, 300.0, 300.0) for f in ("short", "even", "ragged") for p in range(10)],
                               "fire_id string, pos int, day_i4 double, day_i5 double, night_i4 double, night_i5 double")
    got = D.active_fire_test(manifest, day, day.limit(0), th, 4, 4, size=2).collect()
    seen = {(r.fire_id, r.block, r.window_idx, r.step): (r.x[0], r.af) for r in got}
    assert {k[:2] for k in seen} == {("short", 0), ("even", 0), ("even", 1), ("ragged", 0), ("ragged", 1)}
    assert sorted({(r.window_idx, r.start_idx) for r in got}) == [(0, 0), (1, 4), (2, 6)]
    assert seen["short", 0, 1, 1] == (0.0, 0) and seen["short", 0, 1, 2] == (7.0, 1) and seen["short", 0, 1, 3] == (0.0, 0)
    assert seen["even", 1, 2, 3] == (20.0, 0) and seen["ragged", 1, 0, 2] == (13.0, 0) and seen["ragged", 1, 0, 3] == (0.0, 0)
    assert len(got) == 5 * 3 * 4 and {(r.row, r.col) for r in got} == {(1, 1)}
    with pytest.raises(ValueError):
        D.active_fire_test(manifest, day, day.limit(0), th, 11, 4)


def test_pairing_raises_on_a_missing_side(spark):
    keys = "fire_id string, window_idx int, step int"
    images = spark.createDataFrame([("a", 0, 0, 1, 1, [float("nan"), 2.0]), ("a", 0, 1, 1, 1, [1.0, float("inf")])], f"{keys}, row int, col int, x array<float>")
    goes = spark.createDataFrame([("a", 0, 1, [[0.0, -3.0]]), ("a", 0, 0, [[1.0, 0.0]])], f"{keys}, bins array<array<float>>")
    got = {r.step: r for r in D.paired_growth_samples(images, goes, channels=2).collect()}
    assert list(got[0].x) == [0.0, 2.0] and list(got[1].x) == [1.0, 0.0]
    assert got[0].bins == [[pytest.approx(np.log(2)), 0.0]] and got[1].bins == [[0.0, 0.0]]
    labels = spark.createDataFrame([("a", 1, 1, 0, 1)], "fire_id string, row int, col int, window_idx int, growth int")
    assert [r.growth for r in D.paired_growth_samples(images, goes, labels, channels=2).collect()] == [1, 1]
    for i, g, l in ((images.where("step = 0"), goes, None), (images, goes.where("step = 0"), None), (images, goes, labels.where("false"))):
        with pytest.raises(Exception, match="no (image|GOES bins|label) for fire a"):
            D.paired_growth_samples(i, g, l, channels=2).collect()
