import datetime as dt

from pyspark.sql import functions as F

from emberline.operators import align, audits
from emberline.operators import scenes as S


def _ts(text):
    return dt.datetime.fromisoformat(text)


def _scenes(spark, rows):
    return spark.createDataFrame(
        [(f, s, _ts(t), n) for f, s, t, n in rows], "fire_id string, source string, ts timestamp_ntz, file_name string")


def test_interval_edges(spark):
    rows = [("f", "viirs_day", "2021-01-01T00:00", "a"), ("f", "viirs_day", "2021-01-01T12:00", "b"),
            ("f", "mask", "2021-01-01T00:00", "g0"), ("f", "mask", "2021-01-01T00:01", "g1"), ("f", "mask", "2021-01-01T12:00", "g2")]
    out = align.interval_alignment(_scenes(spark, rows), ["mask"]).collect()
    assert [(r.interval_index, r.mask_count, r.has_any) for r in out] == [(0, 2, 1)]
    assert out[0].mask_first == _ts("2021-01-01T00:01") and out[0].viirs_gap_hours == 12.0


def test_equal_anchor_times_give_an_empty_interval(spark):
    rows = [("f", "viirs_day", "2021-01-01", "a"), ("f", "viirs_day", "2021-01-01", "b"), ("f", "viirs_day", "2021-01-02", "c"),
            ("f", "mask", "2021-01-01T05:00", "g")]
    out = {r.interval_index: r.mask_count for r in align.interval_alignment(_scenes(spark, rows), ["mask"]).collect()}
    assert out == {0: 0, 1: 1}


def test_single_scene_summary(spark):
    rows = [("f", "viirs_day", "2021-01-01", "a"), ("f", "mask", "2021-01-01T05:00", "g")]
    row = align.alignment_summary(_scenes(spark, rows), ["mask"]).first()
    assert (row.interval_count, row.covered_intervals, row.coverage_ratio, row.first_viirs_time) == (0, 0, 0.0, None)


def test_alignment_matches_a_range_join(spark):
    import random

    rng = random.Random(4)
    base = dt.datetime(2021, 1, 1)
    rows = []
    for i in range(300):
        fire = "hot" if rng.random() < 0.5 else f"f{rng.randrange(3)}"
        source = rng.choice(["viirs_day", "mask", "frp"])
        rows.append((fire, source, (base + dt.timedelta(minutes=30 * rng.randrange(200))).isoformat(), f"n{i}"))
    df = _scenes(spark, rows)
    got = {(r.fire_id, r.interval_index): (r.mask_count, r.frp_count) for r in align.interval_alignment(df, ["mask", "frp"]).collect()}
    want = {}
    for fire in {r[0] for r in rows}:
        anchors = sorted((t, n) for f, s, t, n in rows if f == fire and s == "viirs_day")
        for i in range(len(anchors) - 1):
            a, b = anchors[i][0], anchors[i + 1][0]
            want[fire, i] = tuple(sum(1 for f, s, t, _ in rows if f == fire and s == k and a < t <= b) for k in ("mask", "frp"))
    assert got == want


def test_date_coverage(spark):
    fires = spark.createDataFrame(
        [("a", dt.date(2021, 1, 1), dt.date(2021, 1, 3)), ("blank", None, dt.date(2021, 1, 3)), ("back", dt.date(2021, 1, 5), dt.date(2021, 1, 3))],
        "fire_id string, start_date date, end_date date")
    files = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2021, 1, 3),), (dt.date(2021, 1, 3),)], "day date")
    report = align.date_coverage(fires, files)
    got = {r.fire_id: r for r in report.collect()}
    assert got["a"].coverage_ratio == "0.6667" and got["a"].missing_date_list == "2021-01-02" and got["a"].total_files == 3
    assert got["blank"].is_blank and got["blank"].total_days == 0 and got["blank"].coverage_ratio == "0.0000"
    assert got["back"].total_days == 0
    totals = align.coverage_totals(report).first()
    assert (totals.full_coverage_events, totals.partial_or_missing_events, totals.blank_date_events) == (2, 1, 1)


def test_measures_by_hand(spark):
    rows = [("f", "mask", 0, 10.0), ("f", "mask", 0, 35.0), ("f", "mask", 0, 40.0), ("f", "mask", 0, float("nan")),
            ("f", "mask", 1, -5.0), ("f", "mask", 1, 0.0)]
    df = spark.createDataFrame(rows, "fire_id string, source string, s int, value double")
    got = {r.s: r for r in S.scene_measures(df, keys=["s"]).collect()}
    assert (got[0].coverage, got[0].active_pixel_count, got[0].mask_coverage) == (0.75, 2.0, 0.5)
    assert got[0].frp_mean == 85 / 3 and got[0].frp_max == 40.0
    assert (got[1].frp_mean, got[1].frp_max, got[1].coverage) == (0.0, 0.0, 0.0)


def test_rollups_differ_in_their_masks(spark):
    rows = [("f", _ts("2021-01-01T00:05"), "mask", 0.5, 3.0, 0.1, None, None), ("f", _ts("2021-01-01T00:10"), "mask", 0.7, 2.0, 0.2, None, None),
            ("f", _ts("2021-01-01T00:10"), "frp", None, None, None, 4.0, 9.0)]
    df = spark.createDataFrame(
        rows, "fire_id string, ts timestamp_ntz, kind string, coverage double, active_pixel_count double, mask_coverage double, frp_mean double, frp_max double")
    day = align.daily_rollup(df).first()
    assert (day.goes_mask_file_count, day.goes_mask_cov_mean, day.goes_mask_cov_max, day.goes_frp_max_max) == (2.0, 0.6, 0.7, 9.0)
    bins = align.subdaily_rollup(df, 15)
    b = bins.first()
    assert (b.bin, b.active_pixel_count, b.mask_coverage, b.frp_mean) == (0, 3.0, 0.2, 4.0)
    days = bins.select("fire_id", "day").distinct()
    matrix = align.day_matrix(align.dense_bins(days, bins, 15)).first().bins
    assert len(matrix) == 96 and matrix[0][0] == 3.0 and matrix[95] == [0.0] * 4


def test_prefer_first_directory(spark):
    rows = [("a", "mask"), ("a", "mask_fixed"), ("b", "mask"), ("c", "other")]
    df = spark.createDataFrame(rows, "fire_id string, source string")
    got = sorted(map(tuple, S.prefer_source(df, ["mask_fixed", "mask"]).select("fire_id", "source").collect()))
    assert got == [("a", "mask_fixed"), ("b", "mask")]


def test_misaligned(spark):
    a = spark.createDataFrame([("f", 0), ("f", 1)], "fire_id string, window_idx int")
    assert audits.misaligned_samples(a, a).count() == 0
    audits.require_aligned(a, a)
    try:
        audits.require_aligned(a, a.where("window_idx = 0"))
    except ValueError:
        return
    raise AssertionError("a missing counterpart must raise")


def test_split_by_id_list(spark):
    df = spark.createDataFrame([("1", False), ("2", False), ("3", True)], "fire_id string, is_test boolean")
    got = {r.fire_id: r.split for r in S.assign_split(df, is_test=F.col("is_test"), validation=["2"]).collect()}
    assert got == {"1": "train", "2": "val", "3": "test"}


def test_overwrite_redoes_everything(spark):
    a = spark.range(3)
    assert align.not_yet_done(a, a.where("id < 2"), ["id"]).count() == 1
    assert align.not_yet_done(a, a.where("id < 2"), ["id"], overwrite=True).count() == 3


def test_gaps_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [("f", "viirs_day", "2021-03-13T12:00:00.25", "a"), ("f", "viirs_day", "2021-03-15T13:30", "b")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the clock changes in between
        gaps = [r.gap_hours for r in S.scene_gaps(_scenes(spark, rows)).orderBy("ts").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert gaps == [49.5, None]


def test_fine_segments_change_nothing(spark):
    rows = [("f", "viirs_day", f"2021-03-13T{h:02d}:{m:02d}", f"{h}-{m}") for h in range(6) for m in (0, 7, 31)]
    df = _scenes(spark, rows)
    coarse = sorted((str(r) for r in S.scene_gaps(df).collect()))
    assert len(coarse) == 18
    assert sorted(str(r) for r in S.scene_gaps(df, rows=4, levels=1, fan_in=3600).collect()) == coarse


def test_named_fires_are_left_out(spark):
    df = spark.createDataFrame([("a",), ("US_2021_NV3700011641620210517",)], "fire_id string")
    assert [r.fire_id for r in S.exclude_fires(df).collect()] == ["a"]
    paged = spark.createDataFrame([(f"f{i}",) for i in range(9)], "fire_id string")
    assert [r.fire_id for r in S.page_fires(paged, start=6).orderBy("fire_id").collect()] == ["f6", "f7", "f8"]
    assert S.page_fires(paged).count() == 9
