import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline import constants as K
from emberline.functions import channels as C
from emberline.functions import geo as G
from emberline.functions import timeparse as TP


def _parse(spark, name, policy):
    return spark.range(1).select(TP.timestamp_from_name(F.lit(name), policy).alias("t")).first().t


MIDNIGHT, FULL = dt.datetime(2021, 7, 5), dt.datetime(2021, 7, 5, 18, 0, 32)


@pytest.mark.parametrize("name,policy,expected", [
    ("20210705T180032_mask.tif", "daily", MIDNIGHT),
    ("20210705T180032_mask.tif", "subdaily", FULL),
    ("20210705T180032_mask.tif", "earliest", MIDNIGHT),
    ("20210705T180032_mask.tif", "default", FULL),
    ("2021-07-05_VIIRS_Day.tif", "daily", MIDNIGHT),
    ("2021-07-05_VIIRS_Day.tif", "earliest", MIDNIGHT),
    ("x_20210705180032.tif", "daily", FULL),
    ("x_2021070518.tif", "daily", dt.datetime(2021, 7, 5, 18)),
    ("OR_s2021186180032_e.nc", "daily", FULL),
    ("OR_s20211861800321_e.nc", "default", FULL),
    ("OR_s20211011200321_e.nc", "daily", dt.datetime(2021, 10, 11, 20, 3, 21)),
    ("x_20211305.tif", "daily", None),
    ("x_20210705180060.tif", "daily", None),
    ("no_stamp.tif", "default", None),
])
def test_names(spark, name, policy, expected):
    assert _parse(spark, name, policy) == expected


@pytest.mark.parametrize("policy", TP.POLICIES)
def test_name_is_stripped_once(spark, policy):
    out = spark.createDataFrame([("x_20210705180032.tif",)], "n string").select(TP.timestamp_from_name(F.col("n"), policy).alias("t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3
    assert out.first().t == FULL


@pytest.mark.parametrize("name,policy,expected", [
    ("s2021366000000_x.nc", "daily", dt.datetime(2022, 1, 1)),
    ("a.b/2021-7-5.tif", "subdaily", MIDNIGHT),
    ("2021711.tif", "earliest", dt.datetime(2021, 7, 11)),
    ("x_20210230.tif", "earliest", None),
    ("x_20210705T180060.tif", "subdaily", MIDNIGHT),
    (None, "earliest", None),
])
def test_odd_names(spark, name, policy, expected):
    assert _parse(spark, name, policy) == expected


def test_unknown_policy():
    with pytest.raises(ValueError):
        TP.timestamp_from_name(F.lit("x"), "other")


def test_ranges_and_bins(spark):
    row = spark.range(1).select(
        TP.date_range(F.lit("2021-01-30").cast("date"), F.lit("2021-02-01").cast("date")).alias("days"),
        TP.date_range(F.lit("2021-02-02").cast("date"), F.lit("2021-02-01").cast("date")).alias("none"),
        TP.floor_hours(F.lit("2021-01-01 23:59:00").cast("timestamp_ntz"), 5).alias("five"),
        TP.minute_bin(F.lit("2021-01-01 23:59:00").cast("timestamp_ntz"), 15).alias("bin"),
        TP.clip_stamp(F.lit("2021-07-05T18:00:32.1Z"), F.lit("x.nc")).alias("stamp"),
        TP.clip_stamp(F.lit(None).cast("string"), F.lit("OR_s2021_e1.nc")).alias("named"),
    ).first()
    assert [str(d) for d in row.days] == ["2021-01-30", "2021-01-31", "2021-02-01"]
    assert row.none == []
    assert row.five == dt.datetime(2021, 1, 1, 20)
    assert row.bin == 95 and TP.bins_per_day(15) == 96 and TP.bins_per_day(7) == 206
    assert row.stamp == "20210705T180032" and row.named == "2021"


def test_bbox_of_a_known_fire(spark):
    fires = spark.createDataFrame([(47.182, -109.524)], "lat double, lon double")
    row = G.with_bbox(fires).first()
    assert math.isclose(row.min_lon, -111.21575525586744, abs_tol=1e-9)
    assert math.isclose(row.min_lat, 46.024404181814894, abs_tol=1e-9)
    assert math.isclose(row.max_lon, -107.83224474413257, abs_tol=1e-9)
    assert math.isclose(row.max_lat, 48.33959581818511, abs_tol=1e-9)
    with pytest.raises(Exception, match="poles"):
        G.with_bbox(spark.createDataFrame([(90.0, 0.0)], "lat double, lon double")).collect()


def test_scan_angles_of_the_published_example(spark):
    x, y = G.scan_angles(F.lit(-84.690932), F.lit(33.846162))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert math.isclose(row.x, -0.024052, abs_tol=2e-6) and math.isclose(row.y, 0.095340, abs_tol=2e-6)
    far = spark.range(1).select(G.scan_angles(F.lit(100.0), F.lit(0.0))[0].alias("x")).first()
    assert far.x is None


def test_cleaning(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "v double")
    assert [r[0] for r in df.select(C.clean(F.col("v"))).collect()] == [0.0, 0.0, 0.0, None, 2.5]


def test_land_cover_zero(spark):
    def hot(mode):
        row = spark.range(1).select(F.array(*C.landcover_one_hot(F.lit(0.0), mode)).alias("a")).first()
        return [i + 1 for i, v in enumerate(row.a) if v]

    assert hot("reference") == [17] and hot("strict") == []


def test_pred_encoding(spark):
    raw = [float(i) for i in range(27)]
    raw[0], raw[12], raw[21] = float("nan"), 90.0, 4.0
    out = spark.createDataFrame([(raw,)], "x array<float>").select(C.encode_pred(F.col("x")).alias("y")).first().y
    assert len(out) == 43
    assert math.isclose(out[0], -K.PRED_MEAN[0] / K.PRED_STD[0])
    assert math.isclose(out[12], 1.0)
    assert out[21:38] == [1.0 if k == 4 else 0.0 for k in range(1, 18)]
    assert math.isclose(out[42], (26.0 - K.PRED_MEAN[26]) / K.PRED_STD[26])


def test_day_night_stack(spark):
    rows = [(list(range(8)), [1.0, 2.0, 3.0, 4.0, 5.0]), (list(range(8)), [7.0, 8.0]), (list(range(8)), None)]
    df = spark.createDataFrame([([float(v) for v in d], n) for d, n in rows], "d array<float>, n array<float>")
    got = [r[0][6:] for r in df.select(C.stack_day_night(F.col("d"), F.col("n"))).collect()]
    assert got == [[4.0, 5.0], [7.0, 8.0], [0.0, 0.0]]


def test_quarter_turns_compose(spark):
    df = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "row int, col int").withColumns(
        {"hflip": F.lit(False), "vflip": F.lit(False), "turns": F.lit(1), "r0": F.col("row"), "c0": F.col("col")})
    once = C.augment(df, 4)
    top_left = once.where("row = 0 and col = 0").first()
    assert (top_left.r0, top_left.c0) == (0, 3)  # counter-clockwise: the right top corner moves left
    for _ in range(3):
        once = C.augment(once, 4)
    assert once.where("row <> r0 or col <> c0").count() == 0


def test_angles_follow_flips(spark):
    def turned(h, v, t, a=30.0):
        df = spark.createDataFrame([(h, v, t)], "hflip boolean, vflip boolean, turns int")
        return df.select(C.turn_angle(F.lit(a)).alias("a")).first().a

    assert turned(True, False, 0) == 330.0
    assert turned(False, True, 0) == 150.0
    assert turned(False, False, 1) == 300.0
    assert turned(False, True, 0, 270.0) == 270.0


def test_planned_feature_sets_are_refused():
    with pytest.raises(ValueError, match="planned"):
        C.project_feature_set(None, "pred_no_landcover")


def test_fill_nodata(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (7.0,)], "v double")
    assert [r[0] for r in df.select(G.fill_nodata(F.col("v"), K.MASK_FILL, "smallint")).collect()] == [-99, -99, 7]
