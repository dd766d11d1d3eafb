import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import scenes as S
from emberline.operators.ordered import Scan, block_segment, neighbour, nth_value, row_index, scene_segments, segmented_scan


def _rows(seed, n=400):
    rng = random.Random(seed)
    # A hot key holds a third and more of all rows.
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", i, rng.choice([None, rng.randrange(100)])) for i in range(n)]


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("block", [7, 1000])
def test_scans_match_plain_loops(spark, levels, block):
    rows = _rows(levels * 10 + block)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = segmented_scan(
        df, ["k"], block_segment("i", block), ["i"],
        {
            "s": Scan("sum", F.col("v")),
            "before": Scan("max", F.col("v"), inclusive=False),
            "after": Scan("min", F.col("v"), following=True, inclusive=False),
            "rest": Scan("sum", F.col("v"), following=True),
            "n": Scan("total", F.lit(1)),
        },
        levels=levels, fan_in=3,
    ).collect()
    assert len(got) == len(rows)
    by_key = {}
    for k, i, v in rows:
        by_key.setdefault(k, []).append((i, v))
    for r in got:
        mine = by_key[r.k]
        prev = [v for i, v in mine if i < r.i and v is not None]
        nxt = [v for i, v in mine if i > r.i and v is not None]
        assert r.before == (max(prev) if prev else None)
        assert r.after == (min(nxt) if nxt else None)
        assert r.s == sum(prev) + (r.v or 0)
        assert r.rest == sum(nxt) + (r.v or 0)
        assert r.n == len(mine)


def test_row_index_without_keys(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("x"))
    got = row_index(df, [], block_segment("x", 10), ["x"], "pos", "n").collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.x)] == list(range(100))
    assert {r.n for r in got} == {100}


def test_neighbour_skips_rows_that_do_not_qualify(spark):
    df = spark.createDataFrame([("a", i, i if i % 3 == 0 else None) for i in range(12)], "k string, i int, v int")
    got = neighbour(df, ["k"], block_segment("i", 4), ["i"], {"last": F.col("v")}, following=False,
                    where=F.col("v").isNotNull()).orderBy("i").collect()
    assert [r["last"] for r in got] == [None, 0, 0, 0, 3, 3, 3, 6, 6, 6, 9, 9]


def test_null_order_values_come_first(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 1)], "k string, i int")
    got = {r.i: r.pos for r in row_index(df, ["k"], block_segment("i", 2), ["i"], "pos").collect()}
    assert got == {None: 0, 1: 1, 5: 2}


def test_full_days_are_cut(spark):
    start = dt.datetime(2021, 1, 1)
    rng = random.Random(2)
    # One fire holds 90 % of one day, with many scenes in the same second.
    rows = [("hot", start + dt.timedelta(seconds=rng.randrange(0, 86400, 40)), f"h{i}") for i in range(900)]
    rows += [(f"f{i % 5}", start + dt.timedelta(hours=rng.randrange(72)), f"c{i}") for i in range(100)] + [("hot", None, "n")]
    df = spark.createDataFrame(rows, "fire_id string, ts timestamp_ntz, file_name string")
    cut = scene_segments(df, ["fire_id"], rows=50)
    sizes = cut.groupBy("fire_id", "__stretch").count().collect()
    hot = [r["count"] for r in sizes if r.fire_id == "hot" and r["__stretch"] is not None]
    assert len(hot) >= 18 and max(hot) < 50 + 10 and sum(hot) == 900
    assert {r["__stretch"] % 86400 for r in sizes if r.fire_id != "hot"} == {0}
    want = {}
    for fire, ts, name in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or start, r[2])):
        want[fire, name] = sum(k[0] == fire for k in want)
    for limit in (50, 7, 10_000):
        got = S.frame_index(df, rows=limit)
        assert {(r.fire_id, r.file_name): r.frame for r in got.collect()} == want
        assert got.columns == ["fire_id", "ts", "file_name", "frame", "n_frames"]


@pytest.mark.parametrize("values", [
    [i * 7919 % 1009 for i in range(1000)], [2**60 + i * i for i in range(300)], [5], [3, 3, 3, 9],
    [f"US_2021_{i:05d}" for i in range(700)], ["a", "ab", "abc", "b", "é", "zz" * 9], [x / 7 - 50 for x in range(500)],
])
def test_values_by_position(spark, values):
    kind = {int: "bigint", float: "double", str: "string"}[type(values[0])]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
    ordered = sorted(values)
    for index in {0, 1, len(values) // 2, len(values) - 1, len(values)}:
        got = [r.v for r in nth_value(df, "v", index).collect()]
        assert got == ordered[index:index + 1]


def test_open_and_closed_pages(spark):
    fires = spark.createDataFrame([(f"fire{i:04d}", i) for i in range(300)], "fire_id string, n int").repartition(5)
    for start, limit in ((0, None), (0, 4), (290, None), (290, 30), (17, 60), (300, None), (300, 5), (2, 0)):
        want = [f"fire{i:04d}" for i in range(300)][start:None if limit is None else start + limit]
        assert sorted(r.fire_id for r in S.page_fires(fires, start=start, limit=limit).collect()) == want
