import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import windows as W


def _starts(n, ts, it, tail):
    if tail == "drop":
        return [s for s in range(0, n, it) if s + ts < n]
    if n < ts:
        return []
    return [s if s + ts < n else n - ts for s in range(0, n, it)]


def _simulate(values, labels, ts, it, tail):
    """State carried by hand through the windows, one frame at a time."""
    length = ts + 1 if tail == "drop" else ts
    top, base = 0, False
    peaks, unions, grown = {}, {}, {}
    for w, s in enumerate(_starts(len(values), ts, it, tail)):
        union, kept, before = base, base, False
        for j in range(length):
            top = max(top, values[s + j])
            union = union or labels[s + j]
            if j == it - 1:
                kept = union
            if j < ts:
                peaks[w, j], unions[w, j], before = top, int(union), union
            else:
                grown[w] = int(union and not before)
        base = kept
    return peaks, unions, grown


def _frames(spark, values, labels):
    rows = [("f", 0, 0, k, len(values), float(v), b) for k, (v, b) in enumerate(zip(values, labels))]
    return spark.createDataFrame(rows, "fire_id string, row int, col int, frame int, n_frames int, v double, b boolean")


@pytest.mark.parametrize("tail", ["drop", "clamp"])
def test_carried_state_matches_simulation(spark, tail):
    rng = random.Random(11)
    for _ in range(12):
        ts = rng.randint(1, 5)
        it = rng.randint(1, ts)
        n = rng.randint(1, 14)
        values = [rng.randint(-3, 20) for _ in range(n)]
        labels = [rng.random() < 0.25 for _ in range(n)]
        peaks, unions, grown = _simulate(values, labels, ts, it, tail)
        df = _frames(spark, values, labels)
        got = {(r.window_idx, r.step): r.v for r in W.carried_max(df, ["v"], ts, it, tail, block=3).collect()}
        assert got == peaks, (ts, it, n, tail)
        got = {(r.window_idx, r.step): r.b for r in W.carried_union(df, {"b": F.col("b")}, ts, it, tail).collect()}
        assert got == unions, (ts, it, n, tail)
        if tail == "drop":
            args = (df, F.col("b"), F.lit(False), ts, it)
            assert {r.window_idx: r.growth for r in W.growth_target(*args).collect()} == grown
            sparse = {r.window_idx for r in W.growth_target(*args, dense=False).collect()}
            assert sparse == {w for w, g in grown.items() if g}


def test_carried_maximum_by_hand(spark):
    df = _frames(spark, [5, 1, 9, 2, 0], [False] * 5)
    def run(mode):
        return {(r.window_idx, r.step): r.v for r in W.carried_max(df, ["v"], 2, 1, "drop", leakage=mode).collect()}
    reference, causal = run("reference"), run("causal")
    assert (reference[0, 0], reference[0, 1]) == (5, 5)
    assert reference[1, 0] == 9 and causal[1, 0] == 5


def test_carried_maximum_without_the_edge_row(spark):
    df = _frames(spark, [5, 1, 9, 2, 0, 8, 3], [False] * 7)
    full = {(r.window_idx, r.step): r.v for r in W.carried_max(df, ["v"], 3, 2, "drop", block=1).collect()}
    got = {(r.window_idx, r.step): r.v for r in W.carried_max(df.where("frame <> 3"), ["v"], 3, 2, "drop", block=1).collect()}
    # Frame 3 is the last one that window 0 passed; only the steps at frame 3 itself go with it.
    assert got == {k: v for k, v in full.items() if k not in ((1, 1),)}
    assert got[1, 0] == 9


@pytest.mark.parametrize("tail", ["drop", "clamp"])
def test_carried_maximum_with_gaps(spark, tail):
    rng = random.Random(5)
    for _ in range(8):
        ts, n = rng.randint(1, 5), rng.randint(1, 14)
        it = rng.randint(1, ts)
        values = [rng.randint(0, 20) for _ in range(n)]
        here = [rng.random() < 0.6 for _ in range(n)]
        # A missing row adds nothing to the state and has no step.
        peaks, _, _ = _simulate([v if h else 0 for v, h in zip(values, here)], [False] * n, ts, it, tail)
        top = {}
        for w, s in enumerate(_starts(n, ts, it, tail)):
            top |= {(w, j): p for (v, j), p in peaks.items() if v == w and here[s + j]}
        df = _frames(spark, values, [False] * n).where(F.col("frame").isin([k for k, h in enumerate(here) if h]))
        got = {(r.window_idx, r.step): r.v for r in W.carried_max(df, ["v"], ts, it, tail, block=2).collect()}
        assert got == top, (ts, it, n, tail)


def test_interval_longer_than_window_skips_frames(spark):
    df = _frames(spark, [1, 2, 50, 60, 3, 4, 70], [False] * 7)
    got = {(r.window_idx, r.step): r.v for r in W.carried_max(df, ["v"], 1, 4, "drop").collect()}
    assert got == {(0, 0): 1, (1, 0): 3}
    with pytest.raises(ValueError):
        W.carried_union(df, {"b": F.col("b")}, 1, 4, "drop")


def test_window_starts(spark):
    def starts(n, ts, it, tail, **kw):
        df = spark.range(n).select(F.col("id").cast("int").alias("frame"), F.lit(n).alias("n_frames"))
        rows = W.cut_windows(df, ts, it, tail, **kw).select("window_idx", "start_idx").distinct().orderBy("window_idx").collect()
        return [r.start_idx for r in rows]

    assert starts(7, 3, 2, "drop") == [0, 2]
    assert starts(7, 3, 2, "clamp") == [0, 2, 4, 4]
    assert starts(7, 3, 2, "clamp", distinct=True) == [0, 2, 4]
    assert starts(3, 3, 1, "drop") == []
    assert starts(2, 3, 1, "clamp") == []


def test_label_selector(spark):
    rows = [("f", 0, 0, 0, 2, False, False), ("f", 0, 0, 1, 2, True, False),
            ("f", 0, 1, 0, 2, False, False), ("f", 0, 1, 1, 2, False, True)]
    df = spark.createDataFrame(rows, "fire_id string, row int, col int, frame int, n_frames int, af boolean, p boolean")

    def grown(sel):
        out = W.growth_target(df, F.col("af"), F.col("p"), 1, 1, label_sel=sel).collect()
        return {r.col for r in out if r.growth}

    assert grown(F.lit(1)) == {0}
    assert grown(F.lit(0)) == {0, 1}
    assert grown(F.lit(None).cast("int")) == {0, 1}


def test_blocks(spark):
    df = spark.range(23).select(F.lit("f").alias("fire_id"), F.col("id").cast("int").alias("frame"),
                                F.lit(23).alias("n_frames"), (F.col("id") + 1).alias("v"))
    padded = W.pad_blocks(W.fixed_blocks(df), ["fire_id"], ["v"]).collect()
    assert len(padded) == 30
    assert sorted((r.block, r.pos) for r in padded if not r.is_real) == [(2, p) for p in range(3, 10)]
    assert all(r.v == 0 for r in padded if not r.is_real)
    cut = W.block_windows(W.fixed_blocks(df.where("frame < 10")), 4, 3).select("window_idx", "start_idx", "step").collect()
    assert {(r.window_idx, r.start_idx) for r in cut} == {(0, 0), (1, 3), (2, 6), (3, 6)}
    assert len(cut) == 16
