"""Queries: windows, carried state, targets and sequences over tile pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.pixels import framewise
from . import fixtures as X
from .registry import query

TS, IT = 3, 2
SCAN_BLOCK = 16

_STARTS = {
    "drop": f"w * {IT} + {TS} < n_frames",
    "clamp": f"w * {IT} < n_frames AND n_frames >= {TS}",
}
_START = {"drop": f"w * {IT}", "clamp": f"CASE WHEN w * {IT} + {TS} < n_frames THEN w * {IT} ELSE n_frames - {TS} END"}


def _windows(tail: str, source: str = "tiles") -> str:
    """Window list of every fire: fire_id, w, s and the previous window's start."""
    return f"""
fires AS (SELECT DISTINCT fire_id, n_frames FROM {source}),
wl AS (SELECT fire_id, n_frames, unnest(range(0, n_frames)) AS w FROM fires),
win AS (SELECT fire_id, n_frames, w, {_START[tail]} AS s FROM wl WHERE {_STARTS[tail]}),
winp AS (SELECT *, lag(s) OVER (PARTITION BY fire_id ORDER BY w) AS sp FROM win)"""


_DAYS = X.SCENES + """,
tiles AS (SELECT fire_id, file_name, row_number() OVER (PARTITION BY fire_id ORDER BY ts, file_name) - 1 AS frame,
                 count(*) OVER (PARTITION BY fire_id) AS n_frames FROM scenes WHERE source = 'viirs_day')"""


def _day_frames(spark, sf_dir):
    from ..operators.scenes import frame_index

    return frame_index(X.scenes(spark, sf_dir, "viirs_day").select("fire_id", "ts", "file_name"))


def _window_sql(tail: str, extra: int) -> str:
    return f"""
WITH {_DAYS}, {_windows(tail)}
SELECT win.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(s AS INTEGER) AS start_idx, CAST(j AS INTEGER) AS step, file_name
FROM win CROSS JOIN range(0, {TS + extra}) AS g(j) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
"""


@query(_window_sql("drop", 1))
def windows_drop_tail(spark, sf_dir):
    """Sliding windows that need ts + 1 frames."""
    out = W.cut_windows(_day_frames(spark, sf_dir), TS, IT, "drop")
    return out.select("fire_id", "window_idx", "start_idx", "step", "file_name")


@query(_window_sql("clamp", 0))
def windows_clamp_tail(spark, sf_dir):
    """Sliding windows whose last starts are moved back to fit."""
    out = W.cut_windows(_day_frames(spark, sf_dir), TS, IT, "clamp")
    return out.select("fire_id", "window_idx", "start_idx", "step", "file_name")


@query(f"""
WITH {_DAYS}, {_windows("clamp")}
SELECT DISTINCT win.fire_id, CAST(s AS INTEGER) AS start_idx, CAST(j AS INTEGER) AS step, file_name
FROM win CROSS JOIN range(0, {TS}) AS g(j) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
""")
def windows_clamp_distinct(spark, sf_dir):
    """Clamped windows without repeats."""
    out = W.cut_windows(_day_frames(spark, sf_dir), TS, IT, "clamp", distinct=True)
    return out.select("fire_id", "start_idx", "step", "file_name")


def _max_sql(tail: str, length: int, mode: str) -> str:
    at = "s + j" if mode == "causal" else f"greatest(s + j, coalesce(sp + {length - 1}, -1))"
    return f"""
WITH {X.PIXELS},
pm AS (SELECT fire_id, r, c, frame, greatest(max(v) OVER (PARTITION BY fire_id, r, c ORDER BY frame), 0.0) AS m FROM px), {_windows(tail)}
SELECT pm.fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(w AS INTEGER) AS window_idx, CAST(s AS INTEGER) AS start_idx,
       CAST(j AS INTEGER) AS step, round(m, 6) AS v
FROM winp CROSS JOIN range(0, {TS}) AS g(j) JOIN pm ON pm.fire_id = winp.fire_id AND pm.frame = {at}
"""


def _carried_max(spark, sf_dir, tail: str, mode: str):
    out = W.carried_max(X.tile_pixels(spark, sf_dir), ["v"], TS, IT, tail, leakage=mode, block=SCAN_BLOCK)
    return out.withColumn("v", F.round("v", 6))


@query(_max_sql("drop", TS + 1, "reference"))
def running_max_windows(spark, sf_dir):
    """Carried maximum with the look-ahead of overlapping windows."""
    return _carried_max(spark, sf_dir, "drop", "reference")


@query(_max_sql("drop", TS + 1, "causal"))
def running_max_causal(spark, sf_dir):
    return _carried_max(spark, sf_dir, "drop", "causal")


@query(_max_sql("clamp", TS, "reference"))
def running_max_clamped(spark, sf_dir):
    return _carried_max(spark, sf_dir, "clamp", "reference")


def _union_sql(tail: str) -> str:
    return f"""
WITH {X.PIXELS},
po AS (SELECT fire_id, r, c, frame, max(CAST(v > {X.BURN_LEVEL} AS INTEGER)) OVER w AS burned, max(CAST(v < -{X.BURN_LEVEL} AS INTEGER)) OVER w AS perimeter
       FROM px WINDOW w AS (PARTITION BY fire_id, r, c ORDER BY frame)), {_windows(tail)}
SELECT po.fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(w AS INTEGER) AS window_idx, CAST(s AS INTEGER) AS start_idx,
       CAST(j AS INTEGER) AS step, burned, perimeter
FROM winp CROSS JOIN range(0, {TS}) AS g(j) JOIN po ON po.fire_id = winp.fire_id AND po.frame = greatest(s + j, coalesce(sp + {IT - 1}, -1))
"""


def _carried_union(spark, sf_dir, tail: str):
    labels = {"burned": F.col("v") > X.BURN_LEVEL, "perimeter": F.col("v") < -X.BURN_LEVEL}
    return W.carried_union(X.tile_pixels(spark, sf_dir), labels, TS, IT, tail)


@query(_union_sql("drop"))
def running_union(spark, sf_dir):
    """Carried unions of active fire and perimeter labels."""
    return _carried_union(spark, sf_dir, "drop")


@query(_union_sql("clamp"))
def running_union_clamped(spark, sf_dir):
    return _carried_union(spark, sf_dir, "clamp")


_GROWTH = f"""
WITH {X.PIXELS},
f AS (SELECT fire_id, r, c, frame, max(CAST(v > {X.BURN_LEVEL} OR (CAST(fire_id AS INTEGER) % 2 <> 1 AND v < -{X.BURN_LEVEL}) AS INTEGER))
        OVER (PARTITION BY fire_id, r, c ORDER BY frame) AS final FROM px), {_windows("drop")},
g AS (SELECT a.fire_id, CAST(a.r AS INTEGER) AS "row", CAST(a.c AS INTEGER) AS col, CAST(w AS INTEGER) AS window_idx,
        CAST(a.final = 1 AND b.final = 0 AS INTEGER) AS growth
      FROM win JOIN f a ON a.fire_id = win.fire_id AND a.frame = s + {TS}
               JOIN f b ON b.fire_id = win.fire_id AND b.frame = s + {TS} - 1 AND b.r = a.r AND b.c = a.c)
"""


def _growth(spark, sf_dir, dense: bool):
    px = X.tile_pixels(spark, sf_dir)
    sel = F.col("fire_id").cast("int") % 2
    return W.growth_target(px, F.col("v") > X.BURN_LEVEL, F.col("v") < -X.BURN_LEVEL, TS, IT, label_sel=sel, dense=dense)


@query(_GROWTH + "SELECT * FROM g")
def growth_target(spark, sf_dir):
    """Next-day growth of every pixel and window; odd fires use active fire only."""
    return _growth(spark, sf_dir, True)


@query(_GROWTH + "SELECT * FROM g WHERE growth = 1")
def growth_pixels(spark, sf_dir):
    """Growth pixels alone, without touching the windows."""
    return _growth(spark, sf_dir, False)


@query(f"""
WITH {X.PIXELS}
SELECT fire_id, CAST(frame AS INTEGER) AS frame, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
       max(CAST(v > 0.2 AS INTEGER)) OVER (PARTITION BY fire_id, r, c ORDER BY frame) AS pred FROM px
""")
def cumulative_prediction(spark, sf_dir):
    """Predicted burned area joined over frames."""
    out = W.cumulative_union(X.tile_pixels(spark, sf_dir), F.col("v") > 0.2, ["fire_id", "row", "col"])
    return out.select("fire_id", "frame", "row", "col", "pred")


@query(f"""
WITH {_DAYS},
m AS (SELECT fire_id, max(n_frames) AS n FROM tiles GROUP BY fire_id),
grid AS (SELECT fire_id, k AS frame, n FROM m, LATERAL (SELECT unnest(range(0, CAST(ceil(n / 10.0) * 10 AS BIGINT))) AS k))
SELECT grid.fire_id, CAST(grid.frame // 10 AS INTEGER) AS block, CAST(grid.frame % 10 AS INTEGER) AS pos,
       CAST(file_name IS NOT NULL AS INTEGER) AS is_real, CASE WHEN file_name IS NULL THEN 0 ELSE length(file_name) END AS value
FROM grid LEFT JOIN tiles ON tiles.fire_id = grid.fire_id AND tiles.frame = grid.frame
""")
def fixed_blocks(spark, sf_dir):
    """Blocks of ten frames, the ragged last one padded with zeros."""
    frames = _day_frames(spark, sf_dir).withColumn("value", F.length("file_name").cast("bigint"))
    return W.pad_blocks(W.fixed_blocks(frames), ["fire_id"], ["value"])


@query(f"""
WITH {X.TILES},
b AS (SELECT fire_id, frame // 10 AS block, frame % 10 AS pos, vec_id FROM tiles),
w AS (SELECT i AS w, CASE WHEN i * 3 + 4 > 10 THEN 6 ELSE i * 3 END AS s FROM range(0, 4) AS g(i))
SELECT fire_id, CAST(block AS INTEGER) AS block, CAST(w AS INTEGER) AS window_idx, CAST(s AS INTEGER) AS start_idx, CAST(pos - s AS INTEGER) AS step, vec_id
FROM b JOIN w ON pos >= s AND pos < s + 4
""")
def block_windows(spark, sf_dir):
    """Windows of four frames inside blocks of ten, every three frames."""
    blocked = W.fixed_blocks(X.tiles(spark, sf_dir).select("fire_id", "vec_id", "frame", "n_frames"))
    out = W.block_windows(blocked, 4, 3)
    return out.select("fire_id", "block", "window_idx", "start_idx", "step", "vec_id")


_THRESHOLDS = """
th AS (SELECT CAST(label AS VARCHAR) AS fire_id, p AS pos, 325 + avg(embedding[p + 1]) * 40 AS day_i4, 330 + avg(embedding[p + 2]) * 40 AS day_i5,
              300 + avg(embedding[p + 3]) * 40 AS night_i4, 305 + avg(embedding[p + 4]) * 40 AS night_i5
       FROM embeddings, range(0, 10) AS g(p) GROUP BY ALL)"""


@query(f"""
WITH {X.TILES}, {_THRESHOLDS}
SELECT t.fire_id, vec_id, CAST(frame AS INTEGER) AS frame,
       CAST(320 + embedding[20] * 60 > day_i4 OR 325 + embedding[21] * 60 > day_i5
            OR 295 + embedding[22] * 60 > night_i4 OR 300 + embedding[23] * 60 > night_i5 AS INTEGER) AS af
FROM tiles t JOIN th ON th.fire_id = t.fire_id AND th.pos = t.frame % 10
""")
def threshold_labels(spark, sf_dir):
    """Active-fire labels from per-fire, per-position heat thresholds."""
    e = X.table(spark, sf_dir, "embeddings")

    def at(i):
        return F.get("embedding", i).cast("double")

    th = e.select("label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")).groupBy(
        F.col("label").cast("string").alias("fire_id"), "pos"
    ).agg(
        (325 + F.avg(at(F.col("pos"))) * 40).alias("day_i4"), (330 + F.avg(at(F.col("pos") + 1)) * 40).alias("day_i5"),
        (300 + F.avg(at(F.col("pos") + 2)) * 40).alias("night_i4"), (305 + F.avg(at(F.col("pos") + 3)) * 40).alias("night_i5"),
    )
    scenes = X.tiles(spark, sf_dir).select(
        "fire_id", "vec_id", "frame", (320 + at(F.lit(19)) * 60).alias("i4_day"), (325 + at(F.lit(20)) * 60).alias("i5_day"),
        (295 + at(F.lit(21)) * 60).alias("i4_night"), (300 + at(F.lit(22)) * 60).alias("i5_night"),
    )
    return W.threshold_label(scenes, th).select("fire_id", "vec_id", "frame", "af")


_SEQ = f"""
WITH {X.PIXELS}, {_windows("drop")}
SELECT px.fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, round(v, 6) AS v
FROM win CROSS JOIN range(0, {TS}) AS g(j) JOIN px ON px.fire_id = win.fire_id AND px.frame = s + j
"""


@query(_SEQ)
def pixel_sequences(spark, sf_dir):
    """Ordered per-pixel sequences, listed element by element."""
    samples = W.cut_windows(X.tile_pixels(spark, sf_dir), TS, IT, "drop").where(F.col("step") < TS)
    seq = W.pixel_sequences(samples, "v")
    return seq.select("fire_id", "row", "col", "window_idx", F.posexplode("seq").alias("step", "v")).withColumn("v", F.round("v", 6))


@query(f"""
WITH {_DAYS}, {_windows("drop")}
SELECT win.fire_id || '_' || w || '_' || j AS sample_id, file_name
FROM win CROSS JOIN range(0, {TS}) AS g(j) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
""")
def framewise_samples(spark, sf_dir):
    """Windows flattened to independent frames."""
    cut = W.cut_windows(_day_frames(spark, sf_dir), TS, IT, "drop").where(F.col("step") < TS)
    return framewise(cut).select("sample_id", "file_name")


@query(f"""
WITH {X.MEASURES},
d AS (SELECT fire_id, CAST(ts AS DATE) AS day, count(*) FILTER (kind = 'mask') AS n, avg(frp) FILTER (kind = 'frp') AS fm FROM measures GROUP BY ALL),
tiles AS (SELECT fire_id, ts, row_number() OVER (PARTITION BY fire_id ORDER BY ts, file_name) - 1 AS frame, count(*) OVER (PARTITION BY fire_id) AS n_frames
          FROM scenes WHERE source = 'viirs_day'), {_windows("drop")}
SELECT win.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, CAST(coalesce(n, 0) AS DOUBLE) AS goes_mask_file_count,
       round(coalesce(fm, 0.0), 6) AS goes_frp_mean_mean
FROM win CROSS JOIN range(0, {TS}) AS g(j) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
LEFT JOIN d ON d.fire_id = win.fire_id AND d.day = CAST(tiles.ts AS DATE)
""")
def goes_window_features(spark, sf_dir):
    """GOES daily features attached to each step of each window: aggregated once, then joined."""
    from ..operators import align

    steps = W.cut_windows(_day_frames(spark, sf_dir), TS, IT, "drop").where(F.col("step") < TS)
    steps = steps.withColumn("day", F.to_date("ts"))
    out = align.attach_daily(steps, align.daily_rollup(X.measures(spark, sf_dir)))
    return out.select("fire_id", "window_idx", "step", "goes_mask_file_count", F.round("goes_frp_mean_mean", 6).alias("goes_frp_mean_mean"))
