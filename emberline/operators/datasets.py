"""Training samples from pixel tables: the generators' work as one lazy plan.

Pixel rows are keyed by (fire_id, frame, row, col) throughout, so chunks, part
files and positional pairing have no counterpart here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as C
from ..functions.geo import crop
from . import align
from . import windows as W
from .scenes import frame_index, number_frames

SCENE_KEYS = ("fire_id", "ts")
PIXEL_KEYS = ("fire_id", "ts", "row", "col")


def stack_pixels(
    scenes: DataFrame, day: DataFrame, night: DataFrame, aux: DataFrame | None = None, *,
    offset: int | None = K.CROP_OFFSET, size: int = K.TILE, usable: Column | None = None, skipped: str = "drop",
) -> DataFrame:
    """Cropped pixels with stacked channels and labels: fire_id, frame, n_frames, row, col, x, af, perimeter.

    ``scenes`` is the day manifest (fire_id, ts, file_name), so frames are numbered
    without reading a pixel; scenes left out of it drop out with their pixels.
    Adaptive execution broadcasts it where its measured size allows.

    Day rows hold six bands, the active-fire band and, when eight, the perimeter
    band; night rows are joined where present, auxiliary rows must be. The crop
    comes before the joins, so rows outside it are never shuffled. The perimeter
    stays raw: what its NaN means depends on the task.

    ``usable`` (a condition on ``scenes``) says which scenes can be used, ``skipped`` what becomes of the rest
    (``scenes.number_frames``). Kept ones have vectors of zeros; pass ``skipped_frames`` of the same scenes to the builders below.
    """
    def cut(pixels: DataFrame) -> DataFrame:
        return crop(pixels, offset=offset, size=size)

    frames = _numbered(scenes, usable, skipped).select(*SCENE_KEYS, "frame", "n_frames", "usable")
    bands = F.col("bands")
    rows = cut(day).join(frames, list(SCENE_KEYS)).join(
        cut(night).select(*PIXEL_KEYS, F.col("bands").alias("__night")), list(PIXEL_KEYS), "left"
    )
    x = C.stack_day_night(bands, F.when(F.col("usable"), F.col("__night")))
    if aux is not None:
        rows = rows.join(cut(aux).select(*PIXEL_KEYS, F.col("bands").alias("__aux")), list(PIXEL_KEYS))
        x = F.concat(x, F.col("__aux"))
    if usable is not None and skipped == "reference":
        x = F.when(F.col("usable"), x).otherwise(F.transform(x, lambda v: F.lit(0.0).cast("float")))

    def band(i: int) -> Column:
        return F.get(bands, F.lit(i)).cast("double")

    return rows.select(
        "fire_id", "frame", "n_frames", "row", "col", x.alias("x"),
        C.clean(band(6)).alias("af"), F.when(F.size(bands) == 8, band(7)).otherwise(F.lit(0.0)).alias("perimeter"),
    )


def _numbered(scenes: DataFrame, usable: Column | None, skipped: str) -> DataFrame:
    ok = usable if usable is not None else F.lit(True)
    return number_frames(scenes.select(*SCENE_KEYS, "file_name", ok.alias("__ok")), skipped=skipped, usable=F.col("__ok"))


def skipped_frames(scenes: DataFrame, usable: Column) -> DataFrame:
    """fire_id, frame, n_frames of scenes that cannot be used but keep their place (``skipped="reference"``)."""
    return _numbered(scenes, usable, "reference").where(~F.col("usable")).select("fire_id", "frame", "n_frames")


def windowed_vectors(
    stack: DataFrame, ts: int, interval: int, tail: str, *, n: int, leakage: str = "reference",
    keys: Sequence[str] = W.PIXEL, block: int = 256, keep: Sequence[str] = (), usable: str | None = None,
) -> DataFrame:
    """Channel vectors per (pixel, window, step) with heat bands replaced by their carried maximum.

    ``frame`` and ``n_frames`` of the step's own row come along, as do the columns of ``keep``. Rows whose boolean
    column ``usable`` is false have vectors of zeros and add nothing to the maximum.
    """
    heat = {i: f"__h{i}" for i in K.HEAT_CHANNELS}
    values = {h: F.get("x", F.lit(i)).cast("double") for i, h in heat.items()}
    rows = W.carried_rows(stack, values, ts, interval, tail, leakage=leakage, keys=keys, block=block, keep=["x", *keep], usable=usable)
    raw = C.elements(F.col("x"), n)
    vector = F.array(*[F.col(heat[i]).cast("float") if i in heat else v.cast("float") for i, v in enumerate(raw)])
    if usable:
        vector = F.when(F.col(usable), vector).otherwise(_zeros(n))
    return rows.withColumn("x", vector).drop(*values)


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def growth_samples(
    stack: DataFrame, ts: int, interval: int, *, leakage: str = "reference", block: int = 256, skipped: DataFrame | None = None,
) -> DataFrame:
    """Next-day growth inputs: 27 channels per (pixel, window, step); windows need ts + 1 frames.

    ``skipped`` (fire_id, frame) are numbered frames that cannot be used (``scenes.number_frames``): their steps hold zeros.
    """
    if skipped is not None:
        stack = W.usable_rows(stack, skipped)
    rows = windowed_vectors(
        stack, ts, interval, "drop", n=K.PRED_CHANNELS, leakage=leakage, block=block, usable="usable" if skipped is not None else None)
    return rows.select(*W.PIXEL, "window_idx", "start_idx", "step", "x")


def growth_labels(
    stack: DataFrame, ts: int, interval: int, *, label_sel: Column | None = None, dense: bool = True, skipped: DataFrame | None = None,
) -> DataFrame:
    """Next-day growth targets of the same windows. Without a selector only active fire counts, as in training."""
    return W.growth_target(
        stack, F.col("af") > 0, C.clean(F.col("perimeter")) > 0, ts, interval, label_sel=label_sel, dense=dense, skipped=skipped
    )


def mapping_samples(
    stack: DataFrame, task: str, ts: int, interval: int, *, leakage: str = "reference", block: int = 256, skipped: DataFrame | None = None,
) -> DataFrame:
    """Active-fire or burned-area inputs (8 clean channels) and label planes per (pixel, window, step).

    Planes are (perimeter, active fire so far, active fire); a NaN perimeter is
    nodata, −1. Active fire keeps raw bands; burned area takes the carried maximum
    of heat bands. First hits join the stack once, before windows are cut, so
    "fire so far" is arithmetic on the row. Steps of ``skipped`` frames (fire_id, frame, n_frames) hold zeros throughout.
    """
    if task not in ("af", "ba"):
        raise ValueError(f"unknown task {task!r}")
    reach = W.union_reach(ts, interval, "clamp")
    clean = stack.withColumn("x", C.clean_vector(F.col("x"), K.CORE_CHANNELS))
    keep, usable, lost = ["perimeter", "af", "__first"], None, None
    if skipped is not None:
        clean, usable = W.usable_rows(clean, skipped), "usable"
        burning = F.col("usable") & (F.col("af") != 0)
        hits, lost = W.split_hits(clean, burning, skipped, ts, interval, "clamp", W.PIXEL, ["fire_id"])
        keep = [*keep, "__enters", "usable"]
    else:
        hits = W.first_hits(clean, {"__first": F.col("af") != 0})
    known = clean.join(hits, list(W.PIXEL), "left")
    if task == "af":
        rows = W.cut_windows(known, ts, interval, "clamp").where(F.col("step") < ts)
    else:
        rows = windowed_vectors(
            known, ts, interval, "clamp", n=K.CORE_CHANNELS, leakage=leakage, block=block, keep=keep, usable=usable)
    perimeter = F.when(F.isnan("perimeter"), F.lit(-1.0)).otherwise(C.clean(F.col("perimeter")))
    so_far, x = F.coalesce(F.col("__first") <= reach, F.lit(False)), F.col("x").cast("array<float>")
    if lost is not None:
        rows = rows.join(lost, [*W.PIXEL, "window_idx"], "left")
        so_far = so_far | F.coalesce(F.col("__enters") <= F.col("window_idx"), F.lit(False)) | F.coalesce(
            F.col("__lost") <= F.col("step"), F.lit(False))
        x = F.when(F.col("usable"), x).otherwise(_zeros(K.CORE_CHANNELS))
    planes = F.array(*[c.cast("float") for c in (perimeter, so_far.cast("int"), F.col("af"))])
    if lost is not None:
        planes = F.when(F.col("usable"), planes).otherwise(_zeros(3))
    return rows.select(*W.PIXEL, "window_idx", "start_idx", "step", x.alias("x"), planes.alias("y"))


def goes_daily_samples(day_scenes: DataFrame, daily: DataFrame, ts: int, interval: int) -> DataFrame:
    """Daily GOES features of every window step. ``daily`` is aggregated once, before windows repeat its days."""
    steps = W.cut_windows(frame_index(day_scenes), ts, interval, "drop").where(F.col("step") < ts)
    keyed = steps.select("fire_id", "window_idx", "start_idx", "step", F.to_date("ts").alias("day"))
    return align.attach_daily(keyed, daily)


def goes_bin_samples(day_scenes: DataFrame, bins: DataFrame, ts: int, interval: int, minutes: int = 15) -> DataFrame:
    """Sub-daily GOES matrix of every window step, as an ordered array of bins.

    Each observed day's matrix is built once; windows then point at it by day. A
    step whose scene has no readable time keeps its place with zeros.
    """
    steps = W.cut_windows(frame_index(day_scenes), ts, interval, "drop").where(F.col("step") < ts)
    keyed = steps.select("fire_id", "window_idx", "start_idx", "step", F.to_date("ts").alias("day"))
    days = day_scenes.select("fire_id", F.to_date("ts").alias("day")).distinct()
    joined = keyed.join(align.day_matrix(align.dense_bins(days, bins, minutes)), ["fire_id", "day"], "left")
    blank = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), len(K.SUBDAILY_FEATURES)), 1440 // minutes)
    return joined.withColumn("bins", F.coalesce("bins", blank))


def active_fire_test(
    scenes: DataFrame, day: DataFrame, night: DataFrame, thresholds: DataFrame, ts: int, interval: int, *,
    size: int = K.TILE, block: int = K.BLOCK_FRAMES,
) -> DataFrame:
    """Test samples of active fire: fire_id, block, window_idx, start_idx, step, row, col, x (8 clean channels), af.

    ``scenes`` is the day manifest with the columns of ``scenes.is_usable``; its frames are numbered as they are and
    dealt into blocks of ``block``. The crop is centred on each scene. Labels come from the fire's heat thresholds at the
    frame's place in its block. A scene that the test cannot use keeps its place with zeros, and so do the places that a
    fire's last block lacks: the last frame's rows emit them. Windows lie inside blocks. There is no grid and no
    list of windows; after the joins by scene and pixel nothing is shuffled.
    """
    if ts > block:
        raise ValueError(f"ts {ts} exceeds the block size {block}")
    kept = [*SCENE_KEYS, "frame", "n_frames", "usable", "height", "width"]
    frames = number_frames(scenes, "af_test", skipped="reference").select(*kept)
    rows = crop(day.join(frames, list(SCENE_KEYS)), offset=None, size=size)
    shifted = crop(night.join(frames.where("usable").select(*SCENE_KEYS, "height", "width"), list(SCENE_KEYS)), offset=None, size=size)
    rows = rows.join(shifted.select(*PIXEL_KEYS, F.col("bands").alias("__night")), list(PIXEL_KEYS), "left")
    x = C.elements(C.stack_day_night(F.col("bands"), F.col("__night")), K.CORE_CHANNELS)
    heat = {"i4_day": x[3], "i5_day": x[4], "i4_night": x[6], "i5_night": x[7]}
    placed = W.fixed_blocks(rows, block).select(
        "fire_id", "frame", "n_frames", "block", "pos", "row", "col", "usable",
        F.array(*[C.clean(v.cast("double")).cast("float") for v in x]).alias("x"), *[v.cast("double").alias(n) for n, v in heat.items()])
    labelled = W.threshold_label(placed, thresholds, "pos")
    blank = {"x": _zeros(K.CORE_CHANNELS), "af": F.lit(0)}
    labelled = labelled.withColumns({c: F.when(F.col("usable"), F.col(c)).otherwise(v) for c, v in blank.items()})
    padded = W.pad_blocks(labelled, ["fire_id", "row", "col"], list(blank), block, blank=blank)
    return W.block_windows(padded, ts, interval, block).select(
        "fire_id", "block", "window_idx", "start_idx", "step", "row", "col", "x", "af")


def paired_growth_samples(images: DataFrame, goes: DataFrame, labels: DataFrame | None = None, *, channels: int = K.PRED_CHANNELS) -> DataFrame:
    """Image and GOES side of each step in one row: images' columns with clean ``x``, squashed ``bins`` and, if given, ``growth``.

    ``images`` are ``growth_samples``, ``goes`` are ``goes_bin_samples`` of the same windows, ``labels`` are ``growth_labels``.
    Both sides meet by (fire, window, step), whatever order they were made in. The check that neither side
    lacks a step is part of the same plan: a row without its counterpart raises when it is read, and so does a
    pixel's window without a label.
    """
    keys = ["fire_id", "window_idx", "step"]
    steps = goes.select(*keys, F.col("bins").alias("__bins"), F.lit(True).alias("__goes"))
    both = images.withColumn("__image", F.lit(True)).join(steps, keys, "full_outer")
    place = F.concat_ws(" ", F.col("fire_id"), F.lit("window"), F.col("window_idx").cast("string"), F.lit("step"), F.col("step").cast("string"))

    def missing(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"no {what} for fire "), place)).cast("boolean")

    checked = F.when(F.col("__image").isNull(), missing("image")).when(F.col("__goes").isNull(), missing("GOES bins")).otherwise(True)
    squashed = F.transform("__bins", lambda b: F.transform(b, lambda v: C.squash(v.cast("double")).cast("float")))
    clean = F.array(*[v.cast("float") for v in C.elements(C.clean_vector(F.col("x"), channels), channels)])
    out = both.where(checked).select(*[c for c in images.columns if c != "x"], clean.alias("x"), squashed.alias("bins"))
    if labels is None:
        return out
    targets = labels.select(*W.PIXEL, "window_idx", F.col("growth").alias("__growth"))
    labelled = out.join(targets, [*W.PIXEL, "window_idx"], "left")
    return labelled.withColumn("growth", F.coalesce("__growth", F.when(F.lit(True), missing("label")).cast("int"))).drop("__growth")
