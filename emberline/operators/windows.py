"""Sliding windows over frames and the state carried through them.

Rows carry ``frame`` (0-based) and ``n_frames`` of their fire. A frame knows by
arithmetic alone which windows hold it, so cutting windows is a bounded explode:
no join against a list of starts and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.channels import above
from .ordered import Scan, block_segment, segmented_scan

PIXEL = ("fire_id", "row", "col")


def _check(ts: int, interval: int, tail: str) -> None:
    if ts < 1 or interval < 1:
        raise ValueError("ts and interval must be at least 1")
    if tail not in ("drop", "clamp"):
        raise ValueError(f"tail must be 'drop' or 'clamp', got {tail!r}")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("int")


def _seq(low: Column, high: Column) -> Column:
    """low..high, empty when low > high."""
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def window_start(window: Column, n: Column, ts: int, interval: int, tail: str) -> Column:
    """First frame of a window; clamped windows start at ``n − ts``."""
    start = window * interval
    if tail == "drop":
        return start
    return F.when(start + ts < n, start).otherwise(n - ts)


def windows_of_frame(frame: Column, n: Column, ts: int, interval: int, tail: str, length: int, distinct: bool) -> Column:
    """Indexes of the windows holding ``frame``: at most about ``length / interval`` plus the clamped ones."""
    low = F.greatest(_ceil_div(frame - (length - 1), interval), F.lit(0))
    if tail == "drop":
        return _seq(low, F.least(_div(frame, interval), _div(n - ts - 1, interval)))
    first_clamped = F.greatest(_ceil_div(n - ts, interval), F.lit(0))
    open_part = _seq(low, F.least(_div(frame, interval), first_clamped - 1))
    last = F.least(first_clamped, _ceil_div(n, interval) - 1) if distinct else _ceil_div(n, interval) - 1
    clamped = F.when(frame >= n - ts, _seq(first_clamped, last)).otherwise(F.array().cast("array<int>"))
    return F.when(n >= ts, F.concat(open_part, clamped)).otherwise(F.array().cast("array<int>"))


def cut_windows(
    frames: DataFrame, ts: int, interval: int, tail: str = "drop", *, length: int | None = None, distinct: bool = False,
) -> DataFrame:
    """One row per (row, window holding it): window_idx, start_idx and step.

    drop   windows start at 0, it, 2·it … while start + ts < n, and read ts + 1
           frames (the last one is the target)
    clamp  every start below n; those that would run over the end start at
           n − ts and repeat. ``distinct`` keeps one of the repeats. Fires with
           fewer than ts frames give no window.
    """
    _check(ts, interval, tail)
    size = length if length is not None else (ts + 1 if tail == "drop" else ts)
    members = windows_of_frame(F.col("frame"), F.col("n_frames"), ts, interval, tail, size, distinct)
    start = window_start(F.col("window_idx"), F.col("n_frames"), ts, interval, tail)
    return (
        frames.withColumn("window_idx", F.explode(members))
        .withColumn("start_idx", start.cast("int"))
        .withColumn("step", (F.col("frame") - F.col("start_idx")).cast("int"))
    )


def usable_rows(pixels: DataFrame, skipped: DataFrame, *, fire: Sequence[str] = ("fire_id",), name: str = "usable") -> DataFrame:
    """Mark rows of skipped frames. ``skipped`` (fire keys, frame) is a part of the scene manifest: scenes, not pixels."""
    broken = skipped.select(*fire, "frame", F.lit(False).alias("__usable"))
    return pixels.join(broken, [*fire, "frame"], "left").withColumn(name, F.coalesce("__usable", F.lit(True))).drop("__usable")


def _previous_start(ts: int, interval: int, tail: str) -> Column:
    return window_start(F.col("window_idx") - 1, F.col("n_frames"), ts, interval, tail)


def state_edge(ts: int, interval: int, tail: str, length: int) -> Column:
    """Last frame passed by earlier windows, relative to this window's start; −1 for the first window."""
    edge = F.when(F.col("window_idx") > 0, _previous_start(ts, interval, tail) - F.col("start_idx") + length - 1)
    return F.coalesce(edge, F.lit(-1)).cast("int")


def _with_ahead(
    rows: DataFrame, values: Sequence[str], keep: Sequence[str], keys: Sequence[str], block: int, reach: int,
) -> DataFrame:
    """Add ``__ahead``: frame and values of the pixel's rows in the next ``reach`` frames, at most that many.

    Rows are dealt by blocks of frames; each block lends its first ``reach``
    frames to the block before, so no pixel is ordered as a whole.
    """
    own = F.coalesce(block_segment("frame", block).cast("long"), F.lit(0).cast("long"))
    lent = (F.col("frame") % block < reach) & (own > 0)
    dealt = rows.withColumn("__seg", F.explode(F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))))
    mine = F.col("__seg") == own
    dealt = dealt.select(
        *keys, "frame", "n_frames", "__seg", mine.alias("__mine"), *[F.when(mine, F.col(c)).alias(c) for c in keep], *values)
    near = Window.partitionBy(*keys, "__seg").orderBy("frame").rangeBetween(1, reach)
    return dealt.withColumn("__ahead", F.collect_list(F.struct("frame", *values)).over(near)).where("__mine").drop("__mine")


def carried_rows(
    pixels: DataFrame, values: dict[str, Column], ts: int, interval: int, tail: str = "drop", *,
    leakage: str = "reference", keys: Sequence[str] = PIXEL, block: int = 256, keep: Sequence[str] = (),
    usable: str | None = None, **kw,
) -> DataFrame:
    """Rows cut into windows with each value's running per-pixel maximum (from 0) as the window sees it.

    The state is never reset between windows. In ``reference`` mode a step also
    sees frames that earlier, overlapping windows already passed, so early steps
    look ahead; ``causal`` mode stops at the step's own frame. The frames looked
    ahead at are fewer than a window has, so every row carries them along and
    picks by arithmetic: a step needs its own row only, and nothing is grouped
    or joined after windows are cut. Where the boolean column ``usable`` is given and
    false, a row adds nothing to the state and its own values are 0.
    """
    if leakage not in ("reference", "causal"):
        raise ValueError(f"leakage must be 'reference' or 'causal', got {leakage!r}")
    _check(ts, interval, tail)
    length = ts + 1 if tail == "drop" else ts
    block, reach = max(block, length), length - 1
    members = windows_of_frame(F.col("frame"), F.col("n_frames"), ts, interval, tail, length, False)
    # Only an interval longer than the window leaves frames that no window passes.
    seen = F.size(members) > 0 if interval > length else F.lit(True)
    if usable:
        seen, keep = seen & F.col(usable), [*keep, *([] if usable in keep else [usable])]
    rows = pixels.select(
        *keys, "frame", "n_frames", *keep, *[F.when(seen, v.cast("double")).alias(name) for name, v in values.items()])
    ahead = leakage == "reference" and reach > 0
    if ahead:
        rows = _with_ahead(rows, list(values), keep, keys, block, reach)
    segment = F.col("__seg") if ahead else block_segment("frame", block)
    peaks = segmented_scan(rows, list(keys), segment, ["frame"], {v: Scan("max", F.col(v)) for v in values}, **kw)
    start = window_start(F.col("window_idx"), F.col("n_frames"), ts, interval, tail)
    cut = (
        peaks.withColumn("window_idx", F.explode(members))
        .withColumn("start_idx", start.cast("int"))
        .withColumn("step", (F.col("frame") - F.col("start_idx")).cast("int"))
        .where(F.col("step") < ts)
    )
    tops = {v: [F.col(v)] for v in values}
    if ahead:
        edge = F.col("start_idx") + state_edge(ts, interval, tail, length)
        cut = cut.withColumn("__edge", edge).withColumn(
            "__ahead", F.filter("__ahead", lambda a: a["frame"] <= F.col("__edge")))
        for v in values:
            tops[v].append(F.array_max(F.col("__ahead").getField(v)))
    peak = {v: F.greatest(*[F.coalesce(t, F.lit(0.0)) for t in top], F.lit(0.0)) for v, top in tops.items()}
    if usable:
        peak = {v: F.when(F.col(usable), p).otherwise(F.lit(0.0)) for v, p in peak.items()}
    return cut.select(
        *keys, "frame", "n_frames", "window_idx", "start_idx", "step", *keep, *[p.alias(v) for v, p in peak.items()])


def carried_max(
    pixels: DataFrame, values: Sequence[str], ts: int, interval: int, tail: str = "drop", *,
    keys: Sequence[str] = PIXEL, keep: Sequence[str] = (), **kw,
) -> DataFrame:
    """``carried_rows`` of columns of ``pixels``: a row for each (pixel, window, step) that the pixel has a row for."""
    rows = carried_rows(pixels, {v: F.col(v) for v in values}, ts, interval, tail, keys=keys, keep=keep, **kw)
    return rows.select(*keys, "window_idx", "start_idx", "step", *keep, *values)


def first_hits(pixels: DataFrame, labels: dict[str, Column], keys: Sequence[str] = PIXEL) -> DataFrame:
    """First frame at which each label holds, per pixel.

    A union that only grows is known from its first frame. Labels are sparse, so
    unlabelled rows go before the shuffle and the rest collapse map-side.
    """
    hit = F.lit(False)
    for label in labels.values():
        hit = hit | F.coalesce(label, F.lit(False))
    return pixels.where(hit).groupBy(*keys).agg(
        *[F.min(F.when(label, F.col("frame"))).alias(name) for name, label in labels.items()]
    )


def union_reach(ts: int, interval: int, tail: str) -> Column:
    """Last frame that a step's union holds, on rows that ``cut_windows`` made."""
    length = ts + 1 if tail == "drop" else ts
    if interval > length:
        raise ValueError(f"interval {interval} exceeds the window length {length}: no state would be carried")
    base = F.when(F.col("window_idx") > 0, _previous_start(ts, interval, tail) + interval - 1)
    return F.greatest(F.col("frame"), F.coalesce(base, F.lit(-1)))


def _broken_bases(skipped: DataFrame, ts: int, interval: int, tail: str, fire: Sequence[str]) -> DataFrame:
    """Windows whose union is not handed on, because the frame that closes their first ``interval`` steps was skipped.

    One row (fire keys, window) a skipped frame at such a place; ``skipped`` needs n_frames too.
    """
    f, n = F.col("frame"), F.col("n_frames")
    window = _div(f + 1, interval) - 1
    closes = F.pmod(f + 1, F.lit(interval)) == 0
    if tail == "drop":
        return skipped.where(closes).select(*fire, window.alias("__window"))
    plain = skipped.where(closes & (window * interval + ts < n)).select(*fire, window.alias("__window"))
    clamped = skipped.where((n >= ts) & (f == n - ts + interval - 1)).select(*fire, _first_clamped(n, ts, interval).alias("__window"))
    return plain.union(clamped).distinct()


def _first_clamped(n: Column, ts: int, interval: int) -> Column:
    return F.greatest(_ceil_div(n - ts, interval), F.lit(0))


def split_hits(
    hits: DataFrame, label: Column, skipped: DataFrame, ts: int, interval: int, tail: str, keys: Sequence[str], fire: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """What windows still know of a pixel's labelled frames when some frames were skipped.

    A window hands its union on after ``interval`` steps. If the frame there was skipped, the next
    window starts from an older union and the frames in between are *lost*: seen by windows that hold them, and not
    by later ones. Lost frames are few (an interval a skipped frame), so they alone are cut into windows.

    Returns two tables over ``hits`` (rows with keys, frame, n_frames): ``__first`` (first frame that is not lost) and
    ``__enters`` (first window that knows a lost frame after all, by a clamped window) per pixel, and
    ``__lost`` (first step at which a lost frame is seen) per pixel and window.
    """
    broken = _broken_bases(skipped, ts, interval, tail, fire).withColumn("__gone", F.lit(True))
    n, f = F.col("n_frames"), F.col("frame")
    rows = hits.where(F.coalesce(label, F.lit(False))).select(*keys, "frame", "n_frames")
    rows = rows.withColumn("__window", _div(f, interval)).join(broken, [*fire, "__window"], "left")
    own, gone = F.col("__window") + 1, F.coalesce(F.col("__gone"), F.lit(False))
    if tail == "drop":
        due, enters = own, F.when(~gone, own)
    else:
        rows = rows.withColumnRenamed("__gone", "__gone_own").withColumnRenamed("__window", "__own")
        rows = rows.withColumn("__window", _first_clamped(n, ts, interval)).join(broken, [*fire, "__window"], "left")
        open_ = F.col("__own") * interval + ts < n
        clamped = (n >= ts) & f.between(n - ts, n - ts + interval - 1)
        own, later = F.col("__own") + 1, F.col("__window") + 1
        due = F.least(F.when(open_, own), F.when(clamped, later))
        enters = F.least(F.when(open_ & F.col("__gone_own").isNull(), own), F.when(clamped & F.col("__gone").isNull(), later))
    rows = rows.select(*keys, "frame", "n_frames", (~due.eqNullSafe(enters)).alias("__is_lost"), enters.alias("__enters"))
    pixel = rows.groupBy(*keys).agg(
        F.min(F.when(~F.col("__is_lost"), f)).alias("__first"), F.min(F.when(F.col("__is_lost"), F.col("__enters"))).alias("__enters"))
    lost = cut_windows(rows.where("__is_lost"), ts, interval, tail).groupBy(*keys, "window_idx").agg(F.min("step").alias("__lost"))
    return pixel, lost


def carried_union(
    pixels: DataFrame, labels: dict[str, Column], ts: int, interval: int, tail: str = "drop", *,
    keys: Sequence[str] = PIXEL, skipped: DataFrame | None = None, fire: Sequence[str] = ("fire_id",),
) -> DataFrame:
    """Running union of labels as each window sees it, 0/1 per (pixel, window, step).

    The union restarts from its state after ``interval`` steps of the previous
    window, so with dropped tails a step sees exactly the frames up to its own;
    a clamped window may see as far as the previous window's base. ``skipped``
    (fire keys, frame, n_frames) lists frames that add nothing and whose own steps are 0; see ``split_hits``.
    """
    _check(ts, interval, tail)
    reach = union_reach(ts, interval, tail)
    if skipped is not None:
        rows = usable_rows(pixels, skipped, fire=fire, name="__usable_row")
        for name, label in labels.items():
            rows = rows.withColumn(f"__label_{name}", F.col("__usable_row") & F.coalesce(label, F.lit(False)))
        cut = rows.select(*keys, "frame", "n_frames", "__usable_row")
        parts = {n: split_hits(rows, F.col(f"__label_{n}"), skipped, ts, interval, tail, keys, fire) for n in labels}
        for name, (pixel, _) in parts.items():
            cut = cut.join(pixel.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in ("__first", "__enters")]), list(keys), "left")
        cut = cut_windows(cut, ts, interval, tail).where(F.col("step") < ts)
        for name, (_, lost) in parts.items():
            cut = cut.join(lost.withColumnRenamed("__lost", f"__lost_{name}"), [*keys, "window_idx"], "left")

        def holds(name: str) -> Column:
            late = F.coalesce(F.col(f"__enters_{name}") <= F.col("window_idx"), F.lit(False))
            seen = F.coalesce(F.col(f"__lost_{name}") <= F.col("step"), F.lit(False))
            return F.col("__usable_row") & (F.coalesce(F.col(f"__first_{name}") <= reach, F.lit(False)) | late | seen)

        return cut.select(*keys, "window_idx", "start_idx", "step", *[holds(n).cast("int").alias(n) for n in labels])
    hits = first_hits(pixels, {f"__first_{n}": c for n, c in labels.items()}, keys)
    # Hits join before windows are cut: what is cut afterwards is not shuffled again.
    rows = cut_windows(pixels.join(hits, list(keys), "left"), ts, interval, tail).where(F.col("step") < ts)
    return rows.select(
        *keys, "window_idx", "start_idx", "step",
        *[F.coalesce(F.col(f"__first_{n}") <= reach, F.lit(False)).cast("int").alias(n) for n in labels],
    )


def growth_target(
    pixels: DataFrame, fire: Column, perimeter: Column, ts: int, interval: int, *,
    label_sel: Column | None = None, keys: Sequence[str] = PIXEL, dense: bool = True, skipped: DataFrame | None = None,
    fire_keys: Sequence[str] = ("fire_id",),
) -> DataFrame:
    """Pixels burned on a window's target day and not before: 0/1 per (pixel, window).

    The final label is the fire union, joined by the perimeter union unless the
    selector is 1. It grows for the first time at one frame only, so growth is
    ``first hit = target frame`` and the union itself is never built. With
    ``dense=False`` only the growth pixels come back, from one aggregation.

    With ``skipped`` (fire keys, frame, n_frames) a skipped target day has no growth, skipped frames
    burn nothing, and a pixel whose earlier fire was lost (see ``split_hits``) may grow again.
    """
    _check(ts, interval, "drop")
    if interval > ts + 1:
        raise ValueError("an interval above ts + 1 leaves frames between windows; growth is not defined there")
    fire = F.coalesce(fire, F.lit(False))
    wide = F.coalesce(label_sel, F.lit(0)) != 1 if label_sel is not None else F.lit(False)
    final = fire | (wide & F.coalesce(perimeter, F.lit(False)))
    start = F.col("frame") - ts
    window = _div(start, interval)
    is_target = (start >= 0) & (F.pmod(start, F.lit(interval)) == 0)
    if skipped is not None:
        rows = usable_rows(pixels, skipped, fire=fire_keys, name="__usable_row")
        rows = rows.select(*keys, "frame", "n_frames", (F.col("__usable_row") & final).alias("__hit"))
        pixel, lost = split_hits(rows, F.col("__hit"), skipped, ts, interval, "drop", keys, fire_keys)
        targets = rows.where(is_target & (F.lit(dense) | F.col("__hit"))).withColumn("window_idx", window)
        known = targets.join(pixel, list(keys), "left").join(lost, [*keys, "window_idx"], "left")
        burnt = F.coalesce(F.col("__first") < F.col("frame"), F.lit(False)) | F.coalesce(F.col("__lost") < ts, F.lit(False))
        out = known.select(*keys, "window_idx", (F.col("__hit") & ~burnt).cast("int").alias("growth"))
        return out if dense else out.where("growth = 1")
    if not dense:
        first = first_hits(pixels, {"frame": final}, keys)
        return first.where(is_target).select(*keys, window.alias("window_idx"), F.lit(1).alias("growth"))
    hits = first_hits(pixels, {"__first": final}, keys)
    targets = pixels.where(is_target).select(*keys, "frame", window.alias("window_idx"))
    return targets.join(hits, list(keys), "left").select(
        *keys, "window_idx",
        F.coalesce(F.col("__first") == F.col("frame"), F.lit(False)).cast("int").alias("growth"),
    )


def cumulative_union(pixels: DataFrame, predicted: Column, keys: Sequence[str], name: str = "pred") -> DataFrame:
    """Predictions joined over frames: 1 from a pixel's first predicted frame on."""
    hits = first_hits(pixels, {"__first": predicted}, keys)
    return pixels.join(hits, list(keys), "left").withColumn(
        name, F.coalesce(F.col("__first") <= F.col("frame"), F.lit(False)).cast("int")
    ).drop("__first")


# --- fixed blocks -----------------------------------------------------------------

def fixed_blocks(frames: DataFrame, size: int = K.BLOCK_FRAMES) -> DataFrame:
    """Consecutive blocks of ``size`` frames: block and position inside it."""
    return frames.withColumns(
        {"block": _div(F.col("frame"), size), "pos": (F.col("frame") % size).cast("int")}
    )


def pad_blocks(
    blocked: DataFrame, keys: Sequence[str], values: Sequence[str], size: int = K.BLOCK_FRAMES, *, blank: dict[str, Column] | None = None,
) -> DataFrame:
    """Fill a ragged last block with zero rows; ``blank`` says what zero is for values that are not numbers.

    Only the last frame of each key can leave a gap, and it knows the gap's
    length, so it emits the padding itself: no grid, no join.
    """
    is_last = F.col("frame") == F.col("n_frames") - 1
    extra = F.when(is_last, _seq(F.col("pos"), F.lit(size - 1))).otherwise(F.array(F.col("pos")))
    out = blocked.withColumn("__pos", F.explode(extra))
    real = F.col("__pos") == F.col("pos")
    return out.select(
        *keys, "block", F.col("__pos").alias("pos"), real.cast("int").alias("is_real"),
        *[F.when(real, F.col(v)).otherwise((blank or {}).get(v, F.lit(0))).alias(v) for v in values],
    )


def block_windows(blocked: DataFrame, ts: int, interval: int, size: int = K.BLOCK_FRAMES) -> DataFrame:
    """Windows inside full blocks; a window is clamped only when it would cross the block's end."""
    if ts > size:
        raise ValueError(f"ts {ts} exceeds the block size {size}")
    _check(ts, interval, "clamp")
    # Crossing, not touching, the end clamps: the same rule as clamp tails with one frame more.
    members = windows_of_frame(F.col("pos"), F.lit(size + 1), ts, interval, "drop", ts, False)
    first_clamped = -(-(size - ts + 1) // interval)
    n_windows = -(-size // interval)
    clamped = F.array(*[F.lit(w) for w in range(first_clamped, n_windows)]).cast("array<int>")
    both = F.concat(members, F.when(F.col("pos") >= size - ts, clamped).otherwise(F.array().cast("array<int>")))
    start = F.least(F.col("window_idx") * interval, F.lit(size - ts))
    return (
        blocked.withColumn("window_idx", F.explode(both))
        .withColumn("start_idx", start.cast("int"))
        .withColumn("step", (F.col("pos") - F.col("start_idx")).cast("int"))
    )


def threshold_label(pixels: DataFrame, thresholds: DataFrame, frame: str = "frame") -> DataFrame:
    """Active-fire label of the test fires: day or night heat above the fire's threshold for that position.

    ``thresholds`` holds ten rows per named fire; it joins by key and Spark
    broadcasts it when its measured size allows. A fire without thresholds is an
    error when its rows are read; a NaN band is no fire.
    """
    t = thresholds.select(
        "fire_id", F.col("pos").alias("__pos"), "day_i4", "day_i5", "night_i4", "night_i5"
    )
    joined = pixels.withColumn("__pos", (F.col(frame) % K.BLOCK_FRAMES).cast("int")).join(
        t.withColumn("__known", F.lit(True)), ["fire_id", "__pos"], "left")
    unknown = F.raise_error(F.concat(F.lit("no thresholds for fire "), F.col("fire_id").cast("string"))).cast("int")
    hot = (
        above(F.col("i4_day"), F.col("day_i4")) | above(F.col("i5_day"), F.col("day_i5"))
        | above(F.col("i4_night"), F.col("night_i4")) | above(F.col("i5_night"), F.col("night_i5"))
    )
    label = F.when(F.col("__known"), F.coalesce(hot, F.lit(False)).cast("int")).otherwise(unknown)
    return joined.withColumn("af", label).drop(
        "__pos", "__known", "day_i4", "day_i5", "night_i4", "night_i5"
    )


def pixel_sequences(samples: DataFrame, value: str = "x", keys: Sequence[str] = (*PIXEL, "window_idx")) -> DataFrame:
    """Each pixel's steps as one ordered array (a window's length bounds it)."""
    ordered = F.array_sort(F.collect_list(F.struct("step", F.col(value).alias("v"))))
    return samples.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("seq"))
