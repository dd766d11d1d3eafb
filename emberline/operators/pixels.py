"""Raster operators on pixel rows and tile arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as C


def explode_tile(tiles: DataFrame, values: str, width: int, *, name: str = "v") -> DataFrame:
    """One row per pixel of a row-major single-band tile."""
    cols = [c for c in tiles.columns if c != values]
    return tiles.select(*cols, F.posexplode(values).alias("__pos", name)).select(
        *cols, F.floor(F.col("__pos") / width).cast("int").alias("row"),
        (F.col("__pos") % width).cast("int").alias("col"), name,
    )


def framewise(samples: DataFrame) -> DataFrame:
    """Windows as independent frames: the sample key becomes (window, step)."""
    return samples.withColumn("sample_id", F.concat_ws("_", "fire_id", "window_idx", "step"))


def standardise_scene(pixels: DataFrame, value: str, keys: Sequence[str], out: str | None = None) -> DataFrame:
    """(x − mean) / population deviation per scene and band; NaN takes the band mean, a constant band gives 0.

    Scene statistics are partial aggregates joined back by key, so one large
    scene is never gathered in a window.
    """
    raw = F.col(value).cast("double")
    v = F.nanvl(raw, F.lit(None).cast("double"))
    missing = F.count_if(raw.isNull() | F.isnan(raw))
    stats = pixels.groupBy(*keys).agg(
        F.avg(v).alias("__mean"), F.var_pop(v).alias("__var"), F.count(F.lit(1)).alias("__n"), missing.alias("__nan")
    )
    # Filling NaN with the mean keeps the mean and shrinks the variance by the share of real values.
    std = F.sqrt(F.col("__var") * (F.col("__n") - F.col("__nan")) / F.col("__n"))
    scaled = F.when(std > 0, (v - F.col("__mean")) / std)
    return pixels.join(stats, list(keys)).withColumn(out or value, F.coalesce(scaled, F.lit(0.0))).drop(
        "__mean", "__var", "__n", "__nan"
    )


def minmax_scene(pixels: DataFrame, value: str, keys: Sequence[str], out: str | None = None, *,
                 constant: str = "zero") -> DataFrame:
    """(x − min) / (max − min) per scene and band, NaN ignored and set to 0.

    A constant band gives 0, or stays as it is with ``constant="keep"``.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    stats = pixels.groupBy(*keys).agg(F.min(v).alias("__min"), F.max(v).alias("__max"))
    span = F.col("__max") - F.col("__min")
    flat = v if constant == "keep" else F.lit(0.0)
    scaled = F.when(span > 0, (v - F.col("__min")) / span).otherwise(flat)
    return pixels.join(stats, list(keys)).withColumn(out or value, F.coalesce(scaled, F.lit(0.0))).drop("__min", "__max")


def zero_pad(fine: DataFrame, keys: Sequence[str], coarse_rows: int, coarse_cols: int, value: str = "v") -> DataFrame:
    """Grow each raster with zeros to twice the coarse raster's size.

    The grid comes from one row a raster, so cells that a sparse raster lacks are
    filled too. The raster's own size is that of its largest row and column.
    """
    size = fine.groupBy(*keys).agg((F.max("row") + 1).alias("__h"), (F.max("col") + 1).alias("__w"))

    def cells(own: str, coarse: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.greatest(F.col(own), F.lit(2 * coarse)).cast("int") - 1))

    grid = size.withColumn("row", cells("__h", coarse_rows)).withColumn("col", cells("__w", coarse_cols)).drop("__h", "__w")
    own = fine.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                      F.struct(F.col(value).cast("double").alias("v")).alias("__own"))
    joined = grid.join(own, [*keys, "row", "col"], "left")
    return joined.select(
        *keys, "row", "col", F.when(F.col("__own").isNotNull(), F.col("__own")["v"]).otherwise(F.lit(0.0)).alias(value)
    )


def block_mean(pixels: DataFrame, keys: Sequence[str], k: int, value: str = "v") -> DataFrame:
    return pixels.groupBy(
        *keys, F.floor(F.col("row") / k).cast("int").alias("row"), F.floor(F.col("col") / k).cast("int").alias("col")
    ).agg(F.avg(value).alias(value))


def mosaic_max(pixels: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Maximum of all rasters overlapping on a common grid."""
    return pixels.groupBy(*keys).agg(F.max(value).alias(value))


def channel_stats(vectors: DataFrame, x: str, n: int) -> DataFrame:
    """NaN-aware mean and population deviation of each channel.

    All channels are aggregated side by side in one pass and turned into rows at
    the end: the vectors are never exploded.
    """
    vals = [F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in C.elements(F.col(x), n)]
    stats = F.array(
        *[F.struct(F.lit(i).alias("channel"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
          for i, v in enumerate(vals)]
    )
    return vectors.agg(stats.alias("s")).select(F.inline("s"))


def mean_over_time(scores: DataFrame, keys: Sequence[str], logit: str = "logit", threshold: float = 0.5) -> DataFrame:
    """Logits averaged over the time axis, then sigmoid, then thresholded."""
    return scores.groupBy(*keys).agg(F.avg(logit).alias(logit)).withColumn("prob", C.sigmoid(F.col(logit))).withColumn(
        "pred", C.at_least(F.col("prob"), threshold).cast("int")
    )


def ignore_unlabelled(pixels: DataFrame, label: str = "label") -> DataFrame:
    """Drop pixels labelled −1."""
    return pixels.where(F.col(label) != -1)


def blank_unlabelled(pixels: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Keep pixels labelled −1 but count them as background on both sides."""
    off = F.col(label) == -1
    return pixels.withColumns(
        {pred: F.when(off, F.lit(0)).otherwise(F.col(pred)), label: F.when(off, F.lit(0)).otherwise(F.col(label))}
    )


_WHOLE = float("inf")
_FINEST = 2.0**-61
_LIMIT = 2.0**53
_BLOCK = 8
_TILE = 2048
_AXES = ("d", "x", "y")


def _size(width: Column, finest: float) -> Column:
    """Largest power of two below ``width``, ``finest`` at least; beyond 2^60 one cell holds everything."""
    power = F.when(width <= 2 * finest, F.lit(finest)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(width)) - 1))
    return F.when(width > 2.0**60, F.lit(_WHOLE)).otherwise(power)


def _cell(value: Column, size: Column) -> Column:
    """Number of the cell as a double. From 2^53 on a quotient is whole and its own cell, where a long would end at 2^63."""
    q = value / size
    small = (q == 0) & (value < 0)  # too small for a double
    return F.when(size == _WHOLE, F.lit(0.0)).when(small, F.lit(-1.0)).when(F.abs(q) < _LIMIT, F.floor(q).cast("double")).otherwise(q)


def _code(d: Column, x: Column, y: Column) -> Column:
    """A cell modulo 8 an axis: told apart are cells of a block, and cells of a box."""
    d, x, y = (F.pmod(F.floor(c), F.lit(_BLOCK)).cast("int") for c in (d, x, y))
    return (d * _BLOCK + x) * _BLOCK + y


def _exponent(size: Column) -> Column:
    """From 0 to 127; no size but that of the whole has 127."""
    return F.when(size == _WHOLE, F.lit(127)).otherwise((F.rint(F.log2(size)) + 61).cast("int"))


def _exponents(kind: str) -> Column:
    """Those of cells (``kind`` s) or blocks (w) on all axes as one number, the level."""
    d, x, y = (_exponent(F.col(f"__{kind}{a}")) for a in _AXES)
    return (d * 128 + x) * 128 + y


def _block(size: Column) -> Column:
    """Cells of a block on an axis: 8 or 4, so that blocks are as wide as every other power of two."""
    return F.when(size == _WHOLE, F.lit(1.0)).when(_exponent(size) % 2 == 1, F.lit(float(_BLOCK))).otherwise(F.lit(_BLOCK / 2.0))


def _home(level: Column) -> Column:
    """Where a block is dealt to. Blocks of one width may share it, others cannot."""
    mask = 128**3 - 1
    return F.xxhash64(*(f"__h{a}" for a in _AXES)).bitwiseAND(F.lit(~mask)).bitwiseOR(level.cast("long"))


def size_cells(fires: DataFrame, x_bounds: tuple[str, str] = ("x_min", "x_max"), y_bounds: tuple[str, str] = ("y_min", "y_max")) -> DataFrame:
    """Boxes that can hold a pixel, with the cell size of each axis (``__sd``, ``__sx``, ``__sy``) and their first and last cells."""
    axes = {"d": (F.unix_date("start_date").cast("double"), F.unix_date("end_date").cast("double")),
            "x": tuple(F.col(c).cast("double") for c in x_bounds), "y": tuple(F.col(c).cast("double") for c in y_bounds)}
    sound = F.lit(True)
    for low, high in axes.values():
        sound = sound & (low <= high) & ~F.isnan(low) & ~F.isnan(high)
    boxes = fires.where(sound).select(
        "fire_id", F.col("start_date").alias("__from"), F.col("end_date").alias("__to"),
        *[c.alias(f"__{a}_{end}") for a, pair in axes.items() for end, c in zip(("low", "high"), pair)],
        *[_size(high - low, 1.0 if a == "d" else _FINEST).alias(f"__s{a}") for a, (low, high) in axes.items()])
    return boxes.withColumns({f"__{end}{a}": _cell(F.col(f"__{a}_{to}"), F.col(f"__s{a}")) for a in axes for end, to in (("a", "low"), ("b", "high"))})


def list_cells(boxes: DataFrame) -> DataFrame:
    """Each box of ``size_cells`` once a cell that it touches, the cell in ``__cd``, ``__cx``, ``__cy``."""
    for a in _AXES:
        low, high, i = F.col(f"__a{a}"), F.col(f"__b{a}"), F.col("__i")
        # From 2^53 on, nothing lies between two cells that are neighbours.
        whole = F.least(F.abs(low), F.abs(high)) < _LIMIT
        more = F.when(high <= low, F.lit(0)).when(whole, (high - low).cast("int")).otherwise(F.lit(1))
        boxes = boxes.withColumn("__n", more).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
        boxes = boxes.withColumn(f"__c{a}", F.when(i == F.col("__n"), high).otherwise(low + i)).drop("__n", "__i", f"__a{a}", f"__b{a}")
    return boxes


def tile_boxes(boxes: DataFrame, rows: int) -> DataFrame:
    """Boxes of ``size_cells`` in tiles: ``rows`` at most of one block and size, as arrays.

    The cells that they touch are in ``__codes``; the boxes of the n-th have their places from ``__starts[n]`` on in ``__places``.
    """
    sizes = [f"__s{a}" for a in _AXES]
    boxes = boxes.withColumn("__level", _exponents("s")).withColumns({f"__w{a}": F.col(f"__s{a}") * _block(F.col(f"__s{a}")) for a in _AXES})
    boxes = boxes.withColumns({f"__{end}{a}": _cell(F.col(f"__{a}_{to}"), F.col(f"__w{a}")) for a in _AXES for end, to in (("u", "low"), ("v", "high"))})
    for a in _AXES:  # a block is twice as wide as a box or wider
        low, high = F.col(f"__u{a}"), F.col(f"__v{a}")
        boxes = boxes.withColumn(f"__h{a}", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
    own = ["fire_id", "__from", "__to", *(f"__{a}_{end}" for a in "xy" for end in ("low", "high"))]
    boxes = boxes.select(_home(_exponents("w")).alias("__home"), "__level", *own, *sizes, *(f"__h{a}" for a in _AXES))
    # Only what tells the cells is dealt out; the cells follow from it again.
    place = F.row_number().over(Window.partitionBy("__home", "__level").orderBy("__from")) - 1
    boxes = boxes.withColumn("__place", place).withColumns({"__tile": F.floor(F.col("__place") / rows), "__at": F.col("__place") % rows})
    boxes = boxes.withColumns({"__d_low": F.unix_date("__from").cast("double"), "__d_high": F.unix_date("__to").cast("double")})
    for a in _AXES:
        size, reach = F.col(f"__s{a}"), _block(F.col(f"__s{a}"))
        low, high = (_cell(F.col(f"__{a}_{end}"), size) for end in ("low", "high"))
        first = F.col(f"__h{a}") * reach
        boxes = boxes.withColumns({f"__a{a}": F.greatest(low, first), f"__b{a}": F.least(high, first + reach - 1)}).withColumn(f"__z{a}", F.col(f"__a{a}"))
    first = F.lit(True)
    for a in _AXES:
        first = first & (F.col(f"__c{a}") == F.col(f"__z{a}"))
    listed = list_cells(boxes).withColumn("__entry", _code(*(F.col(f"__c{a}") for a in _AXES)) * rows + F.col("__at"))
    tiles = listed.groupBy("__home", "__level", "__tile").agg(
        F.sort_array(F.collect_list("__entry")).alias("__entries"), F.sort_array(F.collect_list(F.when(first, F.struct("__at", *own)))).alias("__boxes"),
        *[F.min(c).alias(c) for c in sizes])
    starts = F.expr(f"filter(sequence(0, size(__entries) - 1), i -> i = 0 OR get(__entries, i) div {rows} > get(__entries, i - 1) div {rows})")
    return tiles.withColumn("__starts", starts).select(
        "__home", *sizes, F.expr(f"transform(__starts, i -> CAST(get(__entries, i) div {rows} AS INT))").alias("__codes"),
        F.concat("__starts", F.array(F.size("__entries"))).alias("__starts"), F.expr(f"transform(__entries, e -> e % {rows})").alias("__places"),
        *[F.col("__boxes")[c].alias(f"__all_{c}") for c in own])


def clip_to_bounds(
    pixels: DataFrame, fires: DataFrame, *, x: str = "x", y: str = "y", day: str = "day",
    x_bounds: tuple[str, str] = ("x_min", "x_max"), y_bounds: tuple[str, str] = ("y_min", "y_max"),
) -> DataFrame:
    """Pixels inside each fire's bounds (inclusive) on the fire's days, with ``fire_id``.

    Boxes of any size and duration meet pixels on a grid of many levels. Days and either axis have cells of every power of
    two; a box takes the level at which a cell is at least half as wide as it is, so it touches three cells an axis at most (four
    where its width was rounded). Days are whole, so their cells end at one day; a box without extent is a cell of its own.
    Cells are not dealt out one by one, which would move a box ten times and a pixel once a level. Four or eight an axis
    make a block, at least twice as wide as the box, so a box is moved once or twice an axis and a pixel once for each size of blocks
    that some box uses; those are counted in one row, a few for boxes of like sizes. The boxes of a block become tiles of limited size
    with an index of their cells (``tile_boxes``), and a pixel looks its cell up in each tile of its block: most pairs that
    are looked at are matches, and only tiles are held in memory. The join is an equi-join on blocks, whose sides Spark can split
    where a block is hot. The cells of a box in a block differ in the index, so a pair is found once. Empty boxes never match.
    """
    boxes = size_cells(fires, x_bounds, y_bounds)
    wide = boxes.select(*[(F.col(f"__s{a}") * _block(F.col(f"__s{a}"))).alias(f"__w{a}") for a in _AXES])
    levels = wide.agg(F.collect_set(F.struct(_exponents("w").alias("__level"), *wide.columns)).alias("__levels"))
    at = {"d": F.unix_date(F.col(day)).cast("double"), "x": F.col(x).cast("double"), "y": F.col(y).cast("double")}
    found = pixels.where(at["d"].isNotNull() & at["x"].isNotNull() & at["y"].isNotNull() & ~F.isnan(at["x"]) & ~F.isnan(at["y"]))
    placed = found.join(F.broadcast(levels), F.lit(True)).select(*pixels.columns, F.inline("__levels"))
    placed = placed.withColumns({f"__h{a}": _cell(at[a], F.col(f"__w{a}")) for a in _AXES}).select(*pixels.columns, _home(F.col("__level")).alias("__home"))
    met = placed.join(tile_boxes(boxes, _TILE).hint("merge"), "__home")
    code = _code(*(_cell(at[a], F.col(f"__s{a}")) for a in _AXES))
    met = met.withColumn("__n", F.array_position("__codes", code).cast("int"))
    begin, end = F.get("__starts", F.col("__n") - 1), F.get("__starts", F.col("__n"))
    # An inner explode would cut the slice three times, twice to drop empty ones beforehand.
    met = met.withColumn("__at", F.explode_outer(F.when(F.col("__n") > 0, F.slice("__places", begin + 1, end - begin))))

    def of(name: str) -> Column:
        return F.get(F.col(f"__all_{name}"), F.col("__at"))

    inside = F.col(day).between(of("__from"), of("__to"))
    for a, value in (("x", x), ("y", y)):
        inside = inside & F.col(value).between(of(f"__{a}_low"), of(f"__{a}_high"))
    return met.where(inside).select(*pixels.columns, of("fire_id").alias("fire_id"))


def clipped_keys(
    pixels: DataFrame, fires: DataFrame, keys: Sequence[str], *, x_bounds: tuple[str, str] = ("x_min", "x_max"),
    y_bounds: tuple[str, str] = ("y_min", "y_max"), **columns: str,
) -> DataFrame:
    """The (fire, keys) pairs whose clip holds a pixel, without the clips.

    Fires that share days and bounds are clipped as one box, and the box's keys are made distinct before its fires get them.
    """
    bounds = ["start_date", "end_date", *x_bounds, *y_bounds]
    boxes = fires.select(*bounds).distinct().withColumn("fire_id", F.struct(*bounds))
    hits = clip_to_bounds(pixels, boxes, x_bounds=x_bounds, y_bounds=y_bounds, **columns)
    hits = hits.select("fire_id", *keys).distinct().select("fire_id.*", *keys)
    return fires.select("fire_id", *bounds).join(hits, bounds).select("fire_id", *keys)


def variable_ranges(clip: DataFrame, keys: Sequence[str] = (), variables: Sequence[str] = K.CLIP_VARIABLES) -> DataFrame:
    """Minimum and maximum of each clip variable, NaN ignored, as (variable, min, max) rows."""
    def real(v: str) -> Column:
        return F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))

    rows = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.min(real(v)).alias("min"), F.max(real(v)).alias("max"))
          for v in variables]
    )
    return clip.groupBy(*keys).agg(rows.alias("r")).select(*keys, F.inline("r"))
