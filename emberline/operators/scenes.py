"""Scene catalogue operators: choosing, pairing, ordering and summarising scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as C
from .ordered import SEGMENT_ROWS, neighbour, nth_value, row_index, scene_segments


def dedupe_scenes(scenes: DataFrame) -> DataFrame:
    """One row per (fire, source, timestamp, file name)."""
    return scenes.dropDuplicates(["fire_id", "source", "ts", "file_name"])


def frame_index(scenes: DataFrame, *, order: Sequence[str] = ("ts", "file_name"), keys: Sequence[str] = ("fire_id",),
                segment: Column | None = None, total: str | None = "n_frames", **kw) -> DataFrame:
    """0-based frame number of each scene within its fire, and the fire's frame count.

    Without a ``segment`` scenes are scanned by ``ordered.scene_segments`` of ``ts``, which ``order`` must start with.
    """
    if segment is not None:
        return row_index(scenes, list(keys), segment, list(order), "frame", total, **kw)
    cut = scene_segments(scenes, list(keys), rows=kw.pop("rows", SEGMENT_ROWS))
    return row_index(cut, list(keys), F.col("__stretch"), list(order), "frame", total, **kw).drop("__stretch")


def scene_gaps(scenes: DataFrame, *, rows: int = SEGMENT_ROWS, **kw) -> DataFrame:
    """Hours from each scene to the next of the same fire, to 3 decimals; NULL on the last."""
    out = neighbour(
        scene_segments(scenes, ["fire_id"], rows=rows), ["fire_id"], F.col("__stretch"), ["ts", "file_name"], {"next_ts": F.col("ts")},
        following=True, **kw,
    )
    return out.drop("__stretch").withColumn("gap_hours", F.round(hours_between(F.col("ts"), F.col("next_ts")), 3))


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours, exact to the microsecond. Zone-free stamps are subtracted as they are, whatever the session's zone."""
    gap = end - start

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), gap)

    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    micros = minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    return micros / 3.6e9


def is_usable(task: str = "pred") -> Column:
    """Whether a scene's night file is sound (or absent); the active-fire test also needs 8 day bands and equal shapes.

    Expects n_bands, height and width for the day file and night_bands,
    night_height and night_width (NULL when there is no night file).
    """
    ok = F.coalesce(F.col("night_bands") >= 2, F.lit(True))
    if task == "af_test":
        same = (F.col("height") == F.col("night_height")) & (F.col("width") == F.col("night_width"))
        ok = ok & (F.col("n_bands") == 8) & F.coalesce(same, F.lit(True))
    return ok


def usable_scenes(scenes: DataFrame, task: str = "pred") -> DataFrame:
    """Drop scenes that ``is_usable`` rejects."""
    return scenes.where(is_usable(task))


def number_frames(scenes: DataFrame, task: str = "pred", *, skipped: str = "drop", usable: Column | None = None, **kw) -> DataFrame:
    """``frame_index`` with a rule for unusable scenes, and a ``usable`` column.

    drop       they go first, so the next scene takes their place
    reference  they keep their place; windows then hold an empty step there (see ``windows.usable_rows``)
    """
    if skipped not in ("drop", "reference"):
        raise ValueError(f"skipped must be 'drop' or 'reference', got {skipped!r}")
    marked = scenes.withColumn("usable", F.coalesce(usable if usable is not None else is_usable(task), F.lit(False)))
    return frame_index(marked.where("usable") if skipped == "drop" else marked, **kw)


def join_night(day: DataFrame, night: DataFrame, keys: Sequence[str], out: str = "x") -> DataFrame:
    """Day rows with their night rows where present, stacked into eight bands."""
    right = night.select(*keys, F.col("bands").alias("__night"))
    joined = day.join(right, list(keys), "left")
    return joined.withColumn(out, C.stack_day_night(F.col("bands"), F.col("__night"))).drop("__night")


def join_auxiliary(day: DataFrame, aux: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Append auxiliary layers; day rows without them are dropped (see ``missing_auxiliary``)."""
    right = aux.select(*keys, F.col("bands").alias("__aux"))
    return day.join(right, list(keys), "inner").withColumn(x, F.concat(F.col(x), F.col("__aux"))).drop("__aux")


def missing_auxiliary(day: DataFrame, aux: DataFrame, keys: Sequence[str]) -> DataFrame:
    return day.join(aux.select(*keys), list(keys), "left_anti")


def fires_with_inputs(fires: DataFrame, scenes: DataFrame, *, day: str = "viirs_day", aux: str = "aux") -> DataFrame:
    """Fires having at least one day image and one auxiliary layer.

    One conditional rollup of the scenes stands in for two semi joins, so scenes
    are read and shuffled once, as partial counts.
    """
    seen = (
        scenes.where(F.col("source").isin(day, aux))
        .groupBy("fire_id")
        .agg(F.count_if(F.col("source") == day).alias("d"), F.count_if(F.col("source") == aux).alias("a"))
        .where((F.col("d") > 0) & (F.col("a") > 0))
    )
    return fires.join(seen.select("fire_id"), "fire_id", "left_semi")


def prefer_source(scenes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep, for each fire, only the first of ``order`` that it has."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(order)])
    ranked = scenes.where(F.col("source").isin(*order)).withColumn("__rank", rank)
    best = ranked.groupBy("fire_id").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, ["fire_id", "__rank"], "left_semi").drop("__rank")


def page_fires(fires: DataFrame, *, start: int = 0, limit: int | None = None, key: str = "fire_id") -> DataFrame:
    """``limit`` fires from position ``start`` in id order; ids are unique.

    The ids at the page's ends are looked up by position (``ordered.nth_value``) and the rest is a filter: the
    skipped fires are neither sorted nor moved, and a page past the end is empty.
    """
    first, page = max(start, 0), fires
    if limit is not None and limit <= 0:
        return fires.limit(0)
    if first > 0:
        low = nth_value(fires, key, first).withColumnRenamed(key, "__first")
        page = page.join(F.broadcast(low), F.col(key) >= F.col("__first")).drop("__first")
    if limit is not None:
        high = nth_value(fires, key, first + limit - 1).agg(F.max(key).alias("__last"))
        page = page.join(F.broadcast(high), F.coalesce(F.col(key) <= F.col("__last"), F.col(key).isNotNull())).drop("__last")
    return page


def exclude_fires(
    fires: DataFrame, ids: DataFrame | Sequence[str] = K.TEST_EXCLUDED_FIRES, key: str = "fire_id"
) -> DataFrame:
    """All fires but the named ones; ``ids`` is a list, or a DataFrame with a ``key`` column."""
    if isinstance(ids, DataFrame):
        return fires.join(ids.select(key), key, "left_anti")
    return fires.where(~F.col(key).isin(*ids))


def assign_split(
    fires: DataFrame, *, is_test: Column, validation: DataFrame | Sequence[str] = K.VALIDATION_FIRES, key: str = "fire_id",
) -> DataFrame:
    """train, val or test for every fire. ``validation`` is an id list or a one-column DataFrame of ids."""
    if isinstance(validation, DataFrame):
        marked = fires.join(
            validation.select(F.col(validation.columns[0]).alias(key)).distinct().withColumn("__val", F.lit(True)),
            key, "left",
        )
        in_val = F.coalesce(F.col("__val"), F.lit(False))
    else:
        marked, in_val = fires, F.col(key).isin(*validation)
    split = F.when(is_test, "test").when(in_val, "val").otherwise("train")
    return marked.withColumn("split", split).drop("__val")


def attach_label_selector(samples: DataFrame, fires: DataFrame, key: str = "fire_id") -> DataFrame:
    """Label selector of each sample's fire, 0 when the fire table has none."""
    sel = fires.select(key, F.col("label_sel").alias("__sel"))
    return samples.join(sel, key, "left").withColumn("label_sel", F.coalesce("__sel", F.lit(0))).drop("__sel")


# --- per-scene measures of one-band rasters --------------------------------------

def is_fire_code(code: Column) -> Column:
    """Membership in the 18 fire mask codes."""
    hit = F.lit(False)
    for low, high in K.FIRE_CODE_RANGES:
        hit = hit | code.between(low, high)
    return F.coalesce(hit & (code == F.floor(code)), F.lit(False))


def mask_measures(value: Column) -> dict[str, Column]:
    """Aggregates of one mask scene: any-code coverage, fire-code count and fire-code coverage."""
    v = F.coalesce(C.clean(value.cast("double")), F.lit(0.0))
    fire = is_fire_code(v).cast("int")
    return {
        "coverage": F.avg((v > 0).cast("int")),
        "active_pixel_count": F.sum(fire).cast("double"),
        "mask_coverage": F.avg(fire),
    }


def frp_measures(value: Column) -> dict[str, Column]:
    """Mean and maximum over positive pixels, 0 when there are none."""
    v = C.clean(value.cast("double"))
    pos = F.when(v > 0, v)
    return {"frp_mean": F.coalesce(F.avg(pos), F.lit(0.0)), "frp_max": F.coalesce(F.max(pos), F.lit(0.0))}


def scene_measures(pixels: DataFrame, value: str = "value", keys: Sequence[str] = ("fire_id", "source", "ts", "file_name")) -> DataFrame:
    """Mask and FRP measures of every scene in one pass over its pixels (partial aggregation, one shuffle)."""
    v = F.col(value)
    aggs = {**mask_measures(v), **frp_measures(v)}
    return pixels.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
