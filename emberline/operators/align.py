"""Two-sensor alignment: intervals, as-of, daily and sub-daily rollups, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.timeparse import bins_per_day, date_range, floor_hours, minute_bin
from .ordered import SEGMENT_ROWS, Scan, neighbour, scene_segments, segmented_scan
from .scenes import hours_between


# --- interval alignment ---------------------------------------------------------

def interval_members(scenes: DataFrame, anchor: str = "viirs_day", *, rows: int = SEGMENT_ROWS, **kw) -> DataFrame:
    """Number every scene by the anchor interval ``(t, t+1]`` it falls in.

    The intervals tile the time line, so the interval of a scene is the number
    of earlier anchor scenes, less one: a running count, not a range join. On
    equal times other sensors sort before anchors, which makes the interval open
    at its start and closed at its end.
    """
    is_anchor = F.col("source") == anchor
    marked = scene_segments(scenes.withColumn("__late", is_anchor.cast("int")), ["fire_id"], rows=rows)
    out = segmented_scan(
        marked, ["fire_id"], F.col("__stretch"), ["ts", "__late", "file_name"],
        {"__n": Scan("sum", F.col("__late"))}, **kw,
    )
    return out.withColumn("interval_index", (F.col("__n") - 1).cast("int")).drop("__n", "__late", "__stretch")


def _interval_rollup(scenes: DataFrame, sources: Sequence[str], anchor: str, **kw) -> DataFrame:
    """A row per fire and interval number, with the stretches before the first and after the last anchor (no border there).

    Each anchor scene closes one interval and opens the next, so it is emitted
    twice and a single rollup yields both borders together with the counts. A
    pre-aggregated interval is one row however many scenes it holds.
    """
    members = interval_members(scenes.where(F.col("source").isin(anchor, *sources)), anchor, **kw)
    is_anchor = F.col("source") == anchor
    roles = F.when(
        is_anchor,
        F.array(
            F.struct(F.col("interval_index").alias("i"), F.lit("open").alias("role")),
            F.struct((F.col("interval_index") - 1).alias("i"), F.lit("close").alias("role")),
        ),
    ).otherwise(F.array(F.struct(F.col("interval_index").alias("i"), F.col("source").alias("role"))))
    rows = members.select("fire_id", "ts", F.inline(roles))

    def of(role: str) -> Column:
        return F.when(F.col("role") == role, F.col("ts"))

    per_source = []
    for s in sources:
        per_source += [
            F.count(of(s)).alias(f"{s}_count"), F.min(of(s)).alias(f"{s}_first"), F.max(of(s)).alias(f"{s}_last"),
            F.count_if(F.col("role") == s).alias(f"__{s}_rows"),
        ]
    return rows.groupBy("fire_id", F.col("i").alias("interval_index")).agg(
        F.max(of("open")).alias("viirs_t"), F.max(of("close")).alias("viirs_t_plus_1"),
        F.count_if(F.col("role") == "open").alias("__anchors"), *per_source)


def _complete() -> Column:
    return F.col("viirs_t").isNotNull() & F.col("viirs_t_plus_1").isNotNull()


def _any_scene(sources: Sequence[str]) -> Column:
    found = F.lit(False)
    for s in sources:
        found = found | (F.col(f"{s}_count") > 0)
    return found


def interval_alignment(scenes: DataFrame, sources: Sequence[str], anchor: str = "viirs_day", **kw) -> DataFrame:
    """One row per anchor interval with count, first and last scene time of each source."""
    out = _interval_rollup(scenes, sources, anchor, **kw).where(_complete())
    return out.drop("__anchors", *[f"__{s}_rows" for s in sources]).withColumns(
        {
            "viirs_gap_hours": F.round(hours_between(F.col("viirs_t"), F.col("viirs_t_plus_1")), 3),
            "has_any": _any_scene(sources).cast("int"),
        }
    )


def alignment_summary(scenes: DataFrame, sources: Sequence[str], anchor: str = "viirs_day", **kw) -> DataFrame:
    """Per fire: scene and interval counts, covered intervals, coverage ratio to 4 decimals, sources seen.

    All of it comes from the interval rollup, so scenes are not read again.
    """
    fires = _interval_rollup(scenes, sources, anchor, **kw).groupBy("fire_id").agg(
        F.sum("__anchors").alias("viirs_count"),
        F.array_compact(F.array(*[F.when(F.sum(f"__{s}_rows") > 0, F.lit(s)) for s in sorted(sources)])).alias("sources"),
        F.count_if(_complete() & _any_scene(sources)).alias("covered"),
        F.min("viirs_t").alias("first_viirs_time"), F.max("viirs_t").alias("last_viirs_time"))
    intervals = F.greatest(F.col("viirs_count") - 1, F.lit(0))
    return fires.where("viirs_count > 0").select(
        "fire_id", "viirs_count", intervals.alias("interval_count"), "sources", F.col("covered").alias("covered_intervals"),
        F.when(intervals > 0, F.round(F.col("covered") / intervals, 4)).otherwise(F.lit(0.0)).alias("coverage_ratio"),
        F.when(intervals > 0, F.col("first_viirs_time")).alias("first_viirs_time"),
        F.when(intervals > 0, F.col("last_viirs_time")).alias("last_viirs_time"),
    )


def asof_latest(scenes: DataFrame, anchor: str = "viirs_day", *, rows: int = SEGMENT_ROWS, **kw) -> DataFrame:
    """Each non-anchor scene with the latest strictly earlier anchor scene of its fire (NULL when none)."""
    is_anchor = F.col("source") == anchor
    marked = scene_segments(scenes.withColumn("__late", is_anchor.cast("int")), ["fire_id"], rows=rows)
    out = neighbour(
        marked, ["fire_id"], F.col("__stretch"), ["ts", "__late", "file_name"],
        {"anchor_ts": F.col("ts"), "anchor_file": F.col("file_name")},
        following=False, where=is_anchor, **kw,
    )
    return out.where(~is_anchor).drop("__late", "__stretch")


# --- rollups ----------------------------------------------------------------------

def daily_rollup(measures: DataFrame) -> DataFrame:
    """Scene measures to one row per fire and day, split by kind (mask, frp)."""
    mask, frp = F.col("kind") == "mask", F.col("kind") == "frp"

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return (
        measures.groupBy("fire_id", F.to_date("ts").alias("day"))
        .agg(
            F.count_if(mask).cast("double").alias("goes_mask_file_count"),
            zero(F.avg(F.when(mask, F.col("coverage")))).alias("goes_mask_cov_mean"),
            zero(F.max(F.when(mask, F.col("coverage")))).alias("goes_mask_cov_max"),
            F.count_if(frp).cast("double").alias("goes_frp_file_count"),
            zero(F.avg(F.when(frp, F.col("frp_mean")))).alias("goes_frp_mean_mean"),
            zero(F.max(F.when(frp, F.col("frp_max")))).alias("goes_frp_max_max"),
        )
    )


def subdaily_rollup(measures: DataFrame, minutes: int = 15) -> DataFrame:
    """Scene measures to one row per fire, day and bin: maxima of counts, mean of means."""
    mask, frp = F.col("kind") == "mask", F.col("kind") == "frp"

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return (
        measures.groupBy("fire_id", F.to_date("ts").alias("day"), minute_bin(F.col("ts"), minutes).alias("bin"))
        .agg(
            zero(F.max(F.when(mask, F.col("active_pixel_count")))).alias("active_pixel_count"),
            zero(F.max(F.when(mask, F.col("mask_coverage")))).alias("mask_coverage"),
            zero(F.avg(F.when(frp, F.col("frp_mean")))).alias("frp_mean"),
            zero(F.max(F.when(frp, F.col("frp_max")))).alias("frp_max"),
        )
    )


def attach_daily(steps: DataFrame, daily: DataFrame) -> DataFrame:
    """Window steps with their day's features, zeros where the day has none."""
    joined = steps.join(daily, ["fire_id", "day"], "left")
    return joined.fillna(0.0, subset=list(K.DAILY_FEATURES))


def dense_bins(days: DataFrame, bins: DataFrame, minutes: int = 15) -> DataFrame:
    """Every bin of every (fire, day), zeros where nothing was seen.

    Each day row expands to a fixed number of bins, so nothing is crossed.
    """
    grid = days.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins_per_day(minutes) - 1))))
    return grid.join(bins, ["fire_id", "day", "bin"], "left").fillna(0.0, subset=list(K.SUBDAILY_FEATURES))


def day_matrix(dense: DataFrame, keys: Sequence[str] = ("fire_id", "day")) -> DataFrame:
    """One row per day with its bins as an ordered array of feature vectors (a day's bins bound the array)."""
    vec = F.array(*[F.col(c).cast("float") for c in K.SUBDAILY_FEATURES])
    return dense.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", vec.alias("v")))), lambda s: s["v"]).alias("bins")
    )


def hourly_counts(scenes: DataFrame, sources: Sequence[str], hours: int = 1) -> DataFrame:
    """Scene counts per fire and time bin, one column per source."""
    return scenes.where(F.col("source").isin(*sources)).groupBy(
        "fire_id", floor_hours(F.col("ts"), hours).alias("bin_start")
    ).agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources])


def source_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("fire_id", "source").agg(F.count(F.lit(1)).alias("n"))


# --- date coverage ----------------------------------------------------------------

def date_coverage(fires: DataFrame, files: DataFrame, day: str = "day") -> DataFrame:
    """Which days of each fire's date range have files. Fires with a blank date get an all-zero row."""
    per_day = files.groupBy(F.col(day).alias("__day")).agg(F.count(F.lit(1)).alias("__files"))
    dated = fires.select(
        "fire_id", "start_date", "end_date",
        F.explode_outer(date_range(F.col("start_date"), F.col("end_date"))).alias("__day"),
    )
    hit = F.col("__files").isNotNull()
    real = F.col("__day").isNotNull()
    rolled = (
        dated.join(per_day, "__day", "left")
        .groupBy("fire_id", "start_date", "end_date")
        .agg(
            F.count("__day").alias("total_days"),
            F.count_if(real & hit).alias("covered_days"),
            F.count_if(real & ~hit).alias("missing_days"),
            F.coalesce(F.sum("__files"), F.lit(0)).alias("total_files"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(real & ~hit, F.col("__day").cast("string")))), ";"
            ).alias("missing_date_list"),
        )
    )
    ratio = F.when(F.col("total_days") > 0, F.col("covered_days") / F.col("total_days")).otherwise(F.lit(0.0))
    return rolled.withColumns(
        {
            "coverage_ratio": F.printf(F.lit("%.4f"), ratio),
            "is_blank": F.col("start_date").isNull() | F.col("end_date").isNull(),
        }
    )


def coverage_totals(report: DataFrame) -> DataFrame:
    """Fleet totals. A blank-date fire has no missing day and so counts as full; it is also reported apart."""
    return report.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("missing_days") == 0).alias("full_coverage_events"),
        F.count_if(F.col("missing_days") > 0).alias("partial_or_missing_events"),
        F.count_if("is_blank").alias("blank_date_events"),
    )


def clip_outcomes(results: DataFrame, keys: Sequence[str] = ("fire_id",)) -> DataFrame:
    """Clip results per fire: inputs and how many were saved, empty, already there or failed."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return results.groupBy(*keys).agg(
        F.count("status").alias("input_files"), n("saved").alias("saved_files"), n("empty").alias("empty_files"),
        n("exists").alias("existing_files"), n("error").alias("error_files"),
    )


def clip_status(pairs: DataFrame, clipped: DataFrame, done: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Status of every (fire, file) pair: exists, saved, or empty when the clip holds no pixel.

    ``clipped`` holds the pixels inside the boxes, or each pair that has one (``pixels.clipped_keys``);
    its pairs are counted before the join, so a large clip is one row there. A pair with no pixel is empty
    whether or not an output exists, for the clip is looked at first.
    """
    found = clipped.groupBy(*keys).agg(F.lit(True).alias("__found"))
    there = done.select(*keys).distinct().withColumn("__done", F.lit(not overwrite))
    status = (
        F.when(F.col("__found").isNull(), "empty")
        .when(F.coalesce(F.col("__done"), F.lit(False)), "exists")
        .otherwise("saved")
    )
    return pairs.join(found, list(keys), "left").join(there, list(keys), "left").withColumn("status", status).drop("__found", "__done")


def not_yet_done(todo: DataFrame, done: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Work that still has no output; with ``overwrite`` everything."""
    return todo if overwrite else todo.join(done.select(*keys), list(keys), "left_anti")
