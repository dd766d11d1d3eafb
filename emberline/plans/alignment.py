"""Queries: scenes, two-sensor alignment, rollups and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeparse as TP
from ..operators import align, scenes as S
from . import fixtures as X
from .registry import query

TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _text(col: str):
    """Timestamps as text, so that both engines compare them alike."""
    return F.date_format(col, TS).alias(col)


def _t(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"""
WITH {X.MEASURES}
SELECT fire_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST((hour(ts) * 60 + minute(ts)) // 15 AS INTEGER) AS bin,
       round(coalesce(max(hot) FILTER (kind = 'mask'), 0.0), 6) AS active_pixel_count,
       round(coalesce(max(hot) FILTER (kind = 'mask'), 0.0), 6) AS mask_coverage,
       round(coalesce(avg(frp) FILTER (kind = 'frp'), 0.0), 6) AS frp_mean,
       round(coalesce(max(frp) FILTER (kind = 'frp'), 0.0), 6) AS frp_max
FROM measures GROUP BY ALL
""")
def subdaily_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: 15-minute GOES bins of every fire and day."""
    bins = align.subdaily_rollup(X.measures(spark, sf_dir), 15)
    return bins.select(
        "fire_id", F.col("day").cast("string").alias("day"), "bin",
        *[F.round(c, 6).alias(c) for c in ("active_pixel_count", "mask_coverage", "frp_mean", "frp_max")],
    )


@query(f"""
WITH {X.MEASURES}
SELECT fire_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
       CAST(count(*) FILTER (kind = 'mask') AS DOUBLE) AS goes_mask_file_count,
       round(coalesce(avg(cov) FILTER (kind = 'mask'), 0.0), 6) AS goes_mask_cov_mean,
       round(coalesce(max(cov) FILTER (kind = 'mask'), 0.0), 6) AS goes_mask_cov_max,
       CAST(count(*) FILTER (kind = 'frp') AS DOUBLE) AS goes_frp_file_count,
       round(coalesce(avg(frp) FILTER (kind = 'frp'), 0.0), 6) AS goes_frp_mean_mean,
       round(coalesce(max(frp) FILTER (kind = 'frp'), 0.0), 6) AS goes_frp_max_max
FROM measures GROUP BY ALL
""")
def daily_rollup(spark, sf_dir):
    daily = align.daily_rollup(X.measures(spark, sf_dir))
    values = [c for c in daily.columns if c not in ("fire_id", "day")]
    return daily.select("fire_id", F.col("day").cast("string").alias("day"), *[F.round(c, 6).alias(c) for c in values])


@query("""
SELECT l_orderkey AS scene_id,
       round(avg(CASE WHEN l_quantity > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
       CAST(count(*) FILTER (l_quantity BETWEEN 10 AND 15 OR l_quantity BETWEEN 20 AND 25 OR l_quantity BETWEEN 30 AND 35) AS DOUBLE) AS active_pixel_count,
       round(avg(CASE WHEN l_quantity BETWEEN 10 AND 15 OR l_quantity BETWEEN 20 AND 25 OR l_quantity BETWEEN 30 AND 35 THEN 1.0 ELSE 0.0 END), 6) AS mask_coverage
FROM lineitem GROUP BY l_orderkey
""")
def scene_mask_measures(spark, sf_dir):
    """Mask coverage and fire-code counts per scene: orders as scenes, quantities as mask codes."""
    aggs = S.mask_measures(F.col("l_quantity"))
    rolled = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene_id")).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    return rolled.select("scene_id", F.round("coverage", 6).alias("coverage"), "active_pixel_count",
                         F.round("mask_coverage", 6).alias("mask_coverage"))


@query("""
SELECT l_orderkey AS scene_id,
       round(coalesce(avg(l_extendedprice - 40000) FILTER (l_extendedprice > 40000), 0.0), 4) AS frp_mean,
       round(coalesce(max(l_extendedprice - 40000) FILTER (l_extendedprice > 40000), 0.0), 4) AS frp_max
FROM lineitem GROUP BY l_orderkey
""")
def scene_frp_measures(spark, sf_dir):
    """Mean and maximum fire power over positive pixels per scene."""
    aggs = S.frp_measures(F.col("l_extendedprice") - 40000)
    rolled = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scene_id")).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    return rolled.select("scene_id", F.round("frp_mean", 4).alias("frp_mean"), F.round("frp_max", 4).alias("frp_max"))


_COUNTED = ("viirs_day", "viirs_night", "mask", "frp")


@query(f"""
WITH {X.SCENES}
SELECT fire_id,
       strftime(date_trunc('day', ts) + to_hours(CAST((hour(ts) // 3) * 3 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS bin_start,
       {", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in _COUNTED)}
FROM scenes WHERE source <> 'rejected' GROUP BY ALL
""")
def hourly_source_counts(spark, sf_dir):
    """Scene counts of every sensor side by side in 3-hour bins."""
    out = align.hourly_counts(X.scenes(spark, sf_dir, *_COUNTED), _COUNTED, hours=3)
    return out.withColumn("bin_start", F.date_format("bin_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""
WITH {X.SCENES}
SELECT fire_id, source, count(*) AS n FROM scenes GROUP BY ALL
""")
def event_source_counts(spark, sf_dir):
    return align.source_counts(X.scenes(spark, sf_dir))


@query(f"""
WITH {X.SCENES}
SELECT fire_id, file_name, CAST(row_number() OVER (PARTITION BY fire_id ORDER BY ts, file_name) - 1 AS INTEGER) AS frame,
       CAST(count(*) OVER (PARTITION BY fire_id) AS INTEGER) AS n_frames
FROM scenes WHERE source = 'viirs_day'
""")
def frame_index(spark, sf_dir):
    day = X.scenes(spark, sf_dir, "viirs_day")
    return S.frame_index(day).select("fire_id", "file_name", "frame", "n_frames")


@query(f"""
WITH {X.SCENES}
SELECT fire_id, file_name,
       {_t("lead(ts) OVER w")} AS next_ts,
       round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9, 3) AS gap_hours
FROM scenes WHERE source = 'viirs_day' WINDOW w AS (PARTITION BY fire_id ORDER BY ts, file_name)
""")
def scene_gap(spark, sf_dir):
    day = X.scenes(spark, sf_dir, "viirs_day")
    return S.scene_gaps(day).select("fire_id", "file_name", _text("next_ts"), "gap_hours")


@query(f"""
WITH {X.SCENES}
SELECT DISTINCT fire_id, source, {_t("ts")} AS ts, file_name FROM scenes
""")
def dedupe_scenes(spark, sf_dir):
    """The catalogue listed twice, then deduplicated."""
    once = X.scenes(spark, sf_dir).select("fire_id", "source", "ts", "file_name")
    return S.dedupe_scenes(once.unionByName(once)).select("fire_id", "source", _text("ts"), "file_name")


_ALIGN = f"""
WITH {X.SCENES},
v AS (SELECT fire_id, ts AS t, lead(ts) OVER w AS t1, row_number() OVER w - 1 AS i
      FROM scenes WHERE source = 'viirs_day' WINDOW w AS (PARTITION BY fire_id ORDER BY ts, file_name)),
rows AS (
  SELECT v.fire_id, v.i, v.t, v.t1,
         count(*) FILTER (g.source = 'mask') AS mask_count, count(*) FILTER (g.source = 'frp') AS frp_count,
         min(g.ts) FILTER (g.source = 'mask') AS mask_first, max(g.ts) FILTER (g.source = 'mask') AS mask_last,
         min(g.ts) FILTER (g.source = 'frp') AS frp_first, max(g.ts) FILTER (g.source = 'frp') AS frp_last
  FROM v LEFT JOIN scenes g ON g.fire_id = v.fire_id AND g.source IN ('mask', 'frp') AND g.ts > v.t AND g.ts <= v.t1
  WHERE v.t1 IS NOT NULL GROUP BY ALL)"""


@query(_ALIGN + f"""
SELECT fire_id, CAST(i AS INTEGER) AS interval_index, {_t("t")} AS viirs_t, {_t("t1")} AS viirs_t_plus_1,
       round((epoch_us(t1) - epoch_us(t)) / 3.6e9, 3) AS viirs_gap_hours,
       mask_count, {_t("mask_first")} AS mask_first, {_t("mask_last")} AS mask_last,
       frp_count, {_t("frp_first")} AS frp_first, {_t("frp_last")} AS frp_last,
       CAST(mask_count + frp_count > 0 AS INTEGER) AS has_any
FROM rows
""")
def interval_alignment(spark, sf_dir):
    """GOES scenes inside each VIIRS interval (t, t+1]."""
    out = align.interval_alignment(X.scenes(spark, sf_dir, "viirs_day", "mask", "frp"), ["mask", "frp"])
    return out.select(
        "fire_id", "interval_index", _text("viirs_t"), _text("viirs_t_plus_1"), "viirs_gap_hours",
        "mask_count", _text("mask_first"), _text("mask_last"), "frp_count", _text("frp_first"), _text("frp_last"),
        "has_any",
    )


@query(_ALIGN + f""",
c AS (SELECT fire_id, CAST(sum(CASE WHEN mask_count + frp_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM rows GROUP BY fire_id),
b AS (SELECT fire_id, count(*) FILTER (source = 'viirs_day') AS n,
             string_agg(DISTINCT source, ',' ORDER BY source) FILTER (source <> 'viirs_day') AS sources,
             min(ts) FILTER (source = 'viirs_day') AS t0, max(ts) FILTER (source = 'viirs_day') AS t9
      FROM scenes WHERE source IN ('viirs_day', 'mask', 'frp') GROUP BY fire_id)
SELECT fire_id, n AS viirs_count, greatest(n - 1, 0) AS interval_count, coalesce(sources, '') AS sources,
       coalesce(covered, 0) AS covered_intervals,
       CASE WHEN n > 1 THEN round(coalesce(covered, 0) / (n - 1), 4) ELSE 0.0 END AS coverage_ratio,
       CASE WHEN n > 1 THEN {_t("t0")} END AS first_viirs_time, CASE WHEN n > 1 THEN {_t("t9")} END AS last_viirs_time
FROM b LEFT JOIN c USING (fire_id) WHERE n > 0
""")
def alignment_summary(spark, sf_dir):
    out = align.alignment_summary(X.scenes(spark, sf_dir, "viirs_day", "mask", "frp"), ["mask", "frp"])
    return out.select(
        "fire_id", "viirs_count", "interval_count", F.array_join("sources", ",").alias("sources"),
        "covered_intervals", "coverage_ratio", _text("first_viirs_time"), _text("last_viirs_time"),
    )


@query(f"""
WITH {X.SCENES},
g AS (SELECT * FROM scenes WHERE source IN ('mask', 'frp')),
v AS (SELECT * FROM scenes WHERE source = 'viirs_day')
SELECT g.fire_id, g.file_name, {_t("v.ts")} AS anchor_ts, v.file_name AS anchor_file
FROM g ASOF LEFT JOIN v ON g.fire_id = v.fire_id AND g.ts > v.ts
""")
def asof_latest(spark, sf_dir):
    """Latest VIIRS scene strictly before each GOES scene."""
    used = X.scenes(spark, sf_dir, "viirs_day", "mask", "frp")
    return align.asof_latest(used).select("fire_id", "file_name", _text("anchor_ts"), "anchor_file")


_COVERAGE = f"""
WITH {X.DATED_FIRES},
d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS files FROM events GROUP BY 1),
x AS (SELECT fire_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day FROM dated WHERE start_date IS NOT NULL),
r AS (SELECT fire_id, count(*) AS total_days, count(files) AS covered_days, count(*) - count(files) AS missing_days,
             CAST(coalesce(sum(files), 0) AS BIGINT) AS total_files,
             coalesce(string_agg(CASE WHEN files IS NULL THEN CAST(x.day AS VARCHAR) END, ';' ORDER BY x.day), '') AS missing_date_list
      FROM x LEFT JOIN d ON d.day = x.day GROUP BY fire_id),
report AS (
  SELECT dated.fire_id, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
         coalesce(total_days, 0) AS total_days, coalesce(covered_days, 0) AS covered_days, coalesce(missing_days, 0) AS missing_days,
         printf('%.4f', CASE WHEN total_days > 0 THEN covered_days / total_days ELSE 0.0 END) AS coverage_ratio,
         coalesce(total_files, 0) AS total_files, coalesce(missing_date_list, '') AS missing_date_list
  FROM dated LEFT JOIN r USING (fire_id))"""


@query(_COVERAGE + "SELECT * FROM report")
def date_coverage(spark, sf_dir):
    """Day-by-day file coverage of every fire's date range."""
    files = X.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    out = align.date_coverage(X.dated_fires(spark, sf_dir), files)
    return out.select(
        "fire_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        "total_days", "covered_days", "missing_days", "coverage_ratio", "total_files", "missing_date_list",
    )


@query(_COVERAGE + """
SELECT count(*) AS total_events, count(*) FILTER (missing_days = 0) AS full_coverage_events,
       count(*) FILTER (missing_days > 0) AS partial_or_missing_events,
       count(*) FILTER (start_date IS NULL) AS blank_date_events FROM report
""")
def coverage_totals(spark, sf_dir):
    files = X.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return align.coverage_totals(align.date_coverage(X.dated_fires(spark, sf_dir), files))


@query(_COVERAGE + """
SELECT fire_id, unnest(string_split(missing_date_list, ';')) AS missing_day FROM report WHERE missing_days > 0
""")
def missing_dates(spark, sf_dir):
    files = X.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    report = align.date_coverage(X.dated_fires(spark, sf_dir), files).where("missing_days > 0")
    return report.select("fire_id", F.explode(F.split("missing_date_list", ";")).alias("missing_day"))


@query(f"""
WITH {X.MEASURES},
daily AS (
  SELECT fire_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (kind = 'mask') AS DOUBLE) AS n, avg(cov) FILTER (kind = 'mask') AS cm,
         max(cov) FILTER (kind = 'mask') AS cx, CAST(count(*) FILTER (kind = 'frp') AS DOUBLE) AS m,
         avg(frp) FILTER (kind = 'frp') AS fm, max(frp) FILTER (kind = 'frp') AS fx FROM measures GROUP BY ALL)
SELECT s.fire_id, s.file_name, round(coalesce(n, 0.0), 6) AS goes_mask_file_count, round(coalesce(cm, 0.0), 6) AS goes_mask_cov_mean,
       round(coalesce(cx, 0.0), 6) AS goes_mask_cov_max, round(coalesce(m, 0.0), 6) AS goes_frp_file_count,
       round(coalesce(fm, 0.0), 6) AS goes_frp_mean_mean, round(coalesce(fx, 0.0), 6) AS goes_frp_max_max
FROM scenes s LEFT JOIN daily d ON d.fire_id = s.fire_id AND d.day = CAST(s.ts AS DATE) WHERE s.source = 'viirs_day'
""")
def daily_features_zero_filled(spark, sf_dir):
    """Every VIIRS scene with its day's GOES features, zeros on days without GOES."""
    steps = X.scenes(spark, sf_dir, "viirs_day").select("fire_id", "file_name", F.to_date("ts").alias("day"))
    out = align.attach_daily(steps, align.daily_rollup(X.measures(spark, sf_dir)))
    return out.select("fire_id", "file_name", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("goes_")])


@query(f"""
WITH {X.MEASURES},
b AS (SELECT fire_id, CAST(ts AS DATE) AS day, (hour(ts) * 60 + minute(ts)) // 60 AS bin, max(hot) FILTER (kind = 'mask') AS ac,
             avg(frp) FILTER (kind = 'frp') AS fm, max(frp) FILTER (kind = 'frp') AS fx FROM measures GROUP BY ALL),
d AS (SELECT DISTINCT fire_id, CAST(ts AS DATE) AS day FROM scenes WHERE source = 'viirs_day')
SELECT d.fire_id, CAST(d.day AS VARCHAR) AS day, CAST(g.bin AS INTEGER) AS bin, round(coalesce(ac, 0.0), 6) AS active_pixel_count,
       round(coalesce(ac, 0.0), 6) AS mask_coverage, round(coalesce(fm, 0.0), 6) AS frp_mean, round(coalesce(fx, 0.0), 6) AS frp_max
FROM d CROSS JOIN range(0, 24) AS g(bin) LEFT JOIN b ON b.fire_id = d.fire_id AND b.day = d.day AND b.bin = g.bin
""")
def dense_day_bins(spark, sf_dir):
    """All 24 hourly bins of every observed day, zero-filled."""
    days = X.scenes(spark, sf_dir, "viirs_day").select("fire_id", F.to_date("ts").alias("day")).distinct()
    dense = align.dense_bins(days, align.subdaily_rollup(X.measures(spark, sf_dir), 60), 60)
    return dense.select(
        "fire_id", F.col("day").cast("string").alias("day"), "bin",
        *[F.round(c, 6).alias(c) for c in ("active_pixel_count", "mask_coverage", "frp_mean", "frp_max")],
    )


# --- choosing and pairing scenes ------------------------------------------------------------

@query(f"""
WITH {X.SCENES},
e AS (SELECT fire_id || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS fire_id, source, file_name FROM scenes WHERE source IN ('frp', 'mask')),
f AS (SELECT fire_id, bool_or(source = 'frp') AS has_frp FROM e GROUP BY fire_id)
SELECT fire_id, source, file_name FROM e JOIN f USING (fire_id) WHERE source = CASE WHEN has_frp THEN 'frp' ELSE 'mask' END
""")
def prefer_source(spark, sf_dir):
    """First existing directory wins per event (here a fire's day)."""
    event = F.concat_ws("_", "fire_id", F.to_date("ts").cast("string"))
    events = X.scenes(spark, sf_dir, "mask", "frp").withColumn("fire_id", event)
    return S.prefer_source(events, ["frp", "mask"]).select("fire_id", "source", "file_name")


_BANDED = """
b AS (SELECT *, CAST(6 + code % 3 AS INTEGER) AS n_bands, 256 AS height, CASE WHEN code % 5 = 0 THEN 250 ELSE 256 END AS width,
             CASE WHEN code % 4 = 0 THEN NULL ELSE CAST(code % 4 AS INTEGER) END AS night_bands FROM scenes)"""


def _banded(spark, sf_dir):
    code = F.col("code")
    night = F.when(code % 4 != 0, (code % 4).cast("int"))
    return X.scenes(spark, sf_dir).withColumns({
        "n_bands": (6 + code % 3).cast("int"), "height": F.lit(256),
        "width": F.when(code % 5 == 0, 250).otherwise(256), "night_bands": night,
        "night_height": F.when(night.isNotNull(), 256), "night_width": F.when(night.isNotNull(), 256),
    })


@query(f"""
WITH {X.SCENES}, {_BANDED}
SELECT file_name, coalesce(night_bands >= 2, true) AS usable_pred,
       coalesce(night_bands >= 2, true) AND n_bands = 8 AND (night_bands IS NULL OR width = 256) AS usable_af_test
FROM b WHERE coalesce(night_bands >= 2, true)
""")
def reject_scenes(spark, sf_dir):
    """Scenes fit for training, marked with fitness for the active-fire test."""
    rows = _banded(spark, sf_dir)
    strict = S.usable_scenes(rows, "af_test").select("file_name", F.lit(True).alias("ok"))
    kept = S.usable_scenes(rows, "pred").join(strict, "file_name", "left")
    return kept.select("file_name", F.lit(True).alias("usable_pred"), F.coalesce("ok", F.lit(False)).alias("usable_af_test"))


@query(f"""
WITH {X.SCENES},
ok AS (SELECT fire_id FROM scenes GROUP BY fire_id HAVING bool_or(source = 'viirs_day') AND bool_or(source = 'frp'))
SELECT CAST(c_custkey AS VARCHAR) AS fire_id FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT fire_id FROM ok)
""")
def available_fires(spark, sf_dir):
    """Fires with day imagery and (standing in for auxiliary layers) fire power scenes."""
    fires = X.fires(spark, sf_dir, "customer").select("fire_id")
    return S.fires_with_inputs(fires, X.scenes(spark, sf_dir), aux="frp")


@query(f"""
WITH {X.FIRES}
SELECT fire_id FROM fires ORDER BY fire_id LIMIT 20 OFFSET 5
""")
def page_fires(spark, sf_dir):
    """Fires 5..24 in id order: the start and limit flags of the generators."""
    return S.page_fires(X.fires(spark, sf_dir).select("fire_id"), start=5, limit=20)


@query(f"""
WITH {X.FIRES} SELECT fire_id FROM fires ORDER BY fire_id LIMIT 1000000000 OFFSET 7
""")
def page_fires_open(spark, sf_dir):
    """All fires from the eighth on in id order: a start flag without a limit."""
    return S.page_fires(X.fires(spark, sf_dir).select("fire_id"), start=7)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 1234")
def row_by_position(spark, sf_dir):
    """One row by its position, as boxes are picked by index."""
    from ..sources.tables import nth_row

    return nth_row(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1234)


_DAY_NIGHT = f"""
WITH {X.TILES},
day AS (SELECT fire_id, frame, embedding[1:8] AS bands FROM tiles),
night AS (SELECT fire_id, frame, CASE WHEN vec_id % 2 = 0 THEN embedding[9:13] ELSE embedding[9:10] END AS bands FROM tiles WHERE vec_id % 3 <> 0),
aux AS (SELECT fire_id, frame, embedding[14:32] AS bands FROM tiles WHERE vec_id % 5 <> 0),
x AS (SELECT day.fire_id, day.frame,
        list_concat(day.bands[1:6], CASE WHEN night.bands IS NULL THEN [0.0::FLOAT, 0.0::FLOAT]
             WHEN len(night.bands) = 5 THEN night.bands[4:5] ELSE night.bands[1:2] END) AS x
      FROM day LEFT JOIN night USING (fire_id, frame))"""


def _day_night(spark, sf_dir):
    t = X.tiles(spark, sf_dir)
    e = F.col("embedding")
    day = t.select("fire_id", "frame", F.slice(e, 1, 8).alias("bands"))
    night = t.where("vec_id % 3 <> 0").select(
        "fire_id", "frame", F.when(F.col("vec_id") % 2 == 0, F.slice(e, 9, 5)).otherwise(F.slice(e, 9, 2)).alias("bands")
    )
    aux = t.where("vec_id % 5 <> 0").select("fire_id", "frame", F.slice(e, 14, 19).alias("bands"))
    return day, night, aux


def _elements(df, x="x"):
    return df.select("fire_id", "frame", F.posexplode(x).alias("channel", "v")).select(
        "fire_id", "frame", "channel", F.round(F.col("v").cast("double"), 6).alias("v")
    )


@query(_DAY_NIGHT + """
SELECT fire_id, CAST(frame AS INTEGER) AS frame, CAST(i - 1 AS INTEGER) AS channel, round(CAST(x[i] AS DOUBLE), 6) AS v
FROM x, range(1, 9) AS g(i)
""")
def night_left_join(spark, sf_dir):
    """Day scenes with night bands: five-band files give their last two, missing ones zeros."""
    day, night, _ = _day_night(spark, sf_dir)
    return _elements(S.join_night(day, night, ["fire_id", "frame"]))


@query(_DAY_NIGHT + """
SELECT x.fire_id, CAST(x.frame AS INTEGER) AS frame, CAST(i - 1 AS INTEGER) AS channel,
       round(CAST(list_concat(x.x, aux.bands)[i] AS DOUBLE), 6) AS v
FROM x JOIN aux USING (fire_id, frame), range(1, 28) AS g(i)
""")
def auxiliary_join(spark, sf_dir):
    """27-channel stack; scenes without auxiliary layers drop out."""
    day, night, aux = _day_night(spark, sf_dir)
    keys = ["fire_id", "frame"]
    return _elements(S.join_auxiliary(S.join_night(day, night, keys), aux, keys))


@query(_DAY_NIGHT + """
SELECT fire_id, CAST(frame AS INTEGER) AS frame FROM day WHERE (fire_id, frame) NOT IN (SELECT (fire_id, frame) FROM aux)
""")
def missing_auxiliary(spark, sf_dir):
    day, _, aux = _day_night(spark, sf_dir)
    return S.missing_auxiliary(day, aux, ["fire_id", "frame"]).select("fire_id", "frame")


_SPLIT = f"""
WITH {X.CUSTOMER_FIRES},
s AS (SELECT fire_id, CASE WHEN key % 7 = 0 THEN 'test' WHEN key % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM fires)
"""


def _split(spark, sf_dir):
    fires = X.fires(spark, sf_dir, "customer")
    validation = fires.where("key % 10 = 0").select("fire_id")
    return S.assign_split(fires, is_test=F.col("key") % 7 == 0, validation=validation)


@query(_SPLIT + "SELECT fire_id, split FROM s")
def split_assign(spark, sf_dir):
    return _split(spark, sf_dir).select("fire_id", "split")


@query(_SPLIT + "SELECT split, count(*) AS fires FROM s GROUP BY split")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("fires"))


@query(_SPLIT + "SELECT fire_id FROM fires WHERE key % 10 <> 0")
def train_ids(spark, sf_dir):
    """Id-set difference: all fires without the validation fires."""
    fires = X.fires(spark, sf_dir, "customer")
    return S.exclude_fires(fires, fires.where("key % 10 = 0").select("fire_id")).select("fire_id")


@query(f"""
WITH {X.SCENES}, sel AS (SELECT CAST(s_suppkey AS VARCHAR) AS fire_id, CASE WHEN s_suppkey % 3 < 2 THEN CAST(s_suppkey % 3 AS INTEGER) END AS label_sel FROM supplier)
SELECT file_name, coalesce(label_sel, 0) AS label_sel FROM scenes LEFT JOIN sel USING (fire_id)
""")
def label_selector(spark, sf_dir):
    """Label selector of each scene's fire, 0 when the fire table has none."""
    k = F.col("key")
    fires = X.fires(spark, sf_dir).withColumn("label_sel", F.when(k % 3 < 2, (k % 3).cast("int")))
    return S.attach_label_selector(X.scenes(spark, sf_dir), fires).select("file_name", "label_sel")


@query("""
SELECT 'fire' AS kind, CAST(c_custkey AS VARCHAR) AS "Id", round(c_acctbal, 2) AS area, round(c_acctbal / 10000, 6) AS ratiocci, CAST(NULL AS INTEGER) AS label_sel FROM customer
UNION ALL
SELECT 'test', CAST(s_suppkey AS VARCHAR), round(s_acctbal, 2), NULL, CAST(s_suppkey % 3 AS INTEGER) FROM supplier
""")
def union_fire_tables(spark, sf_dir):
    """Fire tables of two generations with differing headers."""
    from ..sources.tables import union_years

    train = X.table(spark, sf_dir, "customer").select(
        F.lit("fire").alias("kind"), F.col("c_custkey").alias("Id"), F.round("c_acctbal", 2).alias("area"),
        F.round(F.col("c_acctbal") / 10000, 6).alias("ratiocci"),
    )
    test = X.table(spark, sf_dir, "supplier").select(
        F.lit("test").alias("kind"), F.col("s_suppkey").alias("Id"), F.round("s_acctbal", 2).alias("area"),
        (F.col("s_suppkey") % 3).cast("int").alias("label_sel"),
    )
    return union_years(train, test)


# --- names and paths -------------------------------------------------------------------------

# Seven naming styles, picked by the event's number.
_NAMES = (
    ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", "clip_{}_mask.tif"),
    ("yyyyMMddHHmmss", "%Y%m%d%H%M%S", "{}_frp.tif"),
    ("yyyy-MM-dd", "%Y-%m-%d", "{}_VIIRS_Day.tif"),
    ("yyyyDDDHHmmss", "%Y%j%H%M%S", "OR_s{}_c.tif"),
    ("yyyyMMddHH", "%Y%m%d%H", "viirs_{}.tiff"),
    ("yyyyMMdd", "%Y%m%d", "img_{}.tif"),
)


def _named(spark, sf_dir):
    k = F.col("event_id") % 7
    name = F.lit("undated.tif")
    for i, (fmt, _, pattern) in enumerate(_NAMES):
        left, right = pattern.split("{}")
        name = F.when(k == i, F.concat(F.lit(left), F.date_format("ts", fmt), F.lit(right))).otherwise(name)
    return X.table(spark, sf_dir, "events").select("event_id", "ts", name.alias("file_name"))


_SECOND = "date_trunc('second', ts)"
_EXPECT = {  # per naming style: what each policy should read
    "daily": ("D", "S", "D", "S", "H", "D"),
    "subdaily": ("S", "S", "D", "S", "H", "D"),
    "earliest": ("D", "S", "D", "S", "H", "D"),
}
_UNIT = {"D": "date_trunc('day', ts)", "S": _SECOND, "H": "date_trunc('hour', ts)"}


def _policy_sql(policy: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {_UNIT[u]}" for i, u in enumerate(_EXPECT[policy]))
    return f"strftime(CASE event_id % 7 {whens} END, '%Y-%m-%d %H:%M:%S')"


@query(f"""
SELECT event_id, {", ".join(f"{_policy_sql(p)} AS ts_{p}" for p in _EXPECT)} FROM events
""")
def name_time_policies(spark, sf_dir):
    """Scene time from the file name under the three reading policies."""
    named = _named(spark, sf_dir)
    return named.select(
        "event_id",
        *[F.date_format(TP.timestamp_from_name(F.col("file_name"), p), "yyyy-MM-dd HH:mm:ss").alias(f"ts_{p}") for p in _EXPECT],
    )


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%dT%H%M%S')
                      WHEN event_id % 3 = 1 THEN strftime(ts, '%Y%j%H%M%S')
                      ELSE 'raw' || CAST(event_id AS VARCHAR) END AS stamp FROM events
""")
def clip_stamps(spark, sf_dir):
    """Clip names from the coverage attribute, else from the raw file name."""
    k = F.col("event_id") % 3
    attr = F.when(k == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.S"), F.lit("Z"))).otherwise(F.lit(""))
    name = F.when(k == 1, F.concat(F.lit("OR_ABI_s"), F.date_format("ts", "yyyyDDDHHmmss"), F.lit("_e1_c1.nc"))).otherwise(
        F.concat(F.lit("raw"), F.col("event_id").cast("string"), F.lit(".nc"))
    )
    return X.table(spark, sf_dir, "events").select("event_id", TP.clip_stamp(attr, name).alias("stamp"))


@query("""
SELECT event_id, CAST(user_id AS VARCHAR) AS fire_id, event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM events WHERE event_id % 4 <> 3
""")
def scene_manifest(spark, sf_dir):
    """Catalogue of raster paths: fire, sensor and time from the path; other files left out."""
    from ..sources.manifest import parse_scene_paths

    ext = F.when(F.col("event_id") % 4 == 3, ".txt").when(F.col("event_id") % 4 == 2, ".TIFF").otherwise(".tif")
    paths = X.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("/archive/"), F.col("user_id"), F.lit("/"), F.col("event_type"), F.lit("/"),
                 F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_x"), ext).alias("path"),
    )
    out = parse_scene_paths(paths)
    return out.select("event_id", "fire_id", "source", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS files FROM events WHERE event_id % 6 <> 5 GROUP BY 1
""")
def raw_manifest_days(spark, sf_dir):
    """Raw files per day from year/day-of-year directories."""
    from ..sources.manifest import parse_raw_paths

    ext = F.when(F.col("event_id") % 6 == 5, ".tmp").otherwise(".nc")
    paths = X.table(spark, sf_dir, "events").select(
        F.concat(F.lit("/raw/"), F.date_format("ts", "yyyy/DDD"), F.lit("/"), F.hour("ts"), F.lit("/OR_"),
                 F.col("event_id"), ext).alias("path")
    )
    return parse_raw_paths(paths).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("files"))


_EVENT_DIRS = """
d AS (SELECT DISTINCT CASE CAST(user_id AS BIGINT) % 3 WHEN 0 THEN '/goes/' WHEN 1 THEN '/goes/' || CAST(2017 + day(ts) % 4 AS VARCHAR) || '/'
             ELSE '/goes/batch/' || CAST(day(ts) AS VARCHAR) || '/' END || 'f' || CAST(user_id AS VARCHAR) AS dir, 'f' || CAST(user_id AS VARCHAR) AS fire_id FROM events)"""


def _event_dirs(spark, sf_dir):
    u, day = F.col("user_id"), F.dayofmonth("ts")
    root = F.when(u % 3 == 0, F.lit("/goes/")).when(
        u % 3 == 1, F.concat(F.lit("/goes/"), (2017 + day % 4).cast("string"), F.lit("/"))
    ).otherwise(F.concat(F.lit("/goes/batch/"), day.cast("string"), F.lit("/")))
    return X.table(spark, sf_dir, "events").select(F.concat(root, F.lit("f"), u.cast("string")).alias("dir")).distinct()


def _f_fires(spark, sf_dir):
    return X.table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("fire_id"))


@query(f"""
WITH {_EVENT_DIRS}
SELECT 'f' || CAST(c_custkey AS VARCHAR) AS fire_id, min(dir) AS event_dir
FROM customer LEFT JOIN d ON d.fire_id = 'f' || CAST(c_custkey AS VARCHAR) GROUP BY 1
""")
def event_dirs(spark, sf_dir):
    """Event directory of each fire: at the root, below a year, or anywhere."""
    from ..sources.manifest import resolve_event_dir

    return resolve_event_dir(_event_dirs(spark, sf_dir), _f_fires(spark, sf_dir), "/goes")


@query("""
WITH leaf AS (SELECT DISTINCT '/goes/' || CASE WHEN user_id % 4 = 0 THEN 'evt-' ELSE '' END || 'f' || lpad(CAST(user_id AS VARCHAR), 7, '0') || '/' || event_type AS dir,
              user_id, event_type FROM events WHERE event_type IN ('click', 'purchase'))
SELECT 'f' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS fire_id, dir, event_type AS source,
       CASE WHEN user_id % 4 = 0 THEN 'substring' ELSE 'segment' END AS match
FROM customer JOIN leaf ON user_id = c_custkey
""")
def event_sources(spark, sf_dir):
    """Leaf directories of each fire by path segment, by part of the path for fires left over."""
    from ..sources.manifest import resolve_event_sources

    u = F.col("user_id")
    padded = F.concat(F.lit("f"), F.lpad(u.cast("string"), 7, "0"))
    dirs = X.table(spark, sf_dir, "events").select(
        F.concat(F.lit("/goes/"), F.when(u % 4 == 0, "evt-").otherwise(""), padded, F.lit("/"), F.col("event_type")).alias("dir")
    ).distinct()
    fires = X.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("fire_id")
    )
    return resolve_event_sources(dirs, fires, ["click", "purchase"]).select("fire_id", "dir", "source", "match")


@query("""
WITH c AS (SELECT CAST(user_id AS VARCHAR) AS fire_id, CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'empty' WHEN 'purchase' THEN 'exists' WHEN 'error' THEN 'error' END AS status FROM events)
SELECT fire_id, count(status) AS input_files, count(*) FILTER (status = 'saved') AS saved_files, count(*) FILTER (status = 'empty') AS empty_files,
       count(*) FILTER (status = 'exists') AS existing_files, count(*) FILTER (status = 'error') AS error_files
FROM c GROUP BY fire_id
""")
def clip_outcomes(spark, sf_dir):
    """Saved, empty, existing and failed clips per fire."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "saved").when(kind == "click", "empty").when(kind == "purchase", "exists").when(kind == "error", "error")
    results = X.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fire_id"), status.alias("status"))
    return align.clip_outcomes(results)


@query("""
WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS fire_id, DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS day, CAST(c_custkey % 45 AS DOUBLE) * 2 AS lo FROM customer),
px AS (SELECT CAST(ts AS DATE) AS day, event_type AS file, value AS x, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS y FROM events),
pairs AS (SELECT DISTINCT f.fire_id, px.file, f.day, f.lo FROM f JOIN px USING (day)),
hit AS (SELECT DISTINCT p.fire_id, p.file FROM pairs p JOIN px ON px.day = p.day AND px.file = p.file AND px.x BETWEEN p.lo AND p.lo + 12 AND px.y BETWEEN p.lo AND p.lo + 9),
done AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS fire_id FROM orders WHERE o_orderstatus = 'P')
SELECT fire_id, count(*) AS input_files, count(*) FILTER (h AND NOT d) AS saved_files, count(*) FILTER (NOT h) AS empty_files, count(*) FILTER (h AND d) AS existing_files, CAST(0 AS BIGINT) AS error_files
FROM (SELECT p.fire_id, (p.fire_id, p.file) IN (SELECT (fire_id, file) FROM hit) AS h, p.fire_id IN (SELECT fire_id FROM done) AS d FROM pairs p) GROUP BY fire_id
""")
def clip_run(spark, sf_dir):
    """A whole clip run: each fire's day of files clipped to its box, outputs already there skipped, outcomes counted."""
    from ..operators.pixels import clipped_keys

    k, lo = F.col("key"), (F.col("key") % 45).cast("double") * 2
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int"))
    fires = X.fires(spark, sf_dir, "customer").select(
        "fire_id", day.alias("start_date"), day.alias("end_date"), lo.alias("x_min"), (lo + 12).alias("x_max"), lo.alias("y_min"), (lo + 9).alias("y_max"),
    )
    px = X.table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("file"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"),
    )
    files = px.select("day", "file").distinct()
    pairs = fires.select("fire_id", F.col("start_date").alias("day")).join(files, "day").select("fire_id", "file")
    done = X.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("fire_id"))
    done = pairs.join(done.distinct(), "fire_id", "left_semi")
    clipped = clipped_keys(px, fires, ["file"])
    return align.clip_outcomes(align.clip_status(pairs, clipped, done, ["fire_id", "file"]))


@query(_COVERAGE + "SELECT * FROM report ORDER BY fire_id LIMIT 10")
def coverage_preview(spark, sf_dir):
    """First ten rows of the coverage report."""
    return date_coverage(spark, sf_dir).orderBy("fire_id").limit(10)


@query("""
SELECT event_id FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
""")
def clips_to_do(spark, sf_dir):
    """Clips that have no output yet."""
    todo = X.table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id")
    done = X.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return align.not_yet_done(todo, done, ["event_id"])
