"""Queries: whole training sets, each vector of the embeddings table being one pixel of one frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import align
from ..operators import datasets as D
from . import fixtures as X
from .registry import query
from .windowing import IT, SCAN_BLOCK, TS, _windows

# Pixel (0, 0) of fire = label; bands from the vector, labels from two further elements.
_STACK = X.TILES + """,
st AS (SELECT fire_id, frame, n_frames, vec_id, embedding, embedding[41] > 0.15 AS af, embedding[42] > 0.15 AS peri FROM tiles)"""


def _stack(spark, sf_dir, n):
    def flag(i):
        return (F.get("embedding", F.lit(i)) > 0.15).cast("double")

    return X.tiles(spark, sf_dir).select(
        "fire_id", "frame", "n_frames", F.lit(0).alias("row"), F.lit(0).alias("col"),
        F.slice("embedding", 1, n).alias("x"), flag(40).alias("af"), flag(41).alias("perimeter"),
    )


def _vectors_sql(tail: str, length: int, n: int) -> str:
    return f"""
ch AS (SELECT fire_id, frame, i - 1 AS channel, CAST(embedding[i] AS DOUBLE) AS v FROM st, range(1, {n + 1}) AS g(i)),
pm AS MATERIALIZED (SELECT *, greatest(max(v) OVER (PARTITION BY fire_id, channel ORDER BY frame), 0.0) AS m FROM ch), {_windows(tail)},
idx AS MATERIALIZED (SELECT fire_id, w, j, s + j AS own, greatest(s + j, coalesce(sp + {length - 1}, -1)) AS peak,
                            greatest(s + j, coalesce(sp + {IT - 1}, -1)) AS base FROM winp CROSS JOIN range(0, {TS}) AS g(j)),
vec AS (SELECT idx.fire_id, w, j, a.channel, a.v AS raw, CASE WHEN a.channel IN (3, 4, 6, 7) THEN b.m ELSE a.v END AS v
        FROM idx JOIN pm a ON a.fire_id = idx.fire_id AND a.frame = own
        JOIN pm b ON b.fire_id = idx.fire_id AND b.frame = peak AND b.channel = a.channel)"""


def _long(df, *cols):
    return df.select("fire_id", "window_idx", "step", F.posexplode("x").alias("channel", "v"), *cols).withColumn(
        "v", F.round(F.col("v").cast("double"), 6)
    )


_KEYS = 'fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step'


@query(f"WITH {_STACK}, {_vectors_sql('drop', TS + 1, K.PRED_CHANNELS)} SELECT {_KEYS}, CAST(channel AS INTEGER) AS channel, round(v, 6) AS v FROM vec")
def growth_samples(spark, sf_dir):
    """27-channel inputs of every growth window, heat bands carried."""
    return _long(D.growth_samples(_stack(spark, sf_dir, K.PRED_CHANNELS), TS, IT, block=SCAN_BLOCK))


@query(f"""
WITH {_STACK}, {_windows("drop")},
f AS (SELECT fire_id, frame, max(CAST(af OR (CAST(fire_id AS INTEGER) % 2 = 0 AND peri) AS INTEGER)) OVER (PARTITION BY fire_id ORDER BY frame) AS final FROM st)
SELECT win.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(a.final = 1 AND b.final = 0 AS INTEGER) AS growth
FROM win JOIN f a ON a.fire_id = win.fire_id AND a.frame = s + {TS} JOIN f b ON b.fire_id = win.fire_id AND b.frame = s + {TS} - 1
""")
def growth_labels(spark, sf_dir):
    """Targets of the same windows, label selector by fire."""
    stack = _stack(spark, sf_dir, 8)
    out = D.growth_labels(stack, TS, IT, label_sel=F.col("fire_id").cast("int") % 2)
    return out.select("fire_id", "window_idx", "growth")


def _mapping_sql(task: str) -> str:
    value = "v" if task == "ba" else "raw"
    return f"""
WITH {_STACK}, {_vectors_sql("clamp", TS, K.CORE_CHANNELS)},
po AS (SELECT fire_id, frame, af, peri, max(CAST(af AS INTEGER)) OVER (PARTITION BY fire_id ORDER BY frame) AS acc FROM st),
lab AS MATERIALIZED (SELECT idx.fire_id, w, j, a.peri, a.af, b.acc FROM idx JOIN po a ON a.fire_id = idx.fire_id AND a.frame = own
        JOIN po b ON b.fire_id = idx.fire_id AND b.frame = base)
SELECT vec.fire_id, CAST(vec.w AS INTEGER) AS window_idx, CAST(vec.j AS INTEGER) AS step, CAST(channel AS INTEGER) AS channel, round({value}, 6) AS v,
       CAST(peri AS DOUBLE) AS perimeter, CAST(acc AS DOUBLE) AS af_so_far, CAST(af AS DOUBLE) AS af
FROM vec JOIN lab ON lab.fire_id = vec.fire_id AND lab.w = vec.w AND lab.j = vec.j
"""


def _mapping(spark, sf_dir, task):
    out = D.mapping_samples(_stack(spark, sf_dir, K.CORE_CHANNELS), task, TS, IT, block=SCAN_BLOCK)
    planes = [F.get("y", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("perimeter", "af_so_far", "af"))]
    return _long(out, *planes)


_AF_SQL = f"""
WITH {_STACK}, {_windows("clamp")},
idx AS MATERIALIZED (SELECT fire_id, w, j, s + j AS own, greatest(s + j, coalesce(sp + {IT - 1}, -1)) AS base FROM winp CROSS JOIN range(0, {TS}) AS g(j)),
po AS MATERIALIZED (SELECT fire_id, frame, embedding, af, peri, max(CAST(af AS INTEGER)) OVER (PARTITION BY fire_id ORDER BY frame) AS acc FROM st)
SELECT idx.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, CAST(i - 1 AS INTEGER) AS channel,
       round(CAST(a.embedding[i] AS DOUBLE), 6) AS v, CAST(a.peri AS DOUBLE) AS perimeter, CAST(b.acc AS DOUBLE) AS af_so_far, CAST(a.af AS DOUBLE) AS af
FROM idx JOIN po a ON a.fire_id = idx.fire_id AND a.frame = own JOIN po b ON b.fire_id = idx.fire_id AND b.frame = base
CROSS JOIN range(1, {K.CORE_CHANNELS + 1}) AS c(i)
"""


@query(_AF_SQL)
def active_fire_samples(spark, sf_dir):
    """8-channel inputs and label planes of active-fire windows."""
    return _mapping(spark, sf_dir, "af")


@query(_mapping_sql("ba"))
def burned_area_samples(spark, sf_dir):
    """8-channel inputs, heat bands carried, and label planes of burned-area windows."""
    return _mapping(spark, sf_dir, "ba")


@query(f"""
WITH {X.MEASURES},
b AS (SELECT fire_id, CAST(ts AS DATE) AS day, (hour(ts) * 60 + minute(ts)) // 360 AS bin, max(hot) FILTER (kind = 'mask') AS ac, max(frp) FILTER (kind = 'frp') AS fx FROM measures GROUP BY ALL),
tiles AS (SELECT fire_id, ts, row_number() OVER (PARTITION BY fire_id ORDER BY ts, file_name) - 1 AS frame, count(*) OVER (PARTITION BY fire_id) AS n_frames
          FROM scenes WHERE source = 'viirs_day'), {_windows("drop")}
SELECT win.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, CAST(k AS INTEGER) AS bin, round(coalesce(ac, 0.0), 4) AS active_pixel_count, round(coalesce(fx, 0.0), 4) AS frp_max
FROM win CROSS JOIN range(0, {TS}) AS g(j) CROSS JOIN range(0, 4) AS h(k) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
LEFT JOIN b ON b.fire_id = win.fire_id AND b.day = CAST(tiles.ts AS DATE) AND b.bin = k
""")
def goes_bin_samples(spark, sf_dir):
    """Sub-daily matrices (6-hour bins) of every window step."""
    day = X.scenes(spark, sf_dir, "viirs_day").select("fire_id", "ts", "file_name")
    bins = align.subdaily_rollup(X.measures(spark, sf_dir), 360)
    out = D.goes_bin_samples(day, bins, TS, IT, 360)
    return out.select("fire_id", "window_idx", "step", F.posexplode("bins").alias("bin", "f")).select(
        "fire_id", "window_idx", "step", "bin", F.round(F.col("f")[0].cast("double"), 4).alias("active_pixel_count"),
        F.round(F.col("f")[3].cast("double"), 4).alias("frp_max"),
    )


@query(f"""
WITH {X.MEASURES},
b AS (SELECT fire_id, CAST(ts AS DATE) AS day, (hour(ts) * 60 + minute(ts)) // 360 AS bin, max(hot) FILTER (kind = 'mask') AS ac, max(frp) FILTER (kind = 'frp') AS fx FROM measures GROUP BY ALL),
tiles AS (SELECT fire_id, ts, value, code, row_number() OVER (PARTITION BY fire_id ORDER BY ts, file_name) - 1 AS frame, count(*) OVER (PARTITION BY fire_id) AS n_frames
          FROM scenes WHERE source = 'viirs_day'), {_windows("drop")},
hot AS (SELECT fire_id, frame, code > 60 AS h, count(*) FILTER (code > 60) OVER (PARTITION BY fire_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tiles)
SELECT win.fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, CAST(k AS INTEGER) AS bin, round(tiles.value, 3) AS band,
  round(ln(1 + greatest(coalesce(ac, 0.0), 0)), 4) AS active_pixels, round(ln(1 + greatest(coalesce(fx, 0.0), 0)), 4) AS frp_max, CAST(hot.h AND hot.before = 0 AS INTEGER) AS growth
FROM win CROSS JOIN range(0, {TS}) AS g(j) CROSS JOIN range(0, 4) AS h(k) JOIN tiles ON tiles.fire_id = win.fire_id AND tiles.frame = s + j
JOIN hot ON hot.fire_id = win.fire_id AND hot.frame = s + {TS}
LEFT JOIN b ON b.fire_id = win.fire_id AND b.day = CAST(tiles.ts AS DATE) AND b.bin = k
""")
def paired_growth_samples(spark, sf_dir):
    """Growth windows with image step, GOES bins and target in one row; each day scene is one pixel."""
    from ..operators.scenes import frame_index

    day = X.scenes(spark, sf_dir, "viirs_day").select("fire_id", "ts", "file_name", "value", "code")
    stack = frame_index(day).select(
        "fire_id", "frame", "n_frames", F.lit(0).alias("row"), F.lit(0).alias("col"),
        F.array_repeat(F.col("value").cast("float"), K.PRED_CHANNELS).alias("x"), (F.col("code") > 60).cast("double").alias("af"), F.lit(0.0).alias("perimeter"))
    bins = align.subdaily_rollup(X.measures(spark, sf_dir), 360)
    goes = D.goes_bin_samples(day.select("fire_id", "ts", "file_name"), bins, TS, IT, 360)
    out = D.paired_growth_samples(D.growth_samples(stack, TS, IT), goes, D.growth_labels(stack, TS, IT))
    return out.select("fire_id", "window_idx", "step", F.get("x", F.lit(0)).alias("band"), "growth", F.posexplode("bins").alias("bin", "f")).select(
        "fire_id", "window_idx", "step", "bin", F.round(F.col("band").cast("double"), 3).alias("band"),
        F.round(F.col("f")[0].cast("double"), 4).alias("active_pixels"), F.round(F.col("f")[3].cast("double"), 4).alias("frp_max"), "growth")


# --- frames that cannot be used ------------------------------------------------------------

# Every seventh vector stands for a scene with an incomplete night file.
_BROKEN = 7
_STATE = f"""
WITH {X.TILES},
st AS MATERIALIZED (SELECT fire_id, CAST(frame AS INTEGER) AS frame, n_frames, vec_id % {_BROKEN} <> 3 AS ok, embedding,
  embedding[41] > 0.15 AS af, embedding[42] > 0.15 AS peri FROM tiles),"""


def _seen_sql(hit: str, end: str) -> str:
    """Whether a window knows a hit: in its own usable frames up to ``end``, or handed on by an earlier window."""
    return f"""EXISTS (SELECT 1 FROM st k WHERE k.fire_id = win.fire_id AND k.ok AND {hit} AND (k.frame BETWEEN s AND {end} OR EXISTS (
      SELECT 1 FROM win v JOIN st z ON z.fire_id = v.fire_id AND z.frame = v.s + {IT - 1}
      WHERE v.fire_id = win.fire_id AND v.w < win.w AND z.ok AND k.frame BETWEEN v.s AND v.s + {IT - 1})))"""


def _usable_scenes(spark, sf_dir, how):
    from ..operators.scenes import number_frames

    raw = X.table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("fire_id"), "vec_id", "embedding")
    return number_frames(raw, skipped=how, usable=F.col("vec_id") % _BROKEN != 3, order=["vec_id"], segment=X.block_segment("vec_id", X.VEC_BLOCK))


def _stack_of(tiles, n):
    def flag(i):
        return (F.get("embedding", F.lit(i)) > 0.15).cast("double")

    stack = tiles.select(
        "fire_id", "frame", "n_frames", F.lit(0).alias("row"), F.lit(0).alias("col"),
        F.slice("embedding", 1, n).alias("x"), flag(40).alias("af"), flag(41).alias("perimeter"))
    return stack, tiles.where(~F.col("usable")).select("fire_id", "frame", "n_frames")


def _kept_sql(tail: str, length: int, n: int) -> str:
    return f"""
{_windows(tail, "st")},
idx AS MATERIALIZED (SELECT fire_id, w, j, s, s + j AS own, greatest(s + j, coalesce(sp + {length - 1}, -1)) AS peak FROM winp CROSS JOIN range(0, {TS}) AS g(j)),
ch AS (SELECT fire_id, frame, ok, i - 1 AS channel, CAST(embedding[i] AS DOUBLE) AS v FROM st, range(1, {n + 1}) AS g(i)),
pm AS MATERIALIZED (SELECT *, greatest(coalesce(max(CASE WHEN ok THEN v END) OVER (PARTITION BY fire_id, channel ORDER BY frame), 0.0), 0.0) AS m FROM ch),
vec AS (SELECT idx.fire_id, idx.w, idx.j, idx.s, a.channel, a.ok, CASE WHEN NOT a.ok THEN 0.0 WHEN a.channel IN (3, 4, 6, 7) THEN b.m ELSE a.v END AS v
        FROM idx JOIN pm a ON a.fire_id = idx.fire_id AND a.frame = own
        JOIN pm b ON b.fire_id = idx.fire_id AND b.frame = peak AND b.channel = a.channel)"""


_LONG_KEYS = "fire_id, CAST(w AS INTEGER) AS window_idx, CAST(j AS INTEGER) AS step, CAST(channel AS INTEGER) AS channel"


@query(f"{_STATE} {_kept_sql('drop', TS + 1, K.PRED_CHANNELS)} SELECT {_LONG_KEYS}, round(v, 6) AS v FROM vec")
def growth_samples_kept(spark, sf_dir):
    """Growth inputs with unusable frames kept as steps of zeros."""
    stack, skipped = _stack_of(_usable_scenes(spark, sf_dir, "reference"), K.PRED_CHANNELS)
    return _long(D.growth_samples(stack, TS, IT, block=SCAN_BLOCK, skipped=skipped))


@query(f"""
WITH tiles AS (SELECT CAST(label AS VARCHAR) AS fire_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
  count(*) OVER (PARTITION BY label) AS n_frames FROM embeddings WHERE vec_id % {_BROKEN} <> 3),
st AS (SELECT * FROM tiles), {_vectors_sql('drop', TS + 1, K.PRED_CHANNELS)} SELECT {_KEYS}, CAST(channel AS INTEGER) AS channel, round(v, 6) AS v FROM vec
""")
def growth_samples_dropped(spark, sf_dir):
    """Growth inputs with unusable frames left out before frames are numbered."""
    stack, _ = _stack_of(_usable_scenes(spark, sf_dir, "drop"), K.PRED_CHANNELS)
    return _long(D.growth_samples(stack, TS, IT, block=SCAN_BLOCK))


_FINAL = "(k.af OR (CAST(k.fire_id AS INTEGER) % 2 = 0 AND k.peri))"


@query(f"""
{_STATE} {_windows("drop", "st")}
SELECT win.fire_id, CAST(win.w AS INTEGER) AS window_idx,
  CAST(t.ok AND (t.af OR (CAST(t.fire_id AS INTEGER) % 2 = 0 AND t.peri)) AND NOT {_seen_sql(_FINAL, f"s + {TS - 1}")} AS INTEGER) AS growth
FROM win JOIN st t ON t.fire_id = win.fire_id AND t.frame = win.s + {TS}
""")
def growth_labels_kept(spark, sf_dir):
    """Growth targets where skipped frames burn nothing, hand no union on and, as target days, have no growth."""
    stack, skipped = _stack_of(_usable_scenes(spark, sf_dir, "reference"), 8)
    out = D.growth_labels(stack, TS, IT, label_sel=F.col("fire_id").cast("int") % 2, skipped=skipped)
    return out.select("fire_id", "window_idx", "growth")


def _mapping_kept_sql(heat: str) -> str:
    return f"""
{_STATE} {_kept_sql("clamp", TS, K.CORE_CHANNELS)},
seen AS MATERIALIZED (SELECT win.fire_id, win.w, j, {_seen_sql("k.af", "s + j")} AS acc FROM win CROSS JOIN range(0, {TS}) AS g(j))
SELECT vec.fire_id, CAST(vec.w AS INTEGER) AS window_idx, CAST(vec.j AS INTEGER) AS step, CAST(channel AS INTEGER) AS channel,
  round({heat}, 6) AS v, CAST(o.ok AND o.peri AS DOUBLE) AS perimeter, CAST(o.ok AND acc AS DOUBLE) AS af_so_far, CAST(o.ok AND o.af AS DOUBLE) AS af
FROM vec JOIN seen ON seen.fire_id = vec.fire_id AND seen.w = vec.w AND seen.j = vec.j
JOIN st o ON o.fire_id = vec.fire_id AND o.frame = vec.s + vec.j
"""


def _mapping_kept(spark, sf_dir, task):
    stack, skipped = _stack_of(_usable_scenes(spark, sf_dir, "reference"), K.CORE_CHANNELS)
    out = D.mapping_samples(stack, task, TS, IT, block=SCAN_BLOCK, skipped=skipped)
    return _long(out, *[F.get("y", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("perimeter", "af_so_far", "af"))])


@query(_mapping_kept_sql("v"))
def burned_area_samples_kept(spark, sf_dir):
    """Burned-area windows with unusable frames kept as steps of zeros."""
    return _mapping_kept(spark, sf_dir, "ba")


@query(_mapping_kept_sql("CASE WHEN o.ok THEN CAST(o.embedding[channel + 1] AS DOUBLE) ELSE 0.0 END"))
def active_fire_samples_kept(spark, sf_dir):
    """Active-fire windows with unusable frames kept as steps of zeros."""
    return _mapping_kept(spark, sf_dir, "af")


@query(f"""
{_STATE} {_windows("drop", "st")}
SELECT win.fire_id, CAST(win.w AS INTEGER) AS window_idx, CAST(win.s AS INTEGER) AS start_idx, CAST(j AS INTEGER) AS step,
  CAST(o.ok AND {_seen_sql("k.af", "s + j")} AS INTEGER) AS burned, CAST(o.ok AND {_seen_sql("k.peri", "s + j")} AS INTEGER) AS perimeter
FROM win CROSS JOIN range(0, {TS}) AS g(j) JOIN st o ON o.fire_id = win.fire_id AND o.frame = win.s + j
""")
def running_union_kept(spark, sf_dir):
    """Running unions across skipped frames: a window that cannot hand its union on loses the frames in between."""
    from ..operators import windows as W

    stack, skipped = _stack_of(_usable_scenes(spark, sf_dir, "reference"), 1)
    labels = {"burned": F.col("af") > 0, "perimeter": F.col("perimeter") > 0}
    return W.carried_union(stack, labels, TS, IT, "drop", skipped=skipped).select(
        "fire_id", "window_idx", "start_idx", "step", "burned", "perimeter")


# --- active-fire test --------------------------------------------------------------------------

# Sixty vectors make three fires, of 7, 20 and 33 scenes of 4 x 4 pixels (column 1 holds data, the middle rows are kept).
_TEST_FIRE = "vec_id // 60 || '_' || CASE WHEN vec_id % 60 < 7 THEN 'a' WHEN vec_id % 60 < 27 THEN 'b' ELSE 'c' END"


@query(f"""
WITH sc AS (SELECT {_TEST_FIRE} AS fire_id, vec_id, embedding, vec_id % 11 <> 4 AND (vec_id % 13 <> 5 OR vec_id % 5 = 0) AS ok,
  row_number() OVER (PARTITION BY {_TEST_FIRE} ORDER BY vec_id) - 1 AS frame, count(*) OVER (PARTITION BY {_TEST_FIRE}) AS n FROM embeddings),
px AS MATERIALIZED (SELECT fire_id, frame, n, ok, p - 1 AS r, list_transform(range(1, 9),
    lambda i: CASE WHEN i > 6 AND vec_id % 5 = 0 THEN 0.0 ELSE CAST(CAST(300 + 60 * CAST(embedding[10 * p + i] AS DOUBLE) AS FLOAT) AS DOUBLE) END) AS x
  FROM sc, range(1, 3) AS g(p)),
places AS (SELECT DISTINCT fire_id, r, b AS block, pos FROM px, range(0, 4) AS g(b), range(0, 10) AS h(pos) WHERE b * 10 < n),
win AS (SELECT w, CASE WHEN w * 3 + 4 > 10 THEN 6 ELSE w * 3 END AS s FROM range(0, 4) AS g(w)),
full_ AS MATERIALIZED (SELECT l.fire_id, l.r, l.block, l.pos, coalesce(ok, false) AS ok, x,
    coalesce(ok AND (x[4] > 303 + l.pos OR x[5] > 304 + l.pos OR x[7] > 302 + l.pos OR x[8] > 305 - l.pos), false) AS af
  FROM places l LEFT JOIN px ON px.fire_id = l.fire_id AND px.r = l.r AND px.frame = l.block * 10 + l.pos)
SELECT fire_id, CAST(block AS INTEGER) AS block, CAST(w AS INTEGER) AS window_idx, CAST(s AS INTEGER) AS start_idx, CAST(pos - s AS INTEGER) AS step,
  CAST(r AS INTEGER) AS "row", CAST(i AS INTEGER) AS channel, round(CASE WHEN ok THEN x[i + 1] ELSE 0.0 END, 3) AS v, CAST(af AS INTEGER) AS af
FROM full_ JOIN win ON pos >= s AND pos < s + 4 CROSS JOIN range(0, 8) AS c(i)
""")
def active_fire_test_samples(spark, sf_dir):
    """Active-fire test samples: blocks of ten scenes, windows of four, fires of 7, 20 and 33 scenes, some unusable."""
    v, of_sixty = F.col("vec_id"), F.col("vec_id") % 60
    part = F.when(of_sixty < 7, "a").when(of_sixty < 27, "b").otherwise("c")
    raw = X.table(spark, sf_dir, "embeddings").select(
        F.concat(F.floor(v / 60).cast("string"), F.lit("_"), part).alias("fire_id"),
        F.timestamp_seconds(v * 86400).cast("timestamp_ntz").alias("ts"), "vec_id", "embedding")
    scenes = raw.select(
        "fire_id", "ts", F.lpad(v.cast("string"), 12, "0").alias("file_name"), F.when(v % 11 == 4, 7).otherwise(8).alias("n_bands"),
        F.lit(4).alias("height"), F.lit(4).alias("width"), F.when(v % 5 != 0, F.when(v % 13 == 5, 1).otherwise(2)).alias("night_bands"),
        F.when(v % 5 != 0, 4).alias("night_height"), F.when(v % 5 != 0, 4).alias("night_width"))
    pixel = raw.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3))))

    def bands(first, n):
        heat = [(300 + 60 * F.get("embedding", 10 * F.col("p") + (first + i - 1)).cast("double")).cast("float") for i in range(n)]
        return pixel.select("fire_id", "ts", F.col("p").alias("row"), F.lit(1).alias("col"), "vec_id", F.array(*heat).alias("bands"))

    day = bands(1, 8)
    night = bands(7, 2).where(v % 5 != 0).withColumn("bands", F.when(v % 13 == 5, F.slice("bands", 1, 1)).otherwise(F.col("bands")))
    th = scenes.select("fire_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "fire_id", "pos", (303.0 + F.col("pos")).alias("day_i4"), (304.0 + F.col("pos")).alias("day_i5"),
        (302.0 + F.col("pos")).alias("night_i4"), (305.0 - F.col("pos")).alias("night_i5"))
    out = D.active_fire_test(scenes, day.drop("vec_id"), night.drop("vec_id"), th, 4, 3, size=2)
    return out.select("fire_id", "block", "window_idx", "start_idx", "step", "row", F.posexplode("x").alias("channel", "v"), "af").withColumn(
        "v", F.round(F.col("v").cast("double"), 3))
