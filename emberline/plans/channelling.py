"""Queries: channel vectors and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import channels as C
from ..functions import geo as G
from ..operators import pixels as P
from . import fixtures as X
from .registry import query

N = K.PRED_CHANNELS


def _scaled(spark, sf_dir):
    """The first 27 elements as raw channels: degrees to 0..360, land cover to 0..17, some values missing."""
    e = [v.cast("double") for v in C.elements(F.col("embedding"), N)]
    out = []
    for i, v in enumerate(e):
        if i in K.DEGREE_CHANNELS:
            out.append(F.pmod(F.abs(v) * 1000.0, F.lit(360.0)))
        elif i == K.LANDCOVER_CHANNEL:
            out.append(F.floor(F.pmod(F.abs(v) * 1000.0, F.lit(18.0))).cast("double"))
        else:
            out.append(F.when((F.col("vec_id") + i) % 11 == 0, F.lit(float("nan"))).otherwise(v * 100.0))
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.array(*out).alias("x"))


_SCALED = f"""
e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS channel, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, {N + 1}) AS g(i)),
raw AS (
  SELECT vec_id, channel, CASE WHEN channel IN (12, 18, 24) THEN fmod(abs(v) * 1000.0, 360.0)
         WHEN channel = 21 THEN floor(fmod(abs(v) * 1000.0, 18.0))
         WHEN (vec_id + channel) % 11 = 0 THEN 'NaN'::DOUBLE ELSE v * 100.0 END AS v FROM e),
clean AS (SELECT vec_id, channel, CASE WHEN isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS v FROM raw)"""


def _consts(name: str, mean, std) -> str:
    rows = ", ".join(f"({i}, {m}::DOUBLE, {s}::DOUBLE)" for i, (m, s) in enumerate(zip(mean, std)))
    return f"{name}(channel, mean, std) AS (VALUES {rows})"


_PRED = _consts("k", K.PRED_MEAN, K.PRED_STD)
_AF = _consts("k", K.AF_MEAN, K.AF_STD)


def _long(df, x="x", keys=("vec_id",)):
    # The outer form keeps Catalyst from repeating the whole vector expression in an inferred filter.
    return df.select(*keys, F.posexplode_outer(x).alias("channel", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {_SCALED} SELECT vec_id, channel, round(v, 6) AS v FROM clean")
def clean_vectors(spark, sf_dir):
    """NaN and infinities to 0."""
    return _long(_scaled(spark, sf_dir).withColumn("x", C.clean_vector(F.col("x"), N)))


@query(f"""
WITH {_SCALED}, {_PRED}
SELECT vec_id, channel, round(CASE WHEN channel IN (12, 18, 24, 21) THEN v ELSE (v - mean) / std END, 6) AS v FROM clean JOIN k USING (channel)
""")
def zscore(spark, sf_dir):
    """Published constants, direction and land-cover channels left alone."""
    cleaned = C.clean_vector(F.col("x"), N)
    return _long(_scaled(spark, sf_dir).withColumn("x", C.pred_zscore(cleaned)))


@query(f"""
WITH {_SCALED}, {_AF}
SELECT vec_id, channel, round((v - mean) / std, 6) AS v FROM clean JOIN k USING (channel)
""")
def zscore_af(spark, sf_dir):
    cleaned = C.clean_vector(F.col("x"), K.CORE_CHANNELS)
    return _long(_scaled(spark, sf_dir).withColumn("x", C.zscore(cleaned, K.AF_MEAN, K.AF_STD)))


@query(f"""
WITH {_SCALED}
SELECT vec_id, channel, round(CASE WHEN channel IN (12, 18, 24) THEN sin(radians(v)) ELSE v END, 6) AS v FROM clean
""")
def sin_encode(spark, sf_dir):
    cleaned = C.clean_vector(F.col("x"), N)
    return _long(_scaled(spark, sf_dir).withColumn("x", C.sin_degrees(cleaned)))


@query("""
SELECT p_partkey, CAST(k AS INTEGER) AS class,
       CAST(CASE WHEN p_size % 18 = 0 THEN 17 ELSE p_size % 18 END = k AS DOUBLE) AS reference_mode,
       CAST(p_size % 18 = k AS DOUBLE) AS strict_mode
FROM part, range(1, 18) AS g(k)
""")
def one_hot(spark, sf_dir):
    """Land cover to 17 indicators in both modes for class 0."""
    code = F.col("p_size") % 18
    pairs = F.arrays_zip(
        F.array(*C.landcover_one_hot(code, "reference")).alias("a"), F.array(*C.landcover_one_hot(code, "strict")).alias("b")
    )
    rows = X.table(spark, sf_dir, "part").select("p_partkey", F.posexplode(pairs).alias("i", "z"))
    return rows.select("p_partkey", (F.col("i") + 1).alias("class"), F.col("z")["a"].alias("reference_mode"), F.col("z")["b"].alias("strict_mode"))


@query(f"""
WITH {_SCALED}, {_PRED},
z AS (SELECT vec_id, channel, v, CASE WHEN channel IN (12, 18, 24) THEN sin(radians(v)) ELSE (v - mean) / std END AS y FROM clean JOIN k USING (channel)),
lc AS (SELECT vec_id, CAST(21 + i AS INTEGER) AS channel, CAST(CASE WHEN v = 0 THEN 17 ELSE v END = i + 1 AS DOUBLE) AS y FROM clean, range(0, 17) AS g(i) WHERE channel = 21)
SELECT vec_id, CASE WHEN channel > 21 THEN channel + 16 ELSE channel END AS channel, round(y, 6) AS v FROM z WHERE channel <> 21
UNION ALL SELECT vec_id, channel, y FROM lc
""")
def encode_pred43(spark, sf_dir):
    """The full 43-channel encoding: clean, z-score, sine, one-hot spliced in."""
    return _long(_scaled(spark, sf_dir).withColumn("x", C.project_feature_set(F.col("x"), "pred_full43")))


@query(f"""
WITH {_SCALED}
SELECT vec_id, channel, round(v, 6) AS v FROM clean WHERE channel < 8
""")
def feature_set_core8(spark, sf_dir):
    """Feature-set projection: the eight core channels."""
    cleaned = C.clean_vector(F.col("x"), N)
    return _long(_scaled(spark, sf_dir).withColumn("x", C.project_feature_set(cleaned, "af_core8")))


@query(f"""
WITH {_SCALED},
m AS (SELECT vec_id, channel, v, max(v) OVER (PARTITION BY channel, vec_id // 5 ORDER BY vec_id) AS peak FROM clean WHERE channel < 8)
SELECT vec_id, channel, round(v, 6) AS af, round(CASE WHEN channel IN (3, 4, 6, 7) THEN peak ELSE v END, 6) AS ba FROM m
""")
def compose_task(spark, sf_dir):
    """Raw bands for active fire, running maximum on heat bands for burned area (groups of five tiles)."""
    from pyspark.sql import Window

    base = _scaled(spark, sf_dir).withColumn("x", C.clean_vector(F.col("x"), 8))
    group = Window.partitionBy(F.floor(F.col("vec_id") / 5)).orderBy("vec_id")  # five rows a group
    peak = F.array(*[F.max(v).over(group) for v in C.elements(F.col("x"), 8)])
    both = base.withColumn("peak", peak).select(
        "vec_id", F.posexplode(F.arrays_zip(
            C.compose(F.col("x"), F.col("peak"), "af", 8).alias("a"), C.compose(F.col("x"), F.col("peak"), "ba", 8).alias("b")
        )).alias("channel", "z"),
    )
    return both.select("vec_id", "channel", F.round(F.col("z")["a"], 6).alias("af"), F.round(F.col("z")["b"], 6).alias("ba"))


@query("""
SELECT vec_id, CAST(i AS INTEGER) AS channel, round(CAST(embedding[3 + i] AS DOUBLE), 6) AS v FROM embeddings, range(0, 6) AS g(i)
""")
def channel_subset(spark, sf_dir):
    """Six-channel mode: the first two of eight channels dropped."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("x"))
    return _long(e.withColumn("x", C.drop_first(F.col("x")).cast("array<double>")))


@query(f"""
WITH {X.PIXELS}
SELECT fire_id, CAST(frame AS INTEGER) AS frame, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
       CAST(NOT v > {X.BURN_LEVEL} AS INTEGER) AS background, CAST(v > {X.BURN_LEVEL} AS INTEGER) AS fire,
       CAST(v > 0.05 AS DOUBLE) AS any_af, CASE CAST(fire_id AS INTEGER) % 3 WHEN 0 THEN round(v, 6) WHEN 1 THEN CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END
       ELSE CASE WHEN v > 0.1 THEN 1.0 ELSE 0.0 END END AS selected
FROM px
""")
def targets(spark, sf_dir):
    """Two-channel target, and the pair of any active fire and the selected label plane."""
    px = X.tile_pixels(spark, sf_dir)
    v = F.col("v")
    y = F.when(v > X.BURN_LEVEL, 1).otherwise(0)
    planes = F.array(F.round(v, 6), F.when(v > 0.05, 1.0).otherwise(0.0), F.when(v > 0.1, 1.0).otherwise(0.0))
    two = C.binary_target(y)
    pair = C.target_pair(planes, F.col("fire_id").cast("int") % 3)
    return px.select("fire_id", "frame", "row", "col", two[0].alias("background"), two[1].alias("fire"),
                     pair[0].alias("any_af"), pair[1].alias("selected"))


@query(f"""
WITH {X.MEASURES}
SELECT fire_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(ln(1 + greatest(value - 50, 0.0)), 6) AS squashed FROM measures WHERE kind = 'frp'
""")
def goes_squash(spark, sf_dir):
    frp = X.scenes(spark, sf_dir, "frp")
    return frp.select("fire_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.round(C.squash(F.col("value") - 50), 6).alias("squashed"))


_PLAN = """
coin AS (SELECT vec_id, md5(CAST(vec_id AS VARCHAR) || ':7') AS h FROM embeddings),
plan AS (SELECT vec_id, ascii(h[1]) % 2 = 1 AS hflip, ascii(h[2]) % 2 = 1 AS vflip, (ascii(h[3]) % 2) * 2 + ascii(h[4]) % 2 AS turns FROM coin)"""


@query(f"""
WITH {X.PIXELS}, {_PLAN},
a AS (SELECT px.vec_id, turns, CASE WHEN vflip THEN 7 - r ELSE r END AS r, CASE WHEN hflip THEN 7 - c ELSE c END AS c, v, hflip, vflip,
             fmod(abs(v) * 1000.0, 360.0) AS angle FROM px JOIN plan USING (vec_id)),
b AS (SELECT *, CASE WHEN hflip THEN 360.0 - angle ELSE angle END AS a1 FROM a),
d AS (SELECT *, CASE WHEN vflip THEN fmod(fmod(180.0 - a1, 360.0) + 360.0, 360.0) ELSE a1 END AS a2 FROM b)
SELECT vec_id, CAST(CASE turns WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r WHEN 3 THEN c ELSE r END AS INTEGER) AS "row",
       CAST(CASE turns WHEN 1 THEN r WHEN 2 THEN 7 - c WHEN 3 THEN 7 - r ELSE c END AS INTEGER) AS col, round(v, 6) AS v,
       round(CASE WHEN turns > 0 THEN fmod(fmod(a2 - 90.0 * turns, 360.0) + 360.0, 360.0) ELSE a2 END, 6) AS angle
FROM d
""")
def augment(spark, sf_dir):
    """Seeded flips and quarter turns of every tile, direction channels repaired."""
    plan = C.augmentation_plan(F.col("vec_id"), 7)
    px = X.tile_pixels(spark, sf_dir).withColumns(plan)
    out = C.augment(px, X.TILE_SIDE)
    angle = C.turn_angle(F.pmod(F.abs(F.col("v")) * 1000.0, F.lit(360.0)))
    return out.select("vec_id", "row", "col", F.round("v", 6).alias("v"), F.round(angle, 6).alias("angle"))


# --- rasters ------------------------------------------------------------------------------

@query(f"""
WITH {X.PIXELS},
n AS (SELECT *, CASE WHEN (r + c + vec_id) % 9 = 0 THEN NULL ELSE v END AS y FROM px),
s AS (SELECT *, coalesce(y, avg(y) OVER (PARTITION BY vec_id)) AS f FROM n)
SELECT vec_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
       round((f - avg(f) OVER (PARTITION BY vec_id)) / stddev_pop(f) OVER (PARTITION BY vec_id), 5) + 0.0 AS v FROM s
""")
def standardise_scene(spark, sf_dir):
    """Per-scene standardisation with NaN taking the scene mean."""
    px = X.tile_pixels(spark, sf_dir)
    hole = (F.col("row") + F.col("col") + F.col("vec_id")) % 9 == 0
    px = px.withColumn("v", F.when(hole, F.lit(float("nan"))).otherwise(F.col("v")))
    out = P.standardise_scene(px, "v", ["vec_id"])
    return out.select("vec_id", "row", "col", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""
WITH {X.PIXELS},
n AS (SELECT *, CASE WHEN (r + c + vec_id) % 9 = 0 THEN NULL WHEN vec_id % 10 = 0 THEN 3.0 ELSE v END AS y FROM px),
s AS (SELECT *, min(y) OVER (PARTITION BY vec_id) AS lo, max(y) OVER (PARTITION BY vec_id) AS hi FROM n)
SELECT vec_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
       round(CASE WHEN y IS NULL OR hi = lo THEN 0.0 ELSE (y - lo) / (hi - lo) END, 6) AS v FROM s
""")
def minmax_scene(spark, sf_dir):
    """Per-scene min-max normalisation; constant scenes give 0."""
    px = X.tile_pixels(spark, sf_dir)
    hole = (F.col("row") + F.col("col") + F.col("vec_id")) % 9 == 0
    flat = F.when(F.col("vec_id") % 10 == 0, 3.0).otherwise(F.col("v"))
    px = px.withColumn("v", F.when(hole, F.lit(float("nan"))).otherwise(flat))
    return P.minmax_scene(px, "v", ["vec_id"]).select("vec_id", "row", "col", F.round("v", 6).alias("v"))


@query(f"""
WITH {X.PIXELS}
SELECT t.vec_id, CAST(i // 10 AS INTEGER) AS "row", CAST(i % 10 AS INTEGER) AS col, round(coalesce(v, 0.0), 6) AS v
FROM (SELECT vec_id FROM tiles) t CROSS JOIN range(0, 120) AS g(i) LEFT JOIN px ON px.vec_id = t.vec_id AND r = i // 10 AND c = i % 10
""")
def zero_pad(spark, sf_dir):
    """8×8 tiles grown with zeros to 12×10, twice a 6×5 raster."""
    px = X.tile_pixels(spark, sf_dir).select("vec_id", "row", "col", "v")
    return P.zero_pad(px, ["vec_id"], 6, 5).withColumn("v", F.round("v", 6))


@query(f"""
WITH {X.PIXELS}
SELECT vec_id, CAST(r // 4 AS INTEGER) AS "row", CAST(c // 4 AS INTEGER) AS col, round(avg(v), 6) AS v FROM px GROUP BY ALL
""")
def block_mean(spark, sf_dir):
    out = P.block_mean(X.tile_pixels(spark, sf_dir), ["vec_id"], 4)
    return out.withColumn("v", F.round("v", 6))


@query(f"""
WITH {X.PIXELS}
SELECT fire_id, CAST(r + (vec_id % 4) * 4 AS INTEGER) AS y, CAST(c + (vec_id % 3) * 4 AS INTEGER) AS x, round(max(v), 6) AS v FROM px GROUP BY ALL
""")
def mosaic_max(spark, sf_dir):
    """Overlapping tiles of each fire on one grid, maximum on overlap."""
    k = F.col("vec_id")
    px = X.tile_pixels(spark, sf_dir).withColumns(
        {"y": (F.col("row") + (k % 4) * 4).cast("int"), "x": (F.col("col") + (k % 3) * 4).cast("int")}
    )
    return P.mosaic_max(px, ["fire_id", "y", "x"]).withColumn("v", F.round("v", 6))


@query(f"""
WITH {_SCALED}
SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM raw WHERE NOT isnan(v) GROUP BY channel
""")
def channel_stats(spark, sf_dir):
    """NaN-aware mean and deviation of all 27 channels."""
    out = P.channel_stats(_scaled(spark, sf_dir), "x", N)
    return out.select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""
SELECT vec_id, CAST(r - 2 AS INTEGER) AS "row", CAST(c - 2 AS INTEGER) AS col, round(CAST(embedding[r * 8 + c + 1] AS DOUBLE), 6) AS v
FROM embeddings, range(2, 6) AS a(r), range(2, 6) AS b(c)
""")
def center_crop(spark, sf_dir):
    """Centre 4×4 of each 8×8 tile, re-based to 0."""
    px = P.explode_tile(X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    px = px.withColumns({"height": F.lit(8), "width": F.lit(8)})
    out = G.crop(px, offset=None, size=4)
    return out.select("vec_id", "row", "col", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"""
WITH {X.SCENES}
SELECT file_name, CASE WHEN code % 7 = 0 THEN -99 ELSE CAST(code AS INTEGER) END AS mask, CASE WHEN code % 5 = 0 THEN -9999.0 ELSE round(value, 2) END AS power FROM scenes
""")
def nodata_fill(spark, sf_dir):
    """Missing mask codes and powers become their fill values."""
    code = F.col("code")
    mask = F.when(code % 7 == 0, F.lit(float("nan"))).otherwise(code.cast("double"))
    power = F.when(code % 5 == 0, F.lit(None).cast("double")).otherwise(F.round("value", 2))
    return X.scenes(spark, sf_dir).select(
        "file_name", G.fill_nodata(mask, K.MASK_FILL, "smallint").cast("int").alias("mask"),
        G.fill_nodata(power, K.POWER_FILL, "double").alias("power"),
    )


@query(f"""
WITH {X.PIXELS}
SELECT fire_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(1 / (1 + exp(-avg(v * 10))), 6) AS prob,
       CAST(1 / (1 + exp(-avg(v * 10))) >= 0.5 AS INTEGER) AS pred FROM px GROUP BY ALL
""")
def score_postprocess(spark, sf_dir):
    """Logits averaged over time, then sigmoid and threshold."""
    px = X.tile_pixels(spark, sf_dir).withColumn("logit", F.col("v") * 10)
    out = P.mean_over_time(px, ["fire_id", "row", "col"])
    return out.select("fire_id", "row", "col", F.round("prob", 6).alias("prob"), "pred")


@query("""
SELECT * FROM (
SELECT l_returnflag AS fire_id, 'Mask' AS variable, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'DQF', min(CAST(l_linenumber AS DOUBLE)), max(CAST(l_linenumber AS DOUBLE)) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'Area', min(l_discount), max(l_discount) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'Temp', min(l_tax), max(l_tax) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'Power', min(l_extendedprice), max(l_extendedprice) FROM lineitem GROUP BY 1)
""")
def clip_profile(spark, sf_dir):
    """Range of each clip variable per fire."""
    clip = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("fire_id"), F.col("l_quantity").alias("Mask"), F.col("l_linenumber").alias("DQF"),
        F.col("l_discount").alias("Area"), F.col("l_tax").alias("Temp"), F.col("l_extendedprice").alias("Power"),
    )
    return P.variable_ranges(clip, ["fire_id"])


# --- geometry --------------------------------------------------------------------------------

_BBOX = f"""
WITH {X.FIRES},
b AS (SELECT *, lon - 128.0 / (111.320 * cos(radians(lat))) AS min_lon, lat - 128.0 / 110.574 AS min_lat,
             lon + 128.0 / (111.320 * cos(radians(lat))) AS max_lon, lat + 128.0 / 110.574 AS max_lat FROM fires)"""
_BOUNDS = ("min_lon", "min_lat", "max_lon", "max_lat")


@query(_BBOX + "SELECT fire_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in _BOUNDS) + " FROM b")
def bbox(spark, sf_dir):
    """128 km boxes around fire centres."""
    return G.with_bbox(X.fires(spark, sf_dir)).select("fire_id", *[F.round(c, 9).alias(c) for c in _BOUNDS])


@query(_BBOX + """
SELECT count(*) AS row_count, CAST(min(DATE '2024-01-01' + CAST(key % 30 AS INTEGER)) AS VARCHAR) AS start_date_min,
       CAST(max(DATE '2024-01-01' + CAST(key % 30 AS INTEGER)) AS VARCHAR) AS end_date_max, 128.0::DOUBLE AS half_width_km, 128.0::DOUBLE AS half_height_km,
       round(min(min_lon), 9) AS min_lon, round(min(min_lat), 9) AS min_lat, round(max(max_lon), 9) AS max_lon, round(max(max_lat), 9) AS max_lat FROM b
""")
def bbox_envelope(spark, sf_dir):
    fires = X.fires(spark, sf_dir).withColumn("start_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("key") % 30).cast("int")))
    boxes = G.with_bbox(fires.withColumn("end_date", F.col("start_date")))
    out = G.bbox_envelope(boxes)
    return out.select(
        "row_count", F.col("start_date_min").cast("string").alias("start_date_min"), F.col("end_date_max").cast("string").alias("end_date_max"),
        "half_width_km", "half_height_km", *[F.round(c, 9).alias(c) for c in _BOUNDS],
    )


@query(_BBOX + """,
ring AS (SELECT fire_id, unnest([[min_lon, min_lat], [min_lon, max_lat], [max_lon, max_lat], [max_lon, min_lat], [min_lon, min_lat]]) AS p, unnest([0, 1, 2, 3, 4]) AS i FROM b)
SELECT fire_id, i AS corner, round(p[1], 9) AS lon, round(p[2], 9) AS lat FROM ring
""")
def geojson_rings(spark, sf_dir):
    """Polygon rings read back from the GeoJSON features."""
    from ..sources.sinks import geojson_features

    features = geojson_features(G.with_bbox(X.fires(spark, sf_dir)), ["fire_id", *_BOUNDS])
    parsed = F.from_json(
        "value", "type STRING, properties STRUCT<fire_id: STRING>, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    )
    return features.select(parsed.alias("f")).select(
        F.col("f.properties.fire_id").alias("fire_id"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("corner", "p")
    ).select("fire_id", "corner", F.round(F.col("p")[0], 9).alias("lon"), F.round(F.col("p")[1], 9).alias("lat"))


_SCAN = _BBOX + f""",
corner AS (SELECT fire_id, unnest([min_lon, min_lon, max_lon, max_lon]) AS lon, unnest([min_lat, max_lat, min_lat, max_lat]) AS lat FROM b),
g AS (SELECT fire_id, atan(tan(radians(lat)) * pow({K.GRS80_POLE} / {K.GRS80_EQUATOR}, 2)) AS phi, radians(lon + 75.0) AS d FROM corner),
r AS (SELECT *, {K.GRS80_POLE} / sqrt(1 - (1 - pow({K.GRS80_POLE} / {K.GRS80_EQUATOR}, 2)) * pow(cos(phi), 2)) AS rc FROM g),
v AS (SELECT fire_id, {K.PERSPECTIVE_HEIGHT} + {K.GRS80_EQUATOR} - rc * cos(phi) * cos(d) AS sx, rc * cos(phi) * sin(d) AS sy, rc * sin(phi) AS sz, rc * cos(phi) * cos(d) AS near FROM r),
a AS (SELECT fire_id, CASE WHEN sx * near >= sy * sy + sz * sz * pow({K.GRS80_EQUATOR} / {K.GRS80_POLE}, 2) THEN asin(sy / sqrt(sx * sx + sy * sy + sz * sz)) END AS x,
             CASE WHEN sx * near >= sy * sy + sz * sz * pow({K.GRS80_EQUATOR} / {K.GRS80_POLE}, 2) THEN atan(sz / sx) END AS y FROM v)
"""


@query(_SCAN + "SELECT fire_id, round(min(x), 9) AS x_min, round(max(x), 9) AS x_max, round(min(y), 9) AS y_min, round(max(y), 9) AS y_max FROM a GROUP BY fire_id")
def scan_bounds(spark, sf_dir):
    """Fixed-grid scan-angle bounds of each bbox."""
    out = G.with_scan_bounds(G.with_bbox(X.fires(spark, sf_dir)))
    return out.select("fire_id", *[F.round(c, 9).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("""
WITH p AS (SELECT l_suppkey AS grid, round(l_quantity, 2) AS x, round(l_discount, 2) AS y FROM lineitem),
x AS (SELECT grid, x, row_number() OVER (PARTITION BY grid ORDER BY x) AS i FROM (SELECT DISTINCT grid, x FROM p)),
y AS (SELECT grid, y, row_number() OVER (PARTITION BY grid ORDER BY y DESC) AS i FROM (SELECT DISTINCT grid, y FROM p))
SELECT a.grid, round(b.x - a.x, 6) AS x_res, round(d.y - c.y, 6) AS y_res, round(a.x - (b.x - a.x) / 2, 6) AS x_origin, round(c.y - (d.y - c.y) / 2, 6) AS y_origin
FROM x a JOIN x b ON a.grid = b.grid AND a.i = 1 AND b.i = 2 JOIN y c ON c.grid = a.grid AND c.i = 1 JOIN y d ON d.grid = a.grid AND d.i = 2
""")
def grid_affine(spark, sf_dir):
    """Resolution and origin of each grid from its coordinates."""
    px = X.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grid"), F.round("l_quantity", 2).alias("x"), F.round("l_discount", 2).alias("y")
    )
    out = G.grid_affine(px, ["grid"])
    return out.select("grid", *[F.round(c, 6).alias(c) for c in ("x_res", "y_res", "x_origin", "y_origin")])


@query("""
WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS fire_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS b,
                  CAST(o_custkey % 45 AS DOUBLE) AS x_min, o_custkey % 45 + 5.0 AS x_max, CAST(o_custkey % 13 AS DOUBLE) * 7000 AS y_min, (o_custkey % 13) * 7000 + 9000.0 AS y_max FROM orders),
p AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_quantity AS x, l_extendedprice AS y FROM lineitem)
SELECT fire_id, l_orderkey, l_linenumber, CAST(day AS VARCHAR) AS day FROM f JOIN p ON day BETWEEN a AND b AND x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max
""")
def bbox_clip(spark, sf_dir):
    """Pixels within each fire's box on the fire's days."""
    o, c = F.col("o_orderdate").cast("date"), F.col("o_custkey")
    fires = X.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("fire_id"), o.alias("start_date"), F.date_add(o, (F.col("o_orderkey") % 5).cast("int")).alias("end_date"),
        (c % 45).cast("double").alias("x_min"), (c % 45 + 5.0).alias("x_max"), ((c % 13) * 7000).cast("double").alias("y_min"), ((c % 13) * 7000 + 9000.0).alias("y_max"),
    )
    px = X.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    px = px.withColumn("day_text", F.col("day").cast("string"))  # once a pixel, not once a match
    out = P.clip_to_bounds(px, fires)
    return out.select("fire_id", "l_orderkey", "l_linenumber", F.col("day_text").alias("day"))
