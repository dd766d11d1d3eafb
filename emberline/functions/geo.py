"""Bounding boxes, the geostationary fixed grid and raster geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def km_to_lat_deg(km: Column | float) -> Column:
    return (F.lit(km) if not isinstance(km, Column) else km) / K.KM_PER_DEGREE_LAT


def km_to_lon_deg(km: Column | float, lat: Column) -> Column:
    """Degrees of longitude; raises for latitudes at the poles."""
    cos_lat = F.cos(F.radians(lat))
    width = (F.lit(km) if not isinstance(km, Column) else km) / (K.KM_PER_DEGREE_LON * cos_lat)
    return F.when(
        F.abs(cos_lat) < K.POLE_GUARD,
        F.raise_error(F.concat(F.lit("longitude conversion is unstable near the poles: "), lat.cast("string"))).cast("double"),
    ).otherwise(width)


def with_bbox(
    fires: DataFrame, lat: str = "lat", lon: str = "lon",
    half_width_km: float = K.HALF_SIZE_KM, half_height_km: float = K.HALF_SIZE_KM,
) -> DataFrame:
    """Add centre, half sizes and the four WGS84 bounds."""
    dlat = km_to_lat_deg(float(half_height_km))
    dlon = km_to_lon_deg(float(half_width_km), F.col(lat))
    return fires.withColumns(
        {
            "center_lat": F.col(lat),
            "center_lon": F.col(lon),
            "half_width_km": F.lit(float(half_width_km)),
            "half_height_km": F.lit(float(half_height_km)),
            "min_lon": F.col(lon) - dlon,
            "min_lat": F.col(lat) - dlat,
            "max_lon": F.col(lon) + dlon,
            "max_lat": F.col(lat) + dlat,
        }
    )


def bbox_envelope(bboxes: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One row: the box around every box, the date span and the row count."""
    return bboxes.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(start).alias("start_date_min"),
        F.max(end).alias("end_date_max"),
        F.max("half_width_km").alias("half_width_km"),
        F.max("half_height_km").alias("half_height_km"),
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
    )


def bbox_ring() -> Column:
    """Closed polygon ring of a bbox row, starting at the south-west corner, clockwise."""
    corners = (("min_lon", "min_lat"), ("min_lon", "max_lat"), ("max_lon", "max_lat"),
               ("max_lon", "min_lat"), ("min_lon", "min_lat"))
    return F.array(*[F.array(F.col(x), F.col(y)) for x, y in corners])


def scan_angles(
    lon: Column, lat: Column, *, origin_lon: float = K.GOES_EAST_LON,
    height: float = K.PERSPECTIVE_HEIGHT, sweep: str = "x",
) -> tuple[Column, Column]:
    """Fixed-grid scan angles (x, y) in radians, by the published forward projection; NULL beyond the limb."""
    a, b = K.GRS80_EQUATOR, K.GRS80_POLE
    e2 = 1.0 - (b * b) / (a * a)
    orbit = height + a
    phi = F.atan(F.tan(F.radians(lat)) * ((b * b) / (a * a)))
    dlon = F.radians(lon - origin_lon)
    radius = b / F.sqrt(1.0 - e2 * F.cos(phi) * F.cos(phi))
    east = radius * F.cos(phi) * F.sin(dlon)
    toward = radius * F.cos(phi) * F.cos(dlon)
    north = radius * F.sin(phi)
    ahead = orbit - toward
    visible = ahead * toward >= east * east + north * north * ((a * a) / (b * b))
    reach = F.sqrt(ahead * ahead + east * east + north * north)
    if sweep == "x":
        x, y = F.asin(east / reach), F.atan(north / ahead)
    elif sweep == "y":
        x, y = F.atan(east / ahead), F.asin(north / reach)
    else:
        raise ValueError(f"sweep must be 'x' or 'y', got {sweep!r}")
    return F.when(visible, x), F.when(visible, y)


def with_scan_bounds(bboxes: DataFrame, **projection) -> DataFrame:
    """Smallest scan-angle box holding the four bbox corners."""
    corners = [scan_angles(F.col(x), F.col(y), **projection)
               for x in ("min_lon", "max_lon") for y in ("min_lat", "max_lat")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return bboxes.withColumns(
        {"x_min": F.least(*xs), "x_max": F.greatest(*xs), "y_min": F.least(*ys), "y_max": F.greatest(*ys)}
    )


def grid_affine(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Resolution and origin of each grid from its first two coordinates on either axis.

    Pixels are read once and collapse, map-side, to their distinct coordinates on either axis; the two leading ones
    of those are found by ranking them. Fewer than two coordinates on an axis is an error. ``y``
    runs downwards (largest first) as rasters are stored.
    """
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col(x).alias("at")), F.struct(F.lit("y").alias("axis"), (-F.col(y)).alias("at")))
    lines = pixels.select(*keys, F.inline(axes)).where(F.col("at").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "axis").orderBy("at"))
    leading = lines.withColumn("__n", place).where("__n <= 2")

    def line(axis: str, n: int) -> Column:
        at = F.col("at") if axis == "x" else -F.col("at")
        return F.min(F.when((F.col("axis") == axis) & (F.col("__n") == n), at)).alias(f"{axis}{n - 1}")

    second = leading.groupBy(*keys).agg(*[line(axis, n) for axis in "xy" for n in (1, 2)])
    short = F.col("x1").isNull() | F.col("y1").isNull()
    error = F.raise_error(F.lit("a grid needs at least two x and two y coordinates")).cast("double")
    x_res = F.when(short, error).otherwise(F.col("x1") - F.col("x0"))
    y_res = F.when(short, error).otherwise(F.col("y1") - F.col("y0"))
    return second.select(
        *keys,
        x_res.alias("x_res"),
        y_res.alias("y_res"),
        (F.col("x0") - (F.col("x1") - F.col("x0")) / 2.0).alias("x_origin"),
        (F.col("y0") - (F.col("y1") - F.col("y0")) / 2.0).alias("y_origin"),
    )


def fill_nodata(value: Column, fill: float, kind: str) -> Column:
    """NULL and NaN become ``fill``, cast to the stored type."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(float(fill))).cast(kind)


def crop(pixels: DataFrame, *, offset: int | None = K.CROP_OFFSET, size: int = K.TILE,
         row: str = "row", col: str = "col", height: str = "height", width: str = "width") -> DataFrame:
    """Square crop, re-based to 0. ``offset=None`` centres it on the scene's height and width."""
    half = size // 2
    r0 = F.lit(offset) if offset is not None else F.floor(F.col(height) / 2).cast("int") - half
    c0 = F.lit(offset) if offset is not None else F.floor(F.col(width) / 2).cast("int") - half
    moved = pixels.withColumns({row: (F.col(row) - r0).cast("int"), col: (F.col(col) - c0).cast("int")})
    return moved.where(F.col(row).between(0, size - 1) & F.col(col).between(0, size - 1))
