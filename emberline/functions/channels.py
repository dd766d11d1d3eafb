"""Channel vectors: stacking, cleaning, normalising, encoding, augmenting.

Vectors are rebuilt element by element with ``array(...)`` rather than with
lambda functions: explicit elements stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def elements(x: Column, n: int) -> list[Column]:
    """The first ``n`` elements; NULL past the end."""
    return [F.get(x, F.lit(i)) for i in range(n)]


def clean(value: Column) -> Column:
    """NaN and both infinities become 0; NULL stays NULL."""
    # NaN sorts above infinity, so one comparison finds every finite value.
    return F.when(F.abs(value) < float("inf"), value).when(value.isNotNull(), F.lit(0.0))


def clean_vector(x: Column, n: int) -> Column:
    return F.array(*[clean(v.cast("double")) for v in elements(x, n)])


def above(value: Column, threshold: Column | float) -> Column:
    """``value > threshold`` for measured values: false on NaN, which Spark orders above every number; NULL on NULL."""
    return F.when(F.isnan(value), F.lit(False)).otherwise(value > threshold)


def at_least(value: Column, threshold: Column | float) -> Column:
    """``value >= threshold``, false on NaN."""
    return F.when(F.isnan(value), F.lit(False)).otherwise(value >= threshold)


def stack_day_night(day: Column, night: Column) -> Column:
    """Six day bands and two night bands; a five-band night file gives its last two, a missing one zeros.

    Any other number of night bands is an error: it would move every later channel.
    """
    zeros = F.array(*[F.lit(0.0).cast("float")] * K.NIGHT_BANDS)
    night2 = (
        F.when(night.isNull(), zeros)
        .when(F.size(night) == 5, F.slice(night, 4, K.NIGHT_BANDS))
        .when(F.size(night) == K.NIGHT_BANDS, night)
        .otherwise(F.raise_error(F.concat(F.lit("night vector with "), F.size(night).cast("string"), F.lit(" bands"))).cast("array<float>"))
    )
    return F.concat(F.slice(day, 1, K.DAY_BANDS), night2)


def compose(x: Column, running_max: Column, task: str, n: int) -> Column:
    """Task input vector: ``af`` keeps raw bands, ``ba`` and ``pred`` use the running maximum for heat bands."""
    if task == "af":
        return F.slice(x, 1, n)
    if task not in ("ba", "pred"):
        raise ValueError(f"unknown task {task!r}")
    raw, peak = elements(x, n), elements(running_max, n)
    return F.array(*[peak[i] if i in K.HEAT_CHANNELS else raw[i] for i in range(n)])


def zscore(x: Column, mean: Sequence[float], std: Sequence[float], skip: Sequence[int] = ()) -> Column:
    return F.array(
        *[v.cast("double") if i in skip else (v.cast("double") - F.lit(mean[i])) / F.lit(std[i])
          for i, v in enumerate(elements(x, len(mean)))]
    )


def pred_zscore(x: Column) -> Column:
    return zscore(x, K.PRED_MEAN, K.PRED_STD, (*K.DEGREE_CHANNELS, K.LANDCOVER_CHANNEL))


def sin_degrees(x: Column, n: int = K.PRED_CHANNELS, channels: Sequence[int] = K.DEGREE_CHANNELS) -> Column:
    return F.array(*[F.sin(F.radians(v)) if i in channels else v for i, v in enumerate(elements(x, n))])


def landcover_one_hot(value: Column, mode: str = "reference") -> list[Column]:
    """17 indicators. Class 0 wraps to class 17 in ``reference`` mode and is all zeros in ``strict`` mode."""
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    code = value.cast("int")
    if mode == "reference":
        code = F.when(code == 0, F.lit(K.LANDCOVER_CLASSES)).otherwise(code)
    return [(code == k).cast("double") for k in range(1, K.LANDCOVER_CLASSES + 1)]


def splice_landcover(x: Column, n: int = K.PRED_CHANNELS, mode: str = "reference") -> Column:
    parts = elements(x, n)
    at = K.LANDCOVER_CHANNEL
    return F.array(*parts[:at], *landcover_one_hot(parts[at], mode), *parts[at + 1:])


def encode_pred(x: Column, mode: str = "reference") -> Column:
    """27 raw channels to the 43 model inputs: clean, z-score, sine, one-hot.

    Scaling a finite FLOAT in double precision cannot overflow, so a second
    cleaning of the result would find nothing.
    """
    vals = [clean(v.cast("double")) for v in elements(x, K.PRED_CHANNELS)]
    out: list[Column] = []
    for i, v in enumerate(vals):
        if i in K.DEGREE_CHANNELS:
            out.append(F.sin(F.radians(v)))
        elif i == K.LANDCOVER_CHANNEL:
            out.extend(landcover_one_hot(v, mode))
        else:
            out.append((v - K.PRED_MEAN[i]) / K.PRED_STD[i])
    return F.array(*out)


def binary_target(y: Column) -> Column:
    """(background, fire)."""
    return F.array((y == 0).cast("int"), above(y, 0).cast("int"))


def target_pair(planes: Column, label_sel: Column) -> Column:
    """(any accumulated active fire, the selected label plane)."""
    return F.array(above(F.get(planes, F.lit(1)), 0).cast("double"), F.get(planes, label_sel).cast("double"))


def drop_first(x: Column, n_drop: int = 2) -> Column:
    """Channel subset of the six-channel mode."""
    return F.slice(x, n_drop + 1, F.greatest(F.size(x) - n_drop, F.lit(0)))


def project_feature_set(x: Column, name: str) -> Column:
    """Channels of an implemented feature set; planned sets have no defined bands."""
    if name == "af_core8":
        return F.slice(x, 1, K.CORE_CHANNELS)
    if name == "pred_full43":
        return encode_pred(x)
    known = {row[1]: row[4] for row in K.FEATURE_SETS}
    raise ValueError(f"feature set {name!r} is {known.get(name, 'unknown')}: its bands are not defined")


def squash(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0)))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


# --- augmentation -------------------------------------------------------------

def _coin(key: Column, nth: int) -> Column:
    return F.ascii(F.substring(F.md5(key.cast("string")), nth, 1)) % 2


def augmentation_plan(window_key: Column, seed: int) -> dict[str, Column]:
    """Reproducible flips and quarter turns: one draw per window, no random state."""
    key = F.concat_ws(":", window_key.cast("string"), F.lit(str(seed)))
    return {
        "hflip": _coin(key, 1) == 1,
        "vflip": _coin(key, 2) == 1,
        "turns": (_coin(key, 3) * 2 + _coin(key, 4)).cast("int"),
    }


def augment(pixels: DataFrame, size: int, *, x: str | None = None, n: int = K.PRED_CHANNELS,
            row: str = "row", col: str = "col", repair_angles: bool = True) -> DataFrame:
    """Flip and turn by remapping coordinates of rows that carry hflip, vflip and turns.

    A pixel moves instead of the raster, so there is no shuffle. Quarter turns
    are counter-clockwise. With ``x`` given, direction channels follow the move.
    """
    last = size - 1
    r, c = F.col(row), F.col(col)
    c = F.when(F.col("hflip"), last - c).otherwise(c)
    r = F.when(F.col("vflip"), last - r).otherwise(r)
    turns = F.col("turns")
    new_r = F.when(turns == 1, last - c).when(turns == 2, last - r).when(turns == 3, c).otherwise(r)
    new_c = F.when(turns == 1, r).when(turns == 2, last - c).when(turns == 3, last - r).otherwise(c)
    moved = {row: new_r.cast("int"), col: new_c.cast("int")}
    if x is not None and repair_angles:
        moved[x] = F.array(
            *[turn_angle(v.cast("double")) if i in K.DEGREE_CHANNELS else v.cast("double")
              for i, v in enumerate(elements(F.col(x), n))]
        )
    return pixels.withColumns(moved)


def turn_angle(angle: Column) -> Column:
    """A compass direction after the row's flips and turns."""
    a = F.when(F.col("hflip"), 360.0 - angle).otherwise(angle)
    a = F.when(F.col("vflip"), F.pmod(180.0 - a, F.lit(360.0))).otherwise(a)
    return F.when(F.col("turns") > 0, F.pmod(a - 90.0 * F.col("turns"), F.lit(360.0))).otherwise(a)


def artifact_epoch(path: Column) -> Column:
    """Epoch number in a checkpoint name, −1 when there is none."""
    base = F.regexp_replace(path, r"^.*/", "")
    return F.coalesce(F.regexp_extract(base, K.EPOCH_RE, 1).try_cast("int"), F.lit(-1))
