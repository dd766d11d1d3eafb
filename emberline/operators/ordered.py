"""Ordered scans that survive a hot key.

A plain ``Window.partitionBy(key)`` puts one key in one task. A single fire (or
task name) may hold a third of all rows, so the scans here split every key into
ordered *segments* (a day of scenes, a block of frames). Rows are scanned
inside ``(key, segment)``; a pre-aggregated table with one row per segment
carries the state across segment borders. Only that small table is ever ordered
per whole key, and it is itself split once more when ``levels`` is above zero.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SEG = "__segment"
_STRETCH = "__stretch"
_FIRST_SEGMENT = -(2**60)
SEGMENT_ROWS = 1_000_000
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "total": F.sum}


@dataclass(frozen=True)
class Scan:
    """One running aggregate.

    how        sum, max, min over the rows before (or after) the current one;
               total is the sum over the whole key.
    following  scan backwards, from the last row of the key.
    inclusive  whether the current row takes part.
    """

    how: str
    value: Column
    following: bool = False
    inclusive: bool = True


def _frame(window, inclusive: bool):
    return window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _merge(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if how == "max" else F.least(a, b)


def segmented_scan(
    df: DataFrame,
    keys: list[str],
    segment: Column,
    order: list[str],
    scans: dict[str, Scan],
    *,
    levels: int = 0,
    fan_in: int = 1024,
) -> DataFrame:
    """Add one column per scan. ``segment`` must be integral and never decrease along ``order``."""
    inputs = {f"__in_{name}": scan.value for name, scan in scans.items()}
    base = df.withColumns({_SEG: F.coalesce(segment.cast("long"), F.lit(_FIRST_SEGMENT)), **inputs})

    totals = base.groupBy(*keys, _SEG).agg(
        *[_AGG[scan.how](f"__in_{name}").alias(f"__sum_{name}") for name, scan in scans.items()]
    )
    carry = _carry(totals, keys, scans, levels, fan_in)

    forward = Window.partitionBy(*keys, _SEG).orderBy(*[F.asc_nulls_first(c) for c in order])
    backward = Window.partitionBy(*keys, _SEG).orderBy(*[F.desc_nulls_last(c) for c in order])
    local = base.withColumns(
        {
            f"__loc_{name}": _AGG[scan.how](f"__in_{name}").over(
                _frame(backward if scan.following else forward, scan.inclusive)
            )
            for name, scan in scans.items()
            if scan.how != "total"
        }
    )
    joined = local.join(carry, [*keys, _SEG], "left")
    out = {
        name: F.coalesce(F.col(f"__carry_{name}"), F.lit(0))
        if scan.how == "total"
        else _merge(scan.how, F.col(f"__loc_{name}"), F.col(f"__carry_{name}"))
        for name, scan in scans.items()
    }
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def _carry(totals: DataFrame, keys: list[str], scans: dict[str, Scan], levels: int, fan_in: int) -> DataFrame:
    """State entering each segment: one row per (key, segment)."""
    if levels > 0:
        exclusive = {
            f"__carry_{name}": Scan(
                scan.how, F.col(f"__sum_{name}"), following=scan.following, inclusive=False
            )
            for name, scan in scans.items()
        }
        named = totals.withColumnRenamed(_SEG, "__inner")
        done = segmented_scan(
            named, keys, F.floor(F.col("__inner") / fan_in), ["__inner"], exclusive,
            levels=levels - 1, fan_in=fan_in,
        )
        return done.withColumnRenamed("__inner", _SEG).select(*keys, _SEG, *exclusive)
    whole = Window.partitionBy(*keys)
    cols = []
    for name, scan in scans.items():
        source = F.col(f"__sum_{name}")
        if scan.how == "total":
            value = F.sum(source).over(whole)
        else:
            ordered = whole.orderBy(F.col(_SEG).desc() if scan.following else F.col(_SEG))
            value = _AGG[scan.how](source).over(_frame(ordered, inclusive=False))
        cols.append(value.alias(f"__carry_{name}"))
    return totals.select(*keys, _SEG, *cols)


def row_index(
    df: DataFrame, keys: list[str], segment: Column, order: list[str], name: str = "frame",
    total: str | None = None, **kw,
) -> DataFrame:
    """0-based position of each row inside its key, and optionally the key's row count."""
    scans = {name: Scan("sum", F.lit(1), inclusive=False)}
    if total:
        scans[total] = Scan("total", F.lit(1))
    out = segmented_scan(df, keys, segment, order, scans, **kw)
    casts = {name: F.col(name).cast("int")}
    if total:
        casts[total] = F.col(total).cast("int")
    return out.withColumns(casts)


@dataclass(frozen=True)
class Lookup:
    """The nearest earlier (or later) row's payload; with ``where``, the nearest row for which it holds."""

    payload: dict[str, Column]
    where: Column | None = None
    following: bool = False


def neighbours(
    df: DataFrame, keys: list[str], segment: Column, order: list[str], lookups: list[Lookup], **kw
) -> DataFrame:
    """Lag, lead and last-not-null in one scan, however many lookups there are.

    A running maximum of ``struct(order, payload)`` over earlier rows *is* the
    latest earlier row. Ties on ``order`` are broken by the payload, so ``order``
    should be unique per key.
    """
    scans = {}
    for n, look in enumerate(lookups):
        packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                          *[v.alias(f"p{i}") for i, v in enumerate(look.payload.values())])
        if look.where is not None:
            packed = F.when(look.where, packed)
        how = "min" if look.following else "max"
        scans[f"__near{n}"] = Scan(how, packed, following=look.following, inclusive=False)
    out = segmented_scan(df, keys, segment, order, scans, **kw)
    return out.withColumns(
        {
            name: F.col(f"__near{n}").getField(f"p{i}")
            for n, look in enumerate(lookups)
            for i, name in enumerate(look.payload)
        }
    ).drop(*scans)


def neighbour(
    df: DataFrame, keys: list[str], segment: Column, order: list[str], payload: dict[str, Column],
    *, following: bool, where: Column | None = None, **kw,
) -> DataFrame:
    """One lookup of ``neighbours``."""
    return neighbours(df, keys, segment, order, [Lookup(payload, where, following)], **kw)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    A scan reads its input twice, so a chain of scans doubles the work of its
    first link each time; a checkpoint between links stops that and outlives lost
    executors. The folder is that of ``shared_folder``.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset in a local session a temporary folder, on a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="run-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The place of a new folder below the checkpoint folder, which driver and executors share."""
    return f"{_checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def time_segment(ts: str | Column, seconds: int = 86400) -> Column:
    """``seconds``-long stretches of time; ``scene_segments`` cuts them where they are too full."""
    col = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date")).cast("long")
    if seconds % 86400 == 0:
        return F.floor(days / (seconds // 86400))
    of_day = F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
    return F.floor((days * 86400 + of_day) / seconds)


def scene_segments(df: DataFrame, keys: list[str], ts: str = "ts", name: str = _STRETCH, *, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``name``: the stretch of time a row is scanned in, a day, or a part of one where a day is too full.

    Days of a key with more than ``rows`` rows are cut where the running count of their seconds passes multiples of
    ``rows``, so however hot a key is, a stretch holds about that many (a single second is never cut). Stretches
    are numbered by their first second, hence in order. Counts of days collapse map-side; seconds are
    counted, and joined to rows, for the full days only, and where there are none that join falls away at run time.
    """
    day, second = time_segment(ts), time_segment(ts, 1)
    marked = df.withColumns({"__day": day, "__second": second})
    full = marked.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    seconds = marked.join(full.drop("__n"), [*keys, "__day"], "left_semi").groupBy(*keys, "__day", "__second").agg(F.count(F.lit(1)).alias("__n"))
    passed = F.sum("__n").over(Window.partitionBy(*keys, "__day").orderBy("__second").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    parts = seconds.withColumn("__part", F.floor(passed / rows))
    first = F.min("__second").over(Window.partitionBy(*keys, "__day", "__part"))
    cuts = parts.select(*keys, "__second", first.alias("__first"))
    stretch = F.coalesce("__first", F.col("__day") * 86400)
    return marked.join(cuts, [*keys, "__second"], "left").withColumn(name, stretch).select(*df.columns, name)


def nth_value(df: DataFrame, key: str, index: int, *, buckets: int = 4096) -> DataFrame:
    """One row, column ``key``: the value at 0-based position ``index`` of the sorted non-null values; no row beyond the end.

    Values are counted in ordered buckets (parts of the range of a number, or the two characters after the common prefix of
    a text); only the bucket that holds the position is sorted. Rows before it are neither sorted nor moved.
    """
    rows = df.select(key).where(F.col(key).isNotNull())
    ends = F.broadcast(rows.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi")))
    if isinstance(df.schema[key].dataType, StringType):
        upto = F.least(F.length("__lo"), F.length("__hi"))
        places = F.sequence(F.lit(1), F.greatest(upto, F.lit(1)))
        differs = F.filter(places, lambda i: F.substring("__lo", i, F.lit(1)) != F.substring("__hi", i, F.lit(1)))
        bucket = F.substring(F.col(key), F.coalesce(F.array_min(differs), upto + 1), F.lit(2))
    else:
        width = (F.col("__hi").cast("double") - F.col("__lo").cast("double") + 1) / buckets
        bucket = F.floor((F.col(key).cast("double") - F.col("__lo").cast("double")) / width)
    placed = rows.join(ends, F.lit(True)).select(key, bucket.alias("__b"))
    counts = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    held = counts.withColumn("__before", before).where(
        (F.col("__before") <= index) & (F.col("__before") + F.col("__n") > index)).select("__b", "__before")
    near = placed.join(F.broadcast(held), "__b")
    place = F.col("__before") + F.row_number().over(Window.orderBy(key)) - 1
    return near.withColumn("__place", place).where(F.col("__place") == index).select(key)


def block_segment(col: str | Column, size: int) -> Column:
    """Consecutive blocks of an integral order column."""
    value = F.col(col) if isinstance(col, str) else col
    return F.floor(value / size)
