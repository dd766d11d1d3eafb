"""Timestamps from scene names, bins and date ranges.

File names carry UTC stamps without a zone, so everything stays
``TIMESTAMP_NTZ``: no session time zone can move a scene to another day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: one pattern per date directive ----------------------------
_DIRECTIVES = {
    "Y": r"(\d{4})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9])",
    "H": r"(2[0-3]|[01]\d|\d)",
    "M": r"([0-5]\d|\d)",
    "S": r"(6[01]|[0-5]\d|\d)",
    "j": r"(36[0-6]|3[0-5]\d|[12]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9])",
}
_WIDTHS = {"Y": 4, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2, "j": 3}
# --- fixed values: stamps looked for in a file stem --------------------------
_STAMP_T = (r"(?<!\d)(20\d{6}T\d{6})(?!\d)", "%Y%m%dT%H%M%S")
_STAMP_14 = (r"(?<!\d)(20\d{12})(?!\d)", "%Y%m%d%H%M%S")
_STAMP_10 = (r"(?<!\d)(20\d{8})(?!\d)", "%Y%m%d%H")
_STAMP_8 = (r"(?<!\d)(20\d{6})(?!\d)", "%Y%m%d")
_STAMP_DOY = (r"(?<!\d)s(20\d{11})(?!\d)", "%Y%j%H%M%S")
_STAMP_BARE_DOY = (r"(?<!\d)(20\d{11})(?!\d)", "%Y%j%H%M%S")
_STAMP_DOY_TENTHS = (r"(?<!\d)s(20\d{11})\d(?!\d)", "%Y%j%H%M%S")
_DAY_SUFFIX = "_VIIRS_Day"

POLICIES = ("daily", "subdaily", "earliest", "default")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often and under whatever conditions ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def parse_stamp(text: Column, fmt: str, *, fixed: bool = False) -> Column:
    """``text`` read with strptime-style directives; NULL unless the whole text matches.

    ``fixed`` says that the text is as long as its directives can be: parts then lie at known places.
    """
    pattern, groups, places = "^", [], []
    i = place = 0
    while i < len(fmt):
        if fmt[i] == "%":
            groups.append(fmt[i + 1])
            places.append(place)
            pattern += _DIRECTIVES[fmt[i + 1]]
            place += _WIDTHS[fmt[i + 1]]
            i += 2
        else:
            pattern += "\\" + fmt[i] if not fmt[i].isalnum() else fmt[i]
            place += 1
            i += 1

    def read(text: Column) -> Column:
        def part(directive: str, default: int) -> Column:
            if directive not in groups:
                return F.lit(default)
            at = groups.index(directive)
            digits = F.substring(text, places[at] + 1, _WIDTHS[directive]) if fixed else F.regexp_extract(text, pattern, at + 1)
            return digits.try_cast("int")

        seconds = part("S", 0)
        whole = (F.length(text) > 0) & (F.regexp_extract(text, pattern, 0) == text) & (seconds < 60)
        if "j" in groups:
            # Day of year counts on from 1 January, so day 366 may enter the next year.
            day = F.date_add(F.make_date(part("Y", 1970), F.lit(1), F.lit(1)), part("j", 1) - 1)
            year, month, dom = F.year(day), F.month(day), F.dayofmonth(day)
        else:
            year, month, dom = part("Y", 1970), part("m", 1), part("d", 1)
        stamp = F.try_make_timestamp_ntz(year, month, dom, part("H", 0), part("M", 0), seconds.cast("decimal(16,6)"))
        return F.when(whole, stamp)

    return _once(text, read)


def _find(stem: Column, stamp: tuple[str, str]) -> Column:
    return parse_stamp(F.regexp_extract(stem, stamp[0], 1), stamp[1], fixed=True)


def stem(name: Column) -> Column:
    """File name without directories and without its last suffix."""
    base = F.regexp_replace(name, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def timestamp_from_name(name: Column, policy: str = "default") -> Column:
    """Acquisition time from a scene name.

    daily     first of: 14, 10, 8 digits, s+day-of-year, dashed date
    subdaily  the same with ``YYYYMMDDTHHMMSS`` tried first
    earliest  the earliest of every reading that works
    default   subdaily, preceded by the 14-digit day-of-year stamp of raw scenes
    """
    ladder = [_STAMP_14, _STAMP_10, _STAMP_8, _STAMP_DOY]
    first = {"daily": ladder, "subdaily": [_STAMP_T, *ladder], "default": [_STAMP_DOY_TENTHS, _STAMP_T, *ladder]}
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")

    def read(s: Column) -> Column:
        if policy != "earliest":
            dashed = parse_stamp(F.replace(s, F.lit(_DAY_SUFFIX), F.lit("")), "%Y-%m-%d")
            return F.coalesce(*[_find(s, p) for p in first[policy]], dashed)
        found = [_find(s, p) for p in (_STAMP_14, _STAMP_10, _STAMP_8, _STAMP_BARE_DOY, _STAMP_DOY)]
        formats = ("%Y%m%dT%H%M%S", "%Y%m%dT%H%M", "%Y%m%d")
        # One array, so that the digits are stripped once; NULLs are no readings.
        loose = _once(F.regexp_replace(s, "[^0-9T]", ""), lambda digits: F.array(*[parse_stamp(digits, f) for f in formats]))
        return F.array_min(F.concat(F.array(*found), loose))

    return _once(stem(name), read)


def clip_stamp(coverage_start: Column, name: Column) -> Column:
    """Stamp used to name a clip: the coverage attribute to whole seconds, else the name's ``_s`` part."""
    compact = F.regexp_replace(F.regexp_replace(coverage_start, "[-:]", ""), r"(\.\d+)?Z$", "")
    s = stem(name)
    after = F.regexp_extract(s, r"_s([^_]*)", 1)
    fallback = F.when(s.contains("_s"), after).otherwise(s)
    return F.when(F.length(F.coalesce(coverage_start, F.lit(""))) > 0, compact).otherwise(fallback)


def floor_hours(ts: Column, hours: int) -> Column:
    """Start of the ``hours``-long bin counted from midnight."""
    floored = (F.floor(F.hour(ts) / hours) * hours).cast("int")
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_interval(hours=floored)


def bins_per_day(minutes: int) -> int:
    return -(-24 * 60 // minutes)


def minute_bin(ts: Column, minutes: int) -> Column:
    """0-based index of the ``minutes``-long bin within the day."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")


def date_range(start: Column, end: Column) -> Column:
    """Inclusive days from start to end; empty when either is NULL or start > end."""
    days = F.sequence(start, F.greatest(start, end), F.expr("INTERVAL 1 DAY"))
    return F.when(start <= end, days).otherwise(F.array().cast("array<date>"))


def day_of_year_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)
