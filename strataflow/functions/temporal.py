"""Time: durations, truncation, buckets, interval algebra and value histories, as Column expressions.

An interval is a pair of Columns of nanoseconds; a null start is 0, a null end is Long.MAX.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = {
    "ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "min": 60 * 10**9, "h": 3600 * 10**9,
    "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9,
}
UNITS = {"second": "s", "minute": "m", "hour": "h", "day": "d", "week": "w"}
CALENDAR = ("month", "quarter", "year")
FOREVER = (1 << 63) - 1


def parse_duration(text: str) -> int:
    """Nanoseconds of "30d", "5min", "250ms" ..."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text.lower())
    if not m or m[2] not in NANOS:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * NANOS[m[2]]


def parse_time(text: str, compat: bool = False) -> int:
    """Nanoseconds of an ISO date, month or time in UTC; digits alone are epoch milliseconds.

    ``compat`` reads seconds that have a suffix ("30Z") as 0.
    """
    s = text.strip()
    if re.fullmatch(r"\d+", s) and len(s) != 4:
        return int(s) * 10**6
    m = re.fullmatch(r"(\d{4})-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?", s)
    if not m:
        raise ValueError(f"not a time: {text!r}")
    year, month, day, hour, minute = int(m[1]), int(m[2]), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0)
    second = 0 if compat and m[8] else int(m[6] or 0)
    n = int(datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc).timestamp()) * 10**9
    if m[7] and not compat:
        n += int(m[7][1:10].ljust(9, "0"))
    if m[8] and m[8] != "Z" and not compat:
        sign = -1 if m[8][0] == "+" else 1
        n += sign * (int(m[8][1:3]) * 3600 + int(m[8][-2:]) * 60) * 10**9
    return n


def _whole(n: Column) -> Column:
    return n.cast("long")


def date_trunc(unit: str, n: Column) -> Column:
    """Start of the calendar unit (UTC, weeks from Monday), in nanoseconds."""
    u = unit.lower()
    if u not in (*UNITS, *CALENDAR):
        raise ValueError(f"unknown unit {unit!r}")
    ts = F.timestamp_micros(F.floor(_whole(n) / 1000).cast("long"))
    return F.unix_micros(F.date_trunc(u, ts)) * F.lit(1000).cast("long")


def time_bucket(width: str | int, n: Column) -> Column:
    """Start of the bucket: fixed widths count from the epoch, calendar units are truncated.

    "1w" counts from the epoch, a Thursday; "week" from Mondays.
    """
    if isinstance(width, str):
        name = width.lower().strip()
        for u in (*UNITS, *CALENDAR):
            if name in (u, f"{u}s", f"1 {u}"):
                return date_trunc(u, n)
        width = parse_duration(name)
    return _whole(n) - F.pmod(_whole(n), F.lit(width).cast("long"))


@dataclass(frozen=True)
class Interval:
    start: Column
    end: Column

    @property
    def s(self) -> Column:
        return F.coalesce(self.start, F.lit(0).cast("long"))

    @property
    def e(self) -> Column:
        return F.coalesce(self.end, F.lit(FOREVER).cast("long"))


def precedes(a: Interval, b: Interval) -> Column:
    return a.e <= b.s


def meets(a: Interval, b: Interval) -> Column:
    return a.e == b.s


def covers(a: Interval, b: Interval) -> Column:
    return (a.s <= b.s) & (a.e >= b.e)


def starts(a: Interval, b: Interval) -> Column:
    return (a.s == b.s) & (a.e <= b.e)


def finishes(a: Interval, b: Interval) -> Column:
    return (a.e == b.e) & (a.s >= b.s)


def equals(a: Interval, b: Interval) -> Column:
    return (a.s == b.s) & (a.e == b.e)


def overlap(a: Interval, b: Interval) -> Column:
    return (a.s < b.e) & (b.s < a.e)


ALLEN = {f.__name__: f for f in (precedes, meets, covers, starts, finishes, equals, overlap)}


def successive(a: Interval, b: Interval, tolerance: int = 10**9) -> Column:
    """b starts within ``tolerance`` of a's end; false when either is open."""
    return F.coalesce(F.abs(a.end - b.start) <= F.lit(tolerance).cast("long"), F.lit(False))


def _within(x: Column, t1: Column, t2: Column) -> Column:
    return F.coalesce((x >= t1) & (x <= t2), F.lit(False))


def changed(i: Interval, created: Column, t1: Column, t2: Column) -> Column:
    """Started, ended or was created in [t1, t2]."""
    return _within(i.start, t1, t2) | _within(i.end, t1, t2) | _within(created, t1, t2)


def change_type(i: Interval, created: Column, t1: Column, t2: Column) -> Column:
    began, ended = _within(i.start, t1, t2), _within(i.end, t1, t2)
    return (
        F.when(began & ended, "started_and_ended").when(began, "started").when(ended, "ended").when(_within(created, t1, t2), "created").otherwise("stable")
    )


def duration(i: Interval) -> Column:
    """end - start; null when open or not positive."""
    return F.when(i.end > i.start, i.end - i.start)


def open_ended(i: Interval) -> Column:
    return i.end.isNull()


def value_at(history: Column, t: Column) -> Column:
    """Last value of a history (sorted by t) at or before a time; null without one."""
    return F.try_element_at(F.filter(history, lambda x: x["t"] <= t), F.lit(-1))["v"]


def history_window(history: Column, t1: Column, t2: Column) -> Column:
    """The part of a history within [t1, t2]."""
    return F.filter(history, lambda x: (x["t"] >= t1) & (x["t"] <= t2))


def compact_history(history: Column, before: Column) -> Column:
    """A history without what was overwritten before a time; the value then in force stays."""
    latest = F.array_max(F.transform(F.filter(history, lambda x: x["t"] <= before), lambda x: x["t"]))
    return F.filter(history, lambda x: (x["t"] > before) | (x["t"] == latest))


def hops(path: Column) -> Column:
    return F.greatest(F.size(path) - 1, F.lit(0))
