"""Clock and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def week_minute(ts: Column) -> Column:
    """Minutes since Monday 00:00 of the local time given."""
    return F.weekday(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def open_at(ranges: Column, minute: Column) -> Column:
    """Whether a minute of the week lies in one of the half-open ranges (structs of start and end)."""
    return F.exists(ranges, lambda r: (minute >= r["start"]) & (minute < r["end"]))


def next_change(ranges: Column, minute: Column) -> Column:
    """Minutes until the state changes, over the end of the week if need be; null if it never does."""
    edges = F.flatten(F.transform(ranges, lambda r: F.array(r["start"], r["end"] % 10080)))
    return F.array_min(F.filter(F.transform(edges, lambda e: F.pmod(e - minute, F.lit(10080))), lambda d: d > 0))


def rush_factor(ts: Column, morning: tuple[int, int] = (7, 10), evening: tuple[int, int] = (16, 19), factor: float = 1.4) -> Column:
    h = F.hour(ts)
    busy = h.between(morning[0], morning[1] - 1) | h.between(evening[0], evening[1] - 1)
    return F.when((F.weekday(ts) < 5) & busy, factor).otherwise(1.0)
