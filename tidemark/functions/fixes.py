"""Readings of a vehicle log: which fixes count, typed samples, turn rate about the vertical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def satellite(speed: Column, accuracy: Column) -> Column:
    """A fix with a speed, and better than 50 m; not-a-number counts as missing."""
    ok = (F.nanvl(speed, F.lit(-1.0)) >= 0) & (F.nanvl(accuracy, F.lit(1e9)) < 50)
    return F.coalesce(ok, F.lit(False))


def truth(speed: Column, accuracy: Column) -> Column:
    """A satellite fix of at most 10 m."""
    return satellite(speed, accuracy) & (accuracy <= 10)


def midpoint(t_us: Column, latency_us: Column) -> Column:
    """When a reply that came at t was read: half its latency before."""
    return t_us - F.floor(latency_us / 2)


def non_negative(x: Column) -> Column:
    return F.when(~F.isnan(x) & (x >= 0), x)


def yaw_about_vertical(gravity: tuple[Column, Column, Column], gyro: tuple[Column, Column, Column]) -> Column:
    """Turn rate about the vertical, counter-clockwise positive: minus the gyro's part along gravity."""
    dot = sum((g * w for g, w in zip(gravity, gyro)), F.lit(0.0))
    norm = F.sqrt(sum((g * g for g in gravity), F.lit(0.0)))
    return -dot / F.nullif(norm, F.lit(0.0))


def flag(bits: Column, bit: int) -> Column:
    return F.shiftright(bits, bit).bitwiseAND(1) == 1


def quantised(e7: Column) -> Column:
    """1e-7 degrees as 1e-6 degrees, halves up."""
    return F.floor((e7 + 5) / 10)


#: Distances that are spoken, in metres.
SPOKEN = (20, 50, 100, 150, 200, 300, 400, 500, 600, 800, 1000, 1500, 2000, 3000)


def spoken(metres: Column, ladder: tuple[int, ...] = SPOKEN) -> Column:
    """The distance of the ladder that is nearest; the smaller of two."""
    steps = F.array(*(F.lit(float(x)) for x in ladder))
    return F.array_min(F.transform(steps, lambda s: F.struct(F.abs(s - metres).alias("d"), s.alias("s"))))["s"]


def quantile_at(shares: list[float], values: list[float], u: Column) -> Column:
    """Piecewise linear inverse of a distribution given at increasing shares."""
    out = F.when(u <= shares[0], float(values[0]))
    for (a, b), (x, y) in zip(zip(shares, shares[1:]), zip(values, values[1:])):
        out = out.when(u <= b, x + (u - a) / (b - a) * (y - x))
    return out.otherwise(float(values[-1]))
