"""Spherical and planar geometry as column expressions; the radius is always an argument."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in metres used for sensor tracks.
EARTH = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in radians, clockwise from north, in (-pi, pi]."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))


def destination(lat: Column, lon: Column, angle: Column, metres: Column, radius: float = EARTH) -> tuple[Column, Column]:
    """Latitude and longitude after a great-circle stretch."""
    a, d = F.radians(lat), metres / radius
    b = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(angle))
    east = F.atan2(F.sin(angle) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(b))
    return F.degrees(b), lon + F.degrees(east)


def enu(lat: Column, lon: Column, lat0: Column, lon0: Column, radius: float = EARTH) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius, F.radians(lat - lat0) * radius


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional web-mercator tile."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def segment_distance(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """Distance of a point from a segment in the plane, and the share of the segment at the closest point."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / n))).otherwise(0.0)
    return F.hypot(px - ax - t * dx, py - ay - t * dy), t


def side_of(ax, ay, bx, by, px, py, dead: float = 15.0) -> Column:
    """left, right, or null within the dead zone beside a line."""
    d = ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / F.nullif(F.hypot(bx - ax, by - ay), F.lit(0.0))
    return F.when(d > dead, "left").when(d < -dead, "right")


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against one ring: whether an odd number of its sides lies to the right of the point."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        at = (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
        crossings = crossings + F.when(((y < y1) != (y < y2)) & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Share of the segment a-b at which it crosses the segment c-d; null if they do not cross or are parallel."""
    area = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    s = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.when(area != 0, area)
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.when(area != 0, area)
    return F.when((s >= 0) & (s <= 1) & (u >= 0) & (u <= 1), s)


def segment_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float) -> Column:
    """Array of the grid cells (structs cx, cy) that a segment touches: a row of cells at a time, by where it enters and leaves."""
    low, high = F.least(ay, by), F.greatest(ay, by)
    rows = F.sequence(cell(low, size), cell(high, size))
    flat = by == ay

    def row(r):
        def at(y):
            inside = F.least(F.greatest(y, low), high)
            return F.when(flat, ax).otherwise(ax + (bx - ax) * (inside - ay) / F.when(~flat, by - ay))

        p, q = at(r * size), at((r + 1) * size)
        p, q = (F.when(flat, F.least(ax, bx)).otherwise(F.least(p, q)), F.when(flat, F.greatest(ax, bx)).otherwise(F.greatest(p, q)))
        return F.transform(F.sequence(cell(p, size), cell(q, size)), lambda c: F.struct(c.alias("cx"), r.alias("cy")))

    return F.flatten(F.transform(rows, row))


def turn_angle(ax, ay, bx, by, cx, cy) -> Column:
    """Turn at b on the way from a to c, in radians: positive to the left, pi for the way back."""
    x, y, u, v = bx - ax, by - ay, cx - bx, cy - by
    return F.atan2(x * v - y * u, x * u + y * v)


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> tuple[Column, Column]:
    """Distance on the plane of the middle latitude, and the bearing in degrees from 0 to 360."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return radius * F.hypot(dx, F.radians(lat2 - lat1)), F.pmod(F.degrees(bearing(lat1, lon1, lat2, lon2)), F.lit(360.0))
