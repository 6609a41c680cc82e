"""Joins by place: cells bound the candidates, exact distances decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import cell, in_ring, segment_distance
from tidemark.operators.tables import cut, scratch
from tidemark.operators.timeseries import previous, running_sum


def _row(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.monotonically_increasing_id())


def within(points: DataFrame, places: DataFrame, x: str, y: str, radius: float, per_place: Column | None = None) -> DataFrame:
    """Pairs of points and places (columns px, py) at most radius apart (or the place's own, at most radius), with distance.

    Each place is copied to the nine cells around it; a point looks only into its own, so the join is an equi-join.
    """
    around = F.array(*(F.struct((cell(F.col("px"), radius) + i).alias("i"), (cell(F.col("py"), radius) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = places.withColumn("_c", F.explode(around))
    spread = spread.select("*", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).drop("_c")
    met = points.withColumns({"_i": cell(F.col(x), radius), "_j": cell(F.col(y), radius)}).join(spread, ["_i", "_j"]).drop("_i", "_j")
    met = met.withColumn("distance", F.hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py")))
    return met.filter(F.col("distance") <= (F.lit(radius) if per_place is None else F.least(F.lit(radius), per_place)))


def nearest(points: DataFrame, places: DataFrame, key: str, x: str, y: str, radius: float, place: str, scale: Column | None = None) -> DataFrame:
    """key, place, distance of the nearest place within radius, by distance over scale if given; ties by place."""
    met = within(points, places, x, y, radius, scale)
    score = F.col("distance") / scale if scale is not None else F.col("distance")
    best = met.groupBy(key).agg(F.min(F.struct(score.alias("score"), F.col(place).alias("place"), "distance")).alias("b"))
    return best.select(key, F.col("b.place").alias(place), F.col("b.distance").alias("distance"))


#: Places that share a cell with one, on the average, where nearest_widening begins to look.
CELL_PLACES = 8


def nearest_widening(points: DataFrame, places: DataFrame, by: list[str], key: str, x: str, y: str, radius: float, place: str, other: Column) -> DataFrame:
    """key, place, distance (9 digits) of the nearest place (columns px, py) within radius with equal `by` for which `other` holds; ties by place.

    A key may have several rows of points, as many as there are values of `by` it looks for. Cells are so narrow at first that
    places are few in each; only points that found none within their width look again in cells twice as wide, up to radius. So
    neither pairs nor what is moved grow with the square of how densely places lie.
    """
    with scratch() as held:
        points, places = cut(points.select(key, *by, x, y)), cut(places)
        cells = places.groupBy(*by, cell(F.col("px"), radius), cell(F.col("py"), radius)).agg(F.count("*").cast("double").alias("n"))
        full = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        width = radius / 2 ** max(0, math.ceil(math.log2(max(1.0, full / CELL_PLACES)) / 2))
        found = []
        while True:
            # a little wider than what settles a point, so that all places at its distance, as rounded, are seen
            wide = width + 1e-8 if width < radius else radius
            around = F.array(*(F.struct((cell(F.col("px"), wide) + i).alias("i"), (cell(F.col("py"), wide) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
            spread = places.withColumn("_c", F.explode(around)).select("*", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).drop("_c")
            met = points.withColumns({"_i": cell(F.col(x), wide), "_j": cell(F.col(y), wide)}).join(spread, [*by, "_i", "_j"]).filter(other)
            met = met.withColumn("d", F.hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py"))).filter(F.col("d") <= wide)
            best = met.groupBy(key).agg(F.min(F.struct(F.round("d", 9).alias("r"), F.col(place).alias("place"))).alias("b"), F.min("d").alias("d")).filter(F.col("d") <= width)
            found.append(cut(best.select(key, F.col("b.place").alias(place), F.col("b.r").alias("distance"))))
            if width >= radius:
                break
            points = cut(points.join(found[-1].select(key), key, "left_anti"))
            if points.isEmpty():
                break
            width = min(2 * width, radius)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return held.keep(cut(out))


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """Rows in a box: a range of cell rows, which prunes data laid out by cell, then the exact test."""
    x0, y0, x1, y1 = box
    row = cell(F.col(y), size)
    return df.filter((row >= int(y0 // size)) & (row <= int(y1 // size)) & F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def innermost(points: DataFrame, areas: list[tuple[str, float, list[tuple[float, float]]]], x: str, y: str) -> DataFrame:
    """points with the name of the smallest area (name, size, ring) that holds each; the list of areas is a parameter, not data."""
    found = F.lit(None).cast("string")
    for name, _, ring in sorted(areas, key=lambda a: (-a[1], a[0])):
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        near = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
        found = F.when(near & in_ring(F.col(x), F.col(y), ring), name).otherwise(found)
    return points.withColumn("area", found)


def within_reach(points: DataFrame, places: DataFrame, x: str, y: str, reach: str) -> DataFrame:
    """Pairs of points and places (columns px, py, and how far each reaches), with distance; a reach may be of any size.

    Places are cells of their own class of reach, the power of two above it, so one with a long reach does not widen the cells of the
    others; a point looks into one cell of each class, of which there are as many as the reaches have doublings.
    """
    level = F.ceil(F.log2(F.col(reach))).cast("int")
    wide = places.filter(F.col(reach) > 0).withColumn("_level", level)
    levels = sorted(r[0] for r in wide.select("_level").distinct().collect())
    if not levels:
        return points.join(places.limit(0), F.lit(False)).withColumn("distance", F.lit(0.0))
    at = lambda c, more=0: (F.floor(c / F.pow(F.lit(2.0), F.col("_level"))) + more).cast("long")
    around = F.array(*(F.struct(at(F.col("px"), i).alias("i"), at(F.col("py"), j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = wide.withColumn("_c", F.explode(around)).select("*", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j")).drop("_c")
    looked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    looked = looked.withColumns({"_i": at(F.col(x)), "_j": at(F.col(y))})
    met = looked.join(spread, ["_level", "_i", "_j"]).drop("_level", "_i", "_j")
    return met.withColumn("distance", F.hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py"))).filter(F.col("distance") <= F.col(reach))


def near_any(points: DataFrame, places: DataFrame, x: str, y: str, radius: float, per_place: Column | None = None, other: Column | None = None) -> DataFrame:
    """Points with a place (columns px, py) at most radius, or the place's own, away, other than what the condition `other` leaves out; each once.

    A semi-join within cells: a point stops at the first place it finds, and no pair is made.
    """
    around = F.array(*(F.struct((cell(F.col("px"), radius) + i).alias("i"), (cell(F.col("py"), radius) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = places.withColumn("_c", F.explode(around)).select("*", F.col("_c.i").alias("_pi"), F.col("_c.j").alias("_pj")).drop("_c")
    own = points.withColumns({"_i": cell(F.col(x), radius), "_j": cell(F.col(y), radius)})
    far = F.hypot(F.col(x) - F.col("px"), F.col(y) - F.col("py")) <= (F.lit(radius) if per_place is None else F.least(F.lit(radius), per_place))
    rule = (F.col("_i") == F.col("_pi")) & (F.col("_j") == F.col("_pj")) & far
    return own.join(spread, rule if other is None else rule & other, "left_semi").drop("_i", "_j")


def segments(line: DataFrame, by: list[str], order: str, x: str, y: str, stretch: int = 10_000) -> DataFrame:
    """Consecutive vertices as segments (order of the first, ax, ay, bx, by_) with the length before them.

    order is a number; stretches of it so wide are tasks of their own, so a line of any length is many.
    """
    v = previous(line.select(*by, order, F.col(x).alias("bx"), F.col(y).alias("by_")), by, [order], [order, "bx", "by_"], stretch, "_p")
    s = v.withColumn("length", F.hypot(F.col("bx") - F.col("_p.bx"), F.col("by_") - F.col("_p.by_")))
    s = running_sum(s, by, [order], F.col("length"), "_upto", stretch).filter("_p is not null")
    return s.select(*by, F.col(f"_p.{order}").alias(order), F.col("_p.bx").alias("ax"), F.col("_p.by_").alias("ay"), "bx", "by_", "length", (F.col("_upto") - F.col("length")).alias("before"))


def corridor(points: DataFrame, segs: DataFrame, key: str, x: str, y: str, width: float) -> DataFrame:
    """key, along, off: the closest point of the line within width; segments meet points by the cells their boxes touch."""
    def span(a: Column, b: Column) -> Column:
        return F.sequence(cell(F.least(a, b) - width, width), cell(F.greatest(a, b) + width, width))

    spread = segs.withColumn("_i", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("_j", F.explode(span(F.col("ay"), F.col("by_"))))
    met = points.withColumns({"_i": cell(F.col(x), width), "_j": cell(F.col(y), width)}).join(spread, ["_i", "_j"])
    d, t = segment_distance(*(F.col(c) for c in (x, y, "ax", "ay", "bx", "by_")))
    met = met.withColumns({"off": d, "along": F.col("before") + t * F.col("length")}).filter(F.col("off") <= width)
    best = met.groupBy(key).agg(F.min(F.struct(F.round("off", 9).alias("off"), "along")).alias("b"))
    return best.select(key, F.col("b.along").alias("along"), F.col("b.off").alias("off"))


def close_values(left: DataFrame, right: DataFrame, by: list[str], value: str, other: str, apart: float) -> DataFrame:
    """Pairs of rows with equal keys whose values differ by less than apart: right rows meet left ones by cell, not by key alone."""
    a = left.withColumn("_cell", F.floor(F.col(value) / apart).cast("long"))
    b = right.withColumn("_cell", F.explode(F.array(*((F.floor(F.col(other) / apart) + k).cast("long") for k in (-1, 0, 1)))))
    return a.join(b, [*by, "_cell"]).filter(F.abs(F.col(value) - F.col(other)) < apart).drop("_cell")


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a box; 0 inside."""
    dx = F.greatest(x0 - x, F.lit(0.0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0.0), y - y1)
    return F.hypot(dx, dy)


#: Cells a box may be copied to, on the average, where nearest_box begins to look.
BOX_CELLS = 128


def nearest_box(points: DataFrame, boxes: DataFrame, key: str, x: str, y: str, box: str, limit: float) -> DataFrame:
    """key, box, distance of the box (x0, y0, x1, y1) nearest within limit; of equally near ones the last by name.

    A box is copied to the cells it and its surroundings touch. Cells are a sixteenth of limit wide at first (wider where boxes are
    large); points that found no box within their width look again in cells twice as wide. Of the boxes that cover a cell only the
    last by name, and those after it that touch the cell, can be an answer there, so boxes on top of one another make few pairs.
    """
    with scratch() as held:
        points, boxes = cut(points.select(key, x, y)), cut(boxes.select(box, "x0", "y0", "x1", "y1"))
        width = limit / 16
        copies = lambda w: boxes.agg(F.avg(((F.col("x1") - F.col("x0")) / w + 3) * ((F.col("y1") - F.col("y0")) / w + 3))).first()[0] or 0.0
        while width < limit and copies(width) > BOX_CELLS:
            width *= 2
        found = []
        while True:
            span = lambda a, b: F.sequence(cell(F.col(a) - width, width), cell(F.col(b) + width, width))
            spread = boxes.withColumn("_i", F.explode(span("x0", "x1"))).withColumn("_j", F.explode(span("y0", "y1")))
            # cells' sides by multiplication are a little off, hence the margin: less counts as covering, more as touching
            slack = width * 1e-6
            low = lambda c: F.col(c) * F.lit(width)
            covers = (F.col("x0") <= low("_i") - slack) & (F.col("x1") >= low("_i") + width + slack) & (F.col("y0") <= low("_j") - slack) & (F.col("y1") >= low("_j") + width + slack)
            touches = (F.col("x0") <= low("_i") + width + slack) & (F.col("x1") >= low("_i") - slack) & (F.col("y0") <= low("_j") + width + slack) & (F.col("y1") >= low("_j") - slack)
            last = spread.filter(covers).groupBy("_i", "_j").agg(F.max(box).alias("_last"))
            asked = spread.join(last, ["_i", "_j"], "left").filter(F.col("_last").isNull() | ((F.col(box) >= F.col("_last")) & touches)).drop("_last")
            met = points.withColumns({"_i": cell(F.col(x), width), "_j": cell(F.col(y), width)}).join(asked, ["_i", "_j"])
            met = met.withColumn("_d", box_distance(*(F.col(c) for c in (x, y, "x0", "y0", "x1", "y1")))).filter(F.col("_d") <= width)
            best = met.groupBy(key).agg(F.max(F.struct((-F.col("_d")).alias("k"), F.col(box).alias("box"))).alias("b"))
            best = best.select(key, F.col("b.box").alias(box), (-F.col("b.k")).alias("distance"))
            # what lies at the very edge of the width may have an equal that was missed by rounding
            found.append(cut(best.filter(F.col("distance") <= (width * (1 - 1e-9) if width < limit else limit))))
            if width >= limit:
                break
            points = cut(points.join(found[-1].select(key), key, "left_anti"))
            if points.isEmpty():
                break
            width = min(2 * width, limit)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return held.keep(cut(out))


def snap(points: DataFrame, segs: DataFrame, key: str, x: str, y: str, bearing: str, seg: str, radius: float, turn: float) -> DataFrame:
    """key, seg, off of the nearest segment within radius that runs along the point's bearing (radians) up to turn, either way."""
    span = lambda a, b: F.sequence(cell(F.least(a, b) - radius, radius), cell(F.greatest(a, b) + radius, radius))
    spread = segs.withColumn("_i", F.explode(span(F.col("ax"), F.col("bx")))).withColumn("_j", F.explode(span(F.col("ay"), F.col("by_"))))
    met = points.withColumns({"_i": cell(F.col(x), radius), "_j": cell(F.col(y), radius)}).join(spread, ["_i", "_j"])
    off, _ = segment_distance(*(F.col(c) for c in (x, y, "ax", "ay", "bx", "by_")))
    way = F.atan2(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    apart = F.pmod(way - F.col(bearing), F.lit(3.141592653589793))
    agrees = F.least(apart, 3.141592653589793 - apart) <= turn
    best = met.withColumn("_off", off).filter((F.col("_off") <= radius) & agrees).groupBy(key).agg(F.min(F.struct(F.round("_off", 9).alias("off"), F.col(seg).alias("seg"))).alias("b"))
    return best.select(key, F.col("b.seg").alias(seg), F.col("b.off").alias("off"))


def within_any(points: DataFrame, areas: DataFrame, rings: DataFrame, key: str, x: str, y: str, size: float) -> DataFrame:
    """key and area of points inside rings (area, i, rx, ry: vertices in order), by ray casting over sides that meet the point's row of cells.

    areas is not read beyond its names; a side is copied to the rows of cells it spans, so no pair of point and far side is made.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("area").orderBy("i")
    first = rings.groupBy("area").agg(F.min_by(F.struct("rx", "ry"), "i").alias("_f"))
    sides = rings.join(areas.select("area"), "area").join(first, "area").withColumn("_n", F.coalesce(F.lead(F.struct("rx", "ry")).over(w), F.col("_f")))
    sides = sides.select("area", F.col("rx").alias("ax"), F.col("ry").alias("ay"), F.col("_n.rx").alias("bx"), F.col("_n.ry").alias("by_")).filter("ay <> by_")
    sides = sides.withColumn("_j", F.explode(F.sequence(cell(F.least("ay", "by_"), size), cell(F.greatest("ay", "by_"), size))))
    met = points.select(key, x, y).withColumn("_j", cell(F.col(y), size)).join(sides, "_j")
    crosses = ((F.col(y) < F.col("ay")) != (F.col(y) < F.col("by_"))) & (F.col(x) < (F.col(y) - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by_") - F.col("ay")) + F.col("ax"))
    return met.groupBy(key, "area").agg(F.count_if(crosses).alias("_k")).filter("_k % 2 = 1").select(key, "area")


def polygon_vertices(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ring, hole, i, x, y of outlines in polygon text: a name, then rings (a ! marks a hole) of a vertex a line up to END."""
    body = F.regexp_replace(F.col(text), r"^[^\n]*\n", "")
    rings = F.filter(F.transform(F.split(body, r"\n?END\n?"), lambda r: F.trim(r)), lambda r: r != "")
    each = df.select(key, F.explode(rings).alias("_r")).select(key, F.split("_r", r"\n").alias("_l"))
    each = each.select(key, F.regexp_replace(F.trim(F.get("_l", F.lit(0))), "^!", "").alias("ring"), F.get("_l", F.lit(0)).startswith("!").alias("hole"), F.posexplode(F.slice("_l", F.lit(2), F.size("_l"))).alias("i", "_v"))
    xy = F.split(F.trim("_v"), r"\s+")
    return each.select(key, "ring", "hole", "i", F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))
