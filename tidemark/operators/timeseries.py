"""Joins and windows along time, per key, that stay exact and parallel when one key holds most rows.

A key's rows are cut into time buckets. Ordered work runs inside (key, bucket); what a bucket needs of earlier
ones comes from a table with one row for each key and bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a time bucket in microseconds: a day.
BUCKET = 86_400_000_000


def _bucketed(df: DataFrame, t: str, bucket: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(t) / bucket).cast("long"))


def previous(df: DataFrame, by: list[str], order: list[str], cols: list[str], bucket: int = BUCKET, name: str = "prev") -> DataFrame:
    """df with a struct of the columns cols of the row before in the key's order (order[0] is time in microseconds)."""
    df = _bucketed(df, order[0], bucket)
    row = F.struct(*cols)
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    last = df.groupBy(*by, "_b").agg(F.max_by(row, F.struct(*order)).alias("_row"))
    over = Window.partitionBy(*by).orderBy("_b")
    carry = last.select(*by, "_b", F.lag("_row").over(over).alias("_carry"))
    out = df.withColumn("_lag", F.lag(row).over(inside)).join(carry, [*by, "_b"], "left")
    return out.withColumn(name, F.coalesce("_lag", "_carry")).drop("_b", "_lag", "_carry")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """df with the sum of value over the key's rows up to this one."""
    df = _bucketed(df.withColumn("_v", value), order[0], bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_b").agg(F.sum("_v").alias("_s")).select(*by, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    out = df.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(base, [*by, "_b"], "left")
    return out.withColumn(name, F.col("_in") + F.col("_base")).drop("_v", "_b", "_in", "_base")


def around(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], tie: str | None = None, back: str | None = "back", ahead: str | None = "ahead", bucket: int = BUCKET) -> DataFrame:
    """left with structs (t, cols) of right's last row at or before its time and of the first at or after; a name of None leaves a side out.

    Each side comes from one walk over each key's buckets, and what a bucket needs of its neighbours from a table
    with one row a bucket. Right rows at one time are ordered by tie, the last of them counting either way.
    """
    keep = F.struct(F.col(t).alias("t"), *cols)
    kind = right.select(keep.alias("x")).schema["x"].dataType
    a = left.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast("long").alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_r"))
    # a right row stands before the left rows of its time for those that look back, behind them for those that look ahead
    places = [o for o, name in ((0, back), (2, ahead)) if name]
    b = right.select(*by, F.col(t).alias("_t"), F.explode(F.array(*map(F.lit, places))).alias("_o"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_tie"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), keep.alias("_r"))
    b = b.withColumn("_tie", F.when(F.col("_o") == 2, -F.col("_tie")).otherwise(F.col("_tie")))
    rows = _bucketed(a.unionByName(b), "_t", bucket)
    inside, buckets = Window.partitionBy(*by, "_b").orderBy("_t", "_o", "_tie"), Window.partitionBy(*by).orderBy("_b")
    ends, carry, found = [], [F.col(c) for c in (*by, "_b")], {}
    if back:
        ends.append(F.max_by("_r", F.when(F.col("_o") == 0, F.struct("_t", "_tie"))).alias("_end"))
        carry.append(F.last("_end", ignorenulls=True).over(buckets.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        rows = rows.withColumn("_back", F.last(F.when(F.col("_o") == 0, F.col("_r")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        found[back] = F.coalesce("_back", "_before")
    if ahead:
        ends.append(F.min_by("_r", F.when(F.col("_o") == 2, F.struct("_t", "_tie"))).alias("_start"))
        carry.append(F.last("_start", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"))
        # backwards, so that each row adds to what is known: a frame to the end would be read anew for every row
        backwards = Window.partitionBy(*by, "_b").orderBy(F.desc("_t"), F.desc("_o"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_ahead", F.last(F.when(F.col("_o") == 2, F.col("_r")), ignorenulls=True).over(backwards))
        found[ahead] = F.coalesce("_ahead", "_behind")
    marks = rows.groupBy(*by, "_b").agg(*ends).select(*carry)
    out = rows.filter("_o = 1").join(marks, [*by, "_b"], "left")
    return out.select("_l.*", *(c.alias(name) for name, c in found.items()))


def asof(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], tolerance: int | None = None, forward: bool = False, tie: str | None = None, name: str = "match", bucket: int = BUCKET) -> DataFrame:
    """left with a struct (t, cols) of the last row of right at or before its time (forward: the first at or after).

    Right rows at one time are ordered by tie. Left rows without a key or match get null.
    """
    out = around(left, right, by, t, cols, tie, None if forward else name, name if forward else None, bucket)
    if tolerance is not None:
        out = out.withColumn(name, F.when(F.abs(F.col(t) - F.col(name)["t"]) <= tolerance, F.col(name)))
    return out


def nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, cols: list[str], tolerance: int | None = None, tie: str | None = None) -> DataFrame:
    """left with the row of right closest in time; of two equally close the earlier one."""
    both = around(left, right, by, t, cols, tie, "_back", "_ahead")
    closer = F.col("_back").isNull() | (F.abs(F.col("_ahead.t") - F.col(t)) < F.abs(F.col(t) - F.col("_back.t")))
    match = F.when(F.col("_ahead").isNotNull() & closer, F.col("_ahead")).otherwise(F.col("_back"))
    if tolerance is not None:
        match = F.when(F.abs(match["t"] - F.col(t)) <= tolerance, match)
    return both.withColumn("match", match).drop("_back", "_ahead")


def interpolate(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str, gap: int, hold: int, tie: str | None = None, name: str = "value_at") -> DataFrame:
    """left with right's value at its time: linear between samples at most gap apart, else the earlier one held for hold."""
    both = around(left, right, by, t, [value], tie, "_p", "_n")
    p, n, at = F.col("_p"), F.col("_n"), F.col(t)
    near = (n["t"] - p["t"]) <= gap
    line = F.when(n["t"] == p["t"], p[value]).otherwise(p[value] + (n[value] - p[value]) * (at - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0)))
    held = F.when(at - p["t"] <= hold, p[value])
    return both.withColumn(name, F.when(p.isNull(), None).when(n.isNotNull() & near, line).otherwise(held)).drop("_p", "_n")


def framed(df: DataFrame, by: list[str], place: str, before: int, after: int = 0, width: int = BUCKET) -> DataFrame:
    """df in buckets _b of place, each with copies of the rows up to before ahead of it and after behind it; _own tells them apart.

    A window over a frame of that reach within (by, _b) is right for the rows with _own, so a key of any length
    is many tasks.
    """
    first, last = (F.floor((F.col(place) + d) / width).cast("long") for d in (-after, before))
    out = df.withColumn("_b", F.explode(F.sequence(first, last)))
    return out.withColumn("_own", F.col("_b") == F.floor(F.col(place) / width))


def over_frame(df: DataFrame, by: list[str], place: str, before: int, columns: dict, after: int = 0, width: int = BUCKET) -> DataFrame:
    """df with columns over the rows of the key whose place is within before and after of each row's; columns maps names to functions of the window."""
    w = Window.partitionBy(*by, "_b").orderBy(place).rangeBetween(-before, after)
    rows = framed(df, by, place, before, after, width)
    return rows.withColumns({name: make(w) for name, make in columns.items()}).filter("_own").drop("_b", "_own")


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place", bucket: int = BUCKET) -> DataFrame:
    """df with each row's place (from 1) in its key's order (order[0] is time or another number); bucket is the width of a task."""
    df = _bucketed(df, order[0], bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return df.withColumn("_in", F.row_number().over(inside)).join(base, [*by, "_b"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_b", "_in", "_base")


def prefer_fresh(first: DataFrame, second: DataFrame, by: list[str], t: str, stale: int) -> DataFrame:
    """All rows of first, and those of second whose last row of first is older than stale or missing."""
    marked = asof(second, first, by, t, [], name="_m")
    kept = marked.filter(F.col("_m").isNull() | (F.col(t) - F.col("_m.t") > stale)).drop("_m")
    return first.unionByName(kept)


def islands(df: DataFrame, by: list[str], order: list[str], gap: int, bucket: int = BUCKET) -> DataFrame:
    """df with run: the number of gaps over gap before the row, so rows of one run share it."""
    df = previous(df, by, order, [order[0]], bucket, "_p")
    new = F.when(F.col("_p").isNull() | (F.col(order[0]) - F.col(f"_p.{order[0]}") > gap), 1).otherwise(0)
    return running_sum(df, by, order, new, "run", bucket).drop("_p")


def gaps(df: DataFrame, by: list[str], t: str, longer: int, start: Column, end: Column) -> DataFrame:
    """by, from_t, to_t: stretches without a row, strictly longer, also before the first and after the last row.

    start and end are aggregates or literals that bound each key's recording.
    """
    edges = df.groupBy(*by).agg(start.alias("_s"), end.alias("_e"))
    points = df.select(*by, t).unionByName(edges.select(*by, F.col("_s").alias(t))).unionByName(edges.select(*by, F.col("_e").alias(t)))
    found = previous(points.distinct(), by, [t], [t], name="_p")
    return found.filter(F.col(t) - F.col(f"_p.{t}") > longer).select(*by, F.col(f"_p.{t}").alias("from_t"), F.col(t).alias("to_t"))


def inside_windows(df: DataFrame, windows: DataFrame, by: list[str], t: str, bucket: int = BUCKET) -> DataFrame:
    """df with from_t and to_t of the first half-open window that holds its time, null outside; windows meet rows by time bucket."""
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("from_t") / bucket).cast("long"), F.floor((F.col("to_t") - 1) / bucket).cast("long"))))
    left = _bucketed(df, t, bucket).withColumn("_row", F.monotonically_increasing_id())
    met = left.select(*by, "_b", "_row", t).join(spread, [*by, "_b"]).filter((F.col(t) >= F.col("from_t")) & (F.col(t) < F.col("to_t")))
    first = met.groupBy("_row").agg(F.min(F.struct("from_t", "to_t")).alias("_w"))
    return left.join(first, "_row", "left").select(*df.columns, F.col("_w.from_t").alias("from_t"), F.col("_w.to_t").alias("to_t"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """by, start, end: touching and overlapping intervals of each key as one.

    Of those that start together the longest stands for all, so no two rows tie in the order that runs are told by.
    """
    df = _bucketed(df.groupBy(*by, start).agg(F.max(end).alias(end)), start, bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_b").agg(F.max(end).alias("_m")).select(*by, "_b", F.max("_m").over(before).alias("_base"))
    df = df.withColumn("_in", F.max(end).over(inside)).join(base, [*by, "_b"], "left").withColumn("_far", F.greatest("_in", "_base"))
    new = F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far")), 1).otherwise(0)
    run = running_sum(df.drop("_in", "_base"), by, [start, end], new, "_run", bucket)
    return run.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def held_integral(df: DataFrame, by: list[str], order: list[str], value: str, lo: int, hi: int, longest: int) -> DataFrame:
    """by, integral: each value times the time until the next row, clipped to [lo, hi); intervals over longest are skipped."""
    df = previous(df, by, order, [order[0], value], name="_p")
    p, t = F.col("_p"), F.col(order[0])
    span = F.greatest(F.lit(0), F.least(t, F.lit(hi)) - F.greatest(p[order[0]], F.lit(lo))) / 1e6
    part = F.when(t - p[order[0]] <= longest, p[value] * span)
    return df.groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("integral"))


def grid(df: DataFrame, by: list[str], t: str, step: int) -> DataFrame:
    """by and t: every multiple of step between a key's first and last row."""
    ends = df.groupBy(*by).agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    ticks = F.sequence(F.ceil(F.col("_a") / step).cast("long"), F.floor(F.col("_z") / step).cast("long"))
    some = ends.filter(F.ceil(F.col("_a") / step) <= F.floor(F.col("_z") / step))
    return some.select(*by, F.explode(ticks).alias(t)).withColumn(t, F.col(t) * step)


def breaks(df: DataFrame, by: list[str], order: list[str], cols: list[str], broken, name: str = "segment", bucket: int = BUCKET) -> DataFrame:
    """df with the number of breaks up to the row; broken says from the row before (a struct, null for the first) whether one is here."""
    marked = previous(df, by, order, cols, bucket, "_before")
    marked = marked.withColumn("_broken", F.coalesce(broken(F.col("_before")), F.lit(False)).cast("int"))
    return running_sum(marked, by, order, F.col("_broken"), name, bucket).drop("_before", "_broken")


def spells(df: DataFrame, by: list[str], t: str, flag: Column, merge: int, least: int) -> DataFrame:
    """by, from_t, to_t, n: stretches of flagged rows, joined over gaps of at most merge, that last at least least."""
    run = islands(df.filter(flag), by, [t], merge)
    got = run.groupBy(*by, "run").agg(F.min(t).alias("from_t"), F.max(t).alias("to_t"), F.count("*").alias("n"))
    return got.filter(F.col("to_t") - F.col("from_t") >= least).drop("run")


def unwrapped(df: DataFrame, by: list[str], order: list[str], angle: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """df with the angle (radians) made continuous: steps over half a turn lose or gain whole turns."""
    d = F.col(angle) - F.col("_before")[angle]
    turns = -F.floor((d + math.pi) / (2 * math.pi))
    steps = previous(df, by, order, [angle], bucket, "_before").withColumn("_turns", F.coalesce(turns, F.lit(0)))
    total = running_sum(steps, by, order, F.col("_turns"), "_total", bucket)
    return total.withColumn(name, F.col(angle) + 2 * math.pi * F.col("_total")).drop("_before", "_turns", "_total")


def late(df: DataFrame, by: list[str], arrival: str, t: str, delay: int, bucket: int) -> DataFrame:
    """df with late: the row came after one of its key that is more than delay younger; what a watermark would drop.

    Arrival numbers are cut into buckets, like times elsewhere, so that a long key is no single task.
    """
    df = _bucketed(df, arrival, bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*by, "_b").agg(F.max(t).alias("_m")).select(*by, "_b", F.max("_m").over(before).alias("_base"))
    out = df.withColumn("_in", F.max(t).over(inside)).join(base, [*by, "_b"], "left")
    return out.withColumn("late", F.greatest("_in", "_base") - F.col(t) > delay).drop("_b", "_in", "_base")


def all_fresh(df: DataFrame, by: list[str], t: str, channel: str, channels: list[str], within: int) -> DataFrame:
    """Rows at which every channel was heard at most within before (the row's own counts)."""
    heard = {f"_c{i}": (lambda w, c=c: F.max(F.when(F.col(channel) == c, 1)).over(w)) for i, c in enumerate(channels)}
    out = over_frame(df, by, t, within, heard)
    rule = F.lit(True)
    for i in range(len(channels)):
        rule = rule & F.col(f"_c{i}").isNotNull()
    return out.filter(rule).drop(*heard)


def latched(df: DataFrame, by: list[str], order: list[str], on: Column, off: Column, name: str = "held", bucket: int = BUCKET) -> DataFrame:
    """df with the state of a switch that on sets and off clears, cleared at first; rows between keep what was."""
    df = _bucketed(df.withColumn("_say", F.when(on, True).when(off, False)), order[0], bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    said = df.groupBy(*by, "_b").agg(F.max_by("_say", F.when(F.col("_say").isNotNull(), F.struct(*order))).alias("_end"))
    carry = said.select(*by, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    out = df.withColumn("_in", F.last("_say", ignorenulls=True).over(inside)).join(carry, [*by, "_b"], "left")
    return out.withColumn(name, F.coalesce("_in", "_carry", F.lit(False))).drop("_say", "_b", "_in", "_carry")
