"""Tracks: runs along a line, errors over outages, simplification, assignment and staged matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeseries import asof, over_frame


def backwards(df: DataFrame, by: list[str], t: str, value: str, window: int) -> DataFrame:
    """df with back: how far a value lies below the largest one of the window before it."""
    out = over_frame(df, by, t, window, {"_top": lambda w: F.max(value).over(w)})
    return out.withColumn("back", F.col("_top") - F.col(value)).drop("_top")


def spread_over(df: DataFrame, by: list[str], along: str, value: str, length: float, unit: int = 1000, width: int = 100_000) -> DataFrame:
    """df with spread: largest less smallest value over the last stretch of this length; along is ordered and is kept to a unit-th."""
    rows = df.withColumn("_at", F.round(F.col(along) * unit).cast("long"))
    ends = {"_hi": lambda w: F.max(value).over(w), "_lo": lambda w: F.min(value).over(w)}
    out = over_frame(rows, by, "_at", round(length * unit), ends, width=max(width, round(length * unit)))
    return out.withColumn("spread", F.col("_hi") - F.col("_lo")).drop("_at", "_hi", "_lo")


def along_every(segs: DataFrame, by: list[str], step: float) -> DataFrame:
    """by, k, x, y: a point each step along a line given as segments (see spatial.segments), one task's work bounded by a segment."""
    k = F.sequence(F.ceil(F.col("before") / step).cast("long"), F.floor((F.col("before") + F.col("length")) / step).cast("long"))
    some = segs.filter((F.col("length") > 0) & (F.ceil(F.col("before") / step) <= F.floor((F.col("before") + F.col("length")) / step)))
    p = some.withColumn("k", F.explode(k)).withColumn("s", (F.col("k") * step - F.col("before")) / F.col("length"))
    p = p.select(*by, "k", (F.col("ax") + F.col("s") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("s") * (F.col("by_") - F.col("ay"))).alias("y"))
    return p.dropDuplicates([*by, "k"])


def outage_errors(windows: DataFrame, track: DataFrame, truth: DataFrame, by: list[str], value: str, before: int, after: int) -> DataFrame:
    """windows (by, from_t, to_t) with the error at the first truth at or after their end, no later than after, against the last track value no older than before."""
    ends = windows.withColumn("t", F.col("to_t"))
    seen = asof(ends, truth, by, "t", [value], tolerance=after, forward=True, name="truth").filter("truth is not null").withColumn("t", F.col("truth.t") - 1)
    got = asof(seen, track, by, "t", [value], tolerance=before, name="guess").filter("guess is not null")
    return got.select(*by, "from_t", "to_t", F.abs(F.col(f"guess.{value}") - F.col(f"truth.{value}")).alias("error"))


def lag_search(a: DataFrame, b: DataFrame, by: list[str], bin_: str, value: str, lags: list[int]) -> DataFrame:
    """by, lag, sse: the shift of b's bins that follows a best; lags is a short list, so each row meets it once for each."""
    shifted = b.select(*by, F.col(bin_).alias("_b"), F.col(value).alias("_v"), F.explode(F.array(*(F.lit(x) for x in lags))).alias("lag"))
    met = a.join(shifted.withColumn(bin_, F.col("_b") + F.col("lag")), [*by, bin_])
    sse = met.groupBy(*by, "lag").agg(F.round(F.avg(F.pow(F.col(value) - F.col("_v"), 2)), 6).alias("sse"), F.count("*").alias("n"))
    best = sse.filter("n >= 3").groupBy(*by).agg(F.min(F.struct("sse", "lag")).alias("m"))
    return best.select(*by, F.col("m.lag").alias("lag"), F.col("m.sse").alias("sse"))


def simplify(line: DataFrame, by: str, order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """Vertices kept by recursive halving at the farthest vertex until all lie within tolerance; both ends stay."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        p = pdf[[x, y]].to_numpy(dtype=float)
        keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            n = d @ d
            s = np.clip((p[a + 1 : b] - p[a]) @ d / n, 0, 1) if n else np.zeros(b - a - 1)
            off = np.hypot(*(p[a + 1 : b] - p[a] - s[:, None] * d).T)
            far = int(off.argmax())
            if off[far] > tolerance:
                keep.add(a + 1 + far)
                stack += [(a, a + 1 + far), (a + 1 + far, b)]
        return pdf.iloc[sorted(keep)]

    return line.groupBy(by).applyInPandas(run, line.schema)


def assign_once(pairs: DataFrame, by: str, target: str, place: str, distance: str, cap: int) -> DataFrame:
    """by, target, place: targets in order take their nearest free places, at most cap each; every place is used once.

    Keys are walked in sorted partitions, a key's used places being all that is held; rows without a key are left out.
    """
    def run(frames):
        now, taken, held = None, set(), {}
        for pdf in frames:
            out = []
            for k, t, p in zip(pdf[by], pdf[target], pdf[place]):
                if k != now:
                    now, taken, held = k, set(), {}
                if p not in taken and held.get(t, 0) < cap:
                    taken.add(p)
                    held[t] = held.get(t, 0) + 1
                    out.append((k, t, p))
            yield pd.DataFrame(out, columns=[by, target, place])

    cols = pairs.filter(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, target, distance, place)
    return cols.select(by, target, place).mapInPandas(run, pairs.select(by, target, place).schema)


def staged_groups(df: DataFrame, key: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """key, stage, grp: each stage groups, by its own key, the rows that former stages left alone; the rest stay single.

    grp is the least key of the group. Only counts and least keys are joined back, never pairs.
    """
    left, out = df, None
    for name, by in stages:
        keyed = left.withColumn("_k", by)
        groups = keyed.filter("_k is not null").groupBy("_k").agg(F.min(key).alias("_g"), F.count("*").alias("_n")).filter("_n > 1").select("_k", "_g")
        met = keyed.join(groups, "_k", "left")
        found = met.filter("_g is not null").select(key, F.lit(name).alias("stage"), F.col("_g").alias("grp"))
        out = found if out is None else out.unionByName(found)
        left = met.filter("_g is null").select(*df.columns)
    return out.unionByName(left.select(key, F.lit("single").alias("stage"), F.col(key).alias("grp")))
