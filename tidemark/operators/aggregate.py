"""Aggregates that are more than one built-in: fits, verdicts, splits, distances of distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import cut, scratch


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, slope, intercept, r of y over x."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def best_field(df: DataFrame, by: list[str], fields: list[str], y: str, least: int) -> DataFrame:
    """by, field, r, slope: of candidate columns the one that follows y best, among those with enough rows."""
    long = df.unpivot([*by, y], fields, "field", "x")
    fit = long.groupBy(*by, "field").agg(F.corr("x", y).alias("r"), F.regr_slope("x", y).alias("slope"), F.count("*").alias("n")).filter(F.col("n") >= least)
    best = fit.filter("r is not null").groupBy(*by).agg(F.min(F.struct((-F.round(F.abs("r"), 9)).alias("k"), "field", "r", "slope")).alias("b"))
    return best.select(*by, F.col("b.field").alias("field"), F.col("b.r").alias("r"), F.col("b.slope").alias("slope"))


#: Accuracy of the sketch that brackets an exact quantile: the bracket holds about four in so many rows of a group.
SKETCH = 20_000
#: Up to so many groups' brackets are broadcast.
BROADCAST_GROUPS = 100_000


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and exact quantiles of value: wanted maps names to ('floor', q), the member at floor(q n), or ('linear', q).

    A mergeable sketch brackets each rank; then values inside the brackets are counted by value, with the number
    below and the neighbours just outside. No task holds a group, whatever its size.
    """
    with scratch() as held:
        return held.keep(cut(_quantiles(df, by, value, wanted)))


def _quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    qs = sorted({q for _, q in wanted.values()})
    d = 2 / SKETCH
    edges = F.percentile_approx("_v", [min(1.0, max(0.0, q + e)) for q in qs for e in (-d, d)], SKETCH)
    rows = cut(df.select(*by, F.col(value).alias("_v")).filter("_v is not null"))
    marks = cut(rows.groupBy(*by).agg(edges.alias("_e"), F.count("*").alias("_n")))
    met = rows.join(F.broadcast(marks) if marks.count() <= BROADCAST_GROUPS else marks, by)
    met = cut(met.groupBy(*by, "_n", *(F.when(F.col("_v").between(F.col("_e")[2 * i], F.col("_e")[2 * i + 1]), F.col("_v")).alias(f"_in{i}") for i in range(len(qs))), *(F.when(F.col("_v") < F.col("_e")[2 * i], -1).when(F.col("_v") > F.col("_e")[2 * i + 1], 1).otherwise(0).alias(f"_side{i}") for i in range(len(qs)))).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    out = None
    for name, (kind, q) in wanted.items():
        i = qs.index(q)
        counts = met.groupBy(*by, "_n", f"_in{i}", f"_side{i}").agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        at = F.when(F.col(f"_side{i}") < 0, F.col("_hi")).when(F.col(f"_side{i}") > 0, F.col("_lo")).otherwise(F.col(f"_in{i}"))
        w = Window.partitionBy(*by).orderBy(f"_side{i}", f"_in{i}")
        upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.select(*by, "_n", at.alias("_at"), upto.alias("_to"), (upto - F.col("_c")).alias("_from"))
        # below the bracket only its last member is known, above it only the first; ranks wanted lie no further out
        spot = F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n"))) if kind == "floor" else F.floor(F.lit(q) * (F.col("_n") - 1))
        share = F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
        hit = lambda r: F.max(F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("_at")))
        low, high = hit(spot), hit(F.least(F.col("_n") - 1, spot + 1))
        exact = low if kind == "floor" else low + F.max(share) * (high - low)
        one = counts.groupBy(*by).agg(exact.alias(name))
        out = one if out is None else out.join(one, by)
    return out


def verdict(before: DataFrame, now: DataFrame, key: str, score: str, floor: float) -> DataFrame:
    """key, before, now, verdict by upper medians and worst values: worse or better beyond half again and the floor."""
    def of(df, name):
        worst = df.groupBy(key).agg(F.max(score).alias(f"{name}_worst"))
        return worst.join(quantiles(df, [key], score, {f"{name}_median": ("floor", 0.5)}), key, "left")

    j = of(before, "before").join(of(now, "now"), key, "full_outer")

    def beyond(a: str, b: str) -> Column:
        return (F.col(f"{a}_median") > 1.5 * F.col(f"{b}_median") + floor) | (F.col(f"{a}_worst") > 1.5 * F.col(f"{b}_worst") + 2.5 * floor)

    v = F.when(F.col("before_median").isNull(), "new").when(F.col("now_median").isNull(), "gone").when(beyond("now", "before"), "worse").when(beyond("before", "now"), "better").otherwise("same")
    return j.select(key, F.col("before_median").alias("before"), F.col("now_median").alias("now"), v.alias("verdict"))


def largest_gap(df: DataFrame, by: list[str], value: str, parts: int = 4096) -> DataFrame:
    """by, low, high: the two neighbours of the sorted values that lie farthest apart; the first such pair.

    Values are cut into parts of equal width: a gap lies inside one, or between the largest value of one and the
    smallest of the next.
    """
    ends = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_z"))
    rows = df.select(*by, F.col(value).alias("_v")).filter("_v is not null").join(ends, by)
    rows = rows.withColumn("_p", F.when(F.col("_z") > F.col("_a"), F.floor((F.col("_v") - F.col("_a")) / (F.col("_z") - F.col("_a")) * parts)).otherwise(0).cast("long"))
    w = Window.partitionBy(*by, "_p").orderBy("_v")
    inside = rows.select(*by, F.col("_v").alias("low"), F.lead("_v").over(w).alias("high"))
    edges = rows.groupBy(*by, "_p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    across = edges.select(*by, F.col("_hi").alias("low"), F.lead("_lo").over(Window.partitionBy(*by).orderBy("_p")).alias("high"))
    g = inside.unionByName(across).filter("high is not null")
    best = g.groupBy(*by).agg(F.min(F.struct((F.col("low") - F.col("high")).alias("k"), "low", "high")).alias("b"))
    return best.select(*by, F.col("b.low").alias("low"), F.col("b.high").alias("high"))


def _choose(n: Column, k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda p, i: F.when(i <= k, p * (n - k + i) / i).otherwise(p))


def fisher_more(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided Fisher: chance of at least c bad of c + d when a of a + b were bad before (counts of up to some hundreds)."""
    bad, good, n = a + c, b + d, c + d
    term = lambda k: _choose(bad, k) * _choose(good, n - k) / _choose(bad + good, n)
    return F.aggregate(F.sequence(c, F.least(bad, n)), F.lit(0.0), lambda p, k: p + F.when(n - k <= good, term(k)).otherwise(0.0))


def circular_mean(angle: Column) -> Column:
    """Aggregate: mean direction in degrees, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(angle))), F.sum(F.cos(F.radians(angle))))), F.lit(360.0))


def agreed_direction(df: DataFrame, by: list[str], order: list[str], angle: str, apart: float) -> DataFrame:
    """by, direction: the circular mean of a group's angles in degrees, null if one of them is more than apart off the group's first; nulls count for nothing."""
    known = df.filter(F.col(angle).isNotNull())
    first = known.groupBy(*by).agg(F.min_by(angle, F.struct(*order)).alias("_first"))
    off = F.abs(F.pmod(F.col(angle) - F.col("_first") + 180.0, F.lit(360.0)) - 180.0)
    return known.join(first, by).groupBy(*by).agg(F.when(F.max(off) <= apart, circular_mean(F.col(angle))).alias("direction"))


def effective_size(w: Column) -> Column:
    """Aggregate: number of equal weights that tell as much."""
    return F.pow(F.sum(w), 2) / F.nullif(F.sum(w * w), F.lit(0.0))


def log_sum_exp(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """df with weights of a group from logarithms, shifted by their largest so that none overflows."""
    top = df.groupBy(*by).agg(F.max(x).alias("_top"))
    j = df.join(top, by)
    total = j.groupBy(*by).agg(F.sum(F.exp(F.col(x) - F.col("_top"))).alias("_sum"))
    return j.join(total, by).withColumn(name, F.exp(F.col(x) - F.col("_top")) / F.col("_sum")).drop("_top", "_sum")


def agreed(df: DataFrame, by: list[str], value: str, weight: str, share: float) -> DataFrame:
    """by and the value that holds at least a share of the weight, else null."""
    each = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    best = each.groupBy(*by).agg(F.max(F.struct(F.col("w"), F.col(value).alias("v"))).alias("b"), F.sum("w").alias("all"))
    return best.select(*by, F.when(F.col("b.w") >= share * F.col("all"), F.col("b.v")).alias("agreed"))


def longest_prefix(df: DataFrame, text: str, table: DataFrame, prefix: str, value: str) -> DataFrame:
    """df with the value of the longest prefix of a text: equi-join over its own prefixes, not a scan of the table."""
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    cuts = rows.select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda n: F.substring(F.col(text), F.lit(1), n))).alias(prefix))
    best = cuts.join(table, prefix).groupBy("_row").agg(F.max_by(value, F.length(prefix)).alias(value))
    return rows.join(best, "_row", "left").drop("_row")


def rigid_fit(df: DataFrame, by: list[str], a: tuple[str, str], b: tuple[str, str], weight: Column | None = None) -> DataFrame:
    """by, turn, dx, dy, n: rotation (radians) and shift that carry points a to points b with the least weighted square error."""
    w = F.lit(1.0) if weight is None else weight
    (ax, ay), (bx, by_) = ([F.col(c) for c in p] for p in (a, b))
    s = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(w).alias("w"),
        *(F.sum(w * c).alias(n) for n, c in (("ax", ax), ("ay", ay), ("bx", bx), ("by", by_), ("dot", ax * bx + ay * by_), ("cross", ax * by_ - ay * bx))),
    )
    m = {c: F.col(c) / F.col("w") for c in ("ax", "ay", "bx", "by")}
    turn = F.atan2(F.col("cross") / F.col("w") - (m["ax"] * m["by"] - m["ay"] * m["bx"]), F.col("dot") / F.col("w") - (m["ax"] * m["bx"] + m["ay"] * m["by"]))
    s = s.withColumn("turn", turn)
    c, d = F.cos("turn"), F.sin("turn")
    return s.select(*by, "turn", (m["bx"] - c * m["ax"] + d * m["ay"]).alias("dx"), (m["by"] - d * m["ax"] - c * m["ay"]).alias("dy"), "n")


def plane_fit(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """by, p, q, r of z = p x + q y + r by the normal equations; null where the points do not span a plane."""
    s = df.groupBy(*by).agg(F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(y, y).alias("yy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate((x, y, z))))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", F.when(det > 1e-12, det))
    p = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.col("det")
    q = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.col("det")
    return s.select(*by, p.alias("p"), q.alias("q"), (F.col("m2") - p * F.col("m0") - q * F.col("m1")).alias("r"))


def budget_shares(df: DataFrame, by: list[str], value: str, budget: float, edges: list[float]) -> DataFrame:
    """by, n, over (share beyond budget), counts: rows below each edge and not below the one before, and the rest."""
    place = sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(value) > budget).cast("double")).alias("over"), F.array(*(F.count_if(place == i) for i in range(len(edges) + 1))).alias("counts"))


#: Of a group that loses points about so many that lie farthest off are walked at once.
PEELED = 20_000


def peeled_fit(df: DataFrame, by: str, key: str, a: tuple[str, str], b: tuple[str, str], sigma: str, least: int, off: float, at_once: int = PEELED) -> DataFrame:
    """by, turn, dx, dy, n, turn_sigma: the rigid fit of points a to points b, weighted by sigma, without points that lie too far off it.

    While a group has over `least` points and its worst one is more than off sigmas from where the fit puts it, that
    one goes (of equal ones the first key) and the group is fitted anew. turn_sigma grows with what is left of the error. A
    group of fewer points is left out. A round is a few aggregates over the groups that still lose points; about at_once
    points of each, those farthest off, are then walked by one task, for as long as none of the others can have become the
    worst. So points that go cost a round by the thousand and not each.
    """
    (ax, ay), (bx, by_) = a, b
    kind, key_kind = dict(df.dtypes)[by], dict(df.dtypes)[key]
    with scratch() as held:
        w = 1.0 / F.col("s") / F.col("s")
        points = cut(df.select(by, F.col(key).alias("k"), *(F.col(c).cast("double").alias(n) for c, n in ((ax, "ax"), (ay, "ay"), (bx, "bx"), (by_, "by_"), (sigma, "s")))))
        done = []
        while True:
            m = points.groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by_"))).filter(F.col("n") >= least)
            near = points.join(m.drop("n", "w"), by)
            x, y, u, v = (F.col(c) - F.col(f"m_{c}") for c in ("ax", "ay", "bx", "by_"))
            t = near.groupBy(by).agg(F.sum(w * (x * v - y * u)).alias("cross"), F.sum(w * (x * u + y * v)).alias("dot"), F.sum(w * (x * x + y * y)).alias("info"), F.max(F.hypot(x, y)).alias("radius"), F.min("s").alias("least_s"))
            fit = m.join(t, by).withColumn("turn", F.atan2("cross", "dot"))
            c, s = F.cos("turn"), F.sin("turn")
            fit = cut(fit.withColumns({"dx": F.col("m_bx") - c * F.col("m_ax") + s * F.col("m_ay"), "dy": F.col("m_by_") - s * F.col("m_ax") - c * F.col("m_ay")}))
            apart = points.join(fit, by).withColumn("r", F.hypot(c * F.col("ax") - s * F.col("ay") + F.col("dx") - F.col("bx"), s * F.col("ax") + c * F.col("ay") + F.col("dy") - F.col("by_")) / F.col("s"))
            worst = cut(apart.groupBy(by).agg(F.sum(F.col("r") * F.col("r")).alias("chi"), F.percentile_approx("r", [1 - 0.5**i for i in range(40)], 20_000).alias("ladder"), F.min(F.struct((-F.col("r")).alias("r"), "k")).alias("worst")).join(fit, by))
            more = (F.col("n") > least) & (-F.col("worst.r") > off)
            spread = F.sqrt(F.greatest(F.lit(1.0), F.col("chi") / F.greatest(F.lit(1), 2 * F.col("n") - 3)) / F.col("info"))
            done.append(worst.filter(~more).select(by, "turn", "dx", "dy", "n", spread.alias("turn_sigma")))
            losing = worst.filter(more)
            if losing.isEmpty():
                break
            # beyond the bound lie about at_once points, and never none: the worst is walked in any case
            rung = F.ceil(F.log2(F.col("n") / at_once)).cast("int")
            losing = losing.withColumn("bound", F.when(F.col("n") <= at_once, -1.0).otherwise(F.element_at("ladder", F.least(rung + 1, F.lit(40))))).drop("ladder", "chi")
            far = apart.select(by, "k", "ax", "ay", "bx", "by_", "s", "r").join(losing, by).filter((F.col("r") > F.col("bound")) | (F.col("k") == F.col("worst.k")))
            gone = cut(far.drop("worst").groupBy(by).applyInPandas(_peel(by, least, off), f"{by} {kind}, k {key_kind}"))
            points = cut(points.join(losing.select(by), by, "left_semi").join(gone, [by, "k"], "left_anti"))
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return held.keep(cut(out))


def _peel(by: str, least: int, off: float):
    """The points of one group that go, of those given, which lie farthest off.

    A fit depends on sums alone, so a point that goes is taken out of them. The points that are not given lie within the bound
    of the first fit, and within what places have moved more of a later one; as soon as the worst may be among them, the walk ends.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        one = pdf.iloc[0]
        x, y, u, v = (pdf[c].to_numpy() - one[f"m_{c}"] for c in ("ax", "ay", "bx", "by_"))
        s = pdf["s"].to_numpy()
        w, live, n = 1 / s / s, np.ones(len(pdf), dtype=bool), int(one["n"])
        total, dot, cross, sx, sy, su, sv = one["w"], one["dot"], one["cross"], 0.0, 0.0, 0.0, 0.0
        first = None
        while n > least:
            turn = np.arctan2(cross - (sx * sv - sy * su) / total, dot - (sx * su + sy * sv) / total)
            c, d = np.cos(turn), np.sin(turn)
            dx, dy = (su - c * sx + d * sy) / total, (sv - d * sx - c * sy) / total
            first = first or (turn, dx, dy)
            moved = 2 * abs(np.sin((turn - first[0]) / 2)) * one["radius"] + np.hypot(dx - first[1], dy - first[2])
            r = np.where(live, np.hypot(c * x - d * y + dx - u, d * x + c * y + dy - v) / s, -1.0)
            i = int(r.argmax())
            # the first worst is known to be the worst of all
            if not live[i] or r[i] <= off or (not live.all() and r[i] <= one["bound"] + moved / one["least_s"]):
                break
            live[i], n, total = False, n - 1, total - w[i]
            dot, cross = dot - w[i] * (x[i] * u[i] + y[i] * v[i]), cross - w[i] * (x[i] * v[i] - y[i] * u[i])
            sx, sy, su, sv = sx - w[i] * x[i], sy - w[i] * y[i], su - w[i] * u[i], sv - w[i] * v[i]
        # rounding may put the worst at the limit itself: it goes all the same, as the round found
        if live.all():
            live[int(r.argmax())] = False
        return pdf.loc[~live, [by, "k"]]

    return run


def lag_search(fixes: DataFrame, track: DataFrame, by: str, lags: list[float], window: float = 30.0, step: float = 10.0, least_fixes: int = 25, least_turn: float = 0.5235987755982988, least_speed: float = 3.0, least_windows: int = 6) -> DataFrame:
    """by, windows, lag, rms: the time by which fixes (by, t, x, y) come behind a track (by, t, x, y, psi, speed), where turns tell it.

    Every window of `window` seconds, one each step, that has enough fixes and, at the least lag, enough of a turn and speed throughout, and whose
    fixes all find the track at both the least and the largest lag, is fitted by turning, shifting and scaling the track at each lag; errors
    of all windows are added up. The lag with the least sum counts, unless it is at an end of those tried or from
    too few windows: then it is null, as is rms. t is in microseconds.

    Sums are made by steps of time and added up to windows, so a fix is moved once for each lag and not for each window.
    """
    from tidemark.operators import timeseries as ts

    us, many = 1_000_000, round(window / step)
    t = ts.unwrapped(track, [by], ["t"], "psi", "_psi").select(by, "t", "x", "y", "_psi", "speed")
    span = fixes.groupBy(by).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    tried = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(round(lag * us)).alias("us")) for k, lag in enumerate(lags))))
    f = fixes.join(span, by).select(by, "_t1", "_t0", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("t").alias("_at"), tried.alias("lag"))
    f = f.withColumn("t", F.col("_at") - F.col("lag.us")).withColumn("block", F.floor((F.col("_at") - F.col("_t0")) / (step * us)).cast("long"))
    f = ts.around(f, t, [by], "t", ["x", "y", "_psi", "speed"], back="p", ahead="q")
    share = F.when(F.col("q.t") > F.col("p.t"), (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))).otherwise(0.0)
    mid = lambda c: F.col(f"p.{c}") + share * (F.col(f"q.{c}") - F.col(f"p.{c}"))
    f = f.withColumns({"ax": mid("x"), "ay": mid("y"), "v": mid("speed"), "psi": F.col("p._psi"), "k": F.col("lag.k")})
    x, y, u, v = (F.col(c) for c in ("ax", "ay", "fx", "fy"))
    parts = {"n": F.lit(1.0), "sx": x, "sy": y, "su": u, "sv": v, "dot": x * u + y * v, "cross": x * v - y * u, "aa": x * x + y * y, "bb": u * u + v * v}
    block = f.groupBy(by, "_t0", "_t1", "block", "k").agg(*(F.sum(c).alias(n) for n, c in parts.items()), F.count(F.when(F.col("ax").isNull(), 1)).alias("lost"), F.min("v").alias("slow"), F.min("psi").alias("lo"), F.max("psi").alias("hi"))
    over = block.withColumn("window", F.explode(F.sequence(F.greatest(F.col("block") - (many - 1), F.lit(0).cast("long")), F.col("block"))))
    over = over.filter(F.col("_t0") + F.col("window") * round(step * us) + round(window * us) <= F.col("_t1"))
    sums = over.groupBy(by, "window", "k").agg(*(F.sum(n).alias(n) for n in parts), F.sum("lost").alias("lost"), F.min("slow").alias("slow"), (F.max("hi") - F.min("lo")).alias("turn"))
    n = F.col("n")
    mean = lambda a, b: F.col(a) * F.col(b) / n
    dot, cross = F.col("dot") - mean("sx", "su") - mean("sy", "sv"), F.col("cross") - mean("sx", "sv") + mean("sy", "su")
    aa, bb = F.col("aa") - mean("sx", "sx") - mean("sy", "sy"), F.col("bb") - mean("su", "su") - mean("sv", "sv")
    rest = F.when(aa > 0, F.greatest(F.lit(0.0), bb - (dot * dot + cross * cross) / aa)).otherwise(bb)
    ends = F.col("k").isin(0, len(lags) - 1)
    good = sums.groupBy(by, "window").agg(F.max("n").alias("_n"), F.sum(F.when(ends, F.col("lost"))).alias("_lost"), F.min(F.when(F.col("k") == 0, F.col("slow"))).alias("_slow"), F.max(F.when(F.col("k") == 0, F.col("turn"))).alias("_turn"))
    good = good.filter((F.col("_n") >= least_fixes) & (F.col("_lost") == 0) & (F.col("_slow") >= least_speed) & (F.col("_turn") >= least_turn)).select(by, "window")
    sse = sums.withColumn("rest", rest).join(good, [by, "window"]).groupBy(by, "k").agg(F.sum("rest").alias("sse"), F.sum("n").alias("points"), F.count("*").alias("windows"))
    best = sse.groupBy(by).agg(F.max("windows").alias("windows"), F.max("points").alias("points"), F.min(F.struct(F.round("sse", 9).alias("sse"), "k")).alias("b"))
    sure = (F.col("windows") >= least_windows) & F.col("b.k").between(1, len(lags) - 2)
    best = best.select(by, "windows", F.when(sure, F.element_at(F.array(*map(F.lit, lags)), F.col("b.k") + 1)).alias("lag"), F.when(sure, F.sqrt(F.col("b.sse") / F.col("points"))).alias("rms"))
    return span.select(by).join(best, by, "left").select(by, F.coalesce("windows", F.lit(0).cast("long")).alias("windows"), "lag", "rms")
