"""Vehicle logs and their scores, on events: user_id is the trip, event_type the channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import conv, fixes, wire
from tidemark.operators import aggregate as ag
from tidemark.operators import search as se
from tidemark.operators import stateful as st
from tidemark.operators import tables, tracks
from tidemark.operators import timeseries as ts
from tidemark.operators.stateful import batch, kept_wheels, recent_far
from tidemark.plans.timeline import _E, HOUR, events
from tidemark.sources import ulog

ORDER = ["t", "event_id"]
STATES = {0: "off", 1: "running", 2: "stalled"}


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(e, kind):
    return e.filter(F.col("event_type") == kind)


def _mean_at(e, kind):
    return _kind(e, kind).groupBy("user_id", "t").agg(F.avg("value").alias("value"))


def a3_speed_samples(spark, sf_dir):
    """Replies that count, at the time they were read, with names for codes and nothing for impossible speeds."""
    e = events(spark, sf_dir).filter("event_id % 3 = 1 and event_id % 7 <> 0")
    speed = fixes.non_negative((F.col("value") - 10) / 3.6)
    return e.select("event_id", fixes.midpoint(F.col("t"), F.col("event_id") % 80_001).alias("t"), F.round(speed, 6).alias("speed"), conv.code_name((F.col("event_id") % 4).cast("int"), STATES).alias("state"))


def a1_log_scan(spark, sf_dir):
    """Each user's days written as binary logs and read back by their own description."""
    e = events(spark, sf_dir).withColumns({"day": F.floor(F.col("t") / (24 * HOUR)).cast("long"), "id": F.col("event_id").cast("double")})
    log = ulog.decode(ulog.encoded(e, ["user_id", "day"], "t", ["id", "value"], "reading"))
    got = ulog.stream_of(log, "reading", ["id", "value", "later"])
    return got.select(F.col("id").cast("long").alias("event_id"), "path", "t_us", F.round("value", 4).alias("value"), "later")


def a4_motion_frames(spark, sf_dir):
    v = lambda i: F.col("embedding")[i].cast("double")
    e = _t(spark, sf_dir, "embeddings")
    yaw = fixes.yaw_about_vertical((v(0), v(1), v(2)), (v(3), v(4), v(5)))
    return e.select("vec_id", F.round(yaw, 5).alias("yaw"), fixes.flag(F.col("vec_id"), 0).alias("moving"), fixes.flag(F.col("vec_id"), 3).alias("simulated"), conv.sentinel_to_null(F.col("vec_id") % 16, 15).alias("code"))


def b1_satellite_fixes(spark, sf_dir):
    return events(spark, sf_dir).filter(fixes.satellite(F.col("value") - 20, F.col("event_id") % 80)).select("event_id")


def b2_truth_fixes(spark, sf_dir):
    return events(spark, sf_dir).filter(fixes.truth(F.col("value") - 20, F.col("event_id") % 80)).select("event_id", "t")


def b11_held_shares(spark, sf_dir):
    """A switch that holds above 200 and lets go at 150 or below."""
    return ts.latched(events(spark, sf_dir), ["user_id"], ORDER, F.col("value") > 80, F.col("value") <= 30).select("event_id", "held")


def b18_pending(spark, sf_dir):
    """Orders not sent yet (F), but for each customer's current one."""
    o = _t(spark, sf_dir, "orders")
    current = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return o.filter("o_orderstatus <> 'F'").join(current, "o_orderkey", "left_anti").select("o_orderkey")


def c2_clock_mapping(spark, sf_dir):
    """Log time to clock time by the last sync before, the first one for what came earlier."""
    e = events(spark, sf_dir)
    sync = _kind(e, "purchase").select("user_id", "t", "event_id", (F.col("t") + F.col("event_id") * 1000).alias("utc"))
    first = sync.groupBy("user_id").agg(F.min(F.struct("t", "event_id", "utc")).alias("first"))
    got = ts.asof(_kind(e, "view"), sync, ["user_id"], "t", ["event_id", "utc"], tie="event_id").join(first, "user_id", "left")
    at = lambda c: F.coalesce(F.col(f"match.{c}"), F.col(f"first.{c}"))
    return got.select("event_id", (F.col("t") + at("utc") - at("t")).alias("utc"))


def c6_bracketed_pairs(spark, sf_dir):
    e = events(spark, sf_dir)
    got = ts.around(_kind(e, "click"), _kind(e, "view"), ["user_id"], "t", ["event_id", "value"], tie="event_id")
    steady = (F.col("ahead.t") - F.col("back.t") <= 24 * HOUR) & (F.abs(F.col("ahead.value") - F.col("back.value")) <= 40)
    return got.filter(steady).select("event_id", F.col("back.event_id").alias("before_id"), F.round((F.col("back.value") + F.col("ahead.value")) / 2, 4).alias("value"))


def c11_replaced(spark, sf_dir):
    """Views take the value of the last click if it is fresh, else their own."""
    e = events(spark, sf_dir)
    got = ts.asof(_kind(e, "view"), _kind(e, "click"), ["user_id"], "t", ["value"], tolerance=12 * HOUR, tie="event_id")
    return got.select("event_id", F.round(F.coalesce("match.value", "value"), 4).alias("value"))


def d5_plan_rollup(spark, sf_dir):
    e = ts.previous(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"])
    off = (F.col("event_type") == "error") & (F.coalesce(F.col("prev.event_type"), F.lit("")) != "error")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(off).alias("went_off"), F.round(F.avg((F.col("event_type") == "view").cast("double")), 6).alias("on_share"))


def d10_profile_scores(spark, sf_dir):
    """Suppliers as profiles of parts: which share of theirs was seen returned, the best first."""
    p = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("hit"))
    s = p.groupBy("l_suppkey").agg(F.sum("hit").alias("hits"), F.avg("hit").alias("share"))
    got = tables.ordinal(s, -F.floor(F.col("share") * 200), [F.desc("share"), F.desc("hits"), "l_suppkey"], "place")
    return got.select("l_suppkey", "hits", F.round("share", 6).alias("share"), "place")


STEPS = (0.05, 0.1, 0.25, 0.5, 1.0)


def d15_snapped_scales(spark, sf_dir):
    """Each user's middle scale, or the known step that is within two hundredths of it."""
    e = events(spark, sf_dir).withColumn("scale", F.floor(F.col("value") * 100).cast("long") % 120 / 100).filter("scale > 0")
    m = ag.quantiles(e, ["user_id"], "scale", {"scale": ("floor", 0.5)})
    near = F.filter(F.array(*map(F.lit, STEPS)), lambda s: F.abs(F.col("scale") - s) <= 0.02 * s + 1e-12)
    return m.select("user_id", F.coalesce(F.get(near, F.lit(0)), F.col("scale")).alias("scale"))


def d16_verdicts(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").withColumn("ratio", F.col("l_extendedprice") / (F.col("l_quantity") * 1000))
    m = ag.quantiles(p, ["l_suppkey"], "ratio", {"median": ("floor", 0.5)})
    off = p.join(m, "l_suppkey").withColumn("off", F.abs(F.col("ratio") - F.col("median")))
    mad = ag.quantiles(off, ["l_suppkey"], "off", {"mad": ("floor", 0.5)})
    n = p.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.corr("l_quantity", "l_extendedprice").alias("r"))
    v = F.when(F.col("n") < 30, "pending").when((F.col("r") > 0.85) & (F.col("mad") < 0.33 * F.col("median")), "pass").otherwise("fail")
    return n.join(m, "l_suppkey").join(mad, "l_suppkey").select("l_suppkey", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), v.alias("verdict"))


def d18_calibrations(spark, sf_dir):
    """Each supplier's price as so much a unit and so much a percent of discount, learnt line by line."""
    p = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_partkey", (F.col("l_extendedprice") / 10_000).alias("y"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("b"))
    got = st.batch(p, "l_suppkey", ["id", "y", "a", "b"], st.calibration(1.0, 0.01, 4.0), (1.0, 0.0, 1.0, 0.0, 1.0), "l_suppkey long, id long, p double, q double", ["id", "l_partkey", "y"])
    return got.select("l_suppkey", "id", F.round("p", 5).alias("p"), F.round("q", 5).alias("q"))


def d21_match_metrics(spark, sf_dir):
    """Share of readings on the wrong road, and how long it took to come back: spells of low values."""
    e = events(spark, sf_dir)
    s = ts.spells(e, ["user_id"], "t", F.col("value") < 12, 6 * HOUR, 0).withColumn("took", ((F.col("to_t") - F.col("from_t")) / 1e6).cast("double"))
    q = ag.quantiles(s, ["user_id"], "took", {"p50": ("floor", 0.5), "p99": ("floor", 0.99)})
    n = e.groupBy("user_id").agg(F.round(F.avg((F.col("value") < 12).cast("double")), 6).alias("wrong"))
    return n.join(q, "user_id", "left").select("user_id", "wrong", F.round("p50", 3).alias("p50"), F.round("p99", 3).alias("p99"))


def d23_outage_report(spark, sf_dir):
    """Every gap in the views, scored against each of two tracks."""
    e = events(spark, sf_dir)
    v = _mean_at(e, "view")
    gaps = ts.gaps(v, ["user_id"], "t", 24 * HOUR, F.min("t"), F.max("t"))
    out = None
    for kind in ("click", "purchase"):
        one = tracks.outage_errors(gaps, _mean_at(e, kind), v, ["user_id"], "value", 12 * HOUR, 1).withColumn("track", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("track").agg(F.count("*").alias("n"), F.round(F.avg("error"), 4).alias("mean"), F.round(F.max("error"), 4).alias("worst"))


def d25_drawn_scores(spark, sf_dir):
    """Clicks against the line through the views: middle, ninth tenth, worst and last error, and how often it was large."""
    e = events(spark, sf_dir)
    got = ts.interpolate(_kind(e, "click"), _mean_at(e, "view"), ["user_id"], "t", "value", 48 * HOUR, 0).filter("value_at is not null")
    got = tables.cut(got.select("user_id", "t", "event_id", F.round(F.abs(F.col("value") - F.col("value_at")), 3).alias("error")))
    q = ag.quantiles(got, ["user_id"], "error", {"p50": ("floor", 0.5), "p90": ("floor", 0.9)})
    n = got.groupBy("user_id").agg(F.max("error").alias("worst"), F.max_by("error", F.struct("t", "event_id")).alias("last"), F.count_if(F.col("error") > 30).alias("off"))
    return n.join(q, "user_id")


def d26_signed_offsets(spark, sf_dir):
    """Each purchase against the nearest view in time: how far ahead or behind, in seconds."""
    e = events(spark, sf_dir)
    got = ts.nearest(_kind(e, "purchase"), _kind(e, "view"), ["user_id"], "t", ["event_id"], tolerance=24 * HOUR, tie="event_id")
    return got.select("event_id", F.round((F.col("match.t") - F.col("t")) / 1e6, 3).alias("seconds"))


def d32_eta_windows(spark, sf_dir):
    """Stretches that close once 150 units are driven: planned against actual hours, by tenths of all stretches of a user."""
    got = st.batch(events(spark, sf_dir), "user_id", ["t", "value"], st.legs(150.0), (0, 0.0, None), "user_id long, chunk long, driven double, from_t long, to_t long", ORDER)
    w = got.withColumn("hours", (F.col("to_t") - F.col("from_t")) / HOUR).filter("hours > 0")
    w = tables.cut(w.select("user_id", F.round(F.col("hours") / F.col("driven"), 6).alias("ratio")))
    return ag.quantiles(w, ["user_id"], "ratio", {"p10": ("floor", 0.1), "p50": ("floor", 0.5), "p90": ("floor", 0.9)})


def d33_plausibility(spark, sf_dir):
    """Counts of a list by kind, and whether its odd rows and its size against a copy are within bounds."""
    o = _t(spark, sf_dir, "orders")
    n = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("towns"), F.avg((F.col("o_totalprice") < 20_000).cast("double")).alias("odd"), F.count_if(F.col("o_orderkey") % 3 > 0).alias("copy"))
    ok = (F.col("odd") <= 0.05) & (F.col("n") / F.col("copy")).between(0.7, 2)
    return n.select("o_orderpriority", "n", "towns", F.round("odd", 6).alias("odd"), ok.alias("ok"))


def d35_lowest_limits(spark, sf_dir):
    listed = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_quantity").alias("listed"))
    return _t(spark, sf_dir, "orders").join(listed, "o_orderkey", "left").select("o_orderkey", F.coalesce("listed", (F.col("o_custkey") % 100).cast("double")).alias("limit"))


def d47_voted_names(spark, sf_dir):
    """The ship year that most of an order's lines name; of equal ones the first."""
    p = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n"))
    return p.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("k"), "name")).alias("b")).select("l_orderkey", F.col("b.name").alias("name"))


def d50_ranked_devices(spark, sf_dir):
    """Parts as devices: rules give points, then size and key decide; the best two of each brand."""
    points = F.when(F.col("p_name").startswith("new"), 3).otherwise(0) + F.when(F.col("p_type").isin("PROMO", "ECONOMY"), 2).otherwise(0) + F.when(F.col("p_size") > 40, 1).otherwise(0)
    p = _t(spark, sf_dir, "part").withColumn("points", points)
    best = se.top_per_group(p, ["p_brand"], [F.desc("points"), F.desc("p_size"), "p_partkey"], 2)
    return best.select("p_brand", (F.col("place") - 1).cast("long").alias("place"), "p_partkey", "points")


def d51_cluster_moments(spark, sf_dir):
    """Weighted mean, variances and direction of each label's vectors."""
    v = lambda i: F.col("embedding")[i].cast("double")
    e = _t(spark, sf_dir, "embeddings").select("label", "vec_id", v(0).alias("x"), v(1).alias("y"), (v(2) * v(2) + 0.01).alias("w"))
    m = e.groupBy("label").agg(F.sum("w").alias("s"), *(F.sum(F.col("w") * c).alias(n) for n, c in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))), F.max_by("vec_id", F.struct("w", "vec_id")).alias("heaviest"))
    x, y = F.col("x") / F.col("s"), F.col("y") / F.col("s")
    return m.select("label", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(F.col("xx") / F.col("s") - x * x, 6).alias("vx"), F.round(F.col("yy") / F.col("s") - y * y, 6).alias("vy"), F.round(F.col("xy") / F.col("s") - x * y, 6).alias("vxy"), F.round(F.atan2(y, x), 5).alias("direction"), "heaviest")


def d54_direction_shares(spark, sf_dir):
    """Share of each user's weight that points within a quarter turn of north, and their three heaviest channels."""
    e = events(spark, sf_dir)
    near = F.abs(F.pmod(F.col("value") * 3.6 + 180, F.lit(360.0)) - 180) <= 45
    s = e.groupBy("user_id").agg(F.round(F.sum(F.when(near, F.col("value")).otherwise(0.0)) / F.sum("value"), 6).alias("share"))
    w = e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 3).alias("w"))
    top = w.groupBy("user_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), "event_type"))), 1, 3), lambda x: x["event_type"]), ",").alias("top"))
    return s.join(top, "user_id")


def d55_shared_length(spark, sf_dir):
    """How much of each order's quantity is of parts that the order before has too."""
    p = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    before = p.select((F.col("l_orderkey") + 1).alias("l_orderkey"), "l_partkey").distinct()
    return p.join(before, ["l_orderkey", "l_partkey"], "left_semi").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("shared"))


def e4_recent_far(spark, sf_dir):
    """The latest earlier reading of the last day that differs by 50 or more."""
    got = batch(events(spark, sf_dir), "user_id", ["event_id", "t", "value"], recent_far(50.0, 24 * HOUR), ((), (), None, ()), "user_id long, event_id long, far_id long", ["t", "event_id"])
    return got.select("event_id", "far_id")


def e14_jumps(spark, sf_dir):
    """Steps larger than time allows, by how much."""
    e = ts.previous(events(spark, sf_dir), ["user_id"], ORDER, ["t", "value"])
    excess = F.abs(F.col("value") - F.col("prev.value")) - (F.col("t") - F.col("prev.t")) / HOUR - 15
    return e.withColumn("excess", excess).filter("excess > 0").select("event_id", F.round("excess", 4).alias("excess"))


def l18_fresh_wheels(spark, sf_dir):
    """Readings at which all of four channels were heard within two days."""
    return ts.all_fresh(events(spark, sf_dir), ["user_id"], "t", "event_type", ["view", "click", "purchase", "error"], 48 * HOUR).select("event_id")


def l19_guidance(spark, sf_dir):
    """On, leaving or off a route: off once the reading stayed high for a day."""
    return st.batch(events(spark, sf_dir), "user_id", ["event_id", "t", "value"], st.guidance(40.0, 24 * HOUR), (None, None), "user_id long, event_id long, state string", ORDER)


def l20_announcements(spark, sf_dir):
    """Each threshold is called once for each user and channel, at the first reading that reaches it."""
    e = events(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (20, 50, 100)))))
    return e.filter("value >= threshold").groupBy("user_id", "event_type", "threshold").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("event_id"))


def m8_quantised(spark, sf_dir):
    e7 = F.floor(F.col("c_acctbal") * 123_457).cast("long")
    return _t(spark, sf_dir, "customer").select("c_custkey", fixes.quantised(e7).cast("long").alias("e6"))


def m16_spoken(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", fixes.spoken(F.col("p_retailprice")).alias("metres"), F.greatest(F.lit(1), F.floor(F.col("p_size") * 7 / 60 + 0.5)).cast("long").alias("minutes"))


def m17_insertions(spark, sf_dir):
    """Between which neighbouring lines of an order a stop at 25 adds least."""
    q = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(q, lambda s: s["l_quantity"]).alias("q")).filter("size(q) > 1")
    added = F.transform(F.sequence(F.lit(1), F.size("q") - 1), lambda i: F.struct((F.abs(F.element_at("q", i) - 25) + F.abs(F.element_at("q", i + 1) - 25) - F.abs(F.element_at("q", i + 1) - F.element_at("q", i))).alias("more"), i.alias("i")))
    return o.select("l_orderkey", F.array_min(added)["i"].cast("long").alias("at"), F.array_min(added)["more"].alias("more"))


def _wheels(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", *(F.abs(F.col("embedding")[i].cast("double") * 8).alias(f"w{i}") for i in range(4)))


def m20_plausible(spark, sf_dir):
    return _wheels(spark, sf_dir).select("vec_id", wire.plausible(F.array("w0", "w1", "w2", "w3")).alias("ok"))


def m20_kept_wheels(spark, sf_dir):
    """Readings of four wheels of each label's vehicle, a tenth of a second apart: those that count, jumps from the last one that counted left out."""
    w = _wheels(spark, sf_dir).join(_t(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    w = w.select("label", "vec_id", (F.col("vec_id") * 10_000).alias("t"), F.array("w0", "w1", "w2", "w3").alias("w"))
    return batch(w, "label", ["vec_id", "t", "w"], kept_wheels(), (None, None), f"label {dict(w.dtypes)['label']}, vec_id long, ok boolean", ["t"])


def m21_wheel_yaw(spark, sf_dir):
    return _wheels(spark, sf_dir).select("vec_id", F.round(wire.wheel_yaw(F.col("w2"), F.col("w3"), 1.5, F.col("vec_id") % 5 == 0), 6).alias("yaw"))


SHARES, VALUES = [0.0, 0.25, 0.5, 0.9, 1.0], [1.0, 2.0, 4.0, 10.0, 40.0]


def m24_drawn(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(fixes.quantile_at(SHARES, VALUES, F.col("o_orderkey") % 1001 / 1000), 6).alias("drawn"))


def p3_catalogue(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


def p4_bus_report(spark, sf_dir):
    """Clicks against the nearest views: bias, scale and count."""
    e = events(spark, sf_dir)
    got = ts.nearest(_kind(e, "click"), _mean_at(e, "view"), ["user_id"], "t", ["value"], tolerance=12 * HOUR).filter("match is not null")
    return got.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") - F.col("match.value")), 6).alias("bias"), F.round(F.sum(F.col("value") * F.col("match.value")) / F.sum(F.col("match.value") * F.col("match.value")), 6).alias("scale"))


def p5_offsets_by_direction(spark, sf_dir):
    """Mean reading on the way out and back: passes are runs without a gap, directions alternate."""
    e = ts.islands(events(spark, sf_dir), ["user_id"], ORDER, 12 * HOUR)
    p = e.groupBy("user_id", "run").agg(F.avg("value").alias("offset")).withColumn("out", F.col("run") % 2 == 1)
    return p.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("out"), F.col("offset"))), 6).alias("out_mean"), F.round(F.avg(F.when(~F.col("out"), F.col("offset"))), 6).alias("back_mean"), F.count("*").alias("passes"))


def p13_parity(spark, sf_dir):
    """Views against the last click: how far one replay is from the other."""
    e = events(spark, sf_dir)
    got = ts.asof(_kind(e, "view"), _kind(e, "click"), ["user_id"], "t", ["value"], tolerance=48 * HOUR, tie="event_id").filter("match is not null")
    got = tables.cut(got.select("user_id", F.round(F.abs(F.col("value") - F.col("match.value")), 4).alias("error")))
    q = ag.quantiles(got, ["user_id"], "error", {"p50": ("floor", 0.5), "p90": ("floor", 0.9)})
    return q.join(got.groupBy("user_id").agg(F.max("error").alias("worst")), "user_id")


def p14_end_errors(spark, sf_dir):
    """Where each user's channels ended, against the mean of all ends."""
    last = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct(*ORDER)).alias("end"))
    mean = last.groupBy("event_type").agg(F.avg("end").alias("mean"))
    return last.join(mean, "event_type").groupBy("user_id").agg(F.round(F.avg(F.abs(F.col("end") - F.col("mean"))), 6).alias("error"))


def p19_stops_at(spark, sf_dir):
    """Stops as they stood in the middle of January: the last word on each counts, errors take one away."""
    noon = 1_704_067_200_000_000 + 15 * 24 * HOUR
    e = events(spark, sf_dir).filter(F.col("t") <= noon).withColumn("stop", F.floor(F.col("value") / 10).cast("long"))
    return e.groupBy("user_id", "stop").agg(F.max_by("event_type", F.struct(*ORDER)).alias("word")).filter("word <> 'error'").select("user_id", "stop")


def t4_local_times(spark, sf_dir):
    """Events by day of the week and hour in Kyiv, spread over a year so that both changes of the clock lie in it."""
    spread = F.col("ts").cast("timestamp") + F.make_dt_interval(F.col("event_id").cast("int") % 366)
    e = _t(spark, sf_dir, "events").withColumn("at", F.from_utc_timestamp(spread, "Europe/Kyiv"))
    return e.groupBy(F.weekday("at").cast("long").alias("day"), F.hour("at").cast("long").alias("h")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "abcdelmpt" and k[1:2].isdigit()}
_MEAN = "g AS (SELECT user_id, event_type, t, avg(value) AS value FROM e GROUP BY 1, 2, 3)"


def _floor_q(x: str, q: float) -> str:
    return f"list_sort(list({x}))[least(count({x}), CAST(floor({q}::DOUBLE * count({x})) AS BIGINT) + 1)]"


ORACLES = {
    "a3_speed_samples": f"WITH {_E} SELECT event_id, t - event_id % 80001 // 2 AS t, CASE WHEN value >= 10 THEN round((value - 10) / 3.6::DOUBLE, 6) END AS speed, CASE event_id % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'running' WHEN 2 THEN 'stalled' ELSE 'code_3' END AS state FROM e WHERE event_id % 3 = 1 AND event_id % 7 <> 0",
    "a1_log_scan": f"WITH {_E} SELECT event_id, user_id || '/' || t // {24 * HOUR} AS path, t AS t_us, round(value, 4) AS value, CAST(NULL AS DOUBLE) AS later FROM e",
    "d18_calibrations": """WITH RECURSIVE n AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, l_extendedprice / 10000 AS y, l_quantity / 10 AS a, l_discount * 10 AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
        s0 AS (SELECT DISTINCT l_suppkey FROM n), r AS (SELECT l_suppkey, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS i, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS pp, 0.0::DOUBLE AS pq, 1.0::DOUBLE AS qq FROM s0
        UNION ALL SELECT l_suppkey, id, i, p + ha / s * e, q + hb / s * e, pp - ha * ha / s, pq - ha * hb / s, qq - hb * hb / s FROM (SELECT *, a * ha + b * hb + 4 AS s, y - p * a - q * b AS e FROM (SELECT *, pp * a + pq * b AS ha, pq * a + qq * b AS hb
            FROM (SELECT n.*, r.p, r.q, r.pp, r.pq, r.qq + 0.01 AS qq FROM r JOIN n ON n.l_suppkey = r.l_suppkey AND n.i = r.i + 1))))
        SELECT l_suppkey, id, round(p, 5) AS p, round(q, 5) AS q FROM r WHERE i > 0""",
    "a4_motion_frames": """WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
        SELECT vec_id, round(-(e[1] * e[4] + e[2] * e[5] + e[3] * e[6]) / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3]), 5) AS yaw, vec_id % 2 = 1 AS moving, (vec_id >> 3) % 2 = 1 AS simulated, nullif(vec_id % 16, 15) AS code FROM v""",
    "b1_satellite_fixes": f"WITH {_E} SELECT event_id FROM e WHERE value >= 20 AND event_id % 80 < 50",
    "b2_truth_fixes": f"WITH {_E} SELECT event_id, t FROM e WHERE value >= 20 AND event_id % 80 <= 10",
    "b11_held_shares": f"WITH {_E} SELECT event_id, coalesce(last_value(CASE WHEN value > 80 THEN true WHEN value <= 30 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), false) AS held FROM e",
    "b18_pending": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)",
    "c2_clock_mapping": f"""WITH {_E}, s AS (SELECT user_id, t, event_id * 1000 AS off, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, event_id FROM e WHERE event_type = 'purchase'),
        m AS (SELECT v.event_id, v.user_id, v.t, arg_max(s.off, (s.t, s.event_id)) AS off FROM e v LEFT JOIN s ON s.user_id = v.user_id AND s.t <= v.t WHERE v.event_type = 'view' GROUP BY 1, 2, 3)
        SELECT m.event_id, m.t + coalesce(m.off, s.off) AS utc FROM m LEFT JOIN s ON s.user_id = m.user_id AND s.i = 1""",
    "c6_bracketed_pairs": f"""WITH {_E}, v AS (SELECT * FROM e WHERE event_type = 'view'), b AS (SELECT c.event_id, arg_max(v.event_id, (v.t, v.event_id)) AS bid, arg_max(v.value, (v.t, v.event_id)) AS bv, max(v.t) AS bt FROM e c JOIN v ON v.user_id = c.user_id AND v.t <= c.t WHERE c.event_type = 'click' GROUP BY 1),
        a AS (SELECT c.event_id, arg_min(v.value, (v.t, -v.event_id)) AS av, min(v.t) AS at_ FROM e c JOIN v ON v.user_id = c.user_id AND v.t >= c.t WHERE c.event_type = 'click' GROUP BY 1)
        SELECT event_id, bid AS before_id, round((bv + av) / 2, 4) AS value FROM b JOIN a USING (event_id) WHERE at_ - bt <= {24 * HOUR} AND abs(av - bv) <= 40""",
    "c11_replaced": f"""WITH {_E}, m AS (SELECT v.event_id, v.value, v.t, arg_max(c.value, (c.t, c.event_id)) AS cv, max(c.t) AS ct FROM e v LEFT JOIN e c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.t <= v.t WHERE v.event_type = 'view' GROUP BY 1, 2, 3)
        SELECT event_id, round(CASE WHEN t - ct <= {12 * HOUR} THEN cv ELSE value END, 4) AS value FROM m""",
    "d5_plan_rollup": f"""WITH {_E}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM e) SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors,
        count(*) FILTER (event_type = 'error' AND coalesce(b, '') <> 'error') AS went_off, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS on_share FROM p GROUP BY 1""",
    "d10_profile_scores": """WITH p AS (SELECT l_suppkey, l_partkey, max(CAST(l_returnflag = 'R' AS INT)) AS hit FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, CAST(sum(hit) AS BIGINT) AS hits, avg(hit) AS share FROM p GROUP BY 1)
        SELECT l_suppkey, hits, round(share, 6) AS share, row_number() OVER (ORDER BY share DESC, hits DESC, l_suppkey) AS place FROM s""",
    "d15_snapped_scales": f"""WITH {_E}, s AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) % 120 / 100 AS s FROM e), m AS (SELECT user_id, {_floor_q('s', 0.5)} AS m FROM s WHERE s > 0 GROUP BY 1)
        SELECT user_id, coalesce(list_filter({list(STEPS)}::DOUBLE[], lambda k: abs(m - k) <= 0.02 * k + 1e-12)[1], m) AS scale FROM m""",
    "d16_verdicts": f"""WITH p AS (SELECT *, l_extendedprice / (l_quantity * 1000) AS r FROM lineitem), m AS (SELECT l_suppkey, {_floor_q('r', 0.5)} AS median, count(*) AS n, corr(l_quantity, l_extendedprice) AS c FROM p GROUP BY 1),
        d AS (SELECT l_suppkey, {_floor_q('abs(r - median)', 0.5)} AS mad FROM p JOIN m USING (l_suppkey) GROUP BY 1) SELECT l_suppkey, round(median, 6) AS median, round(mad, 6) AS mad, CASE WHEN n < 30 THEN 'pending' WHEN c > 0.85 AND mad < 0.33 * median THEN 'pass' ELSE 'fail' END AS verdict FROM m JOIN d USING (l_suppkey)""",
    "d21_match_metrics": f"""WITH {_E}, f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM e WHERE value < 12), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, new DESC ROWS UNBOUNDED PRECEDING) AS run FROM f),
        s AS (SELECT user_id, run, (max(t) - min(t)) / 1e6 AS took FROM r GROUP BY 1, 2), q AS (SELECT user_id, {_floor_q('took', 0.5)} AS p50, {_floor_q('took', 0.99)} AS p99 FROM s GROUP BY 1), n AS (SELECT user_id, round(count(*) FILTER (value < 12) / count(*), 6) AS wrong FROM e GROUP BY 1)
        SELECT user_id, wrong, round(p50, 3) AS p50, round(p99, 3) AS p99 FROM n LEFT JOIN q USING (user_id)""",
    "d23_outage_report": f"""WITH {_E}, {_MEAN}, v AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM g WHERE event_type = 'view'),
        j AS (SELECT v.user_id, v.p, c.event_type AS track, abs(c.value - v.value) AS error FROM v JOIN g c ON c.event_type IN ('click', 'purchase') AND c.user_id = v.user_id AND c.t <= v.t - 1 AND v.t - 1 - c.t <= {12 * HOUR} WHERE v.t - v.p > {24 * HOUR} QUALIFY row_number() OVER (PARTITION BY v.user_id, v.p, c.event_type ORDER BY c.t DESC) = 1)
        SELECT track, count(*) AS n, round(avg(error), 4) AS mean, round(max(error), 4) AS worst FROM j GROUP BY 1""",
    "d25_drawn_scores": f"""WITH {_E}, {_MEAN}, v AS (SELECT * FROM g WHERE event_type = 'view'), b AS (SELECT c.event_id, c.user_id, c.t, c.value, max_by(v.value, v.t) AS pv, max(v.t) AS pt FROM e c JOIN v ON v.user_id = c.user_id AND v.t <= c.t WHERE c.event_type = 'click' GROUP BY 1, 2, 3, 4),
        a AS (SELECT c.event_id, min_by(v.value, v.t) AS nv, min(v.t) AS nt FROM e c JOIN v ON v.user_id = c.user_id AND v.t >= c.t WHERE c.event_type = 'click' GROUP BY 1),
        x AS (SELECT user_id, t, event_id, round(abs(value - CASE WHEN nt = pt THEN pv WHEN nt - pt <= {48 * HOUR} THEN pv + (nv - pv) * (t - pt) / (nt - pt) WHEN t = pt THEN pv END), 3) AS error FROM b LEFT JOIN a USING (event_id))
        SELECT user_id, max(error) AS worst, arg_max(error, (t, event_id)) AS last, count(*) FILTER (error > 30) AS off, {_floor_q('error', 0.5)} AS p50, {_floor_q('error', 0.9)} AS p90 FROM x WHERE error IS NOT NULL GROUP BY 1""",
    "d26_signed_offsets": f"""WITH {_E}, m AS (SELECT p.event_id, p.t, v.t AS vt, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.t - p.t), v.t) AS r FROM e p LEFT JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' AND abs(v.t - p.t) <= {24 * HOUR} WHERE p.event_type = 'purchase')
        SELECT event_id, round((vt - t) / 1e6, 3) AS seconds FROM m WHERE r = 1""",
    "d32_eta_windows": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
        r AS (SELECT user_id, t, value, i, 0 AS chunk, value AS total FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.t, n.value, n.i, CASE WHEN r.total >= 150 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.total >= 150 THEN n.value ELSE r.total + n.value END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1),
        w AS (SELECT user_id, chunk, sum(value) AS driven, (max(t) - min(t)) / {HOUR} AS hours FROM r GROUP BY 1, 2), x AS (SELECT user_id, round(hours / driven, 6) AS ratio FROM w WHERE driven >= 150 AND hours > 0)
        SELECT user_id, {_floor_q('ratio', 0.1)} AS p10, {_floor_q('ratio', 0.5)} AS p50, {_floor_q('ratio', 0.9)} AS p90 FROM x GROUP BY 1""",
    "d33_plausibility": "WITH n AS (SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS towns, count(*) FILTER (o_totalprice < 20000) / count(*) AS odd, count(*) FILTER (o_orderkey % 3 > 0) AS copy FROM orders GROUP BY 1) SELECT o_orderpriority, n, towns, round(odd, 6) AS odd, odd <= 0.05 AND n / copy BETWEEN 0.7 AND 2 AS ok FROM n",
    "d35_lowest_limits": "SELECT o_orderkey, coalesce(m, CAST(o_custkey % 100 AS DOUBLE)) AS \"limit\" FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey",
    "d47_voted_names": "WITH n AS (SELECT l_orderkey, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, name FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, name) = 1",
    "d50_ranked_devices": """WITH p AS (SELECT *, CASE WHEN p_name LIKE 'new%' THEN 3 ELSE 0 END + CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 2 ELSE 0 END + CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS points FROM part)
        SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY points DESC, p_size DESC, p_partkey) - 1 AS place, p_partkey, CAST(points AS INTEGER) AS points FROM p QUALIFY place < 2""",
    "d51_cluster_moments": """WITH e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) * CAST(embedding[3] AS DOUBLE) + 0.01 AS w FROM embeddings),
        m AS (SELECT label, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy, arg_max(vec_id, (w, vec_id)) AS heaviest FROM e GROUP BY 1)
        SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(xx - x * x, 6) AS vx, round(yy - y * y, 6) AS vy, round(xy - x * y, 6) AS vxy, round(atan2(y, x), 5) AS direction, heaviest FROM m""",
    "d54_direction_shares": f"""WITH {_E}, a AS (SELECT *, value * 3.6 + 180 - floor((value * 3.6 + 180) / 360) * 360 - 180 AS a FROM e), s AS (SELECT user_id, round(sum(CASE WHEN abs(a) <= 45 THEN value ELSE 0 END) / sum(value), 6) AS share FROM a GROUP BY 1),
        w AS (SELECT user_id, event_type, round(sum(value), 3) AS w FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) <= 3) SELECT user_id, any_value(share) AS share, string_agg(event_type, ',' ORDER BY w DESC, event_type) AS top FROM s JOIN w USING (user_id) GROUP BY 1""",
    "d55_shared_length": "SELECT l_orderkey, sum(l_quantity) AS shared FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey - 1 AND b.l_partkey = a.l_partkey) GROUP BY 1",
    "e4_recent_far": f"WITH {_E} SELECT a.event_id, arg_max(b.event_id, (b.t, b.event_id)) AS far_id FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.t < a.t AND a.t - b.t <= {24 * HOUR} AND abs(a.value - b.value) >= 50 GROUP BY 1",
    "e14_jumps": f"WITH {_E}, p AS (SELECT event_id, abs(value - lag(value) OVER w) - (t - lag(t) OVER w) / {HOUR} - 15 AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, round(x, 4) AS excess FROM p WHERE x > 0",
    "l18_fresh_wheels": f"""WITH {_E}, f AS (SELECT event_id, count(DISTINCT event_type) FILTER (event_type IN ('view', 'click', 'purchase', 'error')) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {48 * HOUR} PRECEDING AND CURRENT ROW) AS n FROM e) SELECT event_id FROM f WHERE n = 4""",
    "l19_guidance": f"""WITH {_E}, s AS (SELECT *, value <= 40 AS near FROM e), g AS (SELECT *, sum(CASE WHEN near THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s),
        m AS (SELECT *, CASE WHEN near THEN 'on' WHEN t - min(CASE WHEN NOT near THEN t END) OVER (PARTITION BY user_id, k) >= {24 * HOUR} THEN 'off' ELSE 'leaving' END AS state FROM g),
        l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM m) SELECT user_id, event_id, state FROM l WHERE was IS NULL OR was <> state""",
    "l20_announcements": f"WITH {_E} SELECT user_id, event_type, threshold, arg_min(event_id, (t, event_id)) AS event_id FROM e, (SELECT unnest([20, 50, 100]) AS threshold) WHERE value >= threshold GROUP BY 1, 2, 3",
    "m8_quantised": "SELECT c_custkey, CAST(floor((CAST(floor(c_acctbal * 123457) AS BIGINT) + 5) / 10) AS BIGINT) AS e6 FROM customer",
    "m16_spoken": f"WITH l AS (SELECT unnest({list(fixes.SPOKEN)}) AS s) SELECT p_partkey, CAST(arg_min(s, (abs(s - p_retailprice), s)) AS DOUBLE) AS metres, CAST(greatest(1, floor(any_value(p_size) * 7 / 60 + 0.5)) AS BIGINT) AS minutes FROM part, l GROUP BY 1",
    "m17_insertions": """WITH q AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER w AS i, lead(l_quantity) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
        SELECT l_orderkey, i AS at, abs(q - 25) + abs(n - 25) - abs(n - q) AS more FROM q WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY more, i) = 1""",
    "m20_plausible": "WITH w AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE) * 8)) AS w FROM embeddings) SELECT vec_id, list_max(w) <= 300 / 3.6 AND list_max(w) - list_min(w) <= 3 / 3.6 + 0.5 * list_avg(w) AS ok FROM w",
    "m20_kept_wheels": """WITH RECURSIVE w AS (SELECT label, vec_id, vec_id * 10000 AS t, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE) * 8)) AS w, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
        o AS (SELECT *, list_max(w) <= 300 / 3.6 AND list_max(w) - list_min(w) <= 3 / 3.6 + 0.5 * list_avg(w) AS fits FROM w),
        r AS (SELECT label, k, vec_id, fits AS ok, CASE WHEN fits THEN t END AS at_us, CASE WHEN fits THEN w END AS last FROM o WHERE k = 1
            UNION ALL SELECT label, k, vec_id, ok, CASE WHEN ok THEN t ELSE at_us END, CASE WHEN ok THEN w ELSE last END
            FROM (SELECT o.label, o.k, o.vec_id, o.t, o.w, r.at_us, r.last, o.fits AND (r.at_us IS NULL OR o.t - r.at_us > 300000 OR list_max(list_transform(list_zip(o.w, r.last), lambda z: abs(z[1] - z[2]))) <= 2 / 3.6 + 14 * (o.t - r.at_us) / 1e6) AS ok FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1))
        SELECT label, vec_id, ok FROM r""",
    "m21_wheel_yaw": "SELECT vec_id, round((abs(CAST(embedding[4] AS DOUBLE) * 8) - abs(CAST(embedding[3] AS DOUBLE) * 8)) / 1.5 * CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END, 6) AS yaw FROM embeddings",
    "m24_drawn": "WITH u AS (SELECT o_orderkey, o_orderkey % 1001 / 1000 AS u FROM orders) SELECT o_orderkey, round(CASE WHEN u <= 0 THEN 1 WHEN u <= 0.25 THEN 1 + u / 0.25 WHEN u <= 0.5 THEN 2 + (u - 0.25) / 0.25 * 2 WHEN u <= 0.9 THEN 4 + (u - 0.5) / 0.4 * 6 ELSE 10 + (u - 0.9) / 0.1 * 30 END, 6) AS drawn FROM u",
    "p3_catalogue": f"WITH {_E} SELECT user_id, min(t) AS from_t, max(t) AS to_t, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM e GROUP BY 1",
    "p4_bus_report": f"""WITH {_E}, {_MEAN}, m AS (SELECT c.event_id, c.user_id, c.value, v.value AS v, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.t - c.t), v.t) AS r FROM e c JOIN g v ON v.event_type = 'view' AND v.user_id = c.user_id AND abs(v.t - c.t) <= {12 * HOUR} WHERE c.event_type = 'click')
        SELECT user_id, count(*) AS n, round(avg(value - v), 6) AS bias, round(sum(value * v) / sum(v * v), 6) AS scale FROM m WHERE r = 1 GROUP BY 1""",
    "p5_offsets_by_direction": f"""WITH {_E}, p AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p),
        q AS (SELECT user_id, run, avg(value) AS o FROM r GROUP BY 1, 2) SELECT user_id, round(avg(o) FILTER (run % 2 = 1), 6) AS out_mean, round(avg(o) FILTER (run % 2 = 0), 6) AS back_mean, count(*) AS passes FROM q GROUP BY 1""",
    "p13_parity": f"""WITH {_E}, m AS (SELECT v.event_id, v.user_id, v.value, v.t, arg_max(c.value, (c.t, c.event_id)) AS cv, max(c.t) AS ct FROM e v JOIN e c ON c.event_type = 'click' AND c.user_id = v.user_id AND c.t <= v.t WHERE v.event_type = 'view' GROUP BY 1, 2, 3, 4),
        x AS (SELECT user_id, round(abs(value - cv), 4) AS error FROM m WHERE t - ct <= {48 * HOUR}) SELECT user_id, {_floor_q('error', 0.5)} AS p50, {_floor_q('error', 0.9)} AS p90, max(error) AS worst FROM x GROUP BY 1""",
    "p14_end_errors": f"WITH {_E}, l AS (SELECT user_id, event_type, arg_max(value, (t, event_id)) AS z FROM e GROUP BY 1, 2), m AS (SELECT *, avg(z) OVER (PARTITION BY event_type) AS m FROM l) SELECT user_id, round(avg(abs(z - m)), 6) AS error FROM m GROUP BY 1",
    "p19_stops_at": f"WITH {_E}, s AS (SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS stop, arg_max(event_type, (t, event_id)) AS w FROM e WHERE t <= {1_704_067_200_000_000 + 15 * 24 * HOUR} GROUP BY 1, 2) SELECT user_id, stop FROM s WHERE w <> 'error'",
    "t4_local_times": "WITH u AS (SELECT ts + to_days(CAST(event_id % 366 AS INTEGER)) AS u FROM events), y AS (SELECT u, make_date(year(u), 3, 31) AS m, make_date(year(u), 10, 31) AS o FROM u), l AS (SELECT u + CASE WHEN u >= m - to_days(CAST(isodow(m) % 7 AS INTEGER)) + INTERVAL 1 HOUR AND u < o - to_days(CAST(isodow(o) % 7 AS INTEGER)) + INTERVAL 1 HOUR THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END AS x FROM y) SELECT isodow(x) - 1 AS day, CAST(hour(x) AS BIGINT) AS h, count(*) AS n FROM l GROUP BY 1, 2",
}
