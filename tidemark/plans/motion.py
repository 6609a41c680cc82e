"""Filters, fits, spells, turns and paths, on events, order tables and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import conv, geo, text
from tidemark.functions.times import micros, open_at, rush_factor, week_minute
from tidemark.operators import aggregate as ag
from tidemark.operators import graph as gr
from tidemark.operators import spatial as sp
from tidemark.operators import stateful as st
from tidemark.operators import timeseries as ts
from tidemark.plans.timeline import _E, HOUR, events

ORDER = ["t", "event_id"]


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def l10_kalman_level(spark, sf_dir):
    got = st.batch(events(spark, sf_dir), "user_id", ["event_id", "t", "value"], st.kalman(4.0, 25.0, HOUR), (None, 0.0, 0.0), "user_id long, event_id long, level double, spread double", ORDER)
    return got.select("event_id", F.round("level", 4).alias("level"), F.round("spread", 4).alias("spread"))


def l12_particle_level(spark, sf_dir):
    got = st.batch(events(spark, sf_dir), "user_id", ["event_id", "t", "value"], st.particles(200, 4.0, 25.0, HOUR), (None, None, None), "user_id long, event_id long, level double", ORDER)
    return got.select("event_id", F.round("level", 6).alias("level"))


def l21_held_limit(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("limit", F.floor(F.col("value") / 50).cast("long") * 50)
    return st.batch(e, "user_id", ["event_id", "t", "limit"], st.held_limit(6 * HOUR), (None, None, None), "user_id long, event_id long, shown long", ORDER)


def l2_late_rows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.col("t") - F.when(F.col("event_type") == "error", F.pmod(F.col("event_id"), F.lit(5)) * HOUR).otherwise(0))
    return ts.late(e, ["user_id"], "event_id", "at", 2 * HOUR, 5000).select("event_id", "late")


def l8_trust_segments(spark, sf_dir):
    def jump(b):
        far = F.abs(F.col("value") - b["value"]) > 40 + 10 * ((F.col("t") - b["t"]) / HOUR)
        return (F.col("t") - b["t"] > 24 * HOUR) | far

    got = ts.breaks(events(spark, sf_dir), ["user_id"], ORDER, ["t", "value"], jump)
    return got.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("t").alias("from_t"), F.max("t").alias("to_t"))


def p1_incidents(spark, sf_dir):
    return ts.spells(events(spark, sf_dir), ["user_id"], "t", F.col("value") > 30, 12 * HOUR, 2 * HOUR)


def e7_extended_spans(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", (F.col("t") - HOUR).alias("from_t"), (F.col("t") + 3 * HOUR).alias("to_t"))
    return ts.merge_intervals(e, ["user_id"], "from_t", "to_t")


def e16_unwrapped_angle(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("angle", F.pmod(F.col("value"), F.lit(6.0)) - 3.0)
    return ts.unwrapped(e, ["user_id"], ORDER, "angle", "whole").select("event_id", F.round("whole", 5).alias("whole"))


def e12_centred_speed(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("t", micros(F.col("o_orderdate")))
    o = ts.numbered(o, ["o_custkey"], ["t", "o_orderkey"], bucket=365 * ts.BUCKET)
    ends = {"a": lambda w: F.first(F.struct("place", "t", "o_totalprice")).over(w), "z": lambda w: F.last(F.struct("place", "t", "o_totalprice")).over(w)}
    o = ts.over_frame(o, ["o_custkey"], "place", 1, ends, after=1, width=10_000).filter("z.place - a.place = 2")
    days = F.nullif((F.col("z.t") - F.col("a.t")) / (24 * HOUR), F.lit(0.0))
    return o.select("o_orderkey", ((F.col("z.o_totalprice") - F.col("a.o_totalprice")) / days).alias("speed")).filter("speed is not null")


def e10_first_last(spark, sf_dir):
    key = F.struct("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("last_order"))


def e15_cumulative_share(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    upto = ts.running_sum(o.groupBy("o_custkey", "o_totalprice").agg(F.count("*").alias("c")), ["o_custkey"], ["o_totalprice"], F.col("c"), "upto", 50_000)
    return o.join(upto.select("o_custkey", "o_totalprice", "upto"), ["o_custkey", "o_totalprice"]).join(n, "o_custkey").select("o_orderkey", F.round(F.col("upto") / F.col("n"), 8).alias("share"))


def d4_budget_shares(spark, sf_dir):
    got = ag.budget_shares(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 50_000.0, [10_000.0, 30_000.0, 60_000.0])
    return got.select("l_returnflag", "l_linestatus", "n", F.round("over", 6).alias("over_share"), *(F.col("counts")[i].alias(f"n{i}") for i in range(4)))


def d8_last_value(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("t", "event_id")).alias("last"))


def d17_plane_fit(spark, sf_dir):
    got = ag.plane_fit(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice")
    return got.select("l_returnflag", *(F.round(c, 2).alias(c) for c in "pqr"))


def d20_rigid_fit(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    of = lambda i: F.col("embedding")[i].cast("double")
    p = e.select("label", *(of(i).alias(f"x{i}") for i in range(4)))
    got = ag.rigid_fit(p, ["label"], ("x0", "x1"), ("x2", "x3"))
    return got.select("label", *(F.round(c, 6).alias(c) for c in ("turn", "dx", "dy")), "n")


def d45_two_of_three(spark, sf_dir):
    """Of a line's three signs, the truth of at least two."""
    votes = sum(((c).cast("int") for c in (F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_returnflag") == "R")), F.lit(0))
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(votes >= 2).alias("agreed"), F.count("*").alias("n"))


def d38_reach(spark, sf_dir):
    """Each nation's customers with the largest distance of the nation's balances from theirs."""
    c = _t(spark, sf_dir, "customer")
    ends = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return c.join(ends, "c_nationkey").select("c_custkey", F.round(F.greatest(F.col("c_acctbal") - F.col("lo"), F.col("hi") - F.col("c_acctbal")), 4).alias("reach"))


def p17_stretch_scales(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / (24 * HOUR)).cast("long"))
    both = e.groupBy("user_id", "day").agg(F.sum(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    return both.filter("a > 0 and b > 0").select("user_id", "day", F.round(F.col("b") / F.col("a"), 6).alias("scale"))


def _line(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def h5_maneuvers(spark, sf_dir):
    p = ts.previous(_line(spark, sf_dir), ["label"], ["vec_id"], ["x", "y"], 1000, "p").withColumns({"px": F.col("p.x"), "py": F.col("p.y")})
    p = ts.previous(p, ["label"], ["vec_id"], ["vec_id", "x", "y", "px", "py"], 1000, "at").filter("at.px is not null")
    turn = geo.turn_angle(F.col("at.px"), F.col("at.py"), F.col("at.x"), F.col("at.y"), F.col("x"), F.col("y"))
    kind = F.when(F.abs(turn) < 0.5, "straight").when(F.abs(turn) > 2.8, "back").when(turn > 0, "left").otherwise("right")
    return p.select(F.col("at.vec_id").alias("vec_id"), F.round(turn, 5).alias("turn"), kind.alias("kind"))


def m14_crossings(spark, sf_dir):
    """Where a line through the vectors of a label crosses the diagonal of the plane."""
    s = sp.segments(_line(spark, sf_dir), ["label"], "vec_id", "x", "y")
    at = geo.crossing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), F.lit(-1.0), F.lit(-1.0), F.lit(1.0), F.lit(1.0))
    got = s.withColumn("s", at).filter("s is not null")
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ax") + F.col("s") * (F.col("bx") - F.col("ax"))), 6).alias("x"))


def m9_segment_cells(spark, sf_dir):
    s = sp.segments(_line(spark, sf_dir), ["label"], "vec_id", "x", "y")
    cells = s.select("label", F.explode(geo.segment_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), 0.05)).alias("c"))
    return cells.groupBy("label", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(F.count("*").alias("n"))


def m3_enu(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", (48 + F.pmod(F.col("c_custkey"), F.lit(100)) / 1000).alias("lat"), (11 + F.pmod(F.col("c_custkey"), F.lit(37)) / 500).alias("lon"))
    e, n = geo.enu(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0))
    return c.select("c_custkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


def c14_cell_counts(spark, sf_dir):
    got = sp.in_box(_line(spark, sf_dir), "x", "y", (-0.1, -0.1, 0.15, 0.1), 0.05)
    return got.groupBy(geo.cell(F.col("x"), 0.05).alias("cx"), geo.cell(F.col("y"), 0.05).alias("cy")).agg(F.count("*").alias("n"))


def c8_events_in_windows(spark, sf_dir):
    """Events inside any window of errors, whoever's: windows become disjoint first, then meet rows by the minute."""
    e = events(spark, sf_dir).withColumn("all", F.lit(1))
    wins = e.filter("event_type = 'error'").select("all", F.col("t").alias("from_t"), (F.col("t") + HOUR // 60).alias("to_t"))
    got = ts.inside_windows(e, ts.merge_intervals(wins, ["all"], "from_t", "to_t", HOUR), ["all"], "t", HOUR // 60)
    return got.filter("from_t is not null").groupBy("event_type").agg(F.count("*").alias("n"))


def c24_shared_nodes(spark, sf_dir):
    """Parts that lie on both of two suppliers' streets, for each pair of neighbours."""
    p = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    on = p.select((F.col("l_suppkey") - 1).alias("l_suppkey"), "l_partkey")
    return p.join(on, ["l_suppkey", "l_partkey"]).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("least"))


def c35_exits(spark, sf_dir):
    tree = _t(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).cast("long").alias("a"), F.col("o_orderkey").alias("b")).filter("a <> b")
    return gr.exit_counts(gr.both_ways(tree)).filter("n > 0")


def h8_longest_path(spark, sf_dir):
    tree = _t(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).cast("long").alias("a"), F.col("o_orderkey").alias("b")).filter("a <> b").withColumn("cost", 1.0 + F.pmod(F.col("b"), F.lit(7)))
    return gr.longest_path(gr.both_ways(tree, "cost"), 1)


RANGES = ((540, 1020), (1980, 2460), (3420, 3900), (9000, 10080))


def t2_open_now(spark, sf_dir):
    ranges = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in RANGES))
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count_if(open_at(ranges, week_minute(F.col("ts")))).alias("open"), F.count("*").alias("n"))


def t3_rush_factor(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.hour("ts").cast("long").alias("h"), (F.weekday("ts") < 5).alias("workday")).agg(F.round(F.avg(rush_factor(F.col("ts"))), 4).alias("factor"))


def s12_numbers(spark, sf_dir):
    """All numbers of at least two digits in a document, and their sum."""
    n = F.transform(F.regexp_extract_all("text", F.lit(r"(?<![0-9])([0-9]{2,6})(?![0-9])"), F.lit(1)), lambda x: x.cast("long"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(n).cast("long").alias("n"), F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def r9_bit_masks(spark, sf_dir):
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    mask = bit(F.col("l_quantity") > 25, 0).bitwiseOR(bit(F.col("l_discount") > 0.05, 1)).bitwiseOR(bit(F.col("l_tax") > 0.04, 2))
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bit_or(mask).cast("long").alias("any"), F.bit_and(mask).cast("long").alias("all"), F.sum(F.bit_count(mask)).alias("bits"))


def c21_close_balances(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    b = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return sp.close_values(a, b, ["nation"], "c_acctbal", "s_acctbal", 400.0).select("c_custkey", "s_suppkey")


def b5_classes(spark, sf_dir):
    """Rules in order, the first that holds names the row."""
    rules = [(F.col("p_size") <= 5, "small"), (F.col("p_type") == "ECONOMY", "cheap"), (F.col("p_retailprice") > 950, "dear"), (F.col("p_name").endswith("ring"), "ring")]
    return _t(spark, sf_dir, "part").select("p_partkey", conv.first_match(rules, "other").alias("class"))


def d37_common_spelling(spark, sf_dir):
    """The commonest name of each brand, of equally common ones the first by code point."""
    n = _t(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    best = n.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("k"), "p_name")).alias("b"))
    return best.select("p_brand", F.col("b.p_name").alias("name"), (-F.col("b.k")).alias("n"))


def d56_distinct_counts(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


def e11_heaviest(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    share = F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.round(share, 6).alias("share"))


def t5_date_stamps(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyMMdd").alias("stamp")).agg(F.count("*").alias("n"))


def s17_codes(spark, sf_dir):
    code = F.substr(F.md5(F.col("c_custkey").cast("string")), F.lit(1), F.lit(10))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.code_normal(F.concat(code, F.lit(" lo"))).alias("code"))


def s14_house_keys(spark, sf_dir):
    house = F.concat(F.lpad(F.pmod(F.col("s_suppkey"), F.lit(40)).cast("string"), 3, "0"), F.lit(" - "), F.substr("s_name", F.lit(1), F.lit(1)))
    return _t(spark, sf_dir, "supplier").groupBy(text.house_key(house).alias("house")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "bcdehlmprst" and k[1:2].isdigit()}
_L = "v AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_S = "s AS (SELECT label, x AS ax, y AS ay, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS bx, lead(y) OVER (PARTITION BY label ORDER BY vec_id) AS b2 FROM v)"
_BOTH = "SELECT a, b, cost FROM t UNION ALL SELECT b, a, cost FROM t"
_OPEN = " OR ".join(f"(m >= {a} AND m < {b})" for a, b in RANGES)
ORACLES = {
    "l10_kalman_level": f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
        r AS (SELECT user_id, event_id, i, t, value AS x, CAST(25 AS DOUBLE) AS p FROM n WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, t, x + pp / (pp + 25) * (value - x), (1 - pp / (pp + 25)) * pp FROM (SELECT n.user_id, n.event_id, n.i, n.t, n.value, r.x, r.p + 4 * ((n.t - r.t) / {HOUR}) AS pp FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))
        SELECT event_id, round(x, 4) AS level, round(p, 4) AS spread FROM r""",
    "l2_late_rows": f"""WITH {_E}, a AS (SELECT *, t - CASE WHEN event_type = 'error' THEN event_id % 5 * {HOUR} ELSE 0 END AS seen FROM e)
        SELECT event_id, max(seen) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - seen > {2 * HOUR} AS late FROM a""",
    "l8_trust_segments": f"""WITH {_E}, p AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        s AS (SELECT *, CAST(sum(CASE WHEN t - pt > {24 * HOUR} OR abs(value - pv) > 40 + 10 * ((t - pt) / {HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM p)
        SELECT user_id, segment, count(*) AS n, min(t) AS from_t, max(t) AS to_t FROM s GROUP BY 1, 2""",
    "p1_incidents": f"""WITH {_E}, p AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e WHERE value > 30),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, new DESC ROWS UNBOUNDED PRECEDING) AS run FROM p)
        SELECT user_id, min(t) AS from_t, max(t) AS to_t, count(*) AS n FROM r GROUP BY user_id, run HAVING max(t) - min(t) >= {2 * HOUR}""",
    "e7_extended_spans": f"""WITH {_E}, s AS (SELECT user_id, t - {HOUR} AS a, t + {3 * HOUR} AS b FROM e WHERE event_type = 'purchase'),
        m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, min(a) AS from_t, max(b) AS to_t FROM r GROUP BY user_id, run""",
    "e16_unwrapped_angle": f"""WITH {_E}, g AS (SELECT *, value - 6 * floor(value / 6) - 3 AS angle FROM e), p AS (SELECT *, angle - lag(angle) OVER (PARTITION BY user_id ORDER BY t, event_id) AS d FROM g)
        SELECT event_id, round(angle + 2 * pi() * sum(coalesce(-floor((d + pi()) / (2 * pi())), 0)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 5) AS whole FROM p""",
    "e12_centred_speed": "WITH s AS (SELECT o_orderkey, (lead(o_totalprice) OVER w - lag(o_totalprice) OVER w) / nullif(date_diff('day', lag(o_orderdate) OVER w, lead(o_orderdate) OVER w), 0) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, s AS speed FROM s WHERE s IS NOT NULL",
    "e10_first_last": "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1",
    "e15_cumulative_share": "SELECT o_orderkey, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 8) AS share FROM orders",
    "d4_budget_shares": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) FILTER (l_extendedprice > 50000) / count(*), 6) AS over_share, count(*) FILTER (l_extendedprice < 10000) AS n0,
        count(*) FILTER (l_extendedprice >= 10000 AND l_extendedprice < 30000) AS n1, count(*) FILTER (l_extendedprice >= 30000 AND l_extendedprice < 60000) AS n2, count(*) FILTER (l_extendedprice >= 60000) AS n3 FROM lineitem GROUP BY 1, 2""",
    "d8_last_value": f"WITH {_E} SELECT user_id, event_type, arg_max(value, (t, event_id)) AS last FROM e GROUP BY 1, 2",
    "d17_plane_fit": """WITH s AS (SELECT l_returnflag, var_pop(l_quantity) AS xx, covar_pop(l_quantity, l_discount) AS xy, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz FROM lineitem GROUP BY 1),
        f AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS p, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS q FROM s) SELECT l_returnflag, round(p, 2) AS p, round(q, 2) AS q, round(mz - p * mx - q * my, 2) AS r FROM f""",
    "d20_rigid_fit": """WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS bx, CAST(embedding[4] AS DOUBLE) AS b2 FROM embeddings),
        s AS (SELECT label, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(bx) AS bx, avg(b2) AS b2, atan2(covar_pop(ax, b2) - covar_pop(ay, bx), covar_pop(ax, bx) + covar_pop(ay, b2)) AS turn FROM p GROUP BY 1)
        SELECT label, round(turn, 6) AS turn, round(bx - cos(turn) * ax + sin(turn) * ay, 6) AS dx, round(b2 - sin(turn) * ax - cos(turn) * ay, 6) AS dy, n FROM s""",
    "d45_two_of_three": "SELECT l_suppkey, count(*) FILTER (CAST(l_quantity > 25 AS INT) + CAST(l_discount > 0.05 AS INT) + CAST(l_returnflag = 'R' AS INT) >= 2) AS agreed, count(*) AS n FROM lineitem GROUP BY 1",
    "d38_reach": "SELECT c_custkey, round(greatest(c_acctbal - min(c_acctbal) OVER w, max(c_acctbal) OVER w - c_acctbal), 4) AS reach FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "p17_stretch_scales": f"WITH {_E}, g AS (SELECT user_id, t // {24 * HOUR} AS day, sum(value) FILTER (event_type = 'view') AS a, sum(value) FILTER (event_type = 'click') AS b FROM e GROUP BY 1, 2) SELECT user_id, day, round(b / a, 6) AS scale FROM g WHERE a > 0 AND b > 0",
    "h5_maneuvers": f"""WITH {_L}, p AS (SELECT vec_id, x - lag(x) OVER w AS a, y - lag(y) OVER w AS b, lead(x) OVER w - x AS c, lead(y) OVER w - y AS d FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
        t AS (SELECT vec_id, atan2(a * d - b * c, a * c + b * d) AS g FROM p WHERE a IS NOT NULL AND c IS NOT NULL) SELECT vec_id, round(g, 5) AS turn, CASE WHEN abs(g) < 0.5 THEN 'straight' WHEN abs(g) > 2.8 THEN 'back' WHEN g > 0 THEN 'left' ELSE 'right' END AS kind FROM t""",
    "m14_crossings": f"""WITH {_L}, {_S}, c AS (SELECT label, ax, bx, ((-1 - ax) * 2 - (-1 - ay) * 2) / nullif((bx - ax) * 2 - (b2 - ay) * 2, 0) AS s, ((-1 - ax) * (b2 - ay) - (-1 - ay) * (bx - ax)) / nullif((bx - ax) * 2 - (b2 - ay) * 2, 0) AS u FROM s WHERE bx IS NOT NULL)
        SELECT label, count(*) AS n, round(avg(ax + s * (bx - ax)), 6) AS x FROM c WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY 1""",
    "m3_enu": "WITH c AS (SELECT c_custkey, 48 + c_custkey % 100 / 1000 AS lat, 11 + c_custkey % 37 / 500 AS lon FROM customer) SELECT c_custkey, round(radians(lon - 11) * cos(radians(48.0)) * 6371000, 3) AS east, round(radians(lat - 48) * 6371000, 3) AS north FROM c",
    "m9_segment_cells": f"""WITH {_L}, {_S}, r AS (SELECT *, unnest(range(CAST(floor(least(ay, b2) / 0.05) AS BIGINT), CAST(floor(greatest(ay, b2) / 0.05) AS BIGINT) + 1)) AS cy FROM s WHERE bx IS NOT NULL),
        q AS (SELECT *, ax + (bx - ax) * (least(greatest(cy * CAST(0.05 AS DOUBLE), least(ay, b2)), greatest(ay, b2)) - ay) / (b2 - ay) AS p, ax + (bx - ax) * (least(greatest((cy + 1) * CAST(0.05 AS DOUBLE), least(ay, b2)), greatest(ay, b2)) - ay) / (b2 - ay) AS z FROM r),
        x AS (SELECT label, cy, unnest(range(CAST(floor(least(p, z) / 0.05) AS BIGINT), CAST(floor(greatest(p, z) / 0.05) AS BIGINT) + 1)) AS cx FROM q) SELECT label, cx, cy, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "c14_cell_counts": f"WITH {_L} SELECT CAST(floor(x / 0.05) AS BIGINT) AS cx, CAST(floor(y / 0.05) AS BIGINT) AS cy, count(*) AS n FROM v WHERE x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.1 AND 0.1 GROUP BY 1, 2",
    "c8_events_in_windows": f"WITH {_E} SELECT event_type, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM e w WHERE w.event_type = 'error' AND e.t >= w.t AND e.t < w.t + {HOUR // 60}) GROUP BY 1",
    "c24_shared_nodes": "WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem) SELECT a.s AS l_suppkey, count(*) AS n, min(a.k) AS least FROM p a JOIN p b ON b.s = a.s + 1 AND b.k = a.k GROUP BY 1",
    "c35_exits": "WITH t AS (SELECT o_orderkey // 2 AS a, o_orderkey AS b FROM orders WHERE o_orderkey // 2 <> o_orderkey), w AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t) SELECT x.a, x.b, count(*) AS n FROM w x JOIN w y ON y.a = x.b AND y.b <> x.a GROUP BY 1, 2",
    "h8_longest_path": f"""WITH RECURSIVE t AS (SELECT o_orderkey // 2 AS a, o_orderkey AS b, CAST(1 + o_orderkey % 7 AS DOUBLE) AS cost FROM orders WHERE o_orderkey // 2 <> o_orderkey), w AS ({_BOTH}),
        r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(-1 AS BIGINT) AS came, CAST(0 AS DOUBLE) AS cost UNION ALL SELECT w.b, w.a, r.cost + w.cost FROM r JOIN w ON w.a = r.node AND w.b <> r.came),
        f AS (SELECT node FROM r ORDER BY cost DESC, node LIMIT 1), q AS (SELECT node AS start, node, CAST(-1 AS BIGINT) AS came, CAST(0 AS DOUBLE) AS cost FROM f UNION ALL SELECT q.start, w.b, w.a, q.cost + w.cost FROM q JOIN w ON w.a = q.node AND w.b <> q.came)
        SELECT start AS a, node AS b, cost FROM q ORDER BY cost DESC, b LIMIT 1""",
    "l21_held_limit": f"""WITH RECURSIVE {_E}, n AS (SELECT *, CAST(floor(value / 50) AS BIGINT) * 50 AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
        r AS (SELECT user_id, event_id, i, v AS shown, CAST(NULL AS BIGINT) AS wish, CAST(NULL AS BIGINT) AS since, true AS said FROM n WHERE i = 1
        UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN n.v = wish AND n.v <> shown AND n.t - since >= {6 * HOUR} THEN n.v ELSE shown END, CASE WHEN n.v = shown OR n.v = wish AND n.t - since >= {6 * HOUR} THEN NULL ELSE n.v END,
            CASE WHEN n.v = shown OR n.v = wish AND n.t - since >= {6 * HOUR} THEN NULL WHEN n.v = wish THEN since ELSE n.t END, coalesce(n.v = wish AND n.v <> shown AND n.t - since >= {6 * HOUR}, false) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
        SELECT user_id, event_id, shown FROM r WHERE said""",
    "t2_open_now": f"WITH m AS (SELECT event_type, (isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS m FROM events) SELECT event_type, count(*) FILTER ({_OPEN}) AS open, count(*) AS n FROM m GROUP BY 1",
    "t3_rush_factor": "SELECT CAST(hour(ts) AS BIGINT) AS h, isodow(ts) <= 5 AS workday, round(avg(CASE WHEN isodow(ts) <= 5 AND (hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 18) THEN 1.4 ELSE 1.0 END), 4) AS factor FROM events GROUP BY 1, 2",
    "s12_numbers": "WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 6), lambda x: CAST(x AS BIGINT)) AS n FROM documents) SELECT doc_id, len(n) AS n, CAST(coalesce(list_sum(n), 0) AS BIGINT) AS total FROM d",
    "r9_bit_masks": "WITH m AS (SELECT l_suppkey, CAST(l_quantity > 25 AS INT) + 2 * CAST(l_discount > 0.05 AS INT) + 4 * CAST(l_tax > 0.04 AS INT) AS m FROM lineitem) SELECT l_suppkey, CAST(bit_or(m) AS BIGINT) AS any, CAST(bit_and(m) AS BIGINT) AS all, CAST(sum(bit_count(m)) AS BIGINT) AS bits FROM m GROUP BY 1",
    "c21_close_balances": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) < 400",
    "b5_classes": "SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'small' WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_retailprice > 950 THEN 'dear' WHEN p_name LIKE '%ring' THEN 'ring' ELSE 'other' END AS class FROM part",
    "d37_common_spelling": "WITH n AS (SELECT p_brand, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, name, n FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, name) = 1",
    "d56_distinct_counts": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
    "e11_heaviest": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders",
    "t5_date_stamps": "SELECT strftime(o_orderdate, '%y%m%d') AS stamp, count(*) AS n FROM orders GROUP BY 1",
    "s17_codes": "WITH c AS (SELECT c_custkey, translate(upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 10) || 'lo'), 'OIL', '011') AS c FROM customer) SELECT c_custkey, c[1:4] || '-' || c[5:8] || '-' || c[9:12] AS code FROM c",
    "s14_house_keys": "SELECT lpad(CAST(s_suppkey % 40 AS VARCHAR), 3, '0') || lower(s_name[1]) AS house, count(*) AS n FROM supplier GROUP BY 1",
}
