"""Places, settlements, cameras and lists of them, on embeddings as a plane and on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import conv, geo
from tidemark.operators import graph as gr
from tidemark.operators import roads as ro
from tidemark.operators import search as se
from tidemark.operators import spatial as sp
from tidemark.operators import tables
from tidemark.operators import timeseries as ts
from tidemark.plans.roads import _GRID, _walk, grid


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("embedding")[2].cast("double").alias("z"))


def _settlements(spark, sf_dir):
    """Each label's centre and reach: its farthest point, at least a tenth."""
    p = _points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return p.join(c, "label").groupBy("label", "cx", "cy").agg(F.greatest(F.lit(0.1), F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))).alias("reach"))


def a10_areas(spark, sf_dir):
    """Points inside areas whose outlines are a table: a square around each of the first labels' centres."""
    s = _settlements(spark, sf_dir).withColumn("area", F.col("label").cast("string"))
    h = F.col("reach") / 4
    corner = lambda i, dx, dy: F.struct(F.lit(i).alias("i"), (F.col("cx") + dx * h).alias("rx"), (F.col("cy") + dy * h).alias("ry"))
    rings = s.select("area", F.explode(F.array(corner(0, -1, -1), corner(1, 1, -1), corner(2, 1, 1), corner(3, -1, 1))).alias("v")).select("area", "v.*")
    return sp.within_any(_points(spark, sf_dir), s, rings, "vec_id", "x", "y", 0.05)


def a12_filtered_scan(spark, sf_dir):
    """Parts that the other side asks for: its brands and sizes are found first and reach the scan as semi-joins."""
    asked = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 10 + 11).cast("string")).alias("p_brand")).distinct()
    sizes = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50 + 1).cast("int").alias("p_size")).distinct()
    return _t(spark, sf_dir, "part").join(asked, "p_brand", "left_semi").join(sizes, "p_size", "left_semi").select("p_partkey")


def a17_live_or_copy(spark, sf_dir):
    """Of each segment's list the live rows if few are odd and their number fits the copy's, else the copy."""
    c = _t(spark, sf_dir, "customer")
    odd = F.avg((F.col("c_acctbal") < 0).cast("double"))
    n = c.groupBy("c_mktsegment").agg(odd.alias("odd"), F.count("*").alias("n"), F.count_if(F.col("c_custkey") % 2 == 0).alias("copy"))
    live = n.select("c_mktsegment", ((F.col("odd") <= 0.09) & (F.col("n") / F.col("copy")).between(0.7, 2.2)).alias("live"))
    return c.join(live, "c_mktsegment").filter("live or c_custkey % 2 = 0").select("c_custkey", "live")


def a26_camera_lists(spark, sf_dir):
    """Rows written as arrays of numbers, read by place."""
    s = _t(spark, sf_dir, "supplier")
    text = F.concat(F.lit("["), F.concat_ws(",", F.col("s_suppkey") / 10 + 40, F.col("s_nationkey") + 20, F.lit("-1"), F.col("s_suppkey") % 4 * 20 + 50), F.lit("]"))
    r = s.select("s_suppkey", F.from_json(text, "array<double>").alias("r"))
    return r.select("s_suppkey", F.col("r")[0].alias("lat"), F.col("r")[1].alias("lon"), F.when(F.col("r")[2] >= 0, F.col("r")[2]).alias("bearing"), F.col("r")[3].cast("int").alias("limit"))


def a27_camera_rows(spark, sf_dir):
    """The same written: six decimals, -1 where there is no bearing."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") / 97, 6).alias("lat"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 360).alias("bearing"))
    return s.select("s_suppkey", F.concat(F.lit("["), F.format_string("%.6f", "lat"), F.lit(","), F.coalesce("bearing", F.lit(-1)).cast("string"), F.lit("]")).alias("row"))


def a28_geojson(spark, sf_dir):
    """A user's track as a line in GeoJSON for each day, in order of time."""
    e = _t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", F.format_string("[%d,%d]", F.col("event_id"), F.col("user_id")).alias("c")).alias("p"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]), ",")
    return e.groupBy("user_id", F.col("day").cast("string").alias("day")).agg(F.concat(F.lit('{"type":"LineString","coordinates":['), line, F.lit("]}")).alias("json"))


def a29_polygons(spark, sf_dir):
    """Outlines as text, one vertex a line, read back into vertices."""
    text = F.concat(F.lit("region\n1\n   "), F.format_string("%.1f", F.col("s_suppkey") / 10), F.lit("   50.5\n   31.0   "), F.format_string("%.2f", F.col("s_nationkey") / 4), F.lit("\nEND\n!2\n 1.0 2.0\nEND\nEND\n"))
    return sp.polygon_vertices(_t(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


def b10_row_problems(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumns({"limit": F.col("o_custkey") % 140, "ref": F.when(F.col("o_orderkey") % 9 == 0, "X1").otherwise("M-01"), "km": F.col("o_totalprice") / 200})
    reason = F.when(~F.col("limit").between(5, 130), "limit").when(~F.col("ref").rlike("^[MHPT]-[0-9]"), "road index").when(~((F.col("km") >= 0) & (F.col("km") < 2000)), "km")
    return o.withColumn("reason", reason).filter("reason is not null").select("o_orderkey", "reason")


def c17_names_then_places(spark, sf_dir):
    """Points find the settlement of their name; those without one the nearest box; the rest are new."""
    p = _points(spark, sf_dir).withColumn("name", F.when(F.col("vec_id") % 3 > 0, F.col("label") + (F.col("vec_id") % 7 == 0).cast("int") * 100))
    s = p.groupBy("label").agg(F.percentile_approx("x", 0.5, 1_000_000).alias("mx"), F.percentile_approx("y", 0.5, 1_000_000).alias("my"))
    named = p.join(s.select(F.col("label").alias("name"), F.lit(True).alias("named")), "name", "left")
    rest = named.filter("named is null")
    boxes = s.select("label", (F.col("mx") - 0.02).alias("x0"), (F.col("my") - 0.02).alias("y0"), (F.col("mx") + 0.02).alias("x1"), (F.col("my") + 0.02).alias("y1"))
    near = sp.nearest_box(rest.drop("label"), boxes, "vec_id", "x", "y", "label", 0.1).select("vec_id", F.col("label").alias("near"))
    got = named.select("vec_id", "name", "named").join(near, "vec_id", "left")
    return got.select("vec_id", F.when(F.col("named"), F.col("name")).otherwise(F.col("near")).alias("owner"), F.when(F.col("named"), "name").when(F.col("near").isNotNull(), "place").otherwise("new").alias("how"))


def c18_nearest_boxes(spark, sf_dir):
    p = _points(spark, sf_dir)
    boxes = p.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("box"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.03).alias("x1"), (F.col("y") + 0.01).alias("y1"))
    return sp.nearest_box(p, boxes, "vec_id", "x", "y", "box", 0.05).select("vec_id", "box", F.round("distance", 6).alias("distance"))


def c19_first_owners(spark, sf_dir):
    """A part on several orders' outlines belongs to the first of them."""
    p = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("refs"))
    return p.select("l_orderkey", F.explode("refs").alias("node")).groupBy("node").agg(F.min("l_orderkey").alias("owner"))


def c26_children(spark, sf_dir):
    """Customers under the nations whose names have a word that starts as asked."""
    n = se.postings(_t(spark, sf_dir, "nation"), "n_nationkey", "n_name").filter(F.col("token").rlike("^(?:n|nation)"))
    return _t(spark, sf_dir, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi").select("c_custkey")


def c27_owners(spark, sf_dir):
    """Suppliers own runs of addresses, one after the other: whose is the address of each part's number?"""
    s = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("all"), F.col("s_suppkey").alias("k"), (F.col("s_nationkey") + 1).alias("n"))
    s = ts.running_sum(s, ["all"], ["k"], F.col("n"), "end", 10_000).select("all", (F.col("end") - F.col("n")).cast("long").alias("t"), "k", "end")
    a = _t(spark, sf_dir, "part").select(F.lit(1).alias("all"), F.col("p_partkey").alias("t"))
    got = ts.asof(a, s, ["all"], "t", ["k", "end"], bucket=10_000)
    return got.select(F.col("t").alias("p_partkey"), F.when(F.col("t") < F.col("match.end"), F.col("match.k")).alias("owner"))


def c28_nearest_houses(spark, sf_dir):
    """Points to houses (every seventh vector) of settlements whose reach covers the point, the nearest within 0.1."""
    p = _points(spark, sf_dir)
    covers = sp.within_reach(p.select("vec_id", "x", "y"), _settlements(spark, sf_dir).withColumnsRenamed({"cx": "px", "cy": "py"}), "x", "y", "reach")
    covers = covers.select("vec_id", F.col("label").alias("town"), "x", "y")
    houses = p.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("house"), F.col("label").alias("town"), F.col("x").alias("px"), F.col("y").alias("py"))
    best = sp.nearest_widening(covers, houses, ["town"], "vec_id", "x", "y", 0.1, "house", F.col("vec_id") != F.col("house"))
    return best.select("vec_id", "house", F.round("distance", 6).alias("distance"))


def c29_settlements_near(spark, sf_dir):
    """For each point the three settlements that reach it best."""
    s = _settlements(spark, sf_dir).withColumnsRenamed({"cx": "px", "cy": "py", "label": "town"})
    met = sp.within_reach(_points(spark, sf_dir).select("vec_id", "x", "y"), s, "x", "y", "reach").withColumn("score", F.col("distance") / F.col("reach"))
    best = met.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "town"))), 1, 3).alias("b"))
    return best.select("vec_id", F.posexplode("b").alias("place", "s")).select("vec_id", F.col("place").cast("long").alias("place"), "s.town", F.round("s.score", 6).alias("score"))


def c32_cameras_on_roads(spark, sf_dir):
    """Points with a bearing snapped to the nearest street that runs their way."""
    k = F.col("vec_id")
    segs = _points(spark, sf_dir).filter("vec_id % 3 = 0").select(k.alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 0.05 * (k % 2)).alias("bx"), (F.col("y") + 0.05 * (1 - k % 2)).alias("by_"))
    cams = _points(spark, sf_dir).filter("vec_id % 3 = 1").select("vec_id", "x", "y", ((k % 8) * 0.7853981633974483).alias("bearing"))
    return sp.snap(cams, segs, "vec_id", "x", "y", "bearing", "seg", 0.05, 0.5).select("vec_id", "seg", F.round("off", 6).alias("off"))


def c34_without_repeats(spark, sf_dir):
    """Parts of one name and kind by falling price: one goes if a better kept one is closer than 8 in size."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", (-F.col("p_retailprice")).alias("rank"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return se.drop_repeats(p, ["p_name", "p_type"], ["rank", "p_partkey"], "x", "y", 8.0).select("p_partkey")


def d46_urban(spark, sf_dir):
    """Points within the radius of any place, which depends on its kind."""
    k = F.col("vec_id")
    places = _points(spark, sf_dir).filter("vec_id % 10 = 0").select(k.alias("place"), F.col("x").alias("px"), F.col("y").alias("py"), F.element_at(F.array(*map(F.lit, (0.05, 0.03, 0.01))), (F.floor(k / 10) % 3 + 1).cast("int")).alias("r"))
    return sp.near_any(_points(spark, sf_dir).select("vec_id", "x", "y"), places, "x", "y", 0.05, F.col("r")).select("vec_id")


def d38_settlement_reach(spark, sf_dir):
    """Each settlement's reach: its farthest child, at least its kind's radius, in whole steps of 0.05."""
    s = _settlements(spark, sf_dir)
    return s.select("label", F.ceil(F.greatest(F.col("reach"), F.when(F.col("label") % 3 == 0, 0.3).otherwise(0.1)) / 0.05 - 1e-9).cast("long").alias("steps"))


def d41_cell_table(spark, sf_dir):
    """Places in order of their cell, and of each cell the place its first one has."""
    p = _points(spark, sf_dir).withColumns({"row": geo.cell(F.col("y"), 0.05), "col": geo.cell(F.col("x"), 0.05)})
    got = tables.ordinal(p, F.col("row"), ["col", "y", "x", "vec_id"], "place")
    return got.groupBy("row", "col").agg((F.min("place") - 1).alias("first"), F.count("*").alias("n"))


def e9_local_ids(spark, sf_dir):
    """Dense numbers within each tile."""
    p = _points(spark, sf_dir).withColumn("tile", geo.cell(F.col("y"), 0.2) * 1000 + geo.cell(F.col("x"), 0.2))
    return ts.numbered(p, ["tile"], ["vec_id"], bucket=10_000).select("vec_id", "tile", (F.col("place") - 1).alias("local"))


def r2_slices(spark, sf_dir):
    """The leading numbers of each vector, as many as its label says."""
    e = _t(spark, sf_dir, "embeddings")
    kept = F.slice("embedding", F.lit(1), (F.col("label") % 5 + 1).cast("int"))
    return e.select("vec_id", F.size(kept).cast("long").alias("n"), F.round(F.aggregate(F.transform(kept, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def h7_undirected(spark, sf_dir):
    """Least metres to each supplier along the streets, whichever way they may be driven."""
    e = grid(spark, sf_dir).select("a", "b", F.col("metres").alias("cost"))
    return gr.cheapest(gr.both_ways(e, "cost"), spark.createDataFrame([(1, 0.0)], "node long, cost double")).select("node", "cost")


def h12_straight_walks(spark, sf_dir):
    """From every street the walk that keeps straightest, five streets long at most."""
    e = grid(spark, sf_dir)
    return ro.straight_walks(e, e.select("edge"), 5)


def p6_off_road(spark, sf_dir):
    """Points with no other one (as a road) within 0.03."""
    p = _points(spark, sf_dir)
    roads = p.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("road"), F.col("x").alias("px"), F.col("y").alias("py"))
    on = sp.near_any(p.select("vec_id", "x", "y"), roads, "x", "y", 0.03, other=F.col("vec_id") != F.col("road")).select("vec_id")
    return p.join(on, "vec_id", "left_anti").select("vec_id")


def s15_tag_helpers(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat((k * 13).cast("string"), F.lit(" people"))).when(k % 4 == 1, "about").otherwise((k % 200).cast("string"))
    refs = F.concat(F.lit("M-0"), (k % 5).cast("string"), F.when(k % 2 == 0, "; E 40;").otherwise(""))
    p = _t(spark, sf_dir, "part").select("p_partkey", text.alias("t"), refs.alias("r"))
    kph = F.when(F.trim("t").rlike("^[0-9]+$") & F.col("t").try_cast("int").between(5, 150), F.col("t").try_cast("int")).otherwise(0)
    people = F.coalesce(F.nullif(F.regexp_replace("t", "[^0-9]", ""), F.lit("")).try_cast("long"), F.lit(0))
    each = F.filter(F.transform(F.split("r", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return p.select("p_partkey", kph.alias("kph"), people.alias("people"), F.array_join(each, "|").alias("refs"))


def c33_cameras_ahead(spark, sf_dir):
    """Cameras on the streets that can be reached from the first supplier within 800 m, and how far ahead they are."""
    e = grid(spark, sf_dir)
    at = gr.cheapest(e.select("a", "b", F.col("metres").alias("cost")), spark.createDataFrame([(1, 0.0)], "node long, cost double"), 800.0)
    cams = e.filter("edge % 3 = 0").select("edge", F.col("a").alias("node"), (F.col("edge") % 150).cast("double").alias("spot"), "metres").filter("spot <= metres")
    got = cams.join(at.select("node", "cost"), "node").withColumn("ahead", F.col("cost") + F.col("spot")).filter("ahead <= 800")
    return got.select("edge", "ahead")


def h11_limits_ahead(spark, sf_dir):
    """Along each straightest walk the metres until the road's class changes, or the walk ends."""
    e = grid(spark, sf_dir)
    w = ro.straight_walks(e, e.select("edge"), 5).join(e.select("edge", "cls", "metres"), "edge")
    own = w.filter("k = 0").select("start", F.col("cls").alias("own"))
    first = w.join(own, "start").filter("cls <> own").groupBy("start").agg(F.min("k").alias("stop"))
    return w.join(first, "start", "left").filter("stop is null or k < stop").groupBy("start").agg(F.sum("metres").alias("metres"))


def h13_chainage(spark, sf_dir):
    """Official kilometres against measured ones: the sign by correlation, then the line through both."""
    p = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("km"), (F.when(F.col("l_suppkey") % 2 == 0, -1).otherwise(1) * F.col("l_quantity")).alias("measured"))
    f = p.groupBy("l_suppkey").agg(F.corr("km", "measured").alias("r"), F.regr_intercept("measured", "km").alias("a"), F.regr_slope("measured", "km").alias("b"))
    return f.select("l_suppkey", F.when(F.col("r") < 0, -1).otherwise(1).alias("sign"), F.round(F.col("a") + F.col("b") * 50, 4).alias("at_50"))


def m5_wrapped(spark, sf_dir):
    a = F.col("c_acctbal") / 100
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(conv.wrap_pi(a), 6).alias("high"), F.round(conv.wrap_pi_low(a), 6).alias("low"))


def m12_sides(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", geo.side_of(F.lit(-1.0), F.lit(-0.5), F.lit(1.0), F.lit(0.5), F.col("x"), F.col("y"), 0.02).alias("side"))


def t6_elapsed(spark, sf_dir):
    """When a trip over an order's lines reaches half of its quantity: straight between the lines."""
    q = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    o = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(q, lambda s: s["l_quantity"]).alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + x)
    step = lambda s, x: F.when(s["left"] <= 0, s).when(x >= s["left"], F.struct(F.lit(0.0).alias("left"), (s["at"] + s["left"] / x).alias("at"))).otherwise(F.struct((s["left"] - x).alias("left"), (s["at"] + 1).alias("at")))
    got = o.withColumn("half", total / 2).withColumn("s", F.aggregate("q", F.struct(F.col("half").alias("left"), F.lit(0.0).alias("at")), step))
    return got.select("l_orderkey", F.round("s.at", 6).alias("at"))


def m4_planar(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 1400) / 10 - 70).alias("lat"), ((F.col("c_custkey") * 91 % 3600) / 10 - 180).alias("lon"))
    d, b = geo.planar(F.col("lat"), F.col("lon"), F.col("lat") + 0.01, F.col("lon") + 0.02, 6_371_008.8)
    return c.select("c_custkey", F.round(d, 3).alias("metres"), F.round(b, 4).alias("bearing"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "abcdehmprst" and k[1:2].isdigit()}
_P = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_S = "c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), s AS (SELECT label, cx, cy, greatest(0.1, max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))) AS reach FROM p JOIN c USING (label) GROUP BY 1, 2, 3)"
_D = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
_BOXD = "sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2))"
ORACLES = {
    "a10_areas": f"WITH {_P}, {_S} SELECT vec_id, CAST(s.label AS VARCHAR) AS area FROM p, s WHERE x >= cx - reach / 4 AND x < cx + reach / 4 AND y >= cy - reach / 4 AND y < cy + reach / 4",
    "a12_filtered_scan": "SELECT p_partkey FROM part WHERE p_brand IN (SELECT 'Brand#' || CAST(s_nationkey % 10 + 11 AS VARCHAR) FROM supplier) AND p_size IN (SELECT s_suppkey % 50 + 1 FROM supplier)",
    "a17_live_or_copy": "WITH n AS (SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) / count(*) <= 0.09 AND count(*) / count(*) FILTER (c_custkey % 2 = 0) BETWEEN 0.7 AND 2.2 AS live FROM customer GROUP BY 1) SELECT c_custkey, live FROM customer JOIN n USING (c_mktsegment) WHERE live OR c_custkey % 2 = 0",
    "a26_camera_lists": "SELECT s_suppkey, s_suppkey / 10 + 40 AS lat, CAST(s_nationkey + 20 AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS bearing, CAST(s_suppkey % 4 * 20 + 50 AS INTEGER) AS \"limit\" FROM supplier",
    "a27_camera_rows": "SELECT s_suppkey, '[' || printf('%.6f', round(s_acctbal / 97, 6)) || ',' || CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 360 AS VARCHAR) ELSE '-1' END || ']' AS row FROM supplier",
    "a28_geojson": """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, '{"type":"LineString","coordinates":[' || string_agg('[' || event_id || ',' || user_id || ']', ',' ORDER BY ts, event_id) || ']}' AS json FROM events GROUP BY 1, 2""",
    "a29_polygons": "SELECT s_suppkey, '1' AS ring, false AS hole, i, CASE i WHEN 0 THEN s_suppkey / 10 ELSE 31.0 END AS x, CASE i WHEN 0 THEN 50.5 ELSE s_nationkey / 4 END AS y FROM supplier, (SELECT unnest([0, 1]) AS i) UNION ALL SELECT s_suppkey, '2', true, 0, 1.0, 2.0 FROM supplier",
    "b10_row_problems": "WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 140 NOT BETWEEN 5 AND 130 THEN 'limit' WHEN o_orderkey % 9 = 0 THEN 'road index' WHEN o_totalprice / 200 >= 2000 THEN 'km' END AS reason FROM orders) SELECT * FROM r WHERE reason IS NOT NULL",
    "c17_names_then_places": f"""WITH {_P}, q AS (SELECT *, CASE WHEN vec_id % 3 > 0 THEN label + CASE WHEN vec_id % 7 = 0 THEN 100 ELSE 0 END END AS name FROM p), m AS (SELECT label, list_sort(list(x))[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS mx, list_sort(list(y))[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS my FROM p GROUP BY 1),
        b AS (SELECT label AS box, mx - 0.02 AS x0, my - 0.02 AS y0, mx + 0.02 AS x1, my + 0.02 AS y1 FROM m), d AS (SELECT vec_id, box, {_BOXD} AS d FROM q, b WHERE q.name IS NULL OR q.name NOT IN (SELECT label FROM m)),
        n AS (SELECT vec_id, box FROM d WHERE d <= 0.1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, box DESC) = 1)
        SELECT q.vec_id, CASE WHEN m.label IS NOT NULL THEN q.name ELSE n.box END AS owner, CASE WHEN m.label IS NOT NULL THEN 'name' WHEN n.box IS NOT NULL THEN 'place' ELSE 'new' END AS how FROM q LEFT JOIN m ON m.label = q.name LEFT JOIN n ON n.vec_id = q.vec_id""",
    "c18_nearest_boxes": f"WITH {_P}, b AS (SELECT vec_id AS box, x AS x0, y AS y0, x + 0.03 AS x1, y + 0.01 AS y1 FROM p WHERE vec_id % 5 = 0), d AS (SELECT vec_id, box, {_BOXD} AS d FROM p, b) SELECT vec_id, box, round(d, 6) AS distance FROM d WHERE d <= 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, box DESC) = 1",
    "c19_first_owners": "SELECT l_partkey AS node, min(l_orderkey) AS owner FROM lineitem GROUP BY 1",
    "c26_children": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE regexp_matches(lower(n_name), '(^|[^a-z0-9])n'))",
    "c27_owners": "WITH s AS (SELECT s_suppkey AS k, sum(s_nationkey + 1) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS e, s_nationkey + 1 AS n FROM supplier) SELECT p_partkey, k AS owner FROM part LEFT JOIN s ON p_partkey >= e - n AND p_partkey < e",
    "c28_nearest_houses": f"""WITH {_P}, {_S}, v AS (SELECT vec_id, s.label AS town FROM p, s WHERE sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= reach), h AS (SELECT vec_id AS house, label AS town, x, y FROM p WHERE vec_id % 7 = 0)
        SELECT p.vec_id, h.house, round({_D('p', 'h')}, 6) AS distance FROM p JOIN v USING (vec_id) JOIN h ON h.town = v.town AND h.house <> p.vec_id AND {_D('p', 'h')} <= 0.1 QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY round({_D('p', 'h')}, 9), h.house) = 1""",
    "c29_settlements_near": f"""WITH {_P}, {_S}, d AS (SELECT vec_id, s.label AS town, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, reach FROM p, s)
        SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY d / reach, town) - 1 AS place, town, round(d / reach, 6) AS score FROM d WHERE d <= reach QUALIFY place < 3""",
    "c32_cameras_on_roads": f"""WITH {_P}, g AS (SELECT vec_id AS seg, x AS ax, y AS ay, 0.05::DOUBLE * (vec_id % 2) AS dx, 0.05::DOUBLE * (1 - vec_id % 2) AS dy FROM p WHERE vec_id % 3 = 0), j AS (SELECT vec_id, seg, vec_id % 8 AS o, seg % 2 AS e, x, y, ax, ay, dx, dy, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / 0.0025)) AS t FROM p, g WHERE vec_id % 3 = 1),
        d AS (SELECT *, sqrt(power(x - ax - t * dx, 2) + power(y - ay - t * dy, 2)) AS off FROM j WHERE (o % 4) = CASE WHEN e = 1 THEN 2 ELSE 0 END) SELECT vec_id, seg, round(off, 6) AS off FROM d WHERE off <= 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(off, 9), seg) = 1""",
    "c34_without_repeats": """WITH RECURSIVE n AS (SELECT p_partkey, p_name, p_type, p_size, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
        r AS (SELECT p_partkey, p_name, p_type, i, [p_size] AS kept, true AS ok FROM n WHERE i = 1
        UNION ALL SELECT p_partkey, p_name, p_type, i, CASE WHEN far THEN list_append(kept, p_size) ELSE kept END, far FROM (SELECT n.*, r.kept, len(list_filter(r.kept, lambda k: abs(k - n.p_size) < 8)) = 0 AS far FROM r JOIN n ON n.p_name = r.p_name AND n.p_type = r.p_type AND n.i = r.i + 1))
        SELECT p_partkey FROM r WHERE ok""",
    "d46_urban": f"WITH {_P}, q AS (SELECT vec_id AS k, x, y, [0.05, 0.03, 0.01][vec_id // 10 % 3 + 1] AS r FROM p WHERE vec_id % 10 = 0) SELECT DISTINCT p.vec_id FROM p JOIN q ON {_D('p', 'q')} <= r",
    "h12_straight_walks": f"""WITH RECURSIVE {_GRID}, nx AS (SELECT f AS edge, t AS nxt FROM (SELECT f, t, CASE turn WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS bend FROM (SELECT x.edge AS f, y.edge AS t, (y.d - x.d + 4) % 4 AS turn FROM e x JOIN e y ON y.a = x.b)) WHERE bend < 2 QUALIFY row_number() OVER (PARTITION BY f ORDER BY bend, t) = 1),
        r AS (SELECT edge AS start, 0 AS k, edge FROM e UNION ALL SELECT r.start, r.k + 1, nx.nxt FROM r JOIN nx USING (edge) WHERE r.k < 4) SELECT start, k, edge FROM r""",
    "p6_off_road": f"WITH {_P} SELECT a.vec_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.vec_id % 4 = 0 AND b.vec_id <> a.vec_id AND {_D('a', 'b')} <= 0.03)",
    "s15_tag_helpers": """SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 > 1 AND p_partkey % 200 BETWEEN 5 AND 150 THEN p_partkey % 200 ELSE 0 END AS INTEGER) AS kph, CASE p_partkey % 4 WHEN 0 THEN p_partkey * 13 WHEN 1 THEN 0 ELSE p_partkey % 200 END AS people,
        'M-0' || CAST(p_partkey % 5 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '|E 40' ELSE '' END AS refs FROM part""",
    "c33_cameras_ahead": f"WITH RECURSIVE {_GRID}{_walk('c', 'SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost', 'SELECT e.b, c.cost + e.metres FROM {0} c JOIN e ON e.a = c.node WHERE c.cost + e.metres <= 800', 'node')} SELECT edge, cost + edge % 150 AS ahead FROM e JOIN c ON node = a WHERE edge % 3 = 0 AND edge % 150 <= metres AND cost + edge % 150 <= 800",
    "h13_chainage": "WITH p AS (SELECT l_suppkey, l_extendedprice / 1000 AS km, CASE WHEN l_suppkey % 2 = 0 THEN -1 ELSE 1 END * l_quantity AS m FROM lineitem) SELECT l_suppkey, CAST(CASE WHEN corr(km, m) < 0 THEN -1 ELSE 1 END AS INTEGER) AS sign, round(regr_intercept(m, km) + regr_slope(m, km) * 50, 4) AS at_50 FROM p GROUP BY 1",
    "m5_wrapped": "WITH a AS (SELECT c_custkey, c_acctbal / 100 AS a FROM customer) SELECT c_custkey, round(pi() - (pi() - a - floor((pi() - a) / (2 * pi())) * 2 * pi()), 6) AS high, round(a + pi() - floor((a + pi()) / (2 * pi())) * 2 * pi() - pi(), 6) AS low FROM a",
    "m12_sides": f"WITH {_P}, d AS (SELECT vec_id, (2 * (y + 0.5) - (x + 1)) / sqrt(5) AS d FROM p) SELECT vec_id, CASE WHEN d > 0.02 THEN 'left' WHEN d < -0.02 THEN 'right' END AS side FROM d",
    "t6_elapsed": """WITH q AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER w AS i, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
        SELECT l_orderkey, round(i - 1 + (total / 2 - (upto - q)) / q, 6) AS at FROM q WHERE upto >= total / 2 AND upto - q < total / 2""",
    "d38_settlement_reach": f"WITH {_P}, {_S} SELECT label, CAST(ceil(greatest(reach, CASE WHEN label % 3 = 0 THEN 0.3 ELSE 0.1 END) / 0.05::DOUBLE - 1e-9) AS BIGINT) AS steps FROM s",
    "d41_cell_table": f"WITH {_P}, c AS (SELECT *, CAST(floor(y / 0.05) AS BIGINT) AS r, CAST(floor(x / 0.05) AS BIGINT) AS c FROM p), o AS (SELECT r, c, row_number() OVER (ORDER BY r, c, y, x, vec_id) - 1 AS i FROM c) SELECT r AS row, c AS col, min(i) AS first, count(*) AS n FROM o GROUP BY 1, 2",
    "e9_local_ids": f"WITH {_P}, t AS (SELECT vec_id, CAST(floor(y / 0.2) AS BIGINT) * 1000 + CAST(floor(x / 0.2) AS BIGINT) AS tile FROM p) SELECT vec_id, tile, row_number() OVER (PARTITION BY tile ORDER BY vec_id) - 1 AS local FROM t",
    "r2_slices": "SELECT vec_id, CAST(label % 5 + 1 AS BIGINT) AS n, round(list_sum(list_transform(embedding[1:label % 5 + 1], lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings",
    "h7_undirected": f"WITH RECURSIVE {_GRID}, u AS (SELECT a, b, metres FROM e UNION ALL SELECT b, a, metres FROM e){_walk('c', 'SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost', 'SELECT u.b, c.cost + u.metres FROM {0} c JOIN u ON u.a = c.node', 'node')} SELECT * FROM c",
    "m4_planar": """WITH c AS (SELECT c_custkey, radians((c_custkey * 37 % 1400) / 10 - 70) AS a FROM customer), d AS (SELECT c_custkey, a, a + radians(0.01) AS b FROM c)
        SELECT c_custkey, round(6371008.8 * sqrt(power(radians(0.02) * cos((a + b) / 2), 2) + power(radians(0.01), 2)), 3) AS metres, round(degrees(atan2(sin(radians(0.02)) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(radians(0.02)))), 4) AS bearing FROM d""",
}
ORACLES["h11_limits_ahead"] = ORACLES["h12_straight_walks"].replace("SELECT start, k, edge FROM r", "") + """, w AS (SELECT r.start, r.k, cls, metres FROM r JOIN e USING (edge)), o AS (SELECT start, cls AS own FROM w WHERE k = 0), f AS (SELECT start, min(k) AS stop FROM w JOIN o USING (start) WHERE cls <> own GROUP BY 1)
    SELECT start, sum(metres) AS metres FROM w LEFT JOIN f USING (start) WHERE stop IS NULL OR k < stop GROUP BY 1"""
