"""Places and networks: embeddings' first two dimensions as a plane, order tables as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import graph as gr
from tidemark.operators import spatial as sp


def _points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c12_within_radius(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select(F.col("vec_id").alias("other"), F.col("x").alias("px"), F.col("y").alias("py"))
    return sp.within(p, q, "x", "y", 0.02).filter("vec_id < other").select("vec_id", "other", F.round("distance", 6).alias("distance"))


def c15_nearest_scaled(spark, sf_dir):
    p = _points(spark, sf_dir)
    centres = p.groupBy("label").agg(F.avg("x").alias("px"), F.avg("y").alias("py"), F.stddev_pop("x").alias("reach"))
    centres = centres.withColumnRenamed("label", "centre")
    return sp.nearest(p, centres, "vec_id", "x", "y", 0.2, "centre", F.col("reach")).select("vec_id", "centre", F.round("distance", 6).alias("distance"))


AREAS = [("small", 1.0, [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)]), ("wide", 4.0, [(-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2)]), ("wedge", 2.0, [(-0.1, 0.0), (0.05, -0.15), (0.05, 0.15)])]


def c16_innermost_area(spark, sf_dir):
    return sp.innermost(_points(spark, sf_dir), AREAS, "x", "y").select("vec_id", "area")


def c30_corridor(spark, sf_dir):
    p = _points(spark, sf_dir)
    line = spark.createDataFrame([(1, i, -0.2 + 0.1 * i, 0.05 * (i % 2)) for i in range(5)], "line int, i int, x double, y double")
    segs = sp.segments(line, ["line"], "i", "x", "y")
    return sp.corridor(p, segs, "vec_id", "x", "y", 0.05).select("vec_id", F.round("along", 6).alias("along"), F.round("off", 6).alias("off"))


def _earth(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", ((F.col("c_custkey") * 37 % 1400) / 10 - 70).alias("lat"), ((F.col("c_custkey") * 91 % 3600) / 10 - 180).alias("lon"))


def m1_haversine(spark, sf_dir):
    c = _earth(spark, sf_dir)
    home = F.lit(48.1), F.lit(11.6)
    return c.select("c_custkey", F.round(geo.haversine(F.col("lat"), F.col("lon"), *home), 2).alias("metres"), F.round(geo.bearing(F.col("lat"), F.col("lon"), *home), 6).alias("bearing"))


def m2_destination(spark, sf_dir):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.radians(F.col("c_custkey") % 360), F.lit(25_000.0))
    return _earth(spark, sf_dir).select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def m6_tiles(spark, sf_dir):
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), 14)
    return _earth(spark, sf_dir).select("c_custkey", F.floor(x).alias("tx"), F.floor(y).alias("ty"))


def d42_degrees(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"))
    return gr.degrees(e)


def d43_split_ways(spark, sf_dir):
    stop = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    w = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(stop)), lambda s: s["l_partkey"]).alias("refs"))
    got = gr.split_ways(w.filter(F.size("refs") > 1))
    return got.select("way", "part", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


def _tree(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 64 != 1, F.floor(F.col("o_orderkey") / 2)).otherwise(F.col("o_orderkey")).cast("long").alias("b"))


def h9_components(spark, sf_dir):
    return gr.components(_tree(spark, sf_dir))


def _bipartite(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b")).agg(F.min("l_quantity").alias("cost"))
    return gr.both_ways(e, "cost")


def _pieces(spark, sf_dir):
    """Vectors as places, ten after one another along a street, and the streets."""
    p = _points(spark, sf_dir).select(F.col("vec_id").alias("node"), "x", "y")
    ends = p.select(F.col("node").alias("b"))
    return p.filter("node % 10 < 9").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(ends, "b").select("a", "b"), p


def c38_bridges(spark, sf_dir):
    """Hops of at most 0.08 that join the streets."""
    edges, places = _pieces(spark, sf_dir)
    return gr.bridges(edges, places, 0.08, 0.005).select("a", "b", F.round("distance", 6).alias("distance"))


def h8_main_line(spark, sf_dir):
    """Edges and metres of the longest shortest path through the streets and their bridges."""
    edges, places = _pieces(spark, sf_dir)
    line = gr.main_line(edges, places, 0.08, 0.005)
    p = places.select(F.col("node").alias("a"), "x", "y").join(line, "a").join(places.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_")), "b")
    return p.agg(F.count("*").alias("edges"), F.round(F.sum(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by_"))), 6).alias("length"))


def h6_hops(spark, sf_dir):
    return gr.hops(_bipartite(spark, sf_dir), spark.createDataFrame([(1_000_000_001,)], "node long"), 3)


def h1_cheapest_path(spark, sf_dir):
    start = spark.createDataFrame([(1_000_000_001, 0.0)], "node long, cost double")
    return gr.cheapest(_bipartite(spark, sf_dir), start).select("node", "cost")


def h10_viterbi(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.log1p(F.greatest(F.col("value"), F.lit(0.0))).alias("v"))
    e = e.withColumns({f"s{k}": -F.pow(F.col("v") - m, 2) for k, m in enumerate((1.0, 3.0, 4.5))})
    return gr.viterbi(e, ["user_id"], ["t", "event_id"], ["s0", "s1", "s2"], 0.9, 86_400_000_000).select("event_id", "state")


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "cdhm" and k[1:2].isdigit()}
_P = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_C = "c AS (SELECT c_custkey, (c_custkey * 37 % 1400) / 10.0 - 70 AS lat, (c_custkey * 91 % 3600) / 10.0 - 180 AS lon FROM customer)"
_B = "e AS (SELECT l_partkey AS a, l_suppkey + 1000000000 AS b, min(l_quantity) AS cost FROM lineitem GROUP BY 1, 2), w AS (SELECT a, b, cost FROM e UNION ALL SELECT b, a, cost FROM e)"


def _ring(ring):
    sides = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    return "(" + " + ".join(f"CASE WHEN (y < {a[1]}) <> (y < {b[1]}) AND x < (y - {a[1]}) * ({b[0]} - {a[0]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in sides) + ") % 2 = 1"


_WAY = lambda a, b: f"(s{a} + ln({0.9 if a == b else 0.05}::DOUBLE))"
_best = lambda b: "greatest(" + ", ".join(_WAY(a, b) for a in range(3)) + ")"
_back = lambda b: f"CASE WHEN {_WAY(0, b)} >= {_WAY(1, b)} AND {_WAY(0, b)} >= {_WAY(2, b)} THEN 0 WHEN {_WAY(1, b)} >= {_WAY(2, b)} THEN 1 ELSE 2 END"
ORACLES = {
    "c12_within_radius": f"WITH {_P} SELECT a.vec_id, b.vec_id AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02",
    "c15_nearest_scaled": f"""WITH {_P}, c AS (SELECT label AS centre, avg(x) AS px, avg(y) AS py, stddev_pop(x) AS reach FROM p GROUP BY 1), j AS (SELECT vec_id, centre, reach, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM p, c)
        SELECT vec_id, centre, round(d, 6) AS distance FROM j WHERE d <= least(0.2, reach) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d / reach, centre) = 1""",
    "c16_innermost_area": f"WITH {_P} SELECT vec_id, CASE WHEN {_ring(AREAS[0][2])} THEN 'small' WHEN {_ring(AREAS[2][2])} THEN 'wedge' WHEN {_ring(AREAS[1][2])} THEN 'wide' END AS area FROM p",
    "c30_corridor": f"""WITH {_P}, l AS (SELECT i, -0.2 + 0.1 * i AS ax, 0.05 * (i % 2) AS ay, -0.2 + 0.1 * (i + 1) AS bx, 0.05 * ((i + 1) % 2) AS b2 FROM range(0, 4) t(i)),
        s AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (b2 - ay) * (b2 - ay)) AS len FROM l), j AS (SELECT vec_id, x, y, s.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (b2 - ay)) / (len * len))) AS t FROM p, s),
        d AS (SELECT vec_id, i * len + t * len AS along, sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b2 - ay), 2)) AS off FROM j)
        SELECT vec_id, round(along, 6) AS along, round(off, 6) AS off FROM d WHERE off <= 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(off, 9), along) = 1""",
    "m1_haversine": f"""WITH {_C} SELECT c_custkey, round(2 * 6371000 * asin(least(1, sqrt(power(sin(radians(48.1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(48.1)) * power(sin(radians(11.6 - lon) / 2), 2)))), 2) AS metres,
        round(atan2(sin(radians(11.6 - lon)) * cos(radians(48.1)), cos(radians(lat)) * sin(radians(48.1)) - sin(radians(lat)) * cos(radians(48.1)) * cos(radians(11.6 - lon))), 6) AS bearing FROM c""",
    "m2_destination": f"""WITH {_C}, d AS (SELECT *, radians(c_custkey % 360) AS g, 25000.0 / 6371000 AS d, radians(lat) AS a FROM c), b AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(g)) AS b FROM d)
        SELECT c_custkey, round(degrees(b), 6) AS lat, round(lon + degrees(atan2(sin(g) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))), 6) AS lon FROM b""",
    "m6_tiles": f"WITH {_C} SELECT c_custkey, CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS ty FROM c",
    "d42_degrees": "SELECT node, count(*) AS degree FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey + 1000000000 FROM lineitem) GROUP BY 1",
    "d43_split_ways": """WITH v AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem),
        x AS (SELECT * FROM v WHERE size > 1), c AS (SELECT node, count(*) AS uses FROM x GROUP BY 1), s AS (SELECT way, pos, lead(pos) OVER (PARTITION BY way ORDER BY pos) AS stop, row_number() OVER (PARTITION BY way ORDER BY pos) - 1 AS part FROM x JOIN c USING (node) WHERE uses > 1 OR pos = 1 OR pos = size)
        SELECT s.way, CAST(part AS INTEGER) AS part, string_agg(CAST(node AS VARCHAR), ',' ORDER BY x.pos) AS refs FROM s JOIN x ON x.way = s.way AND x.pos BETWEEN s.pos AND s.stop GROUP BY 1, 2""",
    "h10_viterbi": f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, ln(1 + greatest(value, 0)) AS v FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM e),
        k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS i, -power(v - 1.0, 2) AS e0, -power(v - 3.0, 2) AS e1, -power(v - 4.5, 2) AS e2 FROM k),
        r AS (SELECT user_id, run, event_id, i, e0 AS s0, e1 AS s1, e2 AS s2, 0 AS b0, 0 AS b1, 0 AS b2 FROM n WHERE i = 1
        UNION ALL SELECT n.user_id, n.run, n.event_id, n.i, {_best(0)} + e0, {_best(1)} + e1, {_best(2)} + e2, {_back(0)}, {_back(1)}, {_back(2)} FROM r JOIN n ON n.user_id = r.user_id AND n.run = r.run AND n.i = r.i + 1),
        z AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS q, count(*) OVER (PARTITION BY user_id, run) AS size FROM r),
        y AS (SELECT user_id, run, event_id, i, q AS state, CASE q WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS before FROM z WHERE i = size
        UNION ALL SELECT z.user_id, z.run, z.event_id, z.i, y.before, CASE y.before WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END FROM y JOIN z ON z.user_id = y.user_id AND z.run = y.run AND z.i = y.i - 1)
        SELECT event_id, CAST(state AS BIGINT) AS state FROM y""",
    "h9_components": """WITH RECURSIVE e AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 64 <> 1 THEN o_orderkey // 2 ELSE o_orderkey END AS b FROM orders), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
        r AS (SELECT node, node AS spot FROM n UNION ALL SELECT r.node, e.b FROM r JOIN e ON e.a = r.spot WHERE e.a <> e.b) SELECT node, min(spot) AS component FROM r GROUP BY 1""",
    "h6_hops": f"WITH RECURSIVE {_B}, r AS (SELECT CAST(1000000001 AS BIGINT) AS node, 0 AS hops UNION SELECT w.b, hops + 1 FROM r JOIN w ON w.a = r.node WHERE hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY 1",
    "h1_cheapest_path": f"""WITH RECURSIVE {_B}, d(node, cost) USING KEY (node) AS (SELECT CAST(1000000001 AS BIGINT), CAST(0 AS DOUBLE)
        UNION SELECT n.node, min(n.cost) FROM (SELECT w.b AS node, d.cost + w.cost AS cost FROM d JOIN w ON w.a = d.node) n LEFT JOIN (SELECT node AS k0, cost AS c0 FROM recurring.d) r ON k0 = n.node WHERE c0 IS NULL OR n.cost < c0 GROUP BY 1)
        SELECT * FROM d""",
}
# Kruskal: pairs of pieces from the closest on, with the piece of every piece so far as a list; then all shortest paths of the piece with most places
_JOINED = f"""{_P}, e0 AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 < 9),
    c AS (SELECT vec_id, x, y, vec_id // 10 AS piece FROM p), h AS (SELECT min(struct_pack(d := sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), a := a.vec_id, b := b.vec_id)) AS h, a.piece AS p, b.piece AS q FROM c a JOIN c b ON a.piece < b.piece GROUP BY a.piece, b.piece),
    k AS (SELECT h.d, h.a, h.b, p, q, row_number() OVER (ORDER BY h) AS k FROM h WHERE h.d <= 0.08), z AS (SELECT max(piece) AS z FROM c),
    u AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT list(i ORDER BY i) FROM range(0, (SELECT z + 1 FROM z)) t(i)) AS l, false AS took UNION ALL SELECT k.k, CASE WHEN u.l[p + 1] = u.l[q + 1] THEN u.l ELSE list_transform(u.l, lambda x: CASE WHEN x = u.l[q + 1] THEN u.l[p + 1] ELSE x END) END, u.l[p + 1] <> u.l[q + 1] FROM u JOIN k ON k.k = u.k + 1),
    br AS (SELECT a, b, d FROM k JOIN u USING (k) WHERE took)"""
ORACLES["c38_bridges"] = f"WITH RECURSIVE {_JOINED} SELECT a, b, round(d, 6) AS distance FROM br"
ORACLES["h8_main_line"] = f"""WITH RECURSIVE {_JOINED}, w AS (SELECT a, b, d FROM e0 UNION ALL SELECT a, b, d FROM br), v AS (SELECT * FROM w UNION ALL SELECT b, a, d FROM w),
    fin AS (SELECT l FROM u ORDER BY k DESC LIMIT 1), g AS (SELECT vec_id, (SELECT l FROM fin)[vec_id // 10 + 1] AS piece FROM p), big AS (SELECT piece FROM g GROUP BY 1 ORDER BY count(*) DESC, min(vec_id) LIMIT 1),
    s AS (SELECT vec_id AS start, vec_id AS node, CAST(-1 AS BIGINT) AS came, CAST(0 AS DOUBLE) AS cost, 0 AS edges FROM g WHERE piece = (SELECT piece FROM big) UNION ALL SELECT s.start, v.b, v.a, s.cost + v.d, s.edges + 1 FROM s JOIN v ON v.a = s.node AND v.b <> s.came)
    SELECT CAST(edges AS BIGINT) AS edges, round(cost, 6) AS length FROM s ORDER BY cost DESC LIMIT 1"""
