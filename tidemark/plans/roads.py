"""Road networks: orders as ways over parts as nodes, suppliers on a grid of streets.

Tags are made from the tables' numbers by expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import roads as rd
from tidemark.operators import graph as gr
from tidemark.operators import roads as ro
from tidemark.operators import tables

RADIUS = 6_371_008.8


def _case(by: str, values: list) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


HIGHWAYS = [*rd.CLASSES, "primary_link", "footway", "service_link"]
WAY_TAGS = {
    "highway": _case("o_orderkey % 14", HIGHWAYS),
    "oneway": _case("o_custkey % 7", ["yes", "-1", "no", None, None, "reversible", "1"]),
    "access": _case("o_custkey % 9", [None, None, "no", "private;customers", "permissive", None, "destination; no", "agricultural", "no;no"]),
    "motor_vehicle": _case("CAST(floor(o_orderkey / 3) AS BIGINT) % 11", ["private", "yes"]),
    "junction": _case("CAST(floor(o_orderkey / 5) AS BIGINT) % 13", ["roundabout", "circular", "filter"]),
    "tunnel": _case("CAST(floor(o_orderkey / 7) AS BIGINT) % 10", ["yes", "no", "culvert"]),
    "bridge": _case("CAST(floor(o_orderkey / 11) AS BIGINT) % 6", ["yes", "no"]),
    "service": _case("CAST(floor(o_orderkey / 14) AS BIGINT) % 5", ["driveway", "alley", "parking_aisle"]),
    "surface": _case("CAST(floor(o_custkey / 2) AS BIGINT) % 8", ["gravel", "asphalt", "mud", "paved"]),
    "area": _case("CAST(floor(o_custkey / 3) AS BIGINT) % 29", ["yes", "no"]),
    "maxspeed": _case("CAST(floor(o_orderkey / 2) AS BIGINT) % 11", ["50", "60 mph", "UA:urban", "none", "7.5 km/h", "999", None, "walk", "30kmh", "50;30", "0.2"]),
}
TURN_TAGS = {
    "type": _case("l_orderkey % 5", ["restriction", "restriction", "restriction", "multipolygon", "restriction"]),
    "restriction": _case("l_partkey % 6", ["no_left_turn", "only_straight_on", "give_way", "no_u_turn", None, "only_right_turn"]),
    "restriction:motorcar": _case("l_suppkey % 9", ["no_entry", "none"]),
    "except": _case("l_partkey % 7", ["bicycle", "motorcar", "psv; motorcar", None, "motorcars"]),
}
PLACE_TAGS = {
    "amenity": _case("p_partkey % 10", ["fuel", "charging_station", "cafe", "fast_food", "restaurant", "pharmacy", "parking", "bench", "no", None]),
    "access": _case("CAST(floor(p_partkey / 10) AS BIGINT) % 6", ["private", "customers", "yes", None, "no"]),
    "fuel:diesel": _case("p_size % 3", ["yes", "no"]), "fuel:lpg": _case("p_size % 4", ["yes"]), "fuel:octane_95": _case("p_size % 5", ["yes", "only"]),
    "shop": _case("p_partkey % 3", ["bakery", "no"]), "tourism": _case("p_partkey % 4", ["hotel"]),
    "ref": _case("p_size % 6", ["3", " "]), "addr:unit": _case("p_size % 7", ["B"]), "name": _case("p_size % 8", ["12a", "Hall", "Б2", "A-1"]),
}


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tags(exprs: dict[str, str]):
    made = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, exprs)), F.array(*map(F.expr, exprs.values()))), lambda k, v: v.isNotNull())
    return F.explode(F.array(made))  # made once a row, as if it were read


def ways(spark, sf_dir):
    stop = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    refs = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(stop)), lambda s: s["l_partkey"]).alias("refs"))
    # joined by sorting: files of few bytes may hold many rows, and a broadcast that is chosen by their size has all of them pass the driver
    o = _t(spark, sf_dir, "orders").join(refs.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), "refs", _tags(WAY_TAGS).alias("tags"))


def nodes(spark, sf_dir):
    signs = {"highway": _case("p_size % 10", ["traffic_signals", "stop", "give_way"])}
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("50 + p_partkey * 91 % 1000 / 1000e0").alias("lat"), F.expr("30 + p_partkey * 37 % 1000 / 1000e0").alias("lon"), _tags(signs).alias("tags"))


def a8_drivable_ways(spark, sf_dir):
    got = ro.drivable(ways(spark, sf_dir))
    return got.select("id", F.md5(F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").cast("binary")).alias("refs"), F.col("cls").cast("long").alias("cls"), F.col("flags").cast("long").alias("flags"))


def a9_node_locations(spark, sf_dir):
    got = ro.used_nodes(nodes(spark, sf_dir), ro.drivable(ways(spark, sf_dir)))
    sign = rd.tag(F.col("tags"), "highway")
    return got.select("id", "lat", "lon", F.coalesce(sign == "traffic_signals", F.lit(False)).alias("signals"), F.coalesce(sign.isin("stop", "give_way"), F.lit(False)).alias("stop"))


def a13_relation_streets(spark, sf_dir):
    """Parts as members of suppliers' relations: the first relation that has a part as a house names its street."""
    m = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_linenumber") == 1, "street").otherwise("house").alias("role"))
    houses = m.filter("role <> 'street'").join(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return houses.groupBy("l_partkey").agg(F.min_by("s_name", "l_suppkey").alias("street"))


def b5_road_attributes(spark, sf_dir):
    got = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _tags(WAY_TAGS).alias("tags"))
    return ro.classified(got).select("id", "cls", "oneway", "flags", "maxspeed")


def b7_one_ways(spark, sf_dir):
    t = F.col("tags")
    return _t(spark, sf_dir, "orders").select("o_orderkey", _tags(WAY_TAGS).alias("tags")).select("o_orderkey", rd.one_way(t, F.coalesce(rd.tag(t, "junction").isin("roundabout", "circular"), F.lit(False))).alias("oneway"))


def b8_restrictions(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _tags(TURN_TAGS).alias("tags"))
    return p.select("l_orderkey", "l_linenumber", rd.restriction(F.col("tags")).alias("kind"))


def b9_places(spark, sf_dir):
    t = F.col("tags")
    got = _t(spark, sf_dir, "part").select("p_partkey", _tags(PLACE_TAGS).alias("tags")).select("p_partkey", rd.place(t).alias("p"), rd.poi(t).alias("poi"), rd.entrance_number(t).alias("entrance"))
    return got.select("p_partkey", "p.category", "p.flags", "poi", "entrance")


def a11_classified(spark, sf_dir):
    """One object may be several things: a row for each."""
    t = F.col("tags")
    kinds = F.array_compact(F.array(F.when(rd.place(t).isNotNull(), "stop"), F.when(rd.poi(t).isNotNull(), "poi"), F.when(rd.entrance_number(t) != "", "entrance")))
    return _t(spark, sf_dir, "part").select("p_partkey", _tags(PLACE_TAGS).alias("tags")).select("p_partkey", F.explode(kinds).alias("kind"))


def b16_legal_limits(spark, sf_dir):
    got = b5_road_attributes(spark, sf_dir).withColumn("f", F.col("flags") + F.when(F.col("id") % 3 == 0, rd.URBAN).otherwise(0))
    return got.select("id", rd.legal_limit(F.col("cls"), F.col("oneway"), F.col("f"), F.col("maxspeed")).cast("int").alias("limit"))


def m15_edge_seconds(spark, sf_dir):
    got = b5_road_attributes(spark, sf_dir).withColumn("f", F.col("flags") + F.when(F.col("id") % 3 == 0, rd.URBAN).otherwise(0) + F.when(F.col("id") % 6 == 0, rd.CITY).otherwise(0) + F.when(F.col("id") % 12 == 0, rd.BIG_CITY).otherwise(0) + F.when(F.col("id") % 5 == 0, rd.SIGNALS).otherwise(0))
    metres = F.col("id") % 900 + 10.0
    return got.select("id", F.round(rd.edge_seconds(F.col("cls"), F.col("f"), F.col("maxspeed"), metres), 6).alias("seconds"), rd.entry_seconds(F.col("cls"), F.col("f")).alias("entry"))


def _edges(spark, sf_dir):
    with tables.scratch() as held:
        parts = gr.split_ways(tables.cut(ro.drivable(ways(spark, sf_dir)).select("id", "refs")))
        return held.keep(tables.cut(ro.edge_lengths(parts, nodes(spark, sf_dir), RADIUS)))


def d44_edge_lengths(spark, sf_dir):
    return _edges(spark, sf_dir).select("way", F.col("part").cast("long").alias("part"), "a", "b", F.round("metres", 3).alias("metres"))


def c36_mapped_restrictions(spark, sf_dir):
    """Turns forbidden or ordered from each way over a part's node into the next way there, the last one into the first."""
    e = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    edges = e.select((F.col("l_orderkey") * 10_000 + F.col("l_partkey")).alias("edge"), F.floor(F.col("l_orderkey") / 4).cast("long").alias("way"), F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1_000_000_000).alias("b"))
    r = _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).cast("long").alias("from_way"), F.col("l_partkey").alias("via"), (F.col("l_partkey") % 2 + 1).alias("kind"))
    here = Window.partitionBy("via")
    r = r.distinct().withColumn("to_way", F.coalesce(F.lead("from_way").over(here.orderBy("from_way")), F.min("from_way").over(here)))
    return ro.map_restrictions(r.filter("to_way <> from_way"), edges)


def c37_controls(spark, sf_dir):
    """Line items as signs along the edge between their order and its customer."""
    o = _t(spark, sf_dir, "orders")
    edges = o.select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97 + 1_000_000_000).alias("b"), (F.col("o_orderkey") % 200 + 20.0).alias("metres"))
    signs = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sign"), F.col("l_orderkey").alias("edge"), (F.col("l_quantity") * 4).alias("at"))
    signs = signs.join(edges.select("edge", "metres"), "edge").filter("at <= metres").drop("metres")
    return ro.map_controls(signs, edges, gr.degrees(edges.select("a", "b")), 40.0)


def grid(spark, sf_dir):
    """Directed streets between neighbours on a grid of suppliers, ten to a row: edge, a, b, d (north, east, south, west), seconds and headings."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"))
    step = {0: "a + 10", 1: "CASE WHEN a % 10 < 9 THEN a + 1 END", 2: "a - 10", 3: "CASE WHEN a % 10 > 0 THEN a - 1 END"}
    e = s.withColumn("d", F.explode(F.array(*map(F.lit, step)))).withColumn("b", F.expr("CASE d " + " ".join(f"WHEN {d} THEN {x}" for d, x in step.items()) + " END"))
    e = e.join(s.select(F.col("a").alias("b")), "b").filter("not (d = 3 and floor(a / 10) % 3 = 1) and not (d = 2 and a % 4 = 2)")
    across = F.col("d") % 2 == 1
    cls = F.when(across, F.element_at(F.array(*map(F.lit, (2, 3, 4, 6, 6, 8, 6))), (F.floor(F.col("a") / 10) % 7 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, (3, 6, 6, 4))), (F.col("a") % 4 + 1).cast("int")))
    flags = F.lit(rd.ATTRIBUTES + rd.URBAN) + F.when(F.col("a") % 9 == 0, rd.UNPAVED).otherwise(0)
    heading = F.col("d") * 1.5707963267948966
    e = e.select((F.col("a") * 4 + F.col("d")).alias("edge"), "a", "b", "d", heading.alias("heading_in"), heading.alias("heading_out"), (F.col("b") * 4 + (F.col("d") + 2) % 4).alias("twin"), cls.alias("cls"), flags.alias("flags"), F.when(across, 200.0).otherwise(150.0).alias("metres"))
    return e.withColumn("seconds", rd.edge_seconds(F.col("cls"), F.col("flags"), F.lit(0), F.col("metres")) + rd.entry_seconds(F.col("cls"), F.col("flags")))


def _turns(spark, sf_dir, edges):
    no = edges.filter("b % 11 = 5 and d = 0").select(F.col("edge").alias("from_edge"), (F.col("b") * 4 + 3).alias("to_edge"), F.col("b").alias("via"), F.lit(1).alias("kind"))
    only = edges.filter("b % 13 = 7 and d = 1").select(F.col("edge").alias("from_edge"), (F.col("b") * 4 + 1).alias("to_edge"), F.col("b").alias("via"), F.lit(2).alias("kind"))
    lights = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("via"), (F.col("s_nationkey") % 5 == 0).alias("signals"))
    undirected = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = gr.degrees(undirected).select(F.col("node").alias("via"), "degree")
    t = ro.passages(edges, no.unionByName(only)).join(lights, "via").join(degree, "via")
    return t.select("from_edge", "to_edge", rd.pass_seconds(F.col("turn"), F.col("degree"), F.col("signals"), F.col("u_turn"), F.lit(False)).alias("seconds"))


def c35_legal_passages(spark, sf_dir):
    return _turns(spark, sf_dir, grid(spark, sf_dir))


def h1_route_with_turns(spark, sf_dir):
    e = grid(spark, sf_dir)
    got = ro.route(e, _turns(spark, sf_dir, e), e.filter("a = 1").select("edge", F.col("seconds").alias("cost")))
    return got.select("edge", F.round("cost", 4).alias("cost"))


def h2_trip(spark, sf_dir):
    e = grid(spark, sf_dir)
    got = ro.trip(e, _turns(spark, sf_dir, e), STOPS)
    return got.select("leg", "from_node", "to_node", F.round("seconds", 4).alias("seconds"), F.round("starts_at", 4).alias("starts_at"))


def h1_goal_route(spark, sf_dir):
    """The quickest way from the first supplier to the last, small streets searched near both only, and what cannot beat the best way not at all."""
    e = grid(spark, sf_dir).withColumns({"x": (F.col("b") % 10 * 200).cast("double"), "y": (F.floor(F.col("b") / 10) * 150).cast("double")})
    last = _t(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    at = lambda node: (node % 10 * 200.0, node // 10 * 150.0)
    starts = e.filter("a = 1").select("edge", F.col("seconds").alias("cost"))
    got = ro.route_to(e, _turns(spark, sf_dir, e), starts, e.filter(F.col("b") == last).select("edge"), at(1), at(last), FASTEST, LEVELS)
    return got.select("place", "edge", F.round("cost", 4).alias("cost"))


#: Metres a second no street allows more of; classes still searched so far from both ends.
FASTEST, LEVELS = 40.0, ((900.0, 4), (450.0, 6))
STOPS = [1, 4, 8]


def h3_alternatives(spark, sf_dir):
    """Up to three ways between two suppliers: others cost at most six tenths more and share less than eight tenths with those kept."""
    e = grid(spark, sf_dir).select("a", "b", F.col("seconds").alias("cost"))
    got = gr.alternatives(e, 1, 8, 3, 1.4, 1.6, 0.8)
    return got.groupBy("path").agg(F.count("*").alias("edges"), F.round(F.sum("cost"), 4).alias("cost"))


def h4_detours(spark, sf_dir):
    e = grid(spark, sf_dir).select("a", "b", F.col("seconds").alias("cost"))
    places = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return gr.detours(e, 1, 8, places).select("node", F.round("detour", 4).alias("detour"))


def h6_bounded_costs(spark, sf_dir):
    e = grid(spark, sf_dir).select("a", "b", (F.col("metres") + F.when(F.col("cls") == 8, 100.0).otherwise(0.0)).alias("cost"))
    return gr.cheapest(e, spark.createDataFrame([(1, 0.0)], "node long, cost double"), 900.0).select("node", "cost")


def d48_agreed_limits(spark, sf_dir):
    """Of each customer's roads, weighed by price, the limit that at least a third of the weight holds."""
    r = b16_legal_limits(spark, sf_dir).join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.floor("o_totalprice").cast("long").alias("w")), "id")
    return ro.agreed_limit(r, ["o_custkey"], F.col("limit"), "w", 0.34)


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "abcdhm" and k[1:2].isdigit()}


def _columns(tags: dict[str, str]) -> str:
    return ", ".join(f"{e} AS \"{k}\"" for k, e in tags.items())


_CLS = "CASE " + " ".join(f"WHEN highway = '{k}' THEN {v}" for k, v in rd.CLASSES.items()) + " " + " ".join(f"WHEN highway = '{k}_link' THEN {rd.CLASSES[k]}" for k in rd.LINKED) + " END"
_OPEN = "[" + ", ".join(f"'{v}'" for v in rd.ACCESS_OPEN) + "]"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_ROAD = f"""w AS (SELECT o_orderkey AS id, o_custkey, {_columns(WAY_TAGS)} FROM orders), x AS (SELECT *, list_transform(string_split(coalesce(motor_vehicle, access), ';'), lambda v: trim(v)) AS who, coalesce(junction IN ('roundabout', 'circular'), false) AS ring FROM w),
    r AS (SELECT id, o_custkey, {_CLS} AS cls,
        CASE WHEN oneway IN ('yes', '1', 'true') THEN 1 WHEN oneway IN ('-1', 'reverse') THEN 2 WHEN oneway IS NULL AND (ring OR highway = 'motorway') THEN 1 ELSE 0 END AS oneway,
        512 + CASE WHEN highway LIKE '%_link' THEN 1 ELSE 0 END + CASE WHEN ring THEN 2 ELSE 0 END + CASE WHEN tunnel <> 'no' THEN 4 ELSE 0 END + CASE WHEN bridge <> 'no' THEN 8 ELSE 0 END + CASE WHEN NOT list_has_any(who, {_OPEN}) THEN 16 ELSE 0 END
        + CASE WHEN highway = 'service' AND service IN {_IN(rd.MINOR_SERVICES)} THEN 32 ELSE 0 END + CASE WHEN surface IN {_IN(rd.UNPAVED_SURFACES)} THEN 64 ELSE 0 END AS flags,
        CASE maxspeed WHEN '50' THEN 50 WHEN '60 mph' THEN 97 WHEN 'UA:urban' THEN 50 WHEN '7.5 km/h' THEN 8 WHEN '999' THEN 250 WHEN 'walk' THEN 5 WHEN '30kmh' THEN 30 WHEN '0.2' THEN 1 ELSE 0 END AS maxspeed
        FROM x WHERE cls IS NOT NULL AND coalesce(area, '') <> 'yes' AND coalesce(list_distinct(who) <> ['no'], true))"""
_REFS = """l AS (SELECT l_orderkey AS way, l_partkey AS node, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before, l_linenumber AS ln, l_suppkey AS sp FROM lineitem JOIN r ON id = l_orderkey),
    v AS (SELECT way, node, row_number() OVER (PARTITION BY way ORDER BY ln, node, sp) - 1 AS pos, count(*) OVER (PARTITION BY way) AS size FROM l WHERE before IS NULL OR node <> before), u AS (SELECT * FROM v WHERE size >= 2)"""
_NODE = "n AS (SELECT p_partkey AS id, 50 + p_partkey * 91 % 1000 / 1000.0::DOUBLE AS lat, 30 + p_partkey * 37 % 1000 / 1000.0::DOUBLE AS lon, p_size % 10 AS sign FROM part)"
_LIMIT = "CASE WHEN flags & 32 <> 0 THEN NULL WHEN maxspeed > 0 THEN maxspeed WHEN cls = 7 THEN 20 WHEN cls = 0 THEN 130 WHEN id % 3 = 0 THEN 50 WHEN cls IN (1, 2) AND oneway <> 0 AND flags & 3 = 0 THEN NULL ELSE 90 END"


def _kph(cls, flags, maxspeed, urban, city, great):
    cap, limit = f"[{', '.join(map(str, rd.CAP_KPH))}][{cls} + 1]", f"CASE WHEN {maxspeed} > 0 THEN {maxspeed} WHEN {cls} = 0 THEN 130 WHEN {urban} THEN 50 ELSE 90 END"
    big = f"({great} AND {cls} IN (1, 2, 3))"
    kph = f"least(({limit}) * CASE WHEN {big} THEN 1.15 WHEN {city} THEN 0.9 WHEN NOT {urban} THEN 1.1 WHEN {cls} <= 3 THEN 1.3 ELSE 1.0 END::DOUBLE, {cap})"
    kph = f"CASE WHEN {big} THEN least({kph}, 70) ELSE {kph} END"
    kph = f"least({kph}, CASE WHEN {flags} & 64 <> 0 THEN 30 ELSE 1000 END) * CASE WHEN {flags} & 1 <> 0 THEN 0.6 ELSE 1.0 END::DOUBLE"
    return f"(least({kph}, CASE WHEN {flags} & 2 <> 0 THEN 30 ELSE 1000 END) / 3.6::DOUBLE)"


_ENTRY = "CASE WHEN flags & 16 <> 0 THEN 600 ELSE 0 END + CASE WHEN flags & 32 <> 0 THEN 60 ELSE 0 END + CASE WHEN cls = 9 THEN 120 ELSE 0 END"
_GRID = f"""s AS (SELECT s_suppkey AS a, s_nationkey FROM supplier), q AS (SELECT a, d, CASE d WHEN 0 THEN a + 10 WHEN 1 THEN CASE WHEN a % 10 < 9 THEN a + 1 END WHEN 2 THEN a - 10 ELSE CASE WHEN a % 10 > 0 THEN a - 1 END END AS b FROM s, (SELECT unnest([0, 1, 2, 3]) AS d)),
    g AS (SELECT a * 4 + d AS edge, a, b, d, CASE WHEN d % 2 = 1 THEN [2, 3, 4, 6, 6, 8, 6][a // 10 % 7 + 1] ELSE [3, 6, 6, 4][a % 4 + 1] END AS cls, CASE WHEN a % 9 = 0 THEN 704 ELSE 640 END AS flags, CASE WHEN d % 2 = 1 THEN 200.0 ELSE 150.0 END::DOUBLE AS metres
        FROM q WHERE b IN (SELECT a FROM s) AND NOT (d = 3 AND a // 10 % 3 = 1) AND NOT (d = 2 AND a % 4 = 2)),
    e AS (SELECT *, metres / {_kph("cls", "flags", "0", "true", "false", "false")} + {_ENTRY} AS seconds FROM g),
    dg AS (SELECT node, count(*) AS degree FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e) z, LATERAL (SELECT unnest([z.a, z.b]) AS node) GROUP BY 1),
    m AS (SELECT x.edge AS f, y.edge AS t, x.b AS via, (y.d - x.d + 4) % 4 AS turn, x.d AS fd FROM e x JOIN e y ON y.a = x.b
        WHERE NOT (x.b % 11 = 5 AND x.d = 0 AND y.d = 3) AND (NOT (x.b % 13 = 7 AND x.d = 1 AND x.b * 4 + 1 IN (SELECT edge FROM e)) OR y.d = 1)),
    k AS (SELECT *, count(*) FILTER (turn <> 2) OVER (PARTITION BY f) AS others FROM m),
    tn AS (SELECT f AS from_edge, t AS to_edge, CASE WHEN turn = 2 THEN 30 WHEN degree < 3 THEN CASE WHEN s_nationkey % 5 = 0 THEN 5 ELSE 0 END ELSE 2 + CASE turn WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 15 END + CASE WHEN s_nationkey % 5 = 0 THEN 15 ELSE 0 END END::DOUBLE AS seconds
        FROM k JOIN s ON s.a = via JOIN dg ON node = via WHERE turn <> 2 OR others = 0)"""


def _walk(name: str, first: str, step: str, key: str) -> str:
    """Least costs by recursion that ends when nothing improves; {0} stands for what improved last."""
    return f""", {name}({key}, cost) USING KEY ({key}) AS ({first}
        UNION SELECT n.{key}, min(n.cost) FROM ({step.format(name)}) AS n({key}, cost) LEFT JOIN (SELECT {key} AS k0, cost AS c0 FROM recurring.{name}) r ON k0 = n.{key} WHERE c0 IS NULL OR n.cost < c0 GROUP BY 1)"""


_TURNING = "SELECT to_edge, c.cost + tn.seconds + e.seconds FROM {0} c JOIN tn ON from_edge = c.edge JOIN e ON e.edge = to_edge"
_LEGS = [(f"l{i}x", a, b) for i, (a, b) in enumerate(zip(STOPS, STOPS[1:]))]
def _way(k: int) -> str:
    """Least costs with predecessors over edges e{k}, the way back from the goal, and the edges with its penalty as e{k + 1}."""
    out = f""", d{k}(node, cost, via) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(-1 AS BIGINT)
        UNION SELECT n.node, min(n.cost), arg_min(n.via, (n.cost, n.via)) FROM (SELECT x.b AS node, d.cost + x.cost AS cost, x.a AS via FROM d{k} d JOIN e{k} x ON x.a = d.node) n
        LEFT JOIN (SELECT node AS k0, cost AS c0, via AS v0 FROM recurring.d{k}) r ON k0 = n.node WHERE c0 IS NULL OR n.cost < c0 OR n.cost = c0 AND n.via < v0 GROUP BY 1)"""
    out += f", w{k} AS (SELECT via AS a, node AS b FROM d{k} WHERE node = 8 UNION ALL SELECT d.via, d.node FROM w{k} JOIN d{k} d ON d.node = w{k}.a WHERE d.via >= 0)"
    out += f", p{k} AS (SELECT {k} AS path, w.a, w.b, e0.cost FROM w{k} w JOIN e0 ON e0.a = w.a AND e0.b = w.b), e{k + 1} AS MATERIALIZED (SELECT a, b, CASE WHEN EXISTS (SELECT 1 FROM w{k} w WHERE w.a = x.a AND w.b = x.b) THEN cost * 1.4 ELSE cost END AS cost FROM e{k} x)"
    return out


def _kept(k: int, before: str) -> str:
    return f"(SELECT sum(cost) FROM p{k}) <= 1.6 * (SELECT sum(cost) FROM p0) AND (SELECT coalesce(sum(cost), 0) FROM p{k} x WHERE EXISTS (SELECT 1 FROM ({before}) o WHERE o.a = x.a AND o.b = x.b)) < 0.8 * (SELECT sum(cost) FROM p{k})"


ORACLES = {
    "h3_alternatives": f"""WITH RECURSIVE {_GRID}, e0 AS MATERIALIZED (SELECT a, b, seconds::DOUBLE AS cost FROM e){_way(0)}{_way(1)}{_way(2)}, k1 AS (SELECT * FROM p1 WHERE {_kept(1, "SELECT a, b FROM p0")}), k2 AS (SELECT * FROM p2 WHERE {_kept(2, "SELECT a, b FROM p0 UNION SELECT a, b FROM k1")})
        SELECT path, count(*) AS edges, round(sum(cost), 4) AS cost FROM (SELECT * FROM p0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY 1""",
    "a8_drivable_ways": f"WITH {_ROAD}, {_REFS} SELECT way AS id, md5(string_agg(node, ',' ORDER BY pos)) AS refs, CAST(any_value(cls) AS BIGINT) AS cls, CAST(any_value(flags) AS BIGINT) AS flags FROM u JOIN r ON id = way GROUP BY 1",
    "a9_node_locations": f"WITH {_ROAD}, {_REFS}, {_NODE} SELECT id, lat, lon, sign = 0 AS signals, sign IN (1, 2) AS stop FROM n WHERE id IN (SELECT node FROM u)",
    "a13_relation_streets": "SELECT l_partkey, arg_min(s_name, l_suppkey) AS street FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <> 1 GROUP BY 1",
    "b5_road_attributes": f"WITH {_ROAD} SELECT id, CAST(cls AS INTEGER) AS cls, CAST(oneway AS INTEGER) AS oneway, CAST(flags AS INTEGER) AS flags, CAST(maxspeed AS INTEGER) AS maxspeed FROM r",
    "b7_one_ways": f"WITH w AS (SELECT o_orderkey, {_columns(WAY_TAGS)} FROM orders) SELECT o_orderkey, CAST(CASE WHEN oneway IN ('yes', '1') THEN 1 WHEN oneway = '-1' THEN 2 WHEN oneway IS NULL AND (junction IN ('roundabout', 'circular') OR highway = 'motorway') THEN 1 ELSE 0 END AS INTEGER) AS oneway FROM w",
    "b8_restrictions": f"""WITH w AS (SELECT l_orderkey, l_linenumber, {_columns(TURN_TAGS)} FROM lineitem), v AS (SELECT *, coalesce("restriction:motorcar", restriction) AS v FROM w)
        SELECT l_orderkey, l_linenumber, CAST(CASE WHEN type <> 'restriction' OR "except" IN ('motorcar', 'psv; motorcar') THEN NULL WHEN v LIKE 'no!_%' ESCAPE '!' THEN 1 WHEN v LIKE 'only!_%' ESCAPE '!' THEN 2 END AS INTEGER) AS kind FROM v""",
    "b9_places": f"""WITH w AS (SELECT p_partkey, {_columns(PLACE_TAGS)} FROM part), c AS (SELECT *, CASE amenity {" ".join(f"WHEN '{k}' THEN {v}" for k, v in rd.PLACE_CATEGORIES.items())} END AS cat, amenity IN {_IN(rd.CLOSED_AMENITIES)} AND coalesce(access IN ('private', 'customers', 'no'), false) AS shut FROM w)
        SELECT p_partkey, CAST(CASE WHEN NOT shut THEN cat END AS INTEGER) AS category, CAST(CASE WHEN cat IS NOT NULL AND NOT shut THEN CASE WHEN amenity = 'fuel' THEN CASE WHEN "fuel:diesel" = 'yes' THEN 2 ELSE 0 END + CASE WHEN "fuel:lpg" = 'yes' THEN 4 ELSE 0 END + CASE WHEN "fuel:octane_95" = 'yes' THEN 16 ELSE 0 END ELSE 0 END END AS INTEGER) AS flags,
        CASE WHEN amenity <> 'no' THEN 'amenity=' || amenity WHEN shop <> 'no' THEN 'shop=' || shop WHEN tourism IS NOT NULL THEN 'tourism=' || tourism END AS poi,
        CASE WHEN trim(ref) <> '' THEN ref WHEN "addr:unit" IS NOT NULL THEN "addr:unit" WHEN name IN ('12a', 'Б2') THEN name ELSE '' END AS entrance FROM c""",
    "b16_legal_limits": f"WITH {_ROAD} SELECT id, CAST({_LIMIT} AS INTEGER) AS \"limit\" FROM r",
    "m15_edge_seconds": f"WITH {_ROAD} SELECT id, round((id % 900 + 10) / {_kph('cls', 'flags', 'maxspeed', '(id % 3 = 0)', '(id % 6 = 0)', '(id % 12 = 0)')} + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END, 6) AS seconds, CAST({_ENTRY} AS DOUBLE) AS entry FROM r",
    "d44_edge_lengths": f"""WITH {_ROAD}, {_REFS}, {_NODE}, c AS (SELECT node, count(*) AS uses FROM u GROUP BY 1), k AS (SELECT u.*, lat, lon, sum(CASE WHEN uses > 1 OR pos = 0 OR pos = size - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos) AS k FROM u JOIN c USING (node) JOIN n ON n.id = node),
        h AS (SELECT way, pos, node, CAST(lag(k) OVER w - 1 AS BIGINT) AS part, lag(node) OVER w AS p, radians(lat - lag(lat) OVER w) AS dy, radians(lon - lag(lon) OVER w) AS dx, cos(radians(lat)) * cos(radians(lag(lat) OVER w)) AS c FROM k WINDOW w AS (PARTITION BY way ORDER BY pos))
        SELECT way, part, arg_min(p, pos) AS a, arg_max(node, pos) AS b, round(sum(2 * {RADIUS} * asin(least(1, sqrt(power(sin(dy / 2), 2) + c * power(sin(dx / 2), 2))))), 3) AS metres FROM h WHERE part IS NOT NULL GROUP BY 1, 2""",
    "c36_mapped_restrictions": """WITH e AS (SELECT DISTINCT l_orderkey * 10000 + l_partkey AS edge, l_orderkey // 4 AS way, l_partkey AS node FROM lineitem), o AS (SELECT way, node, min(edge) AS edge FROM e GROUP BY 1, 2 HAVING count(*) = 1),
        r AS (SELECT DISTINCT way, node FROM e), n AS (SELECT *, coalesce(lead(way) OVER (PARTITION BY node ORDER BY way), min(way) OVER (PARTITION BY node)) AS to_way FROM r)
        SELECT n.node AS via, n.node % 2 + 1 AS kind, f.edge AS from_edge, t.edge AS to_edge FROM n JOIN o f ON f.way = n.way AND f.node = n.node JOIN o t ON t.way = n.to_way AND t.node = n.node WHERE to_way <> n.way""",
    "c37_controls": """WITH e AS (SELECT o_orderkey AS edge, o_custkey AS a, o_orderkey % 97 + 1000000000 AS b, o_orderkey % 200 + 20.0 AS metres FROM orders), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1),
        s AS (SELECT l_orderkey * 8 + l_linenumber AS sign, edge, a, b, l_quantity * 4 AS spot, metres - l_quantity * 4 AS ahead FROM lineitem JOIN e ON edge = l_orderkey WHERE l_quantity * 4 <= metres),
        c AS (SELECT sign, edge, CASE WHEN spot <= ahead AND spot <= 40 AND da.degree >= 3 THEN a WHEN ahead <= 40 AND db.degree >= 3 THEN b END AS node FROM s JOIN d da ON da.node = a JOIN d db ON db.node = b) SELECT sign, node, CASE WHEN node IS NULL THEN edge END AS edge FROM c""",
    "c35_legal_passages": f"WITH {_GRID} SELECT * FROM tn",
    "h1_route_with_turns": f"WITH RECURSIVE {_GRID}{_walk('c', 'SELECT edge, seconds AS cost FROM e WHERE a = 1', _TURNING, 'edge')} SELECT edge, round(cost, 4) AS cost FROM c",
    "h1_goal_route": f"""WITH RECURSIVE {_GRID}, z AS (SELECT max(a) AS z FROM s), o AS (SELECT e.*, least(sqrt(power(b % 10 * 200 - 200, 2) + power(b // 10 * 150, 2)), sqrt(power((b % 10 - z % 10) * 200, 2) + power((b // 10 - z // 10) * 150, 2))) AS near FROM e, z),
        u AS (SELECT *, CASE WHEN near >= 900 THEN cls <= 4 WHEN near >= 450 THEN cls <= 6 ELSE true END AS main FROM o), pr AS (SELECT * FROM u QUALIFY main OR NOT bool_or(main) OVER (PARTITION BY a))""" + """,
        d(edge, cost, via) USING KEY (edge) AS (SELECT edge, seconds::DOUBLE, CAST(-1 AS BIGINT) FROM pr WHERE a = 1
            UNION SELECT n.edge, min(n.cost), arg_min(n.via, (n.cost, n.via)) FROM (SELECT to_edge AS edge, d.cost + (tn.seconds + pr.seconds) AS cost, d.edge AS via FROM d JOIN tn ON from_edge = d.edge JOIN pr ON pr.edge = to_edge) n
            LEFT JOIN (SELECT edge AS k0, cost AS c0, via AS v0 FROM recurring.d) r ON k0 = n.edge WHERE c0 IS NULL OR n.cost < c0 OR n.cost = c0 AND n.via < v0 GROUP BY 1),
        w AS (SELECT edge, cost, via, 0 AS back FROM d WHERE edge = (SELECT arg_min(edge, (cost, edge)) FROM d WHERE edge IN (SELECT edge FROM pr, z WHERE b = z.z))
            UNION ALL SELECT d.edge, d.cost, d.via, back + 1 FROM w JOIN d ON d.edge = w.via)
        SELECT max(back) OVER () - back AS place, edge, round(cost, 4) AS cost FROM w""",
    "h2_trip": f"WITH RECURSIVE {_GRID}{''.join(_walk(n, f'SELECT edge, seconds AS cost FROM e WHERE a = {a}', _TURNING, 'edge') for n, a, _ in _LEGS)}, p AS ("
    + " UNION ALL ".join(f"SELECT {i} AS leg, {a} AS f, {b} AS t, min(cost) AS s FROM {n} WHERE edge IN (SELECT edge FROM e WHERE b = {b})" for i, (n, a, b) in enumerate(_LEGS))
    + ") SELECT CAST(leg AS INTEGER) AS leg, CAST(f AS BIGINT) AS from_node, CAST(t AS BIGINT) AS to_node, round(s, 4) AS seconds, round(coalesce(sum(s) OVER (ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS starts_at FROM p",
    "h4_detours": f"""WITH RECURSIVE {_GRID}{_walk('x', 'SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost', 'SELECT e.b, c.cost + e.seconds FROM {0} c JOIN e ON e.a = c.node', 'node')}{_walk('y', 'SELECT CAST(8 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost', 'SELECT e.a, c.cost + e.seconds FROM {0} c JOIN e ON e.b = c.node', 'node')}
        SELECT x.node, round(x.cost + y.cost - (SELECT cost FROM x WHERE node = 8), 4) AS detour FROM x JOIN y USING (node)""",
    "h6_bounded_costs": f"WITH RECURSIVE {_GRID}{_walk('c', 'SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost', 'SELECT e.b, c.cost + e.metres + CASE WHEN e.cls = 8 THEN 100 ELSE 0 END FROM {0} c JOIN e ON e.a = c.node WHERE c.cost + e.metres + CASE WHEN e.cls = 8 THEN 100 ELSE 0 END <= 900', 'node')} SELECT * FROM c",
    "d48_agreed_limits": f"""WITH {_ROAD}, l AS (SELECT r.o_custkey, {_LIMIT} AS l, CAST(floor(o_totalprice) AS BIGINT) AS w FROM r JOIN orders ON o_orderkey = id), g AS (SELECT o_custkey, l, sum(w) AS w FROM l GROUP BY 1, 2), t AS (SELECT o_custkey, sum(w) AS total FROM g GROUP BY 1),
        b AS (SELECT * FROM g WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, l) = 1) SELECT t.o_custkey, CAST(CASE WHEN w >= 0.34 * total THEN l END AS INTEGER) AS "limit" FROM t LEFT JOIN b USING (o_custkey)""",
}
ORACLES["a11_classified"] = f"WITH b AS ({ORACLES['b9_places']}) SELECT p_partkey, 'stop' AS kind FROM b WHERE category IS NOT NULL UNION ALL SELECT p_partkey, 'poi' FROM b WHERE poi IS NOT NULL UNION ALL SELECT p_partkey, 'entrance' FROM b WHERE entrance <> ''"
