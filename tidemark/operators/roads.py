"""Road networks from tables of nodes, ways and relations: edges, restrictions, controls, routes with turn costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import geo, roads
from tidemark.operators.graph import cheapest, way_to
from tidemark.operators.tables import cut, scratch


def drivable(ways: DataFrame) -> DataFrame:
    """id, refs and cls, oneway, flags, maxspeed of the ways cars may use; a node that repeats at once counts once."""
    refs = F.transform(F.filter(F.transform("refs", lambda r, i: F.struct(r.alias("r"), F.get("refs", i - 1).alias("before"))), lambda s: s["before"].isNull() | (s["r"] != s["before"])), lambda s: s["r"])
    return classified(ways.select("id", "tags", F.when(F.size("refs") > 0, refs).alias("refs")).filter("size(refs) >= 2")).select("id", "refs", "cls", "oneway", "flags", "maxspeed")


def classified(ways: DataFrame) -> DataFrame:
    """ways (with tags) that cars may use and cls, oneway, flags, maxspeed of each.

    The rules stand in a generator, so that they run once a row and not once for each field and filter.
    """
    found = ways.select("*", F.explode_outer(F.array(roads.road(F.col("tags")))).alias("_road")).filter("_road is not null")
    return found.select(*ways.columns, "_road.*")


def used_nodes(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """The nodes that some way refers to."""
    return nodes.join(ways.select(F.explode("refs").alias("id")).distinct(), "id", "left_semi")


def edge_lengths(parts: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """way, part, a, b, vertices, metres of each part of a way (way, part, refs), over its located nodes in order. Nodes are joined by sorting and do not pass the driver."""
    v = parts.select("way", "part", F.posexplode("refs").alias("pos", "id")).join(nodes.select("id", "lat", "lon").hint("merge"), "id")
    v = v.groupBy("way", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "lat", "lon"))).alias("v"))
    hop = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda p, q: geo.haversine(p["lat"], p["lon"], q["lat"], q["lon"], radius))
    metres = F.aggregate(hop, F.lit(0.0), lambda s, x: s + x)
    return v.filter(F.size("v") > 1).select("way", "part", F.col("v")[0]["id"].alias("a"), F.element_at("v", -1)["id"].alias("b"), F.size("v").alias("vertices"), metres.alias("metres"))


def map_restrictions(restrictions: DataFrame, edges: DataFrame) -> DataFrame:
    """via, kind, from_edge, to_edge of restrictions (from_way, via, to_way, kind) over edges (edge, way, a, b).

    Each side is the edge of its way that touches the via node; where there is none, or more than one, the
    restriction is dropped.
    """
    ends = edges.select("edge", "way", F.explode(F.array_distinct(F.array("a", "b"))).alias("via"))
    one = ends.groupBy("way", "via").agg(F.min("edge").alias("edge"), F.count("*").alias("n")).filter("n = 1")
    side = lambda name: one.select(F.col("way").alias(f"{name}_way"), "via", F.col("edge").alias(f"{name}_edge"))
    return restrictions.join(side("from"), ["from_way", "via"]).join(side("to"), ["to_way", "via"]).select("via", "kind", "from_edge", "to_edge")


def map_controls(signs: DataFrame, edges: DataFrame, degrees: DataFrame, near: float) -> DataFrame:
    """sign, node, edge: where signs (sign, edge, at) that stand on edges (edge, a, b, metres) count.

    A sign within near of an end where three edges meet counts at that junction (the nearer end first, the
    first end of two alike), any other on its edge.
    """
    deg = lambda c: degrees.select(F.col("node").alias(c), F.col("degree").alias(f"deg_{c}"))
    on = signs.join(edges.select("edge", "a", "b", "metres"), "edge").join(deg("a"), "a", "left").join(deg("b"), "b", "left")
    ahead = F.col("metres") - F.col("at")
    at_a = (F.col("at") <= ahead) & (F.col("at") <= near) & (F.col("deg_a") >= 3)
    at_b = (ahead <= near) & (F.col("deg_b") >= 3)
    node = F.when(F.coalesce(at_a, F.lit(False)), F.col("a")).when(F.coalesce(at_b, F.lit(False)), F.col("b"))
    return on.select("sign", node.alias("node"), F.when(node.isNull(), F.col("edge")).alias("edge"))


def passages(edges: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """from_edge, to_edge, via, turn (radians, clockwise), u_turn: legal ways on from each directed edge.

    edges: edge, a, b, heading_in, heading_out (bearings at both ends), twin (the same road the other way, or
    null). A restriction of kind 1 takes its turn away, one of kind 2 all others from that edge there. Turning
    back is legal only where nothing else is. Hubs are bounded by the network's degree, which is small.
    """
    on = edges.select(F.col("a").alias("via"), F.col("edge").alias("to_edge"), F.col("heading_out").alias("_out"))
    met = edges.select(F.col("b").alias("via"), F.col("edge").alias("from_edge"), F.col("heading_in").alias("_in"), "twin").join(on, "via")
    u_turn = F.coalesce(F.col("to_edge") == F.col("twin"), F.lit(False))
    turn = F.lit(3.141592653589793) - F.pmod(F.lit(3.141592653589793) - (F.col("_out") - F.col("_in")), F.lit(6.283185307179586))
    met = met.select("from_edge", "to_edge", "via", turn.alias("turn"), u_turn.alias("u_turn"))
    if forbidden is not None:
        rules = forbidden.select("from_edge", "to_edge", "via", "kind")
        met = met.join(rules, ["from_edge", "to_edge", "via"], "left")
        only = F.max(F.when(F.col("kind") == 2, 1)).over(Window.partitionBy("from_edge", "via"))
        met = met.withColumn("_only", only).filter("coalesce(kind, 0) <> 1 and (_only is null or kind = 2)").drop("kind", "_only")
    others = F.count_if(~F.col("u_turn")).over(Window.partitionBy("from_edge", "via"))
    return met.withColumn("_others", others).filter("not u_turn or _others = 0").drop("_others")


def turn_graph(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """a, b, cost between directed edges: the turn from a to b and the drive over b. edges: edge, seconds (entry included); turns: from_edge, to_edge, seconds."""
    step = turns.join(edges.select(F.col("edge").alias("to_edge"), F.col("seconds").alias("_s")), "to_edge")
    return step.select(F.col("from_edge").alias("a"), F.col("to_edge").alias("b"), (F.col("seconds") + F.col("_s")).alias("cost"))


def route(edges: DataFrame, turns: DataFrame, starts: DataFrame) -> DataFrame:
    """edge, cost, via_edge: least seconds to the end of each directed edge from the starting edges (edge, cost).

    States are directed edges, so turn costs and restrictions are exact.
    """
    found = cheapest(turn_graph(edges, turns), starts.select(F.col("edge").alias("node"), "cost"))
    return found.select(F.col("node").alias("edge"), "cost", F.col("via").alias("via_edge"))


#: By distance from the nearer end in metres: the least important class that is still searched there. Fixed values.
HIERARCHY = ((80_000.0, 3), (35_000.0, 4), (12_000.0, 5))


def pruned(edges: DataFrame, start: tuple[float, float], goal: tuple[float, float], levels: tuple = HIERARCHY) -> DataFrame:
    """edges (edge, a, b, cls, x, y of the place b) without small roads far from both ends.

    From each distance of levels on, only classes up to its class stay. Where all ways on from a place are smaller, they
    stay too, so no dead end is made.
    """
    near = F.least(*(F.hypot(F.col("x") - x, F.col("y") - y) for x, y in (start, goal)))
    rule = F.lit(True)
    for distance, cls in sorted(levels):
        rule = F.when(near >= distance, F.col("cls") <= cls).otherwise(rule)
    marked = edges.withColumn("_main", rule)
    some = marked.groupBy("a").agg(F.max("_main").alias("_any"))
    return marked.join(some, "a").filter("_main or not _any").drop("_main", "_any")


def route_to(edges: DataFrame, turns: DataFrame, starts: DataFrame, goals: DataFrame, start: tuple[float, float], goal: tuple[float, float], fastest: float, levels: tuple = HIERARCHY, safety: float = 0.995) -> DataFrame:
    """place, edge, cost: the edges of the quickest route from one of starts (edge, cost) to one of goals (edge), counted from the start.

    edges: edge, a, b, seconds, cls, x, y (place of b, metres). Away from both ends small roads are left out
    first; if that leaves no way, all are searched. What cannot beat the best way found is not followed: from each place
    the goal is at least the straight way at the fastest speed off, less a little for rounding. Empty if there is no way.
    """
    end = -1  # one state stands for all goals, and each goal leads to it for nothing
    with scratch() as held:
        edges, turns = cut(edges.select("edge", "a", "b", "seconds", "cls", "x", "y")), cut(turns)
        starts, goals = cut(starts.select(F.col("edge").alias("node"), "cost")), cut(goals.select("edge"))
        ahead = edges.select(F.col("edge").alias("b"), (F.hypot(F.col("x") - goal[0], F.col("y") - goal[1]) * F.lit(safety / fastest)).alias("ahead"))
        for kept in (pruned(edges, start, goal, levels), edges):
            own = kept.select(F.col("edge").alias("node"))
            step = turn_graph(kept, turns.join(own.withColumnRenamed("node", "from_edge"), "from_edge")).join(ahead, "b")
            step = step.unionByName(goals.select(F.col("edge").alias("a"), F.lit(end).cast("long").alias("b"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("ahead")))
            found = cheapest(step, starts.join(own, "node", "left_semi"), goal=end)
            way = way_to(found, end)
            if not way.isEmpty():
                break
        # a of each step is a road; place 0 of the way is the step into the goal
        out = way.join(found.select(F.col("node").alias("a"), "cost"), "a").select("place", F.col("a").alias("edge"), "cost")
        last = out.agg(F.max("place").alias("_last"))
        return held.keep(cut(out.join(F.broadcast(last)).select((F.col("_last") - F.col("place")).alias("place"), "edge", "cost")))


def trip(edges: DataFrame, turns: DataFrame, stops: list[int]) -> DataFrame:
    """leg, from_node, to_node, seconds, starts_at: cheapest legs between stops in order, each with the seconds before it.

    stops is a short list that somebody planned; edges: edge, a, b, seconds. A leg that cannot be driven is null.
    """
    legs = None
    with scratch() as held:
        step = cut(turn_graph(edges, turns))
        for k, (a, b) in enumerate(zip(stops, stops[1:])):
            starts = edges.filter(F.col("a") == a).select(F.col("edge").alias("node"), F.col("seconds").alias("cost"))
            found = cheapest(step, starts)
            leg = found.join(edges.filter(F.col("b") == b).select(F.col("edge").alias("node")), "node").agg(F.min("cost").alias("seconds"))
            leg = leg.select(F.lit(k).alias("leg"), F.lit(a).cast("long").alias("from_node"), F.lit(b).cast("long").alias("to_node"), "seconds")
            legs = leg if legs is None else legs.unionByName(leg)
        before = Window.partitionBy(F.lit(0)).orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)  # one row for each planned leg
        return held.keep(cut(legs.withColumn("starts_at", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)))))


def agreed_limit(df: DataFrame, by: list[str], limit: Column, weight: str, share: float) -> DataFrame:
    """by and the limit that holds a share of the weight of all candidates, those without a limit included."""
    each = df.withColumn("_l", limit).groupBy(*by, "_l").agg(F.sum(weight).alias("_w"))
    total = each.groupBy(*by).agg(F.sum("_w").alias("_all"), F.max(F.when(F.col("_l").isNotNull(), F.struct("_w", (-F.col("_l")).alias("_n")))).alias("_b"))
    return total.select(*by, F.when(F.col("_b._w") >= share * F.col("_all"), -F.col("_b._n")).alias("limit"))


def straight_walks(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, k, edge: from each starting edge the walk that turns least at every node, most edges long; never back.

    The next edge of each edge is found once; a step is then a join on a key that is unique on one side.
    """
    met = passages(edges).filter("not u_turn")
    onward = met.groupBy("from_edge").agg(F.min(F.struct(F.round(F.abs("turn"), 6).alias("turn"), "to_edge")).alias("_n"))
    onward = cut(onward.select(F.col("from_edge").alias("edge"), F.col("_n.to_edge").alias("next")))
    at = starts.select(F.col("edge").alias("start"), F.lit(0).alias("k"), "edge")
    out = at
    for k in range(1, most):
        at = at.join(onward, "edge").select("start", F.lit(k).alias("k"), F.col("next").alias("edge"))
        out = out.unionByName(at)
    return out
