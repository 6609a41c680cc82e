"""Graphs as edge tables: degrees, components, bounded shortest paths, walks, and offline matching by Viterbi."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.stateful import batch
from tidemark.operators.tables import cut, scratch, shared_path
from tidemark.operators.timeseries import islands, numbered


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over both ends (a loop counts twice)."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame, cost: str | None = None) -> DataFrame:
    more = [cost] if cost else []
    return edges.select("a", "b", *more).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), by contraction to the least neighbour in hashed order until no edge is left.

    The hash keeps chains short: each round leaves about half of the nodes or fewer.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    with scratch() as held:
        return held.keep(cut(_components(edges, nodes, rank)))


def _components(edges: DataFrame, nodes: DataFrame, rank) -> DataFrame:
    left, steps = cut(edges.filter("a <> b").select("a", "b").distinct()), []
    while not left.isEmpty():
        step = both_ways(left).groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a")))["n"].alias("m"))
        step = cut(step)
        x = step.select("a", F.col("m").alias("x"))
        y = step.select(F.col("a").alias("b"), F.col("m").alias("y"))
        left = cut(left.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        steps.append(step)
    out = None
    for step in reversed(steps):
        now = step.select(F.col("a").alias("node"), F.col("m"))
        out = now.withColumnRenamed("m", "root") if out is None else cut(now.join(out.select(F.col("node").alias("m"), "root"), "m", "left").select("node", F.coalesce("root", "m").alias("root")))
    of = nodes.withColumn("root", F.col("node")) if out is None else nodes.join(out, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("node").alias("component"))
    return of.join(least, "root").select("node", "component")


#: Edges that one task searches at a time.
BLOCK_EDGES = 1_500_000
#: Rounds whose finds are kept as tables of their own before they become one.
COMPACT = 8
#: Nodes whose way back one task may walk; beyond, ways are found by doubling.
WALK_NODES = 500_000
#: Nodes of a front that are sent to the edges; more are dealt out to them.
FRONT_NODES = 500_000
_LABEL = "node long, cost double, via long"


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _least(tables: list[DataFrame]) -> DataFrame:
    """node, cost, via: the least of each node in tables that have it once each."""
    if len(tables) == 1:
        return tables[0]
    return _all(tables).groupBy("node").agg(F.min(F.struct("cost", "via")).alias("s")).select("node", "s.*")


#: Stands for no via in arrays of long; less than any, as null is.
NONE = np.iinfo(np.int64).min


def relax(a: np.ndarray, b: np.ndarray, cost: np.ndarray, ahead: np.ndarray | None, nodes: np.ndarray, start: np.ndarray, before: np.ndarray, most: float, goal: int | None) -> tuple[np.ndarray, ...]:
    """(node, cost, via) of what can be reached over edges (a, b, cost) from nodes (each once) with start costs and the via they have so far.

    All nodes that improved are relaxed together until none does. Of equal costs the smallest via stays. Costs
    over most are dropped, and with a goal those that cannot beat it: ahead holds what at least lies between b and the goal.
    """
    ids = np.unique(np.concatenate([a, b, nodes]))
    order = np.argsort(a, kind="stable")
    tail, head, cost = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order]), cost[order]
    first = np.searchsorted(tail, np.arange(len(ids) + 1))
    best, via = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)
    front = np.searchsorted(ids, nodes)
    best[front], via[front] = start, before
    aim = None if goal is None else int(np.searchsorted(ids, goal))
    if aim is not None and (aim == len(ids) or ids[aim] != goal):
        aim = None
    ahead = None if ahead is None else ahead[order]
    while len(front):
        n = first[front + 1] - first[front]
        edge = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
        to, c, v = head[edge], np.repeat(best[front], n) + cost[edge], np.repeat(ids[front], n)
        limit = most if aim is None else min(most, best[aim])
        keep = (c if ahead is None else c + ahead[edge]) <= limit
        keep &= (c < best[to]) | ((c == best[to]) & (v < via[to]))
        to, c, v = to[keep], c[keep], v[keep]
        one = np.lexsort((v, c, to))
        to, c, v = to[one], c[one], v[one]
        lead = np.ones(len(to), dtype=bool)
        lead[1:] = to[1:] != to[:-1]
        to, c, v = to[lead], c[lead], v[lead]
        front = to[c < best[to]]
        best[to], via[to] = c, v
    found = np.isfinite(best)
    return ids[found], best[found], via[found]


def _laid_out(edges: DataFrame, blocks: int, hub: int) -> tuple[DataFrame, DataFrame]:
    """edges with their part, written in buckets of start and part, and the hubs (a, _hub): starts with over hub edges, whose edges have a part by their end; all others have 0."""
    spark, path = edges.sparkSession, shared_path(edges.sparkSession)
    # hubs of over an eighth of a block: fewer than eight for each block, one row of which is sent for 1.5 million edges
    hubs = cut(edges.groupBy("a").agg(F.count("*").alias("_n")).filter(F.col("_n") > hub).select("a", F.lit(True).alias("_hub")))
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).cast("int")).otherwise(F.lit(0))
    laid = edges.join(F.broadcast(hubs), "a", "left").withColumn("part", part).drop("_hub")
    name = f"tidemark_{path.rsplit('-', 1)[1]}"
    laid.repartition(blocks, "a", "part").write.bucketBy(blocks, "a", "part").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.laid_name = name
    return out, hubs


def cheapest(edges: DataFrame, sources: DataFrame, most: float = float("inf"), goal: int | None = None) -> DataFrame:
    """node, cost, via: least cost over directed edges (a, b, cost) from sources (node, cost), at most `most`.

    Runs until nothing improves, however many edges a path has. Up to BLOCK_EDGES edges are searched in one task. Beyond, a round
    takes each node that got better over its own edges, so there are as many rounds as a cheapest path has edges. Up to
    FRONT_NODES such nodes are sent to the edges where they lie; for the first front that is larger, edges are laid out by their start, a hub's in
    parts, and from then on fronts are dealt out to them. Of equal costs the smallest via is kept, a source has none. Costs must not be negative.

    With a goal only what may lie on a cheapest path to it is followed: nothing beyond the cost it has so far,
    and if edges have a column ahead, which never exceeds the cost from b to the goal, nothing whose sum with
    that is beyond. Costs of other nodes are then those found on the way, and may be missing.
    """
    with scratch() as held:
        more = ["ahead"] if "ahead" in edges.columns else []
        kept = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cost").cast("double").alias("cost"), *more))
        blocks = max(1, -(-kept.count() // BLOCK_EDGES))
        first = sources.groupBy(F.col("node").cast("long").alias("node")).agg(F.min(F.col("cost").cast("double")).alias("cost")).filter(F.col("cost") <= most)
        return held.keep(_in_one_task(kept, first, most, goal) if blocks == 1 else _by_fronts(kept, first, most, goal, blocks))


def _in_one_task(edges: DataFrame, first: DataFrame, most: float, goal: int | None) -> DataFrame:
    more = "ahead" in edges.columns

    def search(labels: pa.Table, own: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy()
        if labels.num_rows:
            node, cost, via = relax(get(own, "a"), get(own, "b"), get(own, "cost"), get(own, "ahead") if more else None, get(labels, "node"), get(labels, "cost"), np.full(labels.num_rows, NONE), most, goal)
        else:
            node, cost, via = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return pa.table([pa.array(node), pa.array(cost), pa.array(via, mask=via == NONE)], names=["node", "cost", "via"])

    block = F.lit(0).alias("block")
    return cut(first.select("*", block).groupBy("block").cogroup(edges.select("*", block).groupBy("block")).applyInArrow(search, _LABEL))


def _by_fronts(edges: DataFrame, first: DataFrame, most: float, goal: int | None, blocks: int) -> DataFrame:
    front = cut(first)
    best, aim, laid, ahead = [front.select("node", "cost", F.lit(None).cast("long").alias("via"))], most, None, "ahead" if "ahead" in edges.columns else "0"
    while n := front.count():
        start = front.select(F.col("node").alias("a"), F.col("cost").alias("_c"))
        if n <= FRONT_NODES:
            met = edges.join(F.broadcast(start), "a")
        else:
            laid = laid or _laid_out(edges, blocks, max(1, BLOCK_EDGES // 8))
            parts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.lit(0)))
            start = start.join(F.broadcast(laid[1]), "a", "left").select("a", "_c", F.explode(parts).alias("part"))
            met = laid[0].join(start.hint("shuffle_hash"), ["a", "part"])
        step = met.select(F.col("b").alias("node"), (F.col("_c") + F.col("cost")).alias("cost"), F.col("a").alias("via"), F.expr(f"_c + cost + {ahead}").alias("_sum")).filter(F.col("_sum") <= aim)
        step = cut(step.groupBy("node").agg(F.min(F.struct("cost", "via")).alias("s")).select("node", "s.*"))
        # of what was found before, only the nodes met again go through the join
        again = best if step.count() > FRONT_NODES else [t.join(F.broadcast(step.select("node")), "node", "left_semi") for t in best]
        old = _least(again).select("node", F.col("cost").alias("_c"), F.col("via").alias("_v"))
        better = cut(step.join(old, "node", "left").filter("_c is null or cost < _c or (cost = _c and via < _v)").withColumn("_same", F.coalesce(F.col("cost") == F.col("_c"), F.lit(False))))
        best.append(better.select("node", "cost", "via"))
        if goal is not None:
            aim = min(aim, better.filter(F.col("node") == goal).agg(F.coalesce(F.min("cost"), F.lit(float("inf")))).first()[0])
        front = better.filter("not _same").select("node", "cost")
        if len(best) > COMPACT:
            best = [cut(_least(best))]
    out = cut(_least(best))
    if laid:
        edges.sparkSession.sql(f"DROP TABLE {laid[0].laid_name}")
    return out


def hops(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """node, hops: fewest edges from any source, up to most."""
    found = cheapest(edges.select("a", "b", F.lit(1.0).alias("cost")), sources.select("node", F.lit(0.0).alias("cost")), float(most))
    return found.select("node", F.col("cost").cast("int").alias("hops"))


def detours(edges: DataFrame, start: int, goal: int, places: DataFrame) -> DataFrame:
    """node, detour of places (node): what calling there on the way from start to goal costs more than the way itself.

    Two searches serve all places: one from start, one from goal over the edges turned round.
    """
    spark = edges.sparkSession
    at = lambda node: spark.createDataFrame([(node, 0.0)], "node long, cost double")
    there = cheapest(edges, at(start)).select("node", F.col("cost").alias("_to"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost")
    home = cheapest(back, at(goal)).select("node", F.col("cost").alias("_from"))
    own = there.filter(F.col("node") == goal).select(F.col("_to").alias("_own"))
    return places.select("node").join(there, "node").join(home, "node").join(F.broadcast(own)).select("node", (F.col("_to") + F.col("_from") - F.col("_own")).alias("detour"))


def viterbi(df: DataFrame, by: list[str], order: list[str], emission: list[str], stay: float, gap: int) -> DataFrame:
    """df with state: the likeliest chain over columns of log-likelihoods, where leaving a state costs log(1 - stay).

    A chain breaks where time (order[0]) jumps by more than gap; of equally likely states the first is taken. Chains are walked
    forth and back in sorted partitions, one row's scores being all that is held, so a chain of any length fits in a task.
    """
    n = len(emission)
    change = [[math.log(stay) if i == j else math.log((1 - stay) / max(1, n - 1)) for j in range(n)] for i in range(n)]

    def forth(state, row):
        at, told = row
        if state[0] is None:
            return (told,), [(at, told, [-1] * n)]
        before = [max(range(n), key=lambda i: state[0][i] + change[i][j]) for j in range(n)]
        score = [state[0][i] + change[i][j] + told[j] for j, i in enumerate(before)]
        return (score,), [(at, score, before)]

    def back(state, row):
        at, score, before = row
        k = max(range(n), key=score.__getitem__) if state[0] is None else state[0]
        return (before[k],), [(at, k)]

    runs = numbered(islands(df, by, order, gap), [*by, "run"], order, "_n").withColumn("_key", F.concat_ws("#", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in by), "run"))
    with scratch() as held:
        runs = cut(runs)
        told = runs.select("_key", "_n", F.array(*(F.col(e).cast("double") for e in emission)).alias("told"))
        onward = cut(batch(told, "_key", ["_n", "told"], forth, (None,), "_key string, _n long, score array<double>, before array<int>", ["_n"]))
        taken = batch(onward.withColumn("_back", -F.col("_n")), "_key", ["_n", "score", "before"], back, (None,), "_key string, _n long, state long", ["_back"])
        return held.keep(cut(runs.join(taken, ["_key", "_n"]).select(*df.columns, "state")))


def split_ways(ways: DataFrame) -> DataFrame:
    """way, part, refs: ways (id, refs) split at nodes used twice or more and at their ends.

    Joined by sorting, as there are about as many nodes and ways on either side: none of them passes the driver.
    """
    v = ways.select("id", F.posexplode("refs").alias("pos", "node"), F.size("refs").alias("size"))
    uses = v.groupBy("node").agg(F.count("*").alias("uses"))
    v = v.join(uses.hint("merge"), "node").withColumn("stop", (F.col("uses") > 1) | (F.col("pos") == 0) | (F.col("pos") == F.col("size") - 1))
    stops = v.filter("stop").groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("stops"))
    parts = ways.join(stops.hint("merge"), "id").select("id", "refs", F.posexplode(F.expr("transform(slice(stops, 1, size(stops) - 1), (a, i) -> struct(a, stops[i + 1] as b))")).alias("part", "p"))
    return parts.select(F.col("id").alias("way"), "part", F.expr("slice(refs, p.a + 1, p.b - p.a + 1)").alias("refs"))


def exits(edges: DataFrame) -> DataFrame:
    """a, b, c: at the end b of each directed edge (a, b) every edge (b, c) on but the way back."""
    on = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return edges.select("a", "b").join(on, "b").filter("c <> a").select("a", "b", "c")


def exit_counts(edges: DataFrame) -> DataFrame:
    """a, b, n: how many ways on there are at the end b of each directed edge, but for the way back; no pair is made."""
    out = edges.groupBy("a").agg(F.count("*").alias("_out")).withColumnRenamed("a", "b")
    back = edges.groupBy(F.col("a").alias("b"), F.col("b").alias("a")).agg(F.count("*").alias("_back"))
    met = edges.select("a", "b").join(out, "b", "left").join(back, ["a", "b"], "left")
    return met.select("a", "b", (F.coalesce("_out", F.lit(0)) - F.coalesce("_back", F.lit(0))).alias("n"))


def way_to(best: DataFrame, goal: int) -> DataFrame:
    """place, a, b: the edges of the path to goal over the via of cheapest(), counted back from it; empty if it was not reached.

    Up to WALK_NODES nodes one task walks back. Beyond, jumps over 1, 2, 4, ... nodes are joined from one another
    until one jump leads past the start, and the nodes of the path are then found from the longest jump down, so
    a path of n edges takes about 2 log n joins.
    """
    with scratch() as held:
        best = cut(best.filter("via is not null").select("node", "via"))
        if best.count() <= WALK_NODES:

            def walk(batches):
                before = {}
                for t in batches:
                    before |= dict(zip(t.column("node").to_pylist(), t.column("via").to_pylist()))
                path, at = [], goal
                while at in before:
                    path.append((len(path), before[at], at))
                    at = before[at]
                cols = list(zip(*path)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["place", "a", "b"])

            return held.keep(cut(best.coalesce(1).mapInArrow(walk, "place long, a long, b long")))
        jumps = [best.select("node", F.col("via").alias("to"))]
        while not jumps[-1].filter(F.col("node") == goal).isEmpty():
            j = jumps[-1]
            jumps.append(cut(j.join(j.select(F.col("node").alias("to"), F.col("to").alias("_on")), "to").select("node", F.col("_on").alias("to"))))
        spark = best.sparkSession
        path = spark.createDataFrame([(0, goal)], "place long, node long")
        for k in reversed(range(len(jumps))):
            path = cut(path.unionByName(path.join(jumps[k], "node").select((F.col("place") + (1 << k)).alias("place"), F.col("to").alias("node"))))
        return held.keep(cut(path.join(best, "node").select("place", F.col("via").alias("a"), F.col("node").alias("b"))))


def alternatives(edges: DataFrame, start: int, goal: int, count: int, penalty: float, slower: float = float("inf"), shared: float = 1.0) -> DataFrame:
    """path, place, a, b, cost: the cheapest path, then others found after each path's edges cost penalty times as much.

    A path is kept if it costs at most slower times the first and shares less than this part of its cost with
    the paths kept (with 1.0: if it is not wholly made of their edges). Costs are those of the plain edges.
    """
    with scratch() as held:
        spark, kept = edges.sparkSession, None
        edges = cut(edges.groupBy("a", "b").agg(F.min("cost").alias("cost")))
        source, now, best = spark.createDataFrame([(start, 0.0)], "node long, cost double"), edges, None
        for k in range(count):
            way = way_to(cheapest(now, source, goal=goal), goal)
            found = cut(way.join(edges, ["a", "b"]).withColumn("path", F.lit(k)))
            old = found.select("a", "b", F.lit(False).alias("_old")).limit(0) if kept is None else kept.select("a", "b", F.lit(True).alias("_old")).distinct()
            got = found.join(old, ["a", "b"], "left").agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("_old"), F.col("cost")).otherwise(0.0)).alias("old")).first()
            if got["cost"] is None:
                break
            best = got["cost"] if best is None else best
            if kept is None or (got["cost"] <= slower * best and got["old"] < shared * got["cost"]):
                kept = found if kept is None else kept.unionByName(found)
            if k + 1 < count:
                now = cut(now.join(way.select("a", "b", F.lit(True).alias("_used")), ["a", "b"], "left").withColumn("cost", F.when(F.col("_used"), F.col("cost") * penalty).otherwise(F.col("cost"))).drop("_used"))
        return held.keep(cut((found if kept is None else kept).select("path", "place", "a", "b", "cost")))


def farthest(edges: DataFrame, start: int) -> DataFrame:
    """node, cost: the node that is costliest to reach from start, the least of equals."""
    reached = cheapest(edges, edges.sparkSession.createDataFrame([(start, 0.0)], "node long, cost double"))
    return reached.orderBy(F.desc("cost"), "node").limit(1).select("node", "cost")


def longest_path(edges: DataFrame, start: int) -> DataFrame:
    """a, b, cost: ends and length of the longest cheapest path of the tree that holds start, by two sweeps."""
    a = farthest(edges, start).first()["node"]
    return farthest(edges, a).select(F.lit(a).cast("long").alias("a"), F.col("node").alias("b"), "cost")


def bridges(edges: DataFrame, places: DataFrame, reach: float, first: float) -> DataFrame:
    """a, b, distance: straight hops of at most reach that join the pieces of a network into as few as they can, shortest first.

    edges: a, b; places: node, x, y. In a round every piece takes its shortest hop to another one (of equal ones that between
    the smallest nodes), so pieces at least halve and no hop is taken twice. A piece looks for foreign places in cells as wide as
    `first`, narrower where places are dense, and only if there is none in cells twice as wide, up to reach. Places look around only
    where pieces meet, so the pairs made do not grow with a piece's size.
    """
    with scratch() as held:
        of = components(edges).withColumnRenamed("component", "piece")
        at = cut(places.select("node", "x", "y").join(of, "node", "left").withColumn("piece", F.coalesce("piece", "node")))
        found, start = [], _narrow(at, min(first, reach))
        while True:
            largest = at.groupBy("piece").count().orderBy(F.desc("count"), "piece").first()
            if largest is None:
                break
            left, hops_, width = cut(at.select("piece").distinct()), [], start
            while True:
                hops_.append(cut(_hops_within(at, left, largest["piece"], width)))
                left = cut(left.join(hops_[-1], "piece", "left_anti"))
                if width >= reach or left.isEmpty():
                    break
                width = min(2 * width, reach)
            taken = cut(_all(hops_))
            if taken.isEmpty():
                break
            found.append(taken.select("h.a", "h.b", F.col("h.d").alias("distance")).distinct())
            joined = components(taken.select(F.col("piece").alias("a"), F.col("h.other").alias("b")))
            at = cut(at.join(joined.select(F.col("node").alias("piece"), "component"), "piece", "left").select("node", "x", "y", F.coalesce("component", "piece").alias("piece")))
        if not found:
            return edges.select(F.col("a"), F.col("b"), F.lit(0.0).alias("distance")).limit(0)
        return held.keep(cut(_all(found)))


#: Places that share a cell with one, on the average, where bridges begin to look.
CELL_PLACES = 8


def _narrow(at: DataFrame, width: float) -> float:
    """width, halved as often as it takes for a place to find about CELL_PLACES in its cell if they lie evenly."""
    cells = at.groupBy(F.floor(F.col("x") / width), F.floor(F.col("y") / width)).agg(F.count("*").cast("double").alias("n"))
    full = cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return width / 2 ** max(0, math.ceil(math.log2(max(1.0, full / CELL_PLACES)) / 2))


def _hops_within(at: DataFrame, left: DataFrame, largest: int, width: float) -> DataFrame:
    """piece, h (d, a, b, other): the shortest hop of at most width of each piece of `left` that has one.

    A hop is met from its end outside the largest piece and counts for both its pieces, so no place of the largest looks around;
    nor does any in whose nine cells there is one piece only, or none of `left`.
    """
    near = [F.struct((F.col("i") + k).alias("i"), (F.col("j") + m).alias("j")) for k in (-1, 0, 1) for m in (-1, 0, 1)]
    celled = at.join(left.withColumn("open", F.lit(True)), "piece", "left").select("node", "x", "y", "piece", F.coalesce("open", F.lit(False)).alias("open"), F.floor(F.col("x") / width).cast("long").alias("i"), F.floor(F.col("y") / width).cast("long").alias("j"))
    cells = celled.groupBy("i", "j").agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.max("open").alias("open"))
    mixed = cells.select("low", "high", "open", F.explode(F.array(*near)).alias("c")).groupBy("c.i", "c.j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("open").alias("open")).filter("low <> high and open").select("i", "j")
    mine = celled.filter(F.col("piece") != largest).join(mixed, ["i", "j"], "left_semi")
    asked = mine.select("i", "j").distinct()
    other = celled.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.col("piece").alias("other"), F.col("open").alias("open_b"), F.explode(F.array(*near)).alias("c")).select("*", F.col("c.i").alias("i"), F.col("c.j").alias("j")).drop("c")
    met = mine.join(other.join(asked, ["i", "j"], "left_semi"), ["i", "j"]).filter("piece <> other and (open or open_b)")
    met = met.withColumn("d", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by_"))).filter(F.col("d") <= width)
    # either end's piece takes the hop; the least of a piece is kept by task before pieces are compared
    ends = met.select("node", "b", "d", F.explode(F.array(F.struct("piece", "other", "open"), F.struct(F.col("other").alias("piece"), F.col("piece").alias("other"), F.col("open_b").alias("open")))).alias("e")).filter("e.open")
    return ends.groupBy("e.piece").agg(F.min(F.struct("d", F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), F.col("e.other").alias("other"))).alias("h"))


def main_line(edges: DataFrame, places: DataFrame, reach: float, first: float) -> DataFrame:
    """place, a, b: the longest of the shortest paths through a network (edges a, b) whose pieces are bridged by hops up to reach.

    Lengths are straight ones between places (node, x, y). The piece with most places is taken; its longest path is found by two sweeps.
    """
    with scratch() as held:
        hops_ = bridges(edges, places, reach, first)
        p = places.select("node", "x", "y")
        both = edges.select("a", "b").unionByName(hops_.select("a", "b"))
        far = both.join(p.select(F.col("node").alias("a"), "x", "y"), "a").join(p.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_")), "b")
        lengths = cut(both_ways(far.select("a", "b", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by_")).alias("cost")), "cost"))
        start = components(both).groupBy("component").count().orderBy(F.desc("count"), "component").first()
        if start is None:
            return held.keep(cut(both.select(F.lit(0).cast("long").alias("place"), "a", "b").limit(0)))
        spark = edges.sparkSession
        one = farthest(lengths, start["component"]).first()["node"]
        reached = cheapest(lengths, spark.createDataFrame([(one, 0.0)], "node long, cost double"))
        end = reached.orderBy(F.desc("cost"), "node").first()["node"]
        return held.keep(cut(way_to(reached, end)))
