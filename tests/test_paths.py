"""Searches of any length, over blocks of any size, against Dijkstra and Bellman-Ford in plain Python."""

import heapq
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, roads, tables

START = "node long, cost double"


def dijkstra(edges, sources):
    on, best, heap = {}, dict(sources), [(c, n) for n, c in sources.items()]
    for a, b, c in edges:
        on.setdefault(a, []).append((b, c))
    heapq.heapify(heap)
    while heap:
        c, n = heapq.heappop(heap)
        if c > best[n]:
            continue
        for b, w in on.get(n, ()):
            if c + w < best.get(b, float("inf")):
                best[b] = c + w
                heapq.heappush(heap, (c + w, b))
    return best


def some_edges(seed, n=60, m=200):
    rng = random.Random(seed)
    # node 7 is a hub with an edge to all
    return [(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 9))) for _ in range(m)] + [(7, k, 3.0) for k in range(n)] + [(0, 7, 20.0)]


@pytest.mark.parametrize("block", [25, 70, 10_000])
def test_costs_and_predecessors_whatever_the_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)
    monkeypatch.setattr(graph, "COMPACT", 2)
    edges = some_edges(block)
    e = spark.createDataFrame(edges, "a long, b long, cost double")
    want = dijkstra(edges, {0: 0.0, 3: 1.0})
    got = {r["node"]: r for r in graph.cheapest(e, spark.createDataFrame([(0, 0.0), (0, 9.0), (3, 1.0)], START)).collect()}
    assert {n: r["cost"] for n, r in got.items()} == want
    for n, r in got.items():
        ways = [a for a, b, c in edges if b == n and a in want and want[a] + c == want[n]]
        assert r["via"] == (None if n == 0 or n == 3 and want[3] == 1.0 else min(ways))
    near = graph.cheapest(e, spark.createDataFrame([(0, 0.0)], START), most=6.0).collect()
    assert {r["node"]: r["cost"] for r in near} == {n: c for n, c in dijkstra(edges, {0: 0.0}).items() if c <= 6}
    # what never exceeds the rest of the way
    rest = dijkstra([(b, a, c) for a, b, c in edges], {41: 0.0})
    ahead = spark.createDataFrame([(n, c * 0.9) for n, c in rest.items()], "b long, ahead double")
    aimed = graph.cheapest(e.join(ahead, "b"), spark.createDataFrame([(0, 0.0)], START), goal=41)
    assert aimed.filter("node = 41").first()["cost"] == dijkstra(edges, {0: 0.0})[41] and aimed.count() <= len(want)


def test_no_edges_no_sources(spark):
    e, none = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, cost double"), spark.createDataFrame([], "a long, b long, cost double")
    assert graph.cheapest(e, spark.createDataFrame([], START)).collect() == []
    assert [tuple(r) for r in graph.cheapest(none, spark.createDataFrame([(4, 2.0)], START)).collect()] == [(4, 2.0, None)]
    assert graph.way_to(graph.cheapest(e, spark.createDataFrame([(1, 0.0)], START)), 9).collect() == []


@pytest.mark.parametrize("walk", [1, 1_000_000])
def test_a_path_of_five_thousand_edges(spark, monkeypatch, walk):
    monkeypatch.setattr(graph, "WALK_NODES", walk)
    line = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.5).alias("cost"))
    best = graph.cheapest(line, spark.createDataFrame([(0, 0.0)], START))
    assert best.count() == 5001 and best.filter("node = 5000").first()["cost"] == 2500.0
    way = sorted(tuple(r) for r in graph.way_to(best, 5000).collect())
    assert way == [(k, 4999 - k, 5000 - k) for k in range(5000)]


def test_searches_leave_their_result_only(spark):
    e = spark.createDataFrame(some_edges(1), "a long, b long, cost double")
    graph.cheapest(e, spark.createDataFrame([(0, 0.0)], START))
    folder = os.path.dirname(tables.shared_path(spark)).removeprefix("file:")
    before = set(os.listdir(folder))
    out = graph.cheapest(e, spark.createDataFrame([(0, 0.0)], START))
    graph.way_to(out, 5)
    assert len(set(os.listdir(folder)) - before) == 2


def test_small_roads_are_left_out_far_from_both_ends(spark):
    # a main road around (class 2) and a quick lane (class 8) across, both from 0 to 3; x runs along
    edges = [(10, 0, 1, 9.0, 2, 100.0), (11, 1, 2, 9.0, 2, 5000.0), (12, 2, 3, 9.0, 2, 9900.0), (20, 1, 4, 1.0, 8, 5000.0), (21, 4, 3, 1.0, 8, 9900.0), (13, 3, 5, 5.0, 8, 10000.0)]
    e = spark.createDataFrame(edges, "edge long, a long, b long, seconds double, cls int, x double").withColumn("y", F.lit(0.0))
    turns = spark.createDataFrame([(x[0], y[0], 0.0) for x in edges for y in edges if x[2] == y[1]], "from_edge long, to_edge long, seconds double")
    starts, goals = spark.createDataFrame([(10, 9.0)], "edge long, cost double"), spark.createDataFrame([(13,)], "edge long")

    def drive(levels, goal=goals):
        return [(r["edge"], r["cost"]) for r in roads.route_to(e, turns, starts, goal, (0.0, 0.0), (10000.0, 0.0), 20000.0, levels).orderBy("place").collect()]

    quick, main = [(10, 9.0), (20, 10.0), (21, 11.0), (13, 16.0)], [(10, 9.0), (11, 18.0), (12, 27.0), (13, 32.0)]
    assert drive(()) == quick and drive(((1000.0, 3),)) == main
    # a goal in the small roads' middle is not near an end here, so the search goes again with all roads
    assert drive(((1000.0, 3),), spark.createDataFrame([(20,)], "edge long")) == quick[:2]
    assert drive((), spark.createDataFrame([(99,)], "edge long")) == []
