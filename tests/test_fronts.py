"""Searches over more edges than a task takes: fronts go to the edges while they are small, to edges laid out by their start beyond."""

import pytest
from pyspark.sql import functions as F
from test_paths import START, dijkstra, some_edges

from tidemark.operators import graph


@pytest.mark.parametrize("front", [2, 1000])
def test_small_fronts_leave_the_edges_where_they_lie(spark, monkeypatch, front):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 25)
    calls, lay = [], graph._laid_out
    monkeypatch.setattr(graph, "_laid_out", lambda *a: calls.append(a) or lay(*a))
    monkeypatch.setattr(graph, "FRONT_NODES", front, raising=False)
    edges = some_edges(3)
    e = spark.createDataFrame(edges, "a long, b long, cost double")
    want = dijkstra(edges, {0: 0.0})
    got = {r["node"]: r for r in graph.cheapest(e, spark.createDataFrame([(0, 0.0)], START)).collect()}
    assert {n: r["cost"] for n, r in got.items()} == want
    for n, r in got.items():
        assert r["via"] == (None if n == 0 else min(a for a, b, c in edges if b == n and a in want and want[a] + c == want[n]))
    assert len(calls) == (1 if front == 2 else 0)


def test_a_far_piece_is_not_laid_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_EDGES", 100)
    monkeypatch.setattr(graph, "_laid_out", lambda *a: pytest.fail("laid out"))
    far = spark.range(1000, 2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("cost"))
    near = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "a long, b long, cost double")
    got = graph.cheapest(far.unionByName(near), spark.createDataFrame([(0, 0.0)], START))
    assert {tuple(r) for r in got.collect()} == {(0, 0.0, None), (1, 1.0, 0), (2, 2.0, 1)}
