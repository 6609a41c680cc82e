"""Tables that grow with the map are not sent through the driver, however few bytes their files have."""

from tidemark.operators import graph, roads
from tidemark.plans import roads as plans

DIR = "/root/testdata/sf0.001"


def test_ways_and_nodes_are_joined_by_sorting(spark):
    ways = plans.ways(spark, DIR)
    parts = graph.split_ways(spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4])], "id long, refs array<long>"))
    edges = roads.edge_lengths(parts, plans.nodes(spark, DIR), plans.RADIUS)
    for df in (ways, parts, edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["way"], r["part"], r["a"], r["b"]) for r in edges.collect()} == {(1, 0, 1, 3), (2, 0, 3, 4)}
