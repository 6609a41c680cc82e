"""The nearest of dense places by widening cells is that of all pairs."""

import random

from pyspark.sql import functions as F

from tidemark.operators import spatial


def _dist(p, q):
    return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5


def test_nearest_of_dense_places(spark):
    rng = random.Random(6)
    houses = [(i, i % 2, rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for i in range(150)] + [(900, 0, 0.5, 0.5), (901, 0, 0.5, 0.5)]
    points = [(i, t, rng.gauss(0, 0.05), rng.gauss(0, 0.05)) for i in range(80) for t in ((0, 1) if i % 3 else (1,))] + [(500, 0, 0.55, 0.5), (501, 1, 0.55, 0.5)]
    points = [(k, t, *next((x, y) for j, _, x, y in points if j == k)) for k, t, _, _ in points]
    want = {}
    for k, t, x, y in points:
        for h, u, hx, hy in houses:
            if t == u and h != k and _dist((x, y), (hx, hy)) <= 0.1:
                want[k] = min(want.get(k, (9.0, 0)), (round(_dist((x, y), (hx, hy)), 9), h))
    p, h = spark.createDataFrame(points, "id long, town int, x double, y double"), spark.createDataFrame(houses, "house long, town int, px double, py double")
    got = spatial.nearest_widening(p, h, ["town"], "id", "x", "y", 0.1, "house", F.col("id") != F.col("house")).collect()
    assert {r["id"]: (r["distance"], r["house"]) for r in got} == want and len(got) == len(want)
    assert 500 in want and 501 not in want
