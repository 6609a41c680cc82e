"""The nearest of boxes on top of one another, however wide the cells are that are looked into first."""

import random

import pytest

from tidemark.operators import spatial


@pytest.mark.parametrize("cells", [0, 128])
def test_nearest_box_of_many(spark, monkeypatch, cells):
    monkeypatch.setattr(spatial, "BOX_CELLS", cells)
    rng = random.Random(8)
    boxes = [(i, x := rng.gauss(0, 0.03), y := rng.gauss(0, 0.03), x + 0.03, y + 0.01) for i in range(150)] + [(900, 0.5, 0.5, 0.5, 0.5), (901, 0.5, 0.5, 0.5, 0.5)]
    points = [(i, rng.gauss(0, 0.07), rng.gauss(0, 0.07)) for i in range(150)] + [(500, 0.5, 0.54), (501, 0.9, 0.9), (502, 0.5, 0.5)]
    want = {}
    for k, x, y in points:
        near = [(-max(0.0, (max(x0 - x, 0.0, x - x1) ** 2 + max(y0 - y, 0.0, y - y1) ** 2) ** 0.5), b) for b, x0, y0, x1, y1 in boxes]
        best = max(near)
        if -best[0] <= 0.05:
            want[k] = (best[1], pytest.approx(-best[0], abs=1e-12))
    p, b = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double")
    got = spatial.nearest_box(p, b, "id", "x", "y", "box", 0.05).collect()
    assert {r["id"]: (r["box"], r["distance"]) for r in got} == want and len(got) == len(want)
    assert want[500][0] == want[502][0] == 901 and 501 not in want
