"""Bridges give what all pairs would, and make no pairs inside a piece."""

import random

from tidemark.operators import graph


def _dist(p, q):
    return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5


def _bridged(places, pieces, reach):
    """Kruskal over all pairs."""
    root = dict(pieces)
    out = set()
    for d, a, b in sorted((_dist(places[a], places[b]), a, b) for a in places for b in places if a < b):
        if d <= reach and root[a] != root[b]:
            out.add((a, b))
            old, new = root[b], root[a]
            root = {k: new if v == old else v for k, v in root.items()}
    return out


def test_bridges_of_dense_and_lonely_places(spark):
    rng = random.Random(5)
    spots = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for _ in range(60)] + [(0.2, 0.0), (0.201, 0.0), (0.9, 0.9)]
    places = dict(enumerate(spots))
    rows = [(i, i + 1) for i in range(59) if i % 3 < 2]
    pieces = {i: i // 3 * 3 if i < 60 else i for i in places}
    e, p = spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(i, *xy) for i, xy in places.items()], "node long, x double, y double")
    got = {(r["a"], r["b"]) for r in graph.bridges(e, p, 0.3, 0.1).collect()}
    assert got == _bridged(places, pieces, 0.3)


def test_one_piece_makes_no_pairs(spark):
    at = spark.createDataFrame([(i, 0.001 * (i % 7), 0.001 * (i % 5), 1) for i in range(50)], "node long, x double, y double, piece long")
    assert graph._narrow(at, 0.08) < 0.08
    assert graph._hops_within(at, at.select("piece").distinct(), 1, 0.08).isEmpty()
