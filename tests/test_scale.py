"""Operators that cut their work into many tasks give what one task would, whatever the cut."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text
from tidemark.functions.hours import week_ranges
from tidemark.operators import aggregate, graph, roads, spatial, tables
from tidemark.operators import timeseries as ts
from tidemark.sources import ulog


@pytest.mark.parametrize("sketch", [8, 20_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, monkeypatch, sketch):
    monkeypatch.setattr(aggregate, "SKETCH", sketch)
    monkeypatch.setattr(aggregate, "BROADCAST_GROUPS", 0 if sketch == 8 else 100)
    rng = random.Random(sketch)
    rows = [(k, rng.choice([float(rng.randrange(7)), rng.uniform(-5, 50)])) for k in range(4) for _ in range((1, 2, 37, 400)[k])] + [(9, None)]
    wanted = {"low": ("floor", 0.0), "mid": ("floor", 0.5), "half": ("linear", 0.5), "most": ("linear", 0.9), "top": ("floor", 1.0)}
    got = {r["k"]: r for r in aggregate.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", wanted).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k in got:
        v = sorted(x for i, x in rows if i == k)
        for name, (kind, q) in wanted.items():
            at = q * (len(v) - 1)
            want = v[min(len(v) - 1, math.floor(q * len(v)))] if kind == "floor" else v[math.floor(at)] + (at - math.floor(at)) * (v[min(len(v) - 1, math.floor(at) + 1)] - v[math.floor(at)])
            assert got[k][name] == pytest.approx(want), (k, name)


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_largest_gap(spark, parts):
    rng = random.Random(parts)
    rows = [(k, float(rng.randrange(200))) for k in range(3) for _ in range(25)] + [(7, 4.0), (8, 1.0), (8, 1.0)]
    got = {r["k"]: (r["low"], r["high"]) for r in aggregate.largest_gap(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", parts).collect()}
    for k in range(3):
        v = sorted(x for i, x in rows if i == k)
        a, b = min(zip(v, v[1:]), key=lambda p: (p[0] - p[1], p[0]))
        assert got[k] == (a, b)
    assert 7 not in got and got[8] == (1.0, 1.0)


def _rows(rng, n=200):
    return [(i % 3, rng.randrange(400), i, rng.uniform(0, 9)) for i in range(n)]


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_windows_over_buckets(spark, width):
    df = spark.createDataFrame(_rows(random.Random(width)), "k int, t long, id long, v double")
    w = Window.partitionBy("k").orderBy("t")
    one = df.select("id", F.max("v").over(w.rangeBetween(-30, 5)).alias("top"), F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("place"), F.coalesce(F.last(F.when(F.col("v") > 6, True).when(F.col("v") < 3, False), ignorenulls=True).over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)).alias("held"))
    got = ts.over_frame(df, ["k"], "t", 30, {"top": lambda w: F.max("v").over(w)}, 5, width)
    got = ts.latched(ts.numbered(got, ["k"], ["t", "id"], bucket=width), ["k"], ["t", "id"], F.col("v") > 6, F.col("v") < 3, bucket=width)
    assert sorted(map(tuple, got.select("id", "top", "place", "held").collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("bucket", [5, 60, 10_000])
def test_both_sides_of_a_time(spark, bucket):
    rng = random.Random(bucket)
    left, right = [(i % 3, rng.randrange(300), i) for i in range(80)], [(i % 2, rng.randrange(300), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k int, t long, id long"), spark.createDataFrame(right, "k int, t long, r long")
    got = {r["id"]: (r["back"] and r["back"]["r"], r["ahead"] and r["ahead"]["r"]) for r in ts.around(a, b, ["k"], "t", ["r"], "r", bucket=bucket).collect()}
    for k, t, i in left:
        back = max(((u, r) for j, u, r in right if j == k and u <= t), default=(0, None))[1]
        ahead = max(((-u, r) for j, u, r in right if j == k and u >= t), default=(0, None))[1]
        assert got[i] == (back, ahead)


def test_places_in_a_whole_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50)) for i in range(120)]
    got = tables.ordinal(spark.createDataFrame(rows, "id int, v int"), F.floor(F.col("v") / 8), ["v", "id"], "place").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] and sorted(r["place"] for r in got) == list(range(1, 121))


@pytest.mark.parametrize("compact", [1, 8])
def test_searches_whatever_is_compacted(spark, monkeypatch, compact):
    monkeypatch.setattr(graph, "COMPACT", compact)
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 9))) for _ in range(80)]
    best, steps = {0: 0.0}, {0: 0}
    for _ in range(30):
        for a, b, c in edges:
            if a in best and best[a] + c < best.get(b, 1e9):
                best[b] = best[a] + c
            if a in steps and steps[a] + 1 < steps.get(b, 99):
                steps[b] = steps[a] + 1
    e = spark.createDataFrame(edges, "a long, b long, cost double")
    assert {r["node"]: r["cost"] for r in graph.cheapest(e, spark.createDataFrame([(0, 0.0)], "node long, cost double")).collect()} == best
    assert {r["node"]: r["hops"] for r in graph.hops(e, spark.createDataFrame([(0,)], "node long"), 30).collect()} == steps


def test_turning_back_only_where_nothing_else_is(spark):
    e = spark.createDataFrame([(1, 10, 20, 0.0, 2), (2, 20, 10, 3.0, 1), (3, 20, 30, 0.0, 4), (4, 30, 20, 3.0, 3)], "edge long, a long, b long, h double, twin long").withColumns({"heading_in": F.col("h"), "heading_out": F.col("h")})
    got = {(r["from_edge"], r["to_edge"]) for r in roads.passages(e).collect()}
    assert got == {(1, 3), (3, 4), (4, 2), (2, 1)}
    none = spark.createDataFrame([(1, 3, 20, 1)], "from_edge long, to_edge long, via long, kind int")
    assert (1, 2) in {(r["from_edge"], r["to_edge"]) for r in roads.passages(e, none).collect()}


def test_points_in_outlines(spark):
    rings = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)])], "area string, i int, rx double, ry double")
    pts = [(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 0.5, 3.0), (4, 3.5, 3.0), (5, -1.0, 1.0), (6, 5.0, 1.0)]
    got = spatial.within_any(spark.createDataFrame(pts, "id int, x double, y double"), rings.select("area").distinct(), rings, "id", "x", "y", 0.5)
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]


def test_folding_other_alphabets(spark):
    cases = {"Хрещатик": ["khreshchatyk"], "Київ": ["kyiv"], "під’їзд": ["pidizd"], "Щастя Юності": ["shchastia", "iunosti"], "Škoda Ölüdeniz": ["skoda", "oludeniz"], "ye Yury": ["ie", "iury"], "йо": ["io"], "字": []}
    rows = spark.createDataFrame(list(cases), "string").select("value", text.tokens(F.col("value")).alias("t")).collect()
    assert {r["value"]: r["t"] for r in rows} == cases


def test_hours_grammar():
    assert week_ranges("Mo-Fr 08:00-12:00, Sa 09:00-10:00")[-1] == (7740, 7800)
    assert week_ranges("mo 10:00-10:00") == [(600, 2040)] and week_ranges("Mo 09:00-17:00+") == [(540, 1020)]
    assert week_ranges("Mo-PH 09:00-10:00") is None and week_ranges("PH,Mo 08:00-09:00") == [(480, 540)] and week_ranges("Mo-Su") == [(0, 10080)]


def test_logs_with_nested_types_and_wrong_files(spark):
    import struct

    body = ulog.encode(0, {}, {"point": "float x;float y;", "track": "uint64_t timestamp;point[2] p;int64_t big;"}, [])
    row = struct.pack("<HQffffq", 1, 5, 1.0, 2.0, 3.0, 4.0, (1 << 60) + 1)
    log = body + struct.pack("<HB", len(row), ord("D")) + row
    got = ulog.decode(spark.createDataFrame([("a", log), ("b", b"no log")], "path string, content binary")).collect()
    data = next(r for r in got if r["kind"] == "data")
    assert data["t_us"] == 5 and data["values"]["p.1.y"] == [4.0] and str((1 << 60) + 1) in data["text"]
    assert [r["kind"] for r in got if r["path"] == "b"] == ["invalid"]
