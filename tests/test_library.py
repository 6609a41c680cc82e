"""Operators without an oracle in SQL, against plain Python; odd inputs; batch against stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import conv, geo, text, times
from tidemark.functions.hours import week_ranges
from tidemark.operators import aggregate, graph, search, spatial, stateful, tables, tracks
from tidemark.operators import timeseries as ts
from tidemark.sources import html, ulog
from tidemark.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_conventions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    got = df.agg(conv.floor_quantile(F.col("x"), 0.5).alias("a"), conv.floor_quantile(F.col("x"), 1.0).alias("b"), conv.linear_quantile(F.col("x"), 0.5).alias("c")).first()
    assert tuple(got) == (3.0, 4.0, 2.5)
    assert one(spark, conv.floor_div(F.lit(-7), 2)) == -4
    assert one(spark, conv.wrap_pi(F.lit(-math.pi))) == pytest.approx(math.pi)
    assert one(spark, conv.wrap_pi_low(F.lit(math.pi))) == pytest.approx(-math.pi)
    assert one(spark, conv.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, conv.half_even(F.lit(2.5))) == 2 and one(spark, conv.half_up(F.lit(2.5))) == 3
    empty = spark.createDataFrame([], "t long").agg(conv.rate_hz(F.col("t")).alias("r")).first()["r"]
    assert empty == 0


def test_text_helpers(spark):
    assert one(spark, text.tokens(F.lit("Crème-Brûlée 12, Yury"))) == ["creme", "brulee", "12", "iury"]
    assert one(spark, text.speed_limit(F.lit("30 mph"))) == 48 and one(spark, text.speed_limit(F.lit("walk"))) is None
    assert tuple(one(spark, text.coordinates(F.lit("120.5, 48.1")))) == (48.1, 120.5)
    assert tuple(one(spark, text.coordinates(F.lit("48.5 S 11.5 W")))) == (-48.5, -11.5)
    assert one(spark, text.coordinates(F.lit("no place"))) is None
    assert one(spark, text.road_km(F.lit("113+5"))) == 113.5
    assert one(spark, text.bit_field(F.array(F.lit(255)), 0, 16)) is None
    assert [search.osa(*p, 3) for p in (("ca", "ac"), ("ca", "abc"), ("word", "word"), ("", "ab"))] == [1, 3, 0, 2]


def test_times(spark):
    week = F.array(F.struct(F.lit(540).alias("start"), F.lit(1020).alias("end")))
    assert one(spark, times.open_at(week, F.lit(540))) and not one(spark, times.open_at(week, F.lit(1020)))
    assert one(spark, times.next_change(week, F.lit(1020))) == 10080 - 480
    assert one(spark, times.week_minute(F.lit("2024-01-01 00:05:00").cast("timestamp"))) == 5


def test_geo(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * geo.EARTH)
    assert one(spark, geo.side_of(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(50.0), F.lit(20.0))) == "left"
    d = one(spark, F.struct(*geo.segment_distance(*(F.lit(float(v)) for v in (5, 3, 0, 0, 0, 0)))))
    assert d[0] == pytest.approx(math.hypot(5, 3)) and d[1] == 0


def test_timeseries_over_buckets(spark):
    """Small buckets force every carry; results equal those of one bucket."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(400), i, float(rng.randrange(9))) for i in range(300)] + [("c", 5, 300, 1.0), (None, 5, 301, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v double")
    small, large = (sorted(map(str, ts.islands(df, ["k"], ["t", "id"], 3, bucket=b).select("id", "run").collect())) for b in (7, 1 << 40))
    assert small == large
    left, right = df.filter("id % 3 = 0"), df.filter("id % 3 > 0")
    for forward in (False, True):
        got = {r["id"]: r["match"] and (r["match"]["t"], r["match"]["id"]) for r in ts.asof(left, right, ["k"], "t", ["id"], forward=forward, tie="id", bucket=11).collect()}
        for k, t, i, _ in rows:
            if i % 3 == 0 and k is not None:
                fit = [(u, j) for q, u, j, _ in rows if j % 3 and q == k and (u >= t if forward else u <= t)]
                want = (min(u for u, _ in fit) if forward else max(fit)[0]) if fit else None
                assert (got[i] and got[i][0]) == want
    assert ts.islands(df.limit(0), ["k"], ["t", "id"], 3).count() == 0


def test_machines_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 3, i, i * 10 + rng.randrange(5), float(rng.randrange(120))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long, t long, v double")
    schema = "k long, id long, warning boolean"
    args = ("k", ["id", "v"], stateful.hysteresis(80.0, 40.0), (False,), schema)
    want = sorted(map(tuple, stateful.batch(df, *args, ["t", "id"]).collect()))
    for part in range(3):
        df.filter((F.col("t") >= part * 1000) & (F.col("t") < part * 1000 + 1000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = stateful.stream(src, *args, "warning boolean", ["t", "id"])
    q = out.writeStream.format("memory").queryName("machines").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("machines").collect())) == want

    kept = stateful.batch(df, "k", ["id", "t"], stateful.thin(0.95e6 / 95), (None,), "k long, id long", ["t"]).collect()
    for k in range(3):
        times_ = [t for q_, i, t, _ in rows if (k, i) in {tuple(r) for r in kept} and q_ == k]
        assert all(b - a >= 95 for a, b in zip(times_, times_[1:]))

    def run(step, state, items):
        out = []
        for x in items:
            state, got = step(state, x)
            out += got
        return out

    assert run(stateful.engine(), (None, None, 0, None, 0), [(1, 900.0), (2, 910.0), (3, 100.0), (4, 90.0), (5, 800.0), (6, 810.0)]) == [(2, "running"), (4, "off"), (6, "running")]
    assert run(stateful.trips(100), (None, None, 0, None), [(1, 0, 1.0), (2, 10, 2.0), (3, 50, 0.0), (4, 200, 0.0)]) == [(0, 50, "parked_timeout")]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0), (9, 9, 1.0)], "a long, b long, cost double")
    assert {tuple(r) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    start = spark.createDataFrame([(1, 0.0)], "node long, cost double")
    assert {r["node"]: r["cost"] for r in graph.cheapest(edges, start).collect()} == {1: 0.0, 2: 1.0, 3: 2.0}
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9, 3, 8])], "id long, refs array<long>")
    assert {(r["way"], tuple(r["refs"])) for r in graph.split_ways(ways).collect()} == {(1, (1, 2, 3)), (1, (3, 4)), (2, (9, 3)), (2, (3, 8))}
    assert graph.components(edges.limit(0)).count() == 0


def test_places(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], "l int, i int, x double, y double")
    p = spark.createDataFrame([(1, 4.0, 0.5), (2, 4.0, 3.0)], "id long, x double, y double")
    got = spatial.corridor(p, spatial.segments(line, ["l"], "i", "x", "y"), "id", "x", "y", 1.0).collect()
    assert [tuple(r) for r in got] == [(1, 4.0, 0.5)]
    ranked = spark.createDataFrame([("a", 3, 0.0, 0.0), ("a", 2, 0.0, 5.0), ("a", 1, 0.0, 20.0)], "name string, neg long, x double, y double")
    assert search.drop_repeats(ranked, ["name"], ["neg"], "x", "y", 10.0).count() == 2
    assert spatial.in_box(p, "x", "y", (0.0, 0.0, 5.0, 1.0), 0.5).count() == 1


def test_sync_and_retention(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, d string")
    local, remote, last = t([("a", "1"), ("b", "2"), ("c", "9"), ("e", "1"), ("f", "1")]), t([("a", "1"), ("b", "1"), ("c", "8"), ("d", "1"), ("e", "2")]), t([("a", "1"), ("b", "1"), ("c", "7"), ("d", "1"), ("e", "1"), ("f", "1")])
    assert {tuple(r) for r in tables.reconcile(local, remote, last, "k", "d").collect()} == {("a", "same"), ("b", "push"), ("c", "edited on both"), ("d", "gone here"), ("e", "pull"), ("f", "gone there")}


def test_fisher(spark):
    got = one(spark, aggregate.fisher_more(F.lit(1), F.lit(9), F.lit(7), F.lit(3)))
    want = sum(math.comb(8, k) * math.comb(12, 10 - k) for k in (7, 8)) / math.comb(20, 10)
    assert got == pytest.approx(want)


def test_logs(spark, tmp_path):
    formats = {"gnss": "uint64_t timestamp;double lat;float[2] acc", "state": "uint64_t timestamp;uint8_t code"}
    rows = [("gnss", 100, 1.5, [2.0, 3.0]), ("state", 110, 7), ("gnss", 120, float("nan"), [4.0, 5.0])]
    data = ulog.encode(50, {"vin": "ABC", "sys": "x"}, formats, rows)
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.ulg").write_bytes(data)
    (tmp_path / "logs/b.ulg").write_bytes(data[:-5])
    log = ulog.read_logs(spark, f"{tmp_path}/logs").cache()
    got = ulog.stream_of(log, "gnss", ["lat", "acc", "later"]).filter("path like '%a.ulg'").orderBy("t_us").collect()
    assert [tuple(r)[1:] for r in got] == [(100, 1.5, 2.0, None), (120, None, 4.0, None)]
    assert log.filter("kind = 'truncated'").count() == 1
    assert {r["text"] for r in ulog.info(log).filter("key = 'vin'").collect()} == {"ABC"}


def test_html_tables(spark):
    page = "<h2>Town  A</h2><table><tr><th>road</th><td>x<br>y</td></tr><tr><td>1 &amp; 2</td></tr></table>"
    got = html.tables(spark.createDataFrame([(1, page), (2, None), (3, "<p>none")], "id long, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "Town A", ["road", "x | y"]), (1, 0, 1, "Town A", ["1 & 2"])]


def test_opening_hours():
    assert week_ranges("24/7") == [(0, 10080)]
    assert week_ranges("Mo-Fr 09:00-17:00; We off")[:3] == [(540, 1020), (1980, 2460), (4860, 5340)]
    assert week_ranges("Su 22:00-02:00") == [(0, 120), (9960, 10080)]
    assert week_ranges("Mo 08:00-12:00,12:00-14:00; PH off") == [(480, 840)]
    assert week_ranges("Sa-Mo 10:00-11:00") == [(600, 660), (7800, 7860), (9240, 9300)]
    assert week_ranges("off") == [] and week_ranges("Mo off") is None and week_ranges("by appointment") is None and week_ranges(None) is None


def test_tracks(spark):
    line = spark.createDataFrame([(1, i, float(i), y) for i, y in enumerate([0.0, 0.1, 0.0, 5.0, 0.0])], "l int, i int, x double, y double")
    assert sorted(r["i"] for r in tracks.simplify(line, "l", "i", "x", "y", 1.0).collect()) == [0, 2, 3, 4]
    pairs = spark.createDataFrame([(1, 1, 7, 5.0), (1, 1, 8, 1.0), (1, 2, 8, 0.5), (1, 2, 9, 3.0)], "k int, t int, p int, d double")
    assert {tuple(r) for r in tracks.assign_once(pairs, "k", "t", "p", "d", 1).collect()} == {(1, 1, 8), (1, 2, 9)}
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "z"), (5, "d", None)], "id long, a string, b string")
    got = {tuple(r) for r in tracks.staged_groups(docs, "id", [("a", F.col("a")), ("b", F.col("b"))]).collect()}
    assert got == {(1, "a", 1), (2, "a", 1), (3, "b", 3), (4, "b", 3), (5, "single", 5)}


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00") for i in range(0, 50, 3)] + [(99, "2024-01-02 12:00:00")]
    df = spark.createDataFrame(rows, "id long, s string").select("id", F.col("s").cast("timestamp").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    of = lambda d: windows.tumbling(d, "ts", [], "10 minutes", "1 minute", F.count("*").alias("n")).select(F.col("window.start").alias("w"), "n")
    windows.run_available(of(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/run")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/run/out").collect()}
    want = {tuple(r) for r in of(df).collect()}
    assert got <= want and len(want) - len(got) <= 1


def test_level_filters(spark):
    rng = random.Random(3)
    rows, level = [], 0.0
    for i in range(300):
        level += rng.gauss(0, 1)
        rows.append((i % 2, i, i * 1000, level + rng.gauss(0, 3)))
    df = spark.createDataFrame(rows, "k int, id long, t long, value double")
    exact = {r["id"]: r["level"] for r in stateful.batch(df, "k", ["id", "t", "value"], stateful.kalman(0.5, 9.0, 1000), (None, 0.0, 0.0), "k int, id long, level double, spread double", ["t"]).collect()}
    near = {r["id"]: r["level"] for r in stateful.batch(df, "k", ["id", "t", "value"], stateful.particles(2000, 0.5, 9.0, 1000), (None, None, None), "k int, id long, level double", ["t"]).collect()}
    assert len(exact) == len(near) == 300
    assert sum(abs(exact[i] - near[i]) for i in exact) / 300 < 0.2


def test_state_machines_meet_missing_values(spark):
    df = spark.createDataFrame([(None, 1, 90.0), (1, 2, None), (1, 3, 90.0), (1, 4, None), (1, 5, 1.0), (2, None, 95.0)], "k long, id long, value double")
    got = {tuple(r) for r in stateful.batch(df, "k", ["id", "value"], stateful.hysteresis(80.0, 40.0), (False,), "k long, id long, warning boolean", ["id"]).collect()}
    assert got == {(None, 1, True), (1, 3, True), (1, 4, False), (2, None, True)}
    assert stateful.batch(df.limit(0), "k", ["id", "value"], stateful.hysteresis(80.0, 40.0), (False,), "k long, id long, warning boolean", ["id"]).collect() == []


def test_held_limit(spark):
    df = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate([(0, 50), (1, 90), (3, 50), (4, 90), (6, 90), (9, 90), (10, 30), (12, 60), (16, 60), (18, 60)])], "k int, id long, t long, v long")
    got = [(r["id"], r["shown"]) for r in stateful.batch(df, "k", ["id", "t", "v"], stateful.held_limit(5), (None, None, None), "k int, id long, shown long", ["t"]).collect()]
    assert got == [(0, 50), (5, 90), (9, 60)]


def test_paths(spark):
    edges = [(1, 2, 1.0), (2, 5, 1.0), (1, 3, 1.5), (3, 5, 1.0), (1, 4, 2.0), (4, 5, 2.0), (1, 5, 9.0)]
    e = spark.createDataFrame(edges, "a long, b long, cost double")
    got = {}
    for r in graph.alternatives(e, 1, 5, 4, 3.0).collect():
        got.setdefault(r["path"], []).append((r["a"], r["b"]))
    assert sorted(map(sorted, got.values())) == [[(1, 2), (2, 5)], [(1, 3), (3, 5)], [(1, 4), (4, 5)]]
    assert graph.alternatives(e, 5, 1, 2, 3.0).collect() == []
    assert {tuple(r) for r in graph.exits(graph.both_ways(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))).collect()} == {(1, 2, 3), (3, 2, 1)}
    tree = graph.both_ways(spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (3, 4, 5.0), (2, 6, 1.5)], "a long, b long, cost double"), "cost")
    assert {tuple(r) for r in graph.longest_path(tree, 1).collect()} == {(4, 6, 9.5)}


def test_segment_cells_and_crossings(spark):
    rng = random.Random(5)
    rows = [(i, *(rng.uniform(-3, 3) for _ in range(4))) for i in range(60)] + [(60, -1.0, 0.5, 2.0, 0.5), (61, 0.5, -1.0, 0.5, 2.0), (62, 0.2, 0.2, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "id int, ax double, ay double, bx double, b2 double")
    got = {r["id"]: {(c["cx"], c["cy"]) for c in r["c"]} for r in df.select("id", geo.segment_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("b2"), 1.0).alias("c")).collect()}
    for i, ax, ay, bx, b2 in rows:
        want = {(math.floor(ax + (bx - ax) * k / 4000), math.floor(ay + (b2 - ay) * k / 4000)) for k in range(4001)}
        assert want <= got[i] and len(got[i]) <= len(want) + 1
    cross = lambda *v: one(spark, geo.crossing(*map(F.lit, v)))
    assert cross(0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0) == 0.5
    assert cross(0.0, 0.0, 2.0, 2.0, 0.0, 1.0, 2.0, 3.0) is None and cross(0.0, 0.0, 1.0, 0.0, 3.0, -1.0, 3.0, 1.0) is None


def test_fits(spark):
    pts = [(float(i), float(i * i % 7)) for i in range(12)]
    c, s = math.cos(0.4), math.sin(0.4)
    df = spark.createDataFrame([(1, x, y, c * x - s * y + 3, s * x + c * y - 1, 2 * x - 3 * y + 5) for x, y in pts] + [(2, 1.0, 1.0, 0.0, 0.0, 0.0)], "k int, x double, y double, u double, v double, z double")
    got = aggregate.rigid_fit(df.filter("k = 1"), ["k"], ("x", "y"), ("u", "v")).first()
    assert [got["turn"], got["dx"], got["dy"]] == pytest.approx([0.4, 3.0, -1.0])
    plane = {r["k"]: (r["p"], r["q"], r["r"]) for r in aggregate.plane_fit(df, ["k"], "x", "y", "z").collect()}
    assert plane[1] == pytest.approx((2.0, -3.0, 5.0)) and plane[2] == (None, None, None)


def test_viterbi(spark):
    import itertools

    rng = random.Random(9)
    rows = [(k, i, i * 10 + (1000 if k == 2 and i > 3 else 0), *(rng.uniform(-3, 0) for _ in range(3))) for k in (1, 2) for i in range(7)]
    df = spark.createDataFrame(rows, "k int, i int, t long, s0 double, s1 double, s2 double")
    got = {(r["k"], r["i"]): r["state"] for r in graph.viterbi(df, ["k"], ["t"], ["s0", "s1", "s2"], 0.8, 500).collect()}
    for chain in (rows[:7], rows[7:11], rows[11:]):
        best = max(itertools.product(range(3), repeat=len(chain)), key=lambda p: sum(r[3 + s] for r, s in zip(chain, p)) + sum(math.log(0.8 if a == b else 0.1) for a, b in zip(p, p[1:])))
        assert [got[r[0], r[1]] for r in chain] == list(best)


def test_close_values_meet_at_cell_borders(spark):
    rng = random.Random(2)
    a, b = ([(i % 2, i, round(rng.uniform(-20, 20), 1)) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(a, "k int, i int, v double"), spark.createDataFrame(b, "k int, j int, w double")
    got = sorted((r["i"], r["j"]) for r in spatial.close_values(left, right, ["k"], "v", "w", 3.0).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and abs(x[2] - y[2]) < 3.0)
