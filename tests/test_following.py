"""Matching, retiming, reordering and the filters against plain Python, in batch and on streams."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import frames, graph, matching, navigation, stateful
from tidemark.streaming import windows

EDGES = [(1, 0, 1, 0.0, 0.0, 100.0, 0.0, 0), (2, 1, 2, 100.0, 0.0, 200.0, 0.0, 0), (3, 1, 3, 100.0, 0.0, 100.0, 100.0, 0), (4, 0, 3, 0.0, 0.0, 100.0, 100.0, 1), (5, 3, 4, 100.0, 100.0, 200.0, 100.0, -1)]
ROADS = "edge long, a long, b long, ax double, ay double, bx double, by_ double, oneway int"
FIX = "trip long, n long, t long, x double, y double, heading double, driven double"


def plain_match(fixes, edges, rules):
    """(n, edge, dir) of one chain by trying candidates and Dijkstra between them, without a search shared or pruned."""
    length = {e: math.hypot(bx - ax, by - ay) for e, _, _, ax, ay, bx, by, _ in edges}
    out = {}
    for e, a, b, *_, oneway in edges:
        for d, tail, head in ((1, a, b), (-1, b, a)):
            out.setdefault(tail, []).append((e, d, head, rules.against if oneway == -d else 0.0))
    ends = {(e, d): head for node in out for e, d, head, _ in out[node]}

    def cands(x, y, heading):
        found = []
        for e, _, _, ax, ay, bx, by, _ in edges:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length[e] ** 2))
            d = round(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), 9)
            if d <= rules.radius:
                found.append((d, e, t * length[e], math.atan2(bx - ax, by - ay)))
        got = []
        for d, e, along, course in sorted(found)[: rules.most]:
            for way in (1, -1):
                off = 0.0 if heading is None else abs(math.atan2(math.sin(heading - course - (0 if way == 1 else math.pi)), math.cos(heading - course - (0 if way == 1 else math.pi))))
                got.append((e, way, along, -0.5 * (d / rules.sigma) ** 2 - 0.5 * (off / rules.heading_sigma) ** 2))
        return got

    def way(p, c, most):
        best = []
        if p[0] == c[0]:
            ahead = (c[2] - p[2]) * p[1]
            if c[1] != p[1]:
                best.append((abs(ahead), rules.back))
            elif ahead >= -rules.jitter:
                best.append((abs(ahead), 0.0))
        rest = length[p[0]] - p[2] if p[1] == 1 else p[2]
        heap, seen = [(0.0, rest, 0.0, p[0], p[1])], set()
        while heap:
            _, far, pen, e, d = heapq.heappop(heap)
            if far > most or (far, pen, e, d) in seen:
                continue
            seen.add((far, pen, e, d))
            for e2, d2, _, against in out[ends[e, d]]:
                more = pen + against + (rules.back if e2 == e and len(out[ends[e, d]]) > 1 else 0.0)
                if (e2, d2) == (c[0], c[1]):
                    best.append((far + (c[2] if d2 == 1 else length[e2] - c[2]), more))
                if more <= 500:
                    heapq.heappush(heap, (far + length[e2] + more, far + length[e2], more, e2, d2))
        return min(((a + b, a, b) for a, b in best if a <= most), default=None)

    score, back = [], []
    for k, (_, x, y, heading, driven) in enumerate(fixes):
        own = cands(x, y, heading)
        if not k:
            score, back, all_ = [c[3] for c in own], [[-1] * len(own)], [own]
            continue
        gone = max(0.0, driven - fixes[k - 1][4])
        now, prev = [-math.inf] * len(own), [-1] * len(own)
        for i, p in enumerate(all_[-1]):
            for j, c in enumerate(own):
                w = way(p, c, gone * rules.factor + rules.slack)
                if w and score[i] - (abs(w[1] - gone) + w[2]) / (rules.beta + rules.beta_share * gone) + c[3] > now[j]:
                    now[j], prev[j] = score[i] - (abs(w[1] - gone) + w[2]) / (rules.beta + rules.beta_share * gone) + c[3], i
        score = now
        back.append(prev)
        all_.append(own)
    k, path = max(range(len(score)), key=score.__getitem__), []
    for i in range(len(fixes) - 1, -1, -1):
        path.append((fixes[i][0], *all_[i][k][:2]))
        k = back[i][k]
    return path[::-1]


def test_matching_takes_the_likeliest_chain(spark):
    rng = random.Random(8)
    # around the triangle, against the one-way road at the end
    true = [(s, 0.0) for s in range(5, 100, 25)] + [(100.0, float(s)) for s in range(10, 100, 25)] + [(100.0 + s, 100.0) for s in range(10, 90, 30)]
    fixes = [(k, x + rng.uniform(-4, 4), y + rng.uniform(-4, 4), None if k % 3 else 1.2, 27.0 * k) for k, (x, y) in enumerate(true)]
    rows = [(1, n, n * 2_000_000, x, y, h, d) for n, x, y, h, d in fixes]
    rows += [(2, 0, 0, 10.0, 1.0, None, 0.0), (2, 1, 1_000_000, 900.0, 900.0, None, 0.0), (2, 2, 2_000_000, 40.0, 1.0, None, 30.0), (2, 3, 60_000_000, 60.0, 1.0, None, 50.0), (2, 4, 61_000_000, 190.0, 98.0, None, 55.0), (3, 0, 0, 900.0, 900.0, None, 0.0)]
    got = matching.match(spark.createDataFrame(rows, FIX), spark.createDataFrame(EDGES, ROADS)).orderBy("trip", "n").collect()
    assert [(r["n"], r["edge"], r["dir"]) for r in got if r["trip"] == 1] == plain_match(fixes, EDGES, matching.Rules())
    assert [(r["n"], r["reason"], r["edge"]) for r in got if r["trip"] == 2] == [(0, "start", 1), (1, "no candidates", None), (2, "no candidates", 1), (3, "gap", 1), (4, "no route", 5)]
    assert [r["reason"] for r in got if r["trip"] == 3] == ["no candidates"]
    assert matching.match(spark.createDataFrame([], FIX), spark.createDataFrame(EDGES, ROADS)).collect() == []


def test_a_swarm_stays_on_the_road(spark):
    # no fix from the sixth row on
    rows = [(7, k, k * 1_000_000, *((10.0 + 20 * k, 2.0) if k < 5 else (None, None)), 1.57 if k == 3 else None, 20.0 * k) for k in range(9)]
    f = spark.createDataFrame(rows, FIX)
    e = spark.createDataFrame(EDGES[:2], ROADS)
    got = navigation.follow(f, e).orderBy("n").collect()
    again = navigation.follow(f.repartition(3), e.repartition(2)).orderBy("n").collect()
    assert got == again and all(r["alive"] == 300 for r in got[:8])
    for k in range(8):
        assert got[k]["edge"] == (1 if 10 + 20 * k < 100 else 2) or abs(10 + 20 * k - 100) < 15
        assert abs(got[k]["y"]) < 1e-9 and abs(got[k]["x"] - (10 + 20 * k)) < 15
    assert navigation.follow(spark.createDataFrame([], FIX), e).collect() == []


def test_eight_states_against_plain_algebra(spark, tmp_path):
    """The filter against the textbook form, P = (I - K H) P, written with loops; and streams against batches."""
    rng = random.Random(2)
    rows, t = [(1, 0, 0, "fix", 0.0, 0.0, 5.0)], 0
    for k in range(1, 60):
        t += 250_000
        kind = rng.choice(["yaw", "yaw", "speed", "still", "fix", "late", "none"])
        a, b, c = {"yaw": (rng.gauss(0, 0.05), 0.0, 0.0), "speed": (rng.choice([0.0, 8 + rng.random()]), 0.0, 0.0), "still": (rng.gauss(0, 0.0004), 0.0, 0.0), "fix": (rng.gauss(0, 6), t / 1e6 * 8 + rng.gauss(0, 6), 6.0), "late": (rng.gauss(0, 6), t / 1e6 * 8, 700_000.0), "none": (0.0, 0.0, 0.0)}[kind]
        rows.append((1, k, t, kind, a, b, c))
    rows[30] = (1, 30, rows[30][2], "fix", 900.0, -900.0, 6.0)
    noise = navigation.Noise()

    def mul(a, b):
        return [[sum(x * y for x, y in zip(r, c)) for c in zip(*b)] for r in a]

    x, p, when, past, want = None, None, 0, [], []
    for _, n, t, kind, a, b, c in rows:
        if x is None:
            x, p = [a, b, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0], [[(noise.first[i] ** 2 if i > 1 else c * c) if i == j else 0.0 for j in range(8)] for i in range(8)]
            past, when = [(t, a, b)], t
            want.append((n, a, b, 0.0, 0.0, 1.0, c, True))
            continue
        dt = (t - when) / 1e6
        yaw = a if kind == "yaw" else None if kind == "none" else x[5]
        f = [[float(i == j) for j in range(8)] for i in range(8)]
        s, co, w = math.sin(x[2]), math.cos(x[2]), 0.0 if yaw is None else yaw - x[5]
        f[0][2], f[0][3], f[1][2], f[1][3] = x[3] * co * dt, s * dt, -x[3] * s * dt, co * dt
        if yaw is not None:
            f[2][5], f[2][6] = x[6] * dt, -w * dt
        q = [noise.position, noise.position, noise.yaw_unknown if yaw is None else noise.yaw * x[6], noise.acceleration, noise.scale, noise.bias, noise.yaw_scale, 0.0]
        x = [x[0] + x[3] * s * dt, x[1] + x[3] * co * dt, math.remainder(x[2] - x[6] * w * dt, 2 * math.pi), *x[3:]]
        p = mul(mul(f, p), list(map(list, zip(*f))))
        for i in range(8):
            p[i][i] += q[i] ** 2 * dt
        h, off, r, gate, ok = [], [], 0.0, math.inf, True
        unit = lambda i, v=1.0: [v if j == i else 0.0 for j in range(8)]
        if kind == "speed" and a == 0:
            h, off, r = [unit(3)], [-x[3]], noise.zero_sigma**2
        elif kind == "speed":
            told = (x[3] - x[7]) / x[4]
            h, off, r = [[0, 0, 0, 1 / x[4], -told / x[4], 0, 0, -1 / x[4]]], [a - told], noise.speed_sigma**2
        elif kind == "still":
            h, off, r, gate = [unit(5)], [a - x[5]], noise.bias_sigma**2, 10.83
        elif kind in ("fix", "late"):
            was = (x[0], x[1])
            if kind == "late":
                old = [q for q in past if q[0] <= t - c]
                ok = bool(old)
                was = old[-1][1:] if old else was
            if ok:
                h, off, r, gate = [unit(0), unit(1)], [a - was[0], b - was[1]], 100.0 if kind == "late" else c * c, 13.82
        if h:
            ph = [[sum(p[i][k] * g[k] for k in range(8)) for g in h] for i in range(8)]
            m = [[sum(g[k] * ph[k][j] for k in range(8)) + (r if i == j else 0.0) for j in range(len(h))] for i, g in enumerate(h)]
            inv = [[1 / m[0][0]]] if len(h) == 1 else [[m[1][1], -m[0][1]], [-m[1][0], m[0][0]]]
            det = 1.0 if len(h) == 1 else m[0][0] * m[1][1] - m[0][1] * m[1][0]
            inv = [[v / det for v in row] for row in inv]
            ok = sum(off[i] * inv[i][j] * off[j] for i in range(len(h)) for j in range(len(h))) <= gate
            if ok:
                k = mul(ph, inv)
                k[6] = [0.0] * len(h)
                x = [v + sum(g * o for g, o in zip(k[i], off)) for i, v in enumerate(x)]
                x[2] = math.remainder(x[2], 2 * math.pi)
                ikh = [[float(i == j) - sum(k[i][g] * h[g][j] for g in range(len(h))) for j in range(8)] for i in range(8)]
                p = mul(mul(ikh, p), list(map(list, zip(*ikh))))
                p = [[p[i][j] + r * sum(k[i][g] * k[j][g] for g in range(len(h))) for j in range(8)] for i in range(8)]
        mean, diff = (p[0][0] + p[1][1]) / 2, math.hypot((p[0][0] - p[1][1]) / 2, p[0][1])
        want.append((n, *x[:5], math.sqrt(mean + diff), ok))
        past, when = [q for q in past if q[0] >= t - noise.keep_us] + [(t, x[0], x[1])], t
    df = spark.createDataFrame(rows, "trip long, id long, t long, kind string, a double, b double, c double")
    args = ("trip", ["id", "t", "kind", "a", "b", "c"], navigation.dead_reckoning())
    got = stateful.batch(df, *args, (None, None, None, None, None), f"trip long, id long, {navigation.RECKONED}", ["t", "id"]).orderBy("id").collect()
    assert len({r[-1] for r in want}) == 2
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[1:-1] == pytest.approx(w[:-1], rel=1e-6, abs=1e-6) and g["accepted"] == w[-1]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((df.filter("id < 25"), df.filter("id >= 25"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = stateful.stream(src, *args, (None, None, None, None, None), f"trip long, id long, {navigation.RECKONED}", navigation.RECKONING_STATE, ["t", "id"])
    windows.run_available(out, str(tmp_path))
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()] == [tuple(r) for r in got]


def test_a_grid_along_a_route_against_loops():
    """Shifting, spreading, leaking and weighing cell by cell."""
    o = navigation.Along(scales=(0.9, 1.2), leak_metres=20.0, window=30.0)
    route = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0)]
    steps = [(k, [list(p) for p in route] if not k else None, 1.0, 8.0 if k != 6 else 0.0, math.nan if k == 4 else (math.pi / 8 if 10 <= k < 14 else 0.0), 40.0 if k == 7 else math.nan, 5.0 if k == 7 else math.nan, 40.0) for k in range(22)]
    step, state, got = navigation.along_route(o), navigation.ALONG_START, []
    for row in steps:
        state, out = step(state, row)
        got += out
    cells, half = 41, [(i * 5.0, 0.0) if i <= 20 else (100.0, (i - 20) * 5.0) for i in range(41)]
    course = [math.pi / 2 if i < 20 else 0.0 for i in range(cells)]
    prior = [math.exp(-0.5 * ((s - o.mean) / o.sigma) ** 2) for s in o.scales]
    prior = [v / sum(prior) for v in prior]
    g = [[prior[j] * math.exp(-0.5 * (i * 5.0 / 15) ** 2) for i in range(cells)] for j in range(2)]
    psi, driven, past = 0.0, 0.0, []
    for (n, _, dt, v, yaw, x, y, acc), told in zip(steps, got, strict=True):
        psi -= 0.0 if math.isnan(yaw) else yaw * dt
        if v > 0:
            d = v * dt
            sigma = max(0.3, (o.share * d + o.floor * dt) / 5.0)
            for j, s in enumerate(o.scales):
                mean, row = s * d / 5.0, [0.0] * cells
                offs = range(math.floor(mean) - math.ceil(3 * sigma), math.floor(mean) + math.ceil(3 * sigma) + 2)
                w = [math.exp(-0.5 * ((k - mean) / sigma) ** 2) for k in offs]
                for i in range(cells):
                    for k, wk in zip(offs, w):
                        if min(cells - 1, i + k) >= 0:
                            row[min(cells - 1, i + k)] += g[j][i] * wk / sum(w)
                g[j] = row
            total = [a + b for a, b in zip(*g)]
            g = [[(1 - o.jump * dt) * g[j][i] + o.jump * dt * prior[j] * total[i] for i in range(cells)] for j in range(2)]
            w = max(1, round(o.leak_metres / 5.0))
            for j in range(2):
                wide = g[j]
                for _ in range(3):
                    wide = [sum(wide[max(0, i - w) : i + w + 1]) / (2 * w + 1) for i in range(cells)]
                g[j] = [(1 - o.leak * dt) * a + o.leak * dt * b for a, b in zip(g[j], wide)]
            driven += d
            past.append((driven, psi, not math.isnan(yaw)))
            k = next(i for i, q in enumerate(past) if q[0] >= driven - o.window)
            if k and all(q[2] for q in past[k - 1 :]):
                (da, pa_, _), (db, pb, _) = past[k - 1], past[k]
                turned = psi - (pa_ + (pb - pa_) * (driven - o.window - da) / (db - da))
                for j, s in enumerate(o.scales):
                    for i in range(cells):
                        e = math.remainder(turned - (course[i] - course[max(0, i - round(s * o.window / 5.0))]), 2 * math.pi)
                        g[j][i] *= o.turn_floor + (1 - o.turn_floor) * math.exp(-0.5 * (e / o.turn_sigma) ** 2)
        if not math.isnan(x):
            for i in range(cells):
                near = math.exp(-0.5 * ((half[i][0] - x) ** 2 + (half[i][1] - y) ** 2) / max(30.0, 1.5 * acc) ** 2)
                for j in range(2):
                    g[j][i] *= 0.8 * near + 0.2 * math.exp(-4.5)
        norm = sum(map(sum, g))
        g = [[v / norm for v in r] for r in g]
        each = [a + b for a, b in zip(*g)]
        mean = sum(i * v for i, v in enumerate(each))
        assert told[3] == pytest.approx(5 * math.sqrt(max(0.0, sum(i * i * v for i, v in enumerate(each)) - mean * mean)), rel=1e-6)
        assert each[int(told[1] / 5)] == pytest.approx(max(each)) and n == told[0]


@pytest.mark.parametrize("stretch", [7, 5000])
def test_frames_are_laid_on_their_period(spark, stretch):
    rng = random.Random(4)
    rows, ends = [], [500_000, 1_400_000]
    for i in (1, 2):
        t = 0
        for k in range(260):
            t += 10_000 + (700_000 if k % 97 == 96 else 0)
            rows.append((5, i, i * 1000 + k, t + rng.randrange(60_000)))
    got = frames.retimed(spark.createDataFrame(rows, "bus long, id long, frame long, t long"), spark.createDataFrame([(5, e) for e in ends], "bus long, end_t long"), stretch=stretch)
    got = {(r["id"], r["frame"]): r["sent"] for r in got.collect()}
    for i in (1, 2):
        seen, last, period, before = [], None, None, None
        for _, _, frame, t in sorted((r for r in rows if r[1] == i), key=lambda r: (r[3], r[2])):
            new = before is None or t - before > 500_000 or any(before <= e < t for e in ends)
            run = (seen[-1][0] + 1 if seen else 0) if new else seen[-1][0]
            seen = (seen + [(run, t)])[-200:]
            before = t
            if new:
                last = float(t)
            else:
                parts = [np.array([y for r, y in seen if r == k], dtype=float) for k in sorted({r for r, _ in seen})]
                parts = [y for y in parts if len(y) > 1]
                j = [np.arange(len(y)) - (len(y) - 1) / 2 for y in parts]
                if sum(map(len, parts)) >= 20:
                    period = sum(a @ (y - y.mean()) for a, y in zip(j, parts)) / sum(a @ a for a in j)
                last = float(t) if period is None else min(t, max(t - 300_000, last + period))
            assert got[i, frame] == pytest.approx(last, abs=0.01)


def test_late_rows_and_order_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((k * 100 + rng.randrange(700), k) for k in range(80))
    rows = [(1 + k % 2, n, 50_000_000 + k * 100_000, "bus" if k % 9 == 4 else "phone") for n, (_, k) in enumerate(rows)]
    df = spark.createDataFrame(rows, "key long, id long, t long, source string")
    delays = {"phone": 300_000, "bus": 500_000}
    got = windows.reordered(df, "key", "id", "id", "t", "source", delays)
    for key in (1, 2):
        newest = out_to = None
        late, delay = set(), 0
        for _, n, t, s in [r for r in rows if r[0] == key]:
            delay = max(delay, delays[s])
            if out_to is not None and t <= out_to:
                late.add(n)
                continue
            newest = t if newest is None else max(newest, t)
            out_to = max(out_to or newest - delay, newest - delay)
        own = got.filter(f"key = {key}")
        assert {r["id"] for r in own.filter("late").collect()} == late and own.count() == sum(r[0] == key for r in rows)
        order = [r["t"] for r in own.collect() if not r["late"]]
        assert order == sorted(order)
    schema = T.StructType([*df.schema.fields, T.StructField("at", T.TimestampType())])
    timed = df.withColumn("at", F.timestamp_micros("t"))
    for k in range(4):
        timed.filter(f"id >= {20 * k} and id < {20 * k + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    # a silent end: one more key, much later, moves the watermark
    spark.createDataFrame([(9, 900, 999_000_000, "phone")], "key long, id long, t long, source string").withColumn("at", F.timestamp_micros("t")).coalesce(1).write.parquet(str(tmp_path / "in" / "8"))
    spark.createDataFrame([(9, 901, 999_900_000, "phone")], "key long, id long, t long, source string").withColumn("at", F.timestamp_micros("t")).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    windows.run_available(windows.reordered_stream(src, "key", "id", "at", "source", delays, "2 seconds"), str(tmp_path))
    streamed = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("key < 9").collect()}
    assert streamed == {tuple(r) for r in got.collect()}


def test_bridges_are_a_shortest_forest(spark):
    rng = random.Random(12)
    places = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(60)] + [(99, 900.0, 900.0)]
    edges = [(k, k + 1) for k in range(0, 60, 4)] + [(k + 1, k + 2) for k in range(0, 56, 8)]
    at = {n: (x, y) for n, x, y in places}
    piece = {n: n for n in at}

    def join(a, b):
        old, new = piece[b], piece[a]
        for n in piece:
            piece[n] = new if piece[n] == old else piece[n]

    for a, b in edges:
        join(a, b)
    want = set()
    for d, a, b in sorted((math.dist(at[a], at[b]), a, b) for a in at for b in at if a < b):
        if d <= 60 and piece[a] != piece[b]:
            want.add((a, b))
            join(a, b)
    got = graph.bridges(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(places, "node long, x double, y double"), 60.0, 2.0).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(want) > 10


def test_a_row_of_the_filter_takes_little(monkeypatch):
    """No general solver, and no matrix built anew but for the entries of the row, for each of so many rows."""
    for name in ("solve", "eigvalsh", "inv"):
        monkeypatch.setattr(np.linalg, name, None)
    for name in ("eye", "vstack"):
        monkeypatch.setattr(np, name, None)
    step, state = navigation.dead_reckoning(), (None,) * 5
    rows = [("fix", 0.0, 0.0, 5.0), ("speed", 8.0, 0.0, 0.0), ("speed", 0.0, 0.0, 0.0), ("yaw", 0.01, 0.0, 0.0), ("still", 0.0002, 0.0, 0.0), ("none", 0.0, 0.0, 0.0), ("fix", 1.0, 8.0, 6.0), ("late", 1.0, 9.0, 700_000.0)]
    for n, (kind, a, b, c) in enumerate(rows):
        state, out = step(state, (n, n * 500_000, kind, a, b, c))
        assert len(out) == 1 and all(math.isfinite(v) for v in out[0][1:7])
    # the state goes on as a stream keeps it: flat lists
    kept = tuple(v.tolist() if hasattr(v, "tolist") else v for v in state)
    assert len(kept[2]) == 64 and step(kept, (9, 5_000_000, "fix", 2.0, 20.0, 6.0))[1] == step(state, (9, 5_000_000, "fix", 2.0, 20.0, 6.0))[1]
