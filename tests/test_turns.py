"""The tracker by turns against all branches tried one by one."""

import math

from tidemark.operators import turns

N = 4


def town():
    """Streets between neighbours of a square of places, 80 across and 110 up; no way back."""
    place = {(i, j): (80.0 * i, 110.0 * j) for i in range(N) for j in range(N)}
    pairs = [(a, b) for a in place for b in place if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 and a < b]
    state = {}
    for e, (a, b) in enumerate(pairs):
        state[a, b], state[b, a] = 2 * e, 2 * e + 1
    roads = [{"state": s, "ax": place[a][0], "ay": place[a][1], "bx": place[b][0], "by_": place[b][1], "length": math.dist(place[a], place[b]), "next": [t for (c, _), t in state.items() if c == b]} for (a, b), s in state.items()]
    return place, state, roads


def drive(path, place, short):
    """Rows along a path of places: ten-metre steps, a quarter turn over two rows at each corner; metres are short by a factor."""
    rows, n = [], 0
    heading = None
    for a, b in zip(path, path[1:]):
        h = math.atan2(place[b][0] - place[a][0], place[b][1] - place[a][1])
        turn = 0.0 if heading is None else turns.wrapped(h - heading)
        heading = h
        length, at = math.dist(place[a], place[b]), 0.0
        while at < length - 1e-9:
            n += 1
            rows.append((n, None, 10.0 / short, turn / 2 if at < 15 and turn else 0.0, math.nan, math.nan))
            at += 10
    return rows


def all_branches(rows, roads, o):
    """Best (state, offset, scale) without merging or pruning: every branch of every turn is kept."""
    r = turns.Roads(roads)
    first = rows[0]
    hyps = []
    for s, q in r.of.items():
        off = max(0.0, min(q["length"], ((first[4] - q["ax"]) * (q["bx"] - q["ax"]) + (first[5] - q["ay"]) * (q["by_"] - q["ay"])) / q["length"]))
        d = math.hypot(q["ax"] + (q["bx"] - q["ax"]) * off / q["length"] - first[4], q["ay"] + (q["by_"] - q["ay"]) * off / q["length"] - first[5])
        hyps.append((s, off, o.scale, 225.0, o.scale_sigma**2, 0.0, -0.5 * (d / 15) ** 2 - 0.5 * (turns.wrapped(first[3] - r.heading[s]) / o.sigma) ** 2))
    hyps = sorted(hyps, key=lambda h: -h[6])[:6]
    psi = steady = first[3]
    opened = None
    for _, _, ds, yaw, *_ in rows[1:]:
        psi += yaw
        hyps = [turns.driven(h, ds, o) for h in hyps]
        if opened is not None or abs(psi - steady) > o.begin:
            opened = (opened or 0.0) + ds
        if opened is not None and abs(yaw) <= o.steady:
            if abs(psi - steady) >= o.least:
                hyps = [b for h in hyps for b in turns.branched(h, psi - steady, opened / 2, r, o)]
            steady, opened = psi, None
        elif opened is None:
            steady = psi
        if opened is None:
            hyps = [turns.moved_on(h, r, o) for h in hyps]
    best = max(hyps, key=lambda h: h[6])
    return best[:3], len(hyps)


def test_turns_find_the_way():
    place, state, roads = town()
    path = [(0, 0), (1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (3, 3), (2, 3)]
    start = (0, [dict(r) for r in roads], 0.0, math.pi / 2, 0.0, 0.0)
    rows = [start, *drive(path, place, 1.2)]
    step, st, out = turns.follow_turns(), turns.TURNS_START, []
    for r in rows:
        st, got = step(st, r)
        out += got
    assert len(out) == len(rows) and out[0][1] == state[(0, 0), (1, 0)]
    assert out[-1][1] == state[(3, 3), (2, 3)] and abs(out[-1][2] - 80) < 25
    # its metres are short by a sixth, which the turns teach
    assert abs(out[-1][5] - 1.2) < 0.06
    best, many = all_branches(rows, roads, turns.Beam())
    assert many > out[-1][7] and best[0] == out[-1][1] and abs(best[1] - out[-1][2]) < turns.Beam().merge and abs(best[2] - out[-1][5]) < 0.05


def test_merging_and_pruning():
    o = turns.Beam(most=2)
    got = turns.thinned([(1, 10.0, 1, 1, 1, 0, -1.0), (1, 12.0, 1, 1, 1, 0, -1.0), (1, 40.0, 1, 1, 1, 0, -2.0), (2, 10.0, 1, 1, 1, 0, -3.0), (3, 0.0, 1, 1, 1, 0, -99.0)], o)
    assert [(h[0], h[1]) for h in got] == [(1, 10.0), (1, 40.0)] and got[0][6] == 0.0
    assert math.isclose(got[1][6], -2.0 - (-1.0 + math.log(2)))
    _, _, roads = town()
    r = turns.Roads(roads)
    # a turn where no road turns costs, and changes nothing else
    dead = turns.Roads([{**q, "next": []} for q in roads])
    h = (0, 10.0, 1.1, 25.0, 0.01, 0.0, 0.0)
    assert turns.branched(h, 1.5, 5.0, dead, o) == [(*h[:6], o.missed)]
    assert all(t in r.of for t, *_ in turns.branched(h, 1.5, 5.0, r, o))
