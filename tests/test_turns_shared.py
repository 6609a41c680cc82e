"""Laps that start in one cell share the roads around it."""

import math

from test_turns import drive, town

from tidemark.operators import turns


def walked(step, state, rows):
    out = []
    for r in rows:
        state, got = step(state, r)
        out += got
    return out


def test_roads_are_told_and_laid_out_once_for_many_laps(monkeypatch):
    place, _, roads = town()
    paths = {"a": [(0, 0), (1, 0), (2, 0), (2, 1), (3, 1)], "b": [(0, 0), (1, 0), (1, 1), (1, 2), (2, 2)], "c": [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2)]}
    laps = {k: [(0, None, 0.0, math.pi / 2, *place[p[0]]), *drive(p, place, 1.1)] for k, p in paths.items()}
    alone = [(k, *r) for k, rows in laps.items() for r in walked(turns.follow_turns(), turns.TURNS_START, [(rows[0][0], roads, *rows[0][2:]), *rows[1:]])]
    made, init = [], turns.Roads.__init__
    monkeypatch.setattr(turns.Roads, "__init__", lambda self, r: made.append(1) or init(self, r))
    told = [(None, None, roads, math.nan, math.nan, math.nan, math.nan)]
    rows = [(k, *r) for k, lap in laps.items() for r in lap]
    assert walked(turns.shared_roads(turns.follow_turns()), (None, None, turns.TURNS_START), told + rows) == alone
    assert len(alone) == len(rows) and len(made) == 1
    # no roads, no rows
    assert walked(turns.shared_roads(turns.follow_turns()), (None, None, turns.TURNS_START), rows) == []
    r = turns.Roads(roads)
    o = turns.Beam()
    for s in r.of:
        before = sorted((abs(a), q) for q in r.of for t, a in r.on(q) if t == s and abs(a) < o.least)
        assert r.behind(s, o) == (before[0][1] if before else None)
