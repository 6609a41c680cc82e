"""A vehicle followed by its turns alone: hypotheses on roads that branch at junctions, are merged where they meet, and pruned."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tidemark.operators.stateful import Step


@dataclass(frozen=True)
class Beam:
    """Metres and radians. Fixed values."""

    most: int = 400
    prune: float = 14.0
    merge: float = 8.0
    scale: float = 1.1
    scale_sigma: float = 0.25
    start_sigma: float = 15.0
    noise: float = 0.5  # square metres a metre driven
    begin: float = math.radians(12)  # a turn begins so far off the last steady heading,
    steady: float = math.radians(4)  # ends with a row that turns no more than this,
    least: float = math.radians(35)  # and counts as one at a junction from here on
    sigma: float = math.radians(20)
    snap: float = 15.0
    sigmas: float = 3.0
    slack: float = 25.0
    missed: float = math.log(0.05)  # a turn where the map has none


def wrapped(a: float) -> float:
    return math.atan2(math.sin(a), math.cos(a))


class Roads:
    """Directed roads by state, with their headings and the roads on from each."""

    def __init__(self, roads: list):
        self.of = {r["state"]: r for r in roads}
        self.heading = {s: math.atan2(r["bx"] - r["ax"], r["by_"] - r["ay"]) for s, r in self.of.items()}
        self._on: dict[int, list[tuple[int, float]]] = {}
        self._behind: dict[float, dict[int, int]] = {}

    def on(self, s: int) -> list[tuple[int, float]]:
        """(road, turn) of each way on from the end of a road, but back."""
        if s not in self._on:
            self._on[s] = [(t, wrapped(self.heading[t] - self.heading[s])) for t in self.of[s]["next"] if t in self.of and t != s ^ 1]
        return self._on[s]

    def straight(self, s: int, o: Beam) -> int | None:
        """The road on that turns least, if that is no turn."""
        ways = sorted((abs(a), t) for t, a in self.on(s) if abs(a) < o.least)
        return ways[0][1] if ways else None

    def behind(self, s: int, o: Beam) -> int | None:
        """The road that runs into the beginning of one straightest, if that is no turn."""
        if o.least not in self._behind:
            ways = sorted((abs(a), r, t) for r in self.of for t, a in self.on(r) if abs(a) < o.least)
            self._behind[o.least] = {t: r for _, r, t in reversed(ways)}
        return self._behind[o.least].get(s)


def driven(h: tuple, ds: float, o: Beam) -> tuple:
    """A hypothesis (road, offset, scale, and variances of offset, of scale, of both, log weight) after ds metres by the vehicle's own measure."""
    s, off, k, pss, pkk, psk, w = h
    return (s, off + k * ds, k, pss + 2 * ds * psk + ds * ds * pkk + o.noise * ds, pkk, psk + ds * pkk, w)


def moved_on(h: tuple, roads: Roads, o: Beam) -> tuple:
    """The same place on the road it lies on, straight ahead; where no road goes straight on it waits beyond the end."""
    s, off, *rest = h
    while off > roads.of[s]["length"] and (t := roads.straight(s, o)) is not None:
        off, s = off - roads.of[s]["length"], t
    return (s, off, *rest)


def junctions(h: tuple, roads: Roads, o: Beam) -> list[tuple[float, int]]:
    """(distance from the hypothesis, road that ends there) of the junctions where it may be: behind it, at its road's end and straight on, as far as it is unsure."""
    s, off, _, pss, *_ = h
    far = o.sigmas * math.sqrt(pss) + o.slack
    before = roads.behind(s, o)
    out = [(-off, before)] if before is not None and off <= far else []
    at, d = s, roads.of[s]["length"] - off
    while at is not None and d <= far:
        if d >= -far:
            out.append((d, at))
        at = roads.straight(at, o)
        d += roads.of[at]["length"] if at is not None else 0.0
    return out


def branched(h: tuple, turned: float, since: float, roads: Roads, o: Beam) -> list[tuple]:
    """What becomes of a hypothesis by a turn, `since` metres ago by its own measure: one for each way off each junction in reach, or itself, at a cost.

    The angle weighs it, and the distance to the junction moves its place there and teaches its scale.
    """
    s, off, k, pss, pkk, psk, w = h
    v = pss + o.snap**2
    out = []
    for d, r in junctions((s, off - k * since, *h[2:]), roads, o):
        for t, a in roads.on(r):
            if abs(a) < o.least / 2:
                continue
            fit = -0.5 * (wrapped(turned - a) / o.sigma) ** 2 - 0.5 * d * d / v - 0.5 * math.log(v / o.snap**2)
            k2 = k + psk / v * d
            out.append((t, k2 * since, k2, pss * (1 - pss / v), pkk - psk * psk / v, psk * (1 - pss / v), w + fit))
    return out or [(*h[:6], w + o.missed)]


def thinned(hyps: list[tuple], o: Beam) -> list[tuple]:
    """Heaviest first: those on one road within merge of a heavier one add to its weight, and what is too light goes."""
    kept: list[list] = []
    for h in sorted(hyps, key=lambda h: (-h[6], h[0], h[1])):
        near = next((q for q in kept if q[0] == h[0] and abs(q[1] - h[1]) < o.merge), None)
        if near:
            near[6] += math.log1p(math.exp(h[6] - near[6]))
        elif not kept or h[6] >= kept[0][6] - o.prune:
            kept.append(list(h))
    kept = sorted(kept, key=lambda h: -h[6])[: o.most]
    top = kept[0][6]
    return [(*h[:6], h[6] - top) for h in kept]


def follow_turns(o: Beam = Beam()) -> Step:
    """Rows (n, roads, ds, yaw, x, y): a vehicle's own metres and clockwise turning since the row before. Out: n, state, offset, x, y, scale, share, hypotheses.

    The first row has the roads around (as roads_around() tells them) and the place x, y where it starts, at the beginning of which the heading is yaw. While it drives
    straight, hypotheses move on by their scale of its metres; a turn over several rows is closed by the first steady one, and branches them
    where the middle of it was. State: roads, hypotheses, heading turned so far and while steady, and the metres of the open turn, half of which lie after its middle.
    """
    last: list = [None, None]

    def roads_of(held: list) -> Roads:
        # told by the list itself, as rows that follow each other mostly have the same
        if last[0] is not held:
            last[:] = held, Roads(held)
        return last[1]

    def step(state, row):
        held, hyps, psi, steady, opened = state
        n, given, ds, yaw, x, y = row
        if held is None:
            if not given:
                return state, []
            held, roads, hyps = given, roads_of(given), []
            for s, r in roads.of.items():
                way = ((r["bx"] - r["ax"]) / r["length"], (r["by_"] - r["ay"]) / r["length"])
                off = max(0.0, min(r["length"], (x - r["ax"]) * way[0] + (y - r["ay"]) * way[1]))
                d = math.hypot(r["ax"] + way[0] * off - x, r["ay"] + way[1] * off - y)
                fit = -0.5 * (d / o.start_sigma) ** 2 - 0.5 * (wrapped(yaw - roads.heading[s]) / o.sigma) ** 2
                hyps.append((s, off, o.scale, o.start_sigma**2, o.scale_sigma**2, 0.0, fit))
            psi = steady = yaw
        else:
            roads = roads_of(held)
            psi += yaw
            hyps = [driven(h, ds, o) for h in hyps]
            turning = abs(psi - steady) > o.begin
            if opened is not None or turning:
                opened = (opened or 0.0) + ds
            if opened is not None and abs(yaw) <= o.steady:
                if abs(psi - steady) >= o.least:
                    hyps = [b for h in hyps for b in branched(h, psi - steady, opened / 2, roads, o)]
                steady, opened = psi, None
            elif opened is None:
                steady = psi
            if opened is None:
                hyps = [moved_on(h, roads, o) for h in hyps]
        hyps = thinned([tuple(h) for h in hyps], o)
        s, off, k, *_ = hyps[0]
        r, total = roads.of[s], sum(math.exp(h[6]) for h in hyps)
        f = min(1.0, off / r["length"])
        return (held, hyps, psi, steady, opened), [(n, s, off, r["ax"] + f * (r["bx"] - r["ax"]), r["ay"] + f * (r["by_"] - r["ay"]), k, 1 / total, len(hyps))]

    return step


TURNED = "state long, offset double, x double, y double, scale double, share double, hypotheses int"
TURNS_START = (None, (), 0.0, 0.0, None)


def shared_roads(step: Step, start: tuple = TURNS_START) -> Step:
    """follow_turns' step for rows (key, n, roads, ...) of many keys: a row without a key, before the others, has the roads around of all of them. Out: the key before what the step says.

    State: the roads, the key, and the step's own.
    """
    def walk(state, row):
        roads, now, inner = state
        key, n, given, *rest = row
        if key is None:
            return (given, None, start), []
        first = key != now
        inner, out = step(start if first else inner, (n, roads if first else None, *rest))
        return (roads, key, inner), [(key, *r) for r in out]

    return walk
