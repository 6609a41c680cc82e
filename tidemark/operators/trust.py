"""Whether satellite fixes are where the vehicle is: by what it can have driven, by the shape of its way, and by where it is reckoned to be."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from tidemark.operators.stateful import Step


@dataclass(frozen=True)
class Limits:
    """Metres, seconds and microseconds. Fixed values."""

    continuity_us: int = 10_000_000
    driven_scale: float = 1.05
    fastest: float = 55.0
    walk: float = 3.0
    reach_sigmas: float = 3.0
    reach_margin: float = 20.0
    far: tuple = (8.0, 150.0)  # so many sigmas of a reckoned place, or so many metres, count as being there
    back: tuple = (4.0, 30.0)
    back_fixes: int = 5
    back_us: int = 4_000_000
    back_sigma: float = 30.0
    shape_least: float = 50.0
    shape_us: int = 60_000_000
    shape_scale: float = 0.05
    shape_sigmas: float = 3.0
    shape_margin: float = 15.0
    verify: float = 200.0
    verify_sure: float = 2000.0
    verify_tests: int = 3
    good: float = 50.0
    regain: float = 30.0
    lose_us: int = 8_000_000
    regain_us: int = 5_000_000


#: What is remembered: the last fix seen and trusted, the one trusted before in another segment, the number of segments, fixes for the shape, whether the last trusted one
#: was where the vehicle was reckoned, the episode, and what is shown.
NEW = {"seen": None, "last": None, "before": None, "segments": 0, "recent": [], "agreed": False, "episode": None, "shown": False, "good_at": None, "regain": None, "fix_at": None, "ever": False}
TRUST_START, TRUST_STATE = (None,), "memory string"
TRUSTED = "verdict string, verified boolean, shown string"


def reach(o: Limits, a: dict, b: dict) -> float:
    """How far b may be from a: driven since, or at the fastest while the speed was not known, a walk all along, and both fixes' errors."""
    passed = [max(0.0, b[k] - a[k]) for k in ("driven", "unknown")]
    return o.driven_scale * passed[0] + o.fastest * passed[1] + o.walk * max(0.0, (b["t"] - a["t"]) / 1e6) + o.reach_sigmas * math.hypot(a["sigma"], b["sigma"]) + o.reach_margin


def at_hand(places: list | None, sigma: float, limit: tuple) -> bool:
    """Whether one of the reckoned places (distance, sigma) is within the limit; without reckoning anything is."""
    return places is None or any(d <= max(limit[0] * math.hypot(s, sigma), limit[1]) for d, s in places)


def shape(o: Limits, recent: list, fix: dict) -> bool | None:
    """Whether the fixes of the segment moved as far as the vehicle since the latest fix shape_least of its own track back; null where that cannot be told."""
    for r in reversed(recent):
        if r["track"] is None or fix["track"] is None or r["track"][2] != fix["track"][2] or r["segment"] != fix["segment"]:
            return None
        own = math.dist(r["track"][:2], fix["track"][:2])
        if own >= o.shape_least:
            slack = o.shape_scale * own + o.shape_sigmas * math.hypot(r["sigma"], fix["sigma"]) + o.shape_margin
            return abs(math.hypot(r["x"] - fix["x"], r["y"] - fix["y"]) - own) <= slack
    return None


def _episode(o: Limits, e: dict, fix: dict, places: list | None, fits: bool | None) -> tuple[str, bool]:
    """The verdict on a fix during an episode, and whether its shape settled it."""
    e["tests"] += fits is True
    own_stream = e["kind"] == "spoof" and fix["segment"] == e["segment"]
    # the refused stream itself must be where a reckoning that is sure of itself has the vehicle
    back = at_hand([p for p in places if p[1] <= o.back_sigma], fix["sigma"], o.back) if own_stream and places is not None else not own_stream and at_hand(places, fix["sigma"], o.back)
    e["streak"] = [*(e["streak"] or [0, fix["t"]])] if back else None
    if back:
        e["streak"][0] += 1
        if e["streak"][0] >= o.back_fixes and fix["t"] - e["streak"][1] >= o.back_us:
            return "ok", False
    need = o.verify_sure if e["kind"] == "spoof" and e["sure"] else o.verify
    near = e["kind"] == "far" or e["sure"] or at_hand(places, fix["sigma"], o.far)
    if near and fix["driven"] - e["from"] >= need and e["tests"] >= o.verify_tests:
        return "ok", True
    return ("reacquiring" if back else "far" if e["kind"] == "far" else "untrusted"), False


def _show(o: Limits, m: dict, t: int, acc: float, usable: bool) -> str:
    """What is shown after a fix: trust is lost after lose_us without a good fix, and comes back after regain_us of usable ones; the first one counts at once."""
    apart = None if m["fix_at"] is None else t - m["fix_at"]
    m["fix_at"] = t
    if usable and acc <= o.good:
        m["good_at"] = t
    if m["shown"]:
        m["shown"] = m["good_at"] is not None and t - m["good_at"] <= o.lose_us
        m["regain"] = None if not m["shown"] else m["regain"]
    elif usable and acc <= o.regain:
        m["regain"] = t if m["regain"] is None or apart is None or apart > o.lose_us else m["regain"]
        if not m["ever"] or t - m["regain"] >= o.regain_us:
            m["shown"], m["regain"] = True, None
    else:
        m["regain"] = None
    m["ever"] |= m["shown"] and usable and acc <= o.good
    e = m["episode"]
    if e:
        return "reacquiring" if e["kind"] == "far" or e["streak"] else "untrusted"
    return "trusted" if m["shown"] else "no fix"


def trust(o: Limits = Limits()) -> Step:
    """Rows (id, t, x, y, sigma, acc, driven, unknown, tx, ty, epoch, inside, distances, sigmas). Out: id, verdict, verified, shown.

    driven and unknown are metres driven and seconds without a speed so far; tx, ty a place on the vehicle's own track, in any frame, which holds while epoch stays (NaN:
    none); distances and sigmas are of the places the vehicle is reckoned to be at (null: it cannot be reckoned).

    A fix outside, out of reach of the last trusted one, or in a stream that does not move as the vehicle does, is refused and begins a spoof episode.
    A fix after a gap, far from all reckoned places, begins a far one. A gap or a jump begins a new segment; a late fix belongs to the segment of the last one seen and is never
    itself the last. An episode ends with enough fixes in a row where the vehicle is reckoned, or once the fixes have kept its shape over a distance,
    which is longer if the reckoning agreed with the fixes before. Where a trusted segment fails by its shape, the segment trusted before it counts.
    """
    def step(state, row):
        m = json.loads(state[0] or json.dumps(NEW))
        n, t, x, y, sigma, acc, driven, unknown, tx, ty, epoch, inside, distances, sigmas = row
        places = None if distances is None else list(zip(distances, sigmas))
        track = None if math.isnan(tx) else [tx, ty, epoch]
        fix = {"t": t, "x": x, "y": y, "sigma": sigma, "driven": driven, "unknown": unknown, "track": track, "segment": m["segments"]}
        seen, late = m["seen"], m["seen"] is not None and t < m["seen"]["t"]
        apart = lambda a: math.hypot(a["x"] - x, a["y"] - y)
        if seen is None or not late and (t - seen["t"] > o.continuity_us or apart(seen) > reach(o, seen, fix)):
            m["segments"] = fix["segment"] = m["segments"] + 1
        m["seen"] = seen if late else fix

        fits, verdict, verified = None, None, False
        if not inside:
            verdict = "outside"
        elif m["last"] and apart(m["last"]) > reach(o, m["last"], fix):
            verdict = "jump"
        else:
            m["recent"] = [r for r in m["recent"] if t - r["t"] <= o.shape_us]
            fits = shape(o, m["recent"], fix)
            if fits is False:
                verdict, m["recent"] = "shape", []
                if m["last"] and m["last"]["segment"] == fix["segment"]:
                    m["last"], m["before"], m["agreed"] = m["before"], None, False
            m["recent"].append(fix)

        e = m["episode"]
        if verdict:
            again = e is not None and e["kind"] == "spoof"
            m["episode"] = {"kind": "spoof", "segment": fix["segment"], "sure": e["sure"] if again else e is None and m["agreed"], "streak": None, "tests": 0, "from": driven}
        elif e:
            verdict, verified = _episode(o, e, fix, places, fits)
        elif not (m["last"] and t - m["last"]["t"] <= o.continuity_us) and not at_hand(places, sigma, o.far):
            verdict = "far"
            m["episode"] = {"kind": "far", "segment": -1, "sure": False, "streak": None, "tests": 0, "from": driven}
        else:
            verdict = "ok"
        if verdict == "ok":
            if m["episode"]:
                m["episode"], m["shown"], m["regain"] = None, True, None
                m["good_at"] = t
            if m["last"] and m["last"]["segment"] != fix["segment"]:
                m["before"] = m["last"]
            m["last"], m["agreed"] = fix, places is not None and at_hand(places, sigma, o.back)
        shown = _show(o, m, t, acc, verdict == "ok")
        return (json.dumps(m),), [(n, verdict, verified, shown)]

    return step
