"""Ordered state machines as plain step functions: one code path for batch (applyInPandas) and streams."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step: state and row in, state and output rows out. State is a flat tuple; arrays in it reach the next micro-batch of a stream as lists.
Step = Callable[[tuple, tuple], tuple[tuple, list[tuple]]]


def batch(df: DataFrame, by: str, cols: list[str], step: Step, start: tuple, schema: str, order: list[str]) -> DataFrame:
    """Run a step over each key's rows in order.

    Keys are walked in sorted partitions, so a key of any length needs no more memory than its state. Missing
    numbers reach the step as NaN, other missing values as None; rows without an order come last.
    """
    kinds = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        now, state, first = None, start, True
        for b in batches:
            columns = [c.fill_null(math.nan) if pa.types.is_floating(c.type) else c for c in b.columns]
            out = []
            for key, *row in zip(*(c.to_pylist() for c in columns)):
                if first or key != now:
                    now, state, first = key, start, False
                state, rows = step(state, tuple(row))
                out += [(key, *r) for r in rows]
            names = arrow.names
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow], names)

    # a number of its own, as few megabytes of rows may be many seconds of steps: without it the runtime puts small partitions together
    own = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by, *(F.col(c).asc_nulls_last() for c in order))
    return own.select(by, *cols).mapInArrow(run, kinds)


def stream(df: DataFrame, by: str, cols: list[str], step: Step, start: tuple, schema: str, state_schema: str, order: list[str]) -> DataFrame:
    """The same step on a stream: rows of a micro-batch are ordered per key, the state is kept between batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        out: list[tuple] = []
        for row in pd.concat(list(frames)).sort_values(order, kind="stable")[cols].itertuples(index=False, name=None):
            now, rows = step(tuple(now), row)
            out += [(key[0], *r) for r in rows]
        state.update(tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in now))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(by).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def thin(hz: float) -> Step:
    """Keep a row (id, t) if it is at least 0.95 / hz after the last KEPT one."""
    least = int(0.95e6 / hz)

    def step(state, row):
        if state[0] is not None and row[1] - state[0] < least:
            return state, []
        return (row[1],), [(row[0],)]

    return step


def chunks(amount: float) -> Step:
    """Number of the chunk of each row (id, value): a chunk closes when its sum reaches amount."""
    def step(state, row):
        number, total = state
        out = [(row[0], number)]
        total += row[1]
        return ((number + 1, 0.0) if total >= amount else (number, total)), out

    return step


def legs(amount: float) -> Step:
    """Chunks of rows (t, value) that reached amount, as each closes: its number, its sum in the order of its rows, and its first and last time."""
    def step(state, row):
        number, total, since = state
        t, value = row
        since = t if since is None else since
        total += value
        if total >= amount:
            return (number + 1, 0.0, None), [(number, total, since, t)]
        return (number, total, since), []

    return step


def odometry(metres: float, wait_us: int) -> Step:
    """Chunks of rows (id, t, source, ds): one closes once it is metres long or lasted wait_us, and before the source changes. Out: id, chunk."""
    def step(state, row):
        number, length, took, source, last = state
        _, t, kind, ds = row
        dt = 0 if last is None else t - last
        if source is not None and (kind != source or length >= metres or took >= wait_us):
            number, length, took = number + 1, 0.0, 0
        return (number, length + ds, took + dt, kind, t), [(row[0], number)]

    return step


def hysteresis(enter: float, leave: float) -> Step:
    """Rows (id, value) where a warning goes on above enter or off at or below leave."""
    def step(state, row):
        on = row[1] > enter if not state[0] else row[1] > leave
        return (on,), ([(row[0], on)] if on != state[0] else [])

    return step


def engine(running: float = 400.0, stopped: float = 250.0, times: int = 2) -> Step:
    """Debounced engine state of rpm rows (id, rpm): two confirmations, and a stale repeat counts as off."""
    def step(state, row):
        current, candidate, count, last, repeats = state
        rpm = row[1]
        repeats = repeats + 1 if rpm == last and rpm >= stopped else 0
        wish = "off" if rpm < stopped or repeats >= times else "running" if rpm >= running else candidate
        count = count + 1 if wish == candidate else 1
        candidate = wish
        out = []
        if candidate and candidate != current and (count >= times or repeats >= times):
            current = candidate
            out.append((row[0], current))
        return (current, candidate, count, rpm, repeats), out

    return step


def trips(parked_us: int = 300_000_000, moving: int = 2) -> Step:
    """Trips from speed rows (id, t, speed): start at the second moving sample in a row, end after a pause of parked_us."""
    def step(state, row):
        start, first, count, still = state
        _, t, speed = row
        out = []
        if start is not None and still is not None and t - still >= parked_us:
            out.append((start, still, "parked_timeout"))
            start = still = first = None
            count = 0
        if speed > 0:
            first = t if count == 0 else first
            count, still = count + 1, None
            if start is None and count >= moving:
                start = first
        else:
            count = 0
            still = t if still is None else still
        return (start, first, count, still), out

    return step


def kept_wheels() -> Step:
    """Rows (id, t, wheels in m/s): whether a reading counts. One beyond range or with too much between its wheels does not, nor one that jumps from the last that counted.

    A jump is more than a little and what the hardest braking can do since, within a third of a second. State: time and wheels of the last kept. Fixed values.
    """
    def step(state, row):
        at, last = state
        n, t, wheels = row
        v = [math.inf if w is None or w != w else abs(w) for w in wheels or [math.inf]]
        ok = max(v) <= 300 / 3.6 and max(v) - min(v) <= 3 / 3.6 + 0.5 * sum(v) / len(v)
        if ok and at is not None and t - at <= 300_000:
            ok = all(abs(a - b) <= 2 / 3.6 + 14 * max(0, t - at) / 1e6 for a, b in zip(v, last))
        return ((t, v) if ok else state), [(n, ok)]

    return step


def recent_far(apart: float, within_us: int) -> Step:
    """Rows (id, t, value): the latest earlier row of the last while whose value is at least `apart` away. Out: id, the other's id or null.

    Of what went before only rows are held that no later one beats in height, or in depth; rows of one time do not count for one another.
    State: rows (t, id, value) falling in value, rows rising in value, and the present time with the rows of it.
    """
    def latest(stack, far):
        # values are sorted along the stack: the last row that is far enough stands before the first that is not
        lo, hi = 0, len(stack)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if far(stack[mid][2]) else (lo, mid)
        return stack[lo - 1][:2] if lo else None

    def pushed(stack, row, beaten):
        k = len(stack)
        while k and beaten(stack[k - 1][2], row[2]):
            k -= 1
        return (*stack[:k], row)

    def step(state, row):
        high, low, now, same = state
        n, t, value = row
        if t != now:
            for s in same:
                high, low = pushed(high, s, lambda a, b: a <= b), pushed(low, s, lambda a, b: a >= b)
            high, low = (tuple(r for r in stack if t - r[0] <= within_us) for stack in (high, low))
            now, same = t, ()
        # the difference is what is held against apart: value + apart is rounded elsewhere
        found = [f for f in (latest(high, lambda v: v - value >= apart), latest(low, lambda v: value - v >= apart)) if f]
        return (high, low, now, (*same, (t, n, value))), [(n, max(found)[1] if found else None)]

    return step


def ewma(tau_us: int) -> Step:
    """Exponentially weighted mean of rows (id, t, value) with time constant tau."""
    def step(state, row):
        t, mean = state
        if t is None:
            return (row[1], row[2]), [(row[0], row[2])]
        keep = math.exp(-(row[1] - t) / tau_us)
        mean = keep * mean + (1 - keep) * row[2]
        return (row[1], mean), [(row[0], mean)]

    return step


def kalman(drift: float, noise: float, unit_us: int) -> Step:
    """Local level of rows (id, t, value): its variance grows by drift each unit, a reading has variance noise."""
    def step(state, row):
        t, level, spread = state
        if t is None:
            return (row[1], row[2], noise), [(row[0], row[2], noise)]
        spread = spread + drift * ((row[1] - t) / unit_us)
        gain = spread / (spread + noise)
        level = level + gain * (row[2] - level)
        spread = (1 - gain) * spread
        return (row[1], level, spread), [(row[0], level, spread)]

    return step


def particles(count: int, drift: float, noise: float, unit_us: int) -> Step:
    """The same level by a bootstrap filter of count particles: systematic resampling below half the effective size.

    Chance is drawn from each row's id, so repeated runs, batches and streams agree. State: time, levels, weights.
    """
    def step(state, row):
        rng = np.random.default_rng(row[0])
        if state[0] is None:
            x = row[2] + np.sqrt(noise) * rng.standard_normal(count)
            w = np.full(count, 1 / count)
        else:
            x = np.asarray(state[1]) + np.sqrt(drift * (row[1] - state[0]) / unit_us) * rng.standard_normal(count)
            v = np.log(np.asarray(state[2])) - (row[2] - x) ** 2 / (2 * noise)
            w = np.exp(v - v.max()) + 1e-300
            w /= w.sum()
            if 1 / (w @ w) < count / 2:
                at = np.searchsorted(np.cumsum(w), (rng.random() + np.arange(count)) / count)
                x, w = x[np.minimum(at, count - 1)], np.full(count, 1 / count)
        return (row[1], x, w), [(row[0], float(w @ x))]

    return step


def held_limit(hold_us: int) -> Step:
    """Rows (id, t, value) where the shown value changes: a new one shows after it held so long, a return cancels it."""
    def step(state, row):
        shown, wish, since = state
        _, t, value = row
        if shown is None:
            return (value, None, None), [(row[0], value)]
        if value == shown:
            return (shown, None, None), []
        if value != wish:
            return (shown, value, t), []
        if t - since >= hold_us:
            return (value, None, None), [(row[0], value)]
        return state, []

    return step


def calibration(spread: float, drift: float, noise: float) -> Step:
    """Rows (id, y, a, b): the two factors of y = p a + q b by a Kalman filter from (1, 0); q wanders by drift a row. Out: id, p, q."""
    def step(state, row):
        p, q, pp, pq, qq = state
        _, y, a, b = row
        qq += drift
        ha, hb = pp * a + pq * b, pq * a + qq * b
        s = a * ha + b * hb + noise
        e = y - p * a - q * b
        p, q = p + ha / s * e, q + hb / s * e
        return (p, q, pp - ha * ha / s, pq - ha * hb / s, qq - hb * hb / s), [(row[0], p, q)]

    return step


def guidance(off: float, hold_us: int) -> Step:
    """Rows (id, t, distance) at which the state changes: on a route, leaving it beyond off, off it once that lasted hold_us."""
    def step(state, row):
        said, since = state
        if row[2] <= off:
            since, now = None, "on"
        else:
            since = row[1] if since is None else since
            now = "off" if row[1] - since >= hold_us else "leaving"
        return (now, since), ([(row[0], now)] if now != said else [])

    return step
