"""Windows, sessions, once-per-key rows and rows put back in order on event-time streams."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.stateful import Step, batch


def tumbling(df: DataFrame, ts: str, by: list[str], width: str, late: str, *aggregates) -> DataFrame:
    """Aggregates of fixed windows; rows later than late are dropped. Works on tables too, where nothing is late."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(*aggregates)


def sliding(df: DataFrame, ts: str, by: list[str], width: str, slide: str, late: str, *aggregates) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by).agg(*aggregates)


def sessions(df: DataFrame, ts: str, by: list[str], gap: str, late: str, *aggregates) -> DataFrame:
    """Aggregates of runs without a gap."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(*aggregates)


def once(df: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, folder: str) -> None:
    """Append what a stream has now to a folder of Parquet files, exactly once over restarts."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()

def reorder(delays: dict[str, int]) -> Step:
    """Rows (id, t, source) in the order they came: each is held until the newest time is its delay ahead, and then goes out in order of time. Out: id, t, late.

    The delay is the longest of the sources heard so far, so it grows when a slow one is heard first. A row older than what was let out
    goes out at once, as late. A row without a time lets all out that is held. State: newest time, time let out, delay, times and ids held.
    """
    def step(state, row):
        newest, out_to, delay, times, ids = state
        n, t, source = row
        held = sorted(zip(times, ids))
        if t is None or t != t:
            return (newest, newest, delay, [], []), [(i, s, False) for s, i in held]
        delay = max(delay, delays[source])
        if out_to is not None and t <= out_to:
            return (newest, out_to, delay, times, ids), [(n, t, True)]
        insort(held, (t, n))
        newest = t if newest is None else max(newest, t)
        out_to = newest - delay if out_to is None else max(out_to, newest - delay)
        k = bisect_right(held, out_to, key=lambda h: h[0])
        rest = held[k:]
        return (newest, out_to, delay, [s for s, _ in rest], [i for _, i in rest]), [(i, s, False) for s, i in held[:k]]

    return step


#: State before the first row, and its schema on streams.
REORDER_START, REORDER_STATE = (None, None, 0, [], []), "newest long, out_to long, delay long, times array<long>, ids array<long>"


def reordered(df: DataFrame, by: str, arrival: str, row_id: str, t: str, source: str, delays: dict[str, int]) -> DataFrame:
    """by, id, t, late, in the order of time but for what came too late: reorder() over a table of arrivals; all that is held at the end goes out."""
    rows = df.select(by, F.col(row_id).alias("id"), F.col(t).cast("long").alias("t"), F.col(source).alias("source"), F.col(arrival).alias("_a"), F.lit(0).alias("_end"))
    ends = rows.groupBy(by).agg(F.max("_a").alias("_a")).select(by, F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("source"), "_a", F.lit(1).alias("_end"))
    return batch(rows.unionByName(ends), by, ["id", "t", "source"], reorder(delays), REORDER_START, f"{by} {dict(df.dtypes)[by]}, id long, t long, late boolean", ["_a", "_end", "id"])


def reordered_stream(df: DataFrame, by: str, row_id: str, t: str, source: str, delays: dict[str, int], longest: str) -> DataFrame:
    """The same on a stream, whose time is the timestamp t: rows of a micro-batch count as coming in the order of their id.

    What is held goes out when the watermark, `longest` behind the newest row of all keys, passes it, though its own key be silent.
    """
    step = reorder(delays)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else REORDER_START
        out: list[tuple] = []
        if state.hasTimedOut:
            now, out = step(now, (None, None, None))
        else:
            got = pd.concat(list(frames)).sort_values("id", kind="stable")
            for row in zip(got["id"].tolist(), got["us"].tolist(), got["source"].tolist()):
                now, rows = step(now, row)
                out += rows
        state.update(now)
        if now[3]:
            state.setTimeoutTimestamp(max(now[3][-1] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[by, "id", "t", "late"])

    rows = df.withWatermark(t, longest).select(by, F.col(row_id).cast("long").alias("id"), F.unix_micros(t).alias("us"), F.col(source).alias("source"), t)
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} {dict(df.dtypes)[by]}, id long, t long, late boolean", REORDER_STATE, "append", GroupStateTimeout.EventTimeTimeout)
