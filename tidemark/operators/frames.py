"""Frames of a vehicle bus: the times at which they were sent, and where in them the speed stands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import timeseries as ts
from tidemark.operators.stateful import Step, batch
from tidemark.operators.tables import cut, scratch

# Fixed values, microseconds and frames.
LATENCY, BREAK, FRAMES, LEAST_FRAMES = 300_000, 500_000, 200, 20
#: Frames of one id that one task walks.
STRETCH = 5000


def clamps() -> Step:
    """Rows (n, low, high, add): what the stretch so far makes of a time x, as limits and an addition: min(high, max(low, x + add))."""
    def step(state, row):
        n, low, high, add = row
        if state[0] is not None:
            a, b, c = state
            low, high, add = min(high, max(low, a + add)), min(high, max(low, b + add)), c + add
        return (low, high, add), [(n, low, high, add)]

    return step


def carried() -> Step:
    """Rows (stretch, low, high, add) of whole stretches, in order: the time before each and after it."""
    def step(state, row):
        stretch, low, high, add = row
        out = min(high, max(low, (0.0 if state[0] is None else state[0]) + add))
        return (out,), [(stretch, state[0])]

    return step


def periods(frames: DataFrame, most: int = FRAMES, least: int = LEAST_FRAMES, stretch: int = STRETCH) -> DataFrame:
    """frames (key, id, t, n, run, first) with period: the slope of the last `most` arrivals against their number, runs pooled, null below `least` of them.

    A run counts with at least two frames in reach. Whole runs in reach come from sums up to each run, the cut ones
    at both ends from sums up to each frame, so a frame needs only the frame just out of its reach, whatever its rate.
    """
    by = ["key"]
    f = frames.withColumn("j", F.col("n") - F.col("first_n")).withColumn("y", (F.col("t") - F.col("first_t")).cast("double"))
    # sums within a run up to each frame
    for name, value in (("sy", F.col("y")), ("sjy", F.col("j") * F.col("y"))):
        f = ts.running_sum(f, [*by, "run"], ["n"], value, name, stretch)
    f = cut(f)
    ends = f.groupBy("key", "run").agg(F.max_by(F.struct("j", "sy", "sjy"), "n").alias("e"))

    def scatter(m: Column, sy: Column, sjy: Column, sj: Column) -> Column:
        return sjy - sj / m * sy

    spread = lambda m: m * (m * m - 1) / 12.0
    m = F.col("e.j") + 1
    whole = ends.select("key", "run", F.when(m >= 2, m).otherwise(0).alias("wn"), F.when(m >= 2, scatter(m, F.col("e.sy"), F.col("e.sjy"), m * (m - 1) / 2.0)).otherwise(0.0).alias("wxy"), F.when(m >= 2, spread(m)).otherwise(0.0).alias("wxx"), F.col("e").alias("end"))
    for name, value in (("qn", "wn"), ("qxy", "wxy"), ("qxx", "wxx")):
        whole = ts.running_sum(whole, by, ["run"], F.col(value), name, stretch)
    whole = cut(whole)
    # the oldest frame in reach, with what its run has before it and up to its end
    old = f.select("key", "run", (F.col("n") + most - 1).alias("n"), F.struct("j", "y", "sy", "sjy").alias("o")).join(whole.select("key", "run", "end", F.struct("qn", "qxy", "qxx").alias("upto")), ["key", "run"]).withColumnRenamed("run", "old_run")
    now = f.join(whole.select("key", "run", F.struct((F.col("qn") - F.col("wn")).alias("qn"), (F.col("qxy") - F.col("wxy")).alias("qxy"), (F.col("qxx") - F.col("wxx")).alias("qxx")).alias("before")), ["key", "run"])
    met = now.join(old, ["key", "n"], "left")
    # within one run from a (exclusive sums) to b
    a_j = F.when(F.col("old_run") == F.col("run"), F.col("o.j")).otherwise(F.lit(0))
    a_sy = F.when(F.col("old_run") == F.col("run"), F.col("o.sy") - F.col("o.y")).otherwise(F.lit(0.0))
    a_sjy = F.when(F.col("old_run") == F.col("run"), F.col("o.sjy") - F.col("o.j") * F.col("o.y")).otherwise(F.lit(0.0))

    def part(b_j, b_sy, b_sjy, a_j, a_sy, a_sjy):
        m = b_j - a_j + 1
        sj = m * (a_j + b_j) / 2.0
        return F.when(m >= 2, m).otherwise(0), F.when(m >= 2, scatter(m, b_sy - a_sy, b_sjy - a_sjy, sj)).otherwise(0.0), F.when(m >= 2, spread(m)).otherwise(0.0)

    last = part(F.col("j"), F.col("sy"), F.col("sjy"), a_j, a_sy, a_sjy)
    other = F.coalesce(F.col("old_run") != F.col("run"), F.lit(False))
    head = part(F.col("end.j"), F.col("end.sy"), F.col("end.sjy"), F.col("o.j"), F.col("o.sy") - F.col("o.y"), F.col("o.sjy") - F.col("o.j") * F.col("o.y"))
    # all runs before this one if nothing is out of reach yet, else those between the oldest one and this one
    between = [F.when(F.col("old_run").isNull(), F.col(f"before.{q}")).when(other, F.col(f"before.{q}") - F.col(f"upto.{q}")).otherwise(0) for q in ("qn", "qxy", "qxx")]
    n, xy, xx = (x + F.when(other, h).otherwise(0) + b for x, h, b in zip(last, head, between))
    return met.withColumn("period", F.when((n >= least) & (xx > 0), xy / xx)).select(*frames.columns, "period")


def retimed(frames: DataFrame, windows: DataFrame | None = None, latency: int = LATENCY, apart: int = BREAK, stretch: int = STRETCH) -> DataFrame:
    """frames (bus, id, frame, t: arrival in microseconds) with sent: when the bus carried each, from the id's own period.

    A frame is one period after the one before, but not after it arrived nor longer than latency before that. The period is that of
    the last frames of the id, runs between breaks pooled; while there are too few, arrival counts. The first
    frame after a break (apart without a frame, or the end_t of a window of windows (bus, end_t) in between) arrived when it was sent.

    Each frame makes a time x into min(arrival, max(arrival - latency, x + period)), and such steps combine to one
    of the same kind: stretches of an id are combined apart, one row a stretch is walked in order, and then each
    stretch from its own beginning, so an id with most of the frames is many tasks.
    """
    with scratch() as held:
        f = frames.select("bus", "id", "frame", "t").withColumn("key", F.concat_ws("#", "bus", "id"))
        f = ts.numbered(f, ["key"], ["t", "frame"], "n")
        if windows is not None:
            marks = windows.select("bus", F.col("end_t").alias("t"))
            f = ts.around(f, marks.withColumn("at", F.col("t")), ["bus"], "t", ["at"], back="closed", ahead=None)
            # a window that ends at the frame's own time still holds it
            f = f.withColumn("closed", F.when(F.col("closed.t") < F.col("t"), F.col("closed.t")))
        else:
            f = f.withColumn("closed", F.lit(None).cast("long"))
        f = ts.breaks(f, ["key"], ["t", "frame"], ["t"], lambda p: p.isNull() | (F.col("t") - p["t"] > apart) | F.coalesce(F.col("closed") >= p["t"], F.lit(False)), "run")
        f = cut(f)
        firsts = f.groupBy("key", "run").agg(F.min("n").alias("first_n"), F.min("t").alias("first_t"))
        f = periods(f.join(firsts, ["key", "run"]).drop("closed"), stretch=stretch)
        first = F.col("n") == F.col("first_n")
        # the period stays from before where there is none
        own = f.withColumn("_known", F.when(~first, F.col("period"))).withColumn("stretch", F.floor(F.col("n") / stretch).cast("long"))
        inside = Window.partitionBy("key", "stretch").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        over = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        ends = own.groupBy("key", "stretch").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("n"))).alias("_e")).select("key", "stretch", F.last("_e", ignorenulls=True).over(over).alias("_c"))
        own = own.withColumn("_in", F.last("_known", ignorenulls=True).over(inside)).join(ends, ["key", "stretch"], "left")
        known = F.coalesce("_in", "_c")
        t = F.col("t").cast("double")
        own = own.withColumn("low", F.when(first | known.isNull(), t).otherwise(t - latency)).withColumn("high", t).withColumn("add", F.coalesce(known, F.lit(0.0)))
        own = cut(own.withColumn("task", F.concat_ws("#", "key", "stretch")).select("bus", "id", "frame", "t", "key", "stretch", "task", "n", "low", "high", "add"))
        made = batch(own, "task", ["n", "low", "high", "add"], clamps(), (None,), "task string, n long, low double, high double, add double", ["n"])
        last = made.groupBy("task").agg(F.max_by(F.struct("low", "high", "add"), "n").alias("s")).join(own.select("key", "stretch", "task").distinct(), "task").select("key", "stretch", "s.*")
        begin = batch(last, "key", ["stretch", "low", "high", "add"], carried(), (None,), "key string, stretch long, x double", ["stretch"])
        done = own.join(made.select("task", "n", F.col("low").alias("_l"), F.col("high").alias("_h"), F.col("add").alias("_a")), ["task", "n"]).join(begin, ["key", "stretch"])
        sent = F.least(F.col("_h"), F.greatest(F.col("_l"), F.coalesce("x", F.lit(0.0)) + F.col("_a")))
        return held.keep(cut(done.select("bus", "id", "frame", "t", sent.alias("sent"))))


# Widths and shifts of fields tried, and what a speed must do. Speeds in km/h.
WIDTHS, SHIFTS = (16, 15, 14, 13, 12, 11), (0, 1, 2, 3, 4)
BRACKET, STEADY_US, STEADY_KPH, MOVING_KPH = 800_000, 1_200_000, 2.0, 5.0
LEAST_PAIRS, LEAST_R, NEAR_R, COUNTS, STAND_KPH, LEAST_STAND, SAME_SCALE = 120, 0.995, 0.001, (0.002, 1.0), 1.5, 3, 0.03


#: (little, shift, bits) of the fields over two neighbouring bytes of a frame.
KINDS = [(little, shift, bits) for little in (False, True) for shift in SHIFTS for bits in WIDTHS if shift + bits <= 16]
#: Ids of buses whose sums one task holds before it sends them on.
HELD = 500


def _weights() -> np.ndarray:
    """What each bit of two bytes, the lowest of the first byte first, adds to the fields of KINDS."""
    out = np.zeros((16, len(KINDS)))
    for i, (little, shift, bits) in enumerate(KINDS):
        for k in range(shift, shift + bits):
            out[k if little else (k + 8) % 16, i] = 2.0 ** (k - shift)
    return out


def _moments(z: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Number, means and centred products of the rows that are there, for each word: z (word, row, value), there (word, row)."""
    n = there.sum(axis=1).astype(float)
    z = np.where(there[:, :, None], z, 0.0)
    mean = z.sum(axis=1) / np.maximum(n, 1)[:, None]
    z = np.where(there[:, :, None], z - mean[:, None, :], 0.0)
    return [n, mean, np.matmul(z.transpose(0, 2, 1), z)]


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of both sets of rows."""
    n = a[0] + b[0]
    part, d = b[0] / np.maximum(n, 1), b[1] - a[1]
    return [n, a[1] + part[:, None] * d, a[2] + b[2] + (a[0] * part)[:, None, None] * d[:, :, None] * d[:, None, :]]


def _bits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of frames (row, byte), with NaN for none: the 16 bits of each two neighbouring bytes (word, row, bit), and whether both are there (word, row)."""
    there = ~np.isnan(data)
    own = (np.where(there, data, 0).astype(np.int64)[:, :, None] >> np.arange(8) & 1).astype(float)
    words = np.concatenate([own[:, :-1], own[:, 1:]], axis=2).transpose(1, 0, 2)
    return words, (there[:, :-1] & there[:, 1:]).T


def layout_sums(pairs: DataFrame) -> DataFrame:
    """bus, id, byte, little, shift, bits and, of the pairs (bus, id, x, share, before, after) a task read: n (with x), fitted and the moments of x and the field, stood and stand (mean without x).

    A field is a sum over its bits, and so is its place between two frames; so means and products of the bits
    of two neighbouring bytes give those of every field that lies in them, and no pair is laid out field by field.
    """
    kinds, weights = KINDS, _weights()

    def rows(held):
        names = ["bus", "id", "byte", "little", "shift", "bits", "n", "fitted", "mx", "my", "sxx", "sxy", "syy", "stood", "stand"]
        out = [[] for _ in names]
        for (bus, id_, _), (n, fit, stand) in held.items():
            for byte in range(len(fit[0])):
                my, sxy = fit[1][byte, 1:] @ weights, fit[2][byte, 0, 1:] @ weights
                syy = np.einsum("ik,ij,jk->k", weights, fit[2][byte, 1:, 1:], weights)
                still = stand[1][byte] @ weights
                for i, kind in enumerate(kinds):
                    for to, x in zip(out, (bus, id_, byte, *kind, n, int(fit[0][byte]), fit[1][byte, 0], my[i], fit[2][byte, 0, 0], sxy[i], syy[i], int(stand[0][byte]), still[i])):
                        to.append(x)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    def run(batches):
        held = {}
        for b in batches:
            lengths = pc.list_value_length(b.column(4)).to_numpy(zero_copy_only=False)
            groups = {}
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lengths)):
                groups.setdefault(key, []).append(i)
            types[:2] = b.column(0).type, b.column(1).type
            x, share = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            for key, at in groups.items():
                if key[2] < 2:
                    continue
                at = np.array(at)
                (u, u_there), (v, v_there) = (_bits(b.column(i).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)) for i in (4, 5))
                moving = ~np.isnan(x[at])
                z = u + (v - u) * share[at][None, :, None]
                z = np.concatenate([np.broadcast_to(x[at][None, :, None], (*z.shape[:2], 1)), z], axis=2)
                new = int(moving.sum()), _moments(z[:, moving], (u_there & v_there)[:, moving]), _moments(u[:, ~moving], u_there[:, ~moving])
                old = held.get(key)
                held[key] = new if old is None else (old[0] + new[0], _merged(old[1], new[1]), _merged(old[2], new[2]))
            if len(held) > HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    types = [None, None, pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.float64()]
    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("bus", "id")}
    schema = f"bus {kind['bus']}, id {kind['id']}, byte int, little boolean, shift int, bits int, n long, fitted long, mx double, my double, sxx double, sxy double, syy double, stood long, stand double"
    return pairs.select("bus", "id", "x", "share", "before", "after").mapInArrow(run, schema)


def speed_pairs(frames: DataFrame, polls: DataFrame, bracket: int = BRACKET) -> DataFrame:
    """bus, id, kph, steady, before, after, share: polls (bus, t, kph) between two frames (bus, id, t, data) of an id at most bracket apart.

    Polls meet the gaps between frames by stretches of time as long as the longest gap.
    """
    f = ts.previous(frames.select("bus", "id", "t", "data"), ["bus", "id"], ["t"], ["t", "data"], name="p").filter("p is not null")
    f = f.filter((F.col("t") - F.col("p.t") <= bracket) & (F.size("data") == F.size("p.data")))
    f = f.withColumn("_b", F.explode(F.sequence(F.floor(F.col("p.t") / bracket).cast("long"), F.floor((F.col("t") - 1) / bracket).cast("long"))))
    q = ts.previous(polls.select("bus", "t", "kph"), ["bus"], ["t"], ["t", "kph"], name="q")
    steady = F.coalesce((F.col("t") - F.col("q.t") <= STEADY_US) & (F.abs(F.col("kph") - F.col("q.kph")) <= STEADY_KPH), F.lit(False))
    q = q.select("bus", F.col("t").alias("at"), "kph", steady.alias("steady"), F.floor(F.col("t") / bracket).cast("long").alias("_b"))
    met = f.join(q, ["bus", "_b"]).filter("at >= p.t and at < t")
    return met.select("bus", "id", "kph", "steady", F.col("p.data").alias("before"), F.col("data").alias("after"), ((F.col("at") - F.col("p.t")) / (F.col("t") - F.col("p.t"))).alias("share"))


def speed_fields(pairs: DataFrame, least_pairs: int = LEAST_PAIRS) -> DataFrame:
    """bus, id, byte, little, shift, bits, kph_per_count, zero, r: the fields of each id that read as a speed.

    Every layout gets its sums from those of the bits it is made of (`layout_sums`): the task that reads the pairs sends a
    row for each layout. A field must follow the polls in a line, in steps a speed has, and stand still where the car does. Of
    the variants of one pair of bytes that fit nearly alike the one without shift, then the widest, is taken; of
    fields that share a byte, or have another scale than the best one, the better.
    """
    moving = (F.col("kph") >= MOVING_KPH) & F.col("steady")
    rows = pairs.filter(moving | (F.col("kph") == 0)).withColumn("x", F.when(moving, F.col("kph").cast("double")))
    layout = ["byte", "little", "shift", "bits"]
    all_of = Window.partitionBy("bus", "id", *layout)
    sums = layout_sums(rows)
    for c in ("mx", "my"):
        sums = sums.withColumn(f"_{c}", F.sum(F.col("fitted") * F.col(c)).over(all_of) / F.nullif(F.sum("fitted").over(all_of), F.lit(0)))
    product = lambda s, a, b: F.sum(F.col(s) + F.col("fitted") * (F.col(a) - F.col(f"_{a}")) * (F.col(b) - F.col(f"_{b}")))
    fit = sums.groupBy("bus", "id", *layout).agg(
        F.sum("n").alias("n"), product("sxx", "mx", "mx").alias("sxx"), product("sxy", "mx", "my").alias("sxy"), product("syy", "my", "my").alias("syy"),
        F.max("_mx").alias("mx"), F.max("_my").alias("my"), F.sum("stood").alias("stood"), (F.sum(F.col("stood") * F.col("stand")) / F.nullif(F.sum("stood"), F.lit(0))).alias("stand"),
    )
    fit = fit.filter("sxx > 0 and syy > 0").withColumn("a", F.col("sxy") / F.col("sxx")).withColumn("b", F.col("my") - F.col("a") * F.col("mx")).withColumn("r", F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    fit = fit.filter("a > 0")
    per = F.lit(1.0) / F.col("a")
    zero = F.when(F.col("stood") >= LEAST_STAND, F.col("stand"))
    ok = fit.filter((F.col("n") >= least_pairs) & (F.col("r") >= LEAST_R) & per.between(*COUNTS))
    ok = ok.withColumn("zero", F.coalesce(zero, F.col("b"))).filter(zero.isNull() | (F.abs(zero - F.col("b")) * per <= STAND_KPH)).select("bus", "id", *layout, per.alias("kph_per_count"), "zero", "r")
    word = Window.partitionBy("bus", "id", "byte", "little")
    near = ok.withColumn("_best", F.max("r").over(word)).filter(F.col("r") >= F.col("_best") - NEAR_R)
    plain = near.withColumn("_k", F.row_number().over(word.orderBy("shift", F.desc("bits")))).filter("_k = 1").drop("_best", "_k")
    # at most 14 words in a frame
    each = plain.groupBy("bus", "id").agg(F.array_sort(F.collect_list(F.struct((-F.round("r", 12)).alias("o"), "byte", "little", "shift", "bits", "kph_per_count", "zero", "r"))).alias("fields"))
    none = F.slice("fields", F.lit(1), F.lit(0))

    def take(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: F.abs(k["byte"] - x["byte"]) < 2) | ((F.size(kept) > 0) & F.coalesce(F.abs(x["kph_per_count"] / F.get(kept, F.lit(0))["kph_per_count"] - 1) > SAME_SCALE, F.lit(False)))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    return each.select("bus", "id", F.explode(F.aggregate("fields", none, take)).alias("f")).select("bus", "id", "f.*").drop("o")


def speed_message(fields: DataFrame) -> DataFrame:
    """bus, id, fields, r: of each bus the id with most fields, then the best mean correlation, then the smallest number."""
    each = fields.groupBy("bus", "id").agg(F.count("*").alias("fields"), F.avg("r").alias("r"))
    first = Window.partitionBy("bus").orderBy(F.desc("fields"), F.desc(F.round("r", 9)), "id")
    return each.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
