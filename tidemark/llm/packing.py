"""Best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scratch, small
from .tokens import encoder, vocabulary_path

SEQUENCE = 2048
END = 0


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        self.ranges[room].append((first, count))
        self._count(room, count)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to most bins with this room: first number and count."""
        first, count = self.ranges[room].pop()
        if count > most:
            self.ranges[room].append((first + most, count - most))
            count = most
        self._count(room, -count)
        return first, count

    def _count(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least room of an open bin that is at least size: up to the first right branch with bins, then down."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> np.ndarray:
    """Best-fit decreasing for counts[size] pieces of each size, as rows (size, first rank, ranks, first bin, offset, per bin).

    Equal pieces are placed together: a row puts pieces of one size, in order of their rank, into bins
    with consecutive numbers, per bin so many one after the other from the offset. The result is that of
    placing them one by one, and its length depends on the sizes, not on the number of pieces.
    """
    bins, rows, made = OpenBins(capacity), [], 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = bins.tightest(size)
            if room is None:
                # a new bin is then the tightest one until no further piece fits into it
                room, each = capacity, min(left, capacity // size)
                count = left // each
                first = made
                made += count
            else:
                each = min(left, room // size)
                first, count = bins.take(room, left // each)
            rows.append((size, rank, count * each, first, capacity - room, each))
            if room - each * size:
                bins.add(room - each * size, first, count)
            rank, left = rank + count * each, left - count * each
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, text: str, path: str, capacity: int, end: int) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 for each piece of each row."""
    def run(batches):
        own = encoder(path)
        last = np.array([end], dtype="<u4").tobytes()
        for b in small(batches):
            out = []
            texts = b.column(2).to_pylist()
            for doc, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own.encode(texts)):
                ids, at, piece = ids + last, 0, 0
                n = len(ids) // 4
                size = n % capacity or capacity
                while at < n:
                    out.append((doc, row, piece, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at, piece, size = at + size, piece + 1, capacity
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "row", "piece", "start", "length", "ids_crc32"]) if out else _none()

    def _none():
        return pa.RecordBatch.from_pydict({n: pa.array([], t) for n, t in zip(("doc_id", "row", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text (null: empty) and the end id. Documents over capacity are cut, the
    first piece taking the remainder. Repeated and missing ids are packed like others; empty in, empty out.

    Only the counts of the sizes (at most capacity numbers) reach the driver, which places them by
    best-fit decreasing. Pieces then look up their place by their rank among those of their size. Ranks come
    from square-root many buckets of a size, so pieces of one frequent size are ranked in many tasks.
    """
    with scratch() as held:
        return held.keep(cut(_placed(cut(pieces(docs, text, path or vocabulary_path(), capacity, end), "pack-pieces"), capacity), "packed"))


def _placed(cutted: DataFrame, capacity: int) -> DataFrame:
    """Pieces with their sequence and offset."""
    spark = cutted.sparkSession
    counts = {r["length"]: r["n"] for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(placed)
    buckets = max(1, math.isqrt(sum(counts.values())))
    order = F.xxhash64("row", "piece")
    keyed = cutted.withColumn("bucket", F.pmod(order, F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(local) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches):
        rows = sent.value
        wide = np.int64(1) << np.int64(42)
        keys = (capacity - rows[:, 0]) * wide + rows[:, 1]
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = rows[np.searchsorted(keys, (capacity - size) * wide + rank, side="right") - 1]
            k = rank - r[:, 1]
            cols = [*b.columns[:5], pa.array(r[:, 3] + k // r[:, 5]), pa.array(r[:, 4] + k % r[:, 5] * size)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
