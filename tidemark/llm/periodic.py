"""Stretches of a text in which the same few words come again and again, by divide and conquer on interned words."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Words that all lags of a block are compared at once; blocks in which a lag still agrees get the Z-function.
TOGETHER = 12


def z_function(s: list) -> list[int]:
    """For each place the length of the longest common prefix of s and its rest from there; of all of s at 0."""
    n = len(s)
    z = [n] * min(n, 1) + [0] * (n - 1)
    lo = hi = 0
    for i in range(1, n):
        k = min(z[i - lo], hi - i) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > hi:
            lo, hi = i, i + k
        z[i] = k
    return z


def _agreeing(ids: np.ndarray, first: np.ndarray, step: int, most: np.ndarray) -> dict[int, list[int]]:
    """Block to lags p up to most whose first p words, read from first on in direction step, equal the next p.

    Lags up to TOGETHER are settled here; a block in which a longer one agrees so far is mapped to [] alone.
    """
    block = np.repeat(np.arange(len(first)), most)
    p = np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1
    at = first[block]
    found: dict[int, list[int]] = {}
    for k in range(TOGETHER):
        same = ids[at] == ids[at + step * p]
        block, p, at = block[same], p[same], at[same] + step
        if not len(block):
            return found
        for b in block[p == k + 1].tolist():
            found.setdefault(b, []).append(k + 1)
        longer = p > k + 1
        block, p, at = block[longer], p[longer], at[longer]
    for b in set(block.tolist()):
        found[b] = []
    return found


def _squares(words: list, lags: list[int] | None) -> list[tuple[int, int]]:
    """(p, common prefix with lag p) for lags at which words starts with a square, but for those that a shorter lag's stretch explains."""
    if lags is not None:
        ends = []
        for p in lags:
            k = p
            while p + k < len(words) and words[k] == words[p + k]:
                k += 1
            ends.append((p, k))
    else:
        z = z_function(words)
        ends = [(p, z[p]) for p in range(1, len(words) // 2 + 1) if z[p] >= p]
    kept, reach = [], 0
    for p, k in ends:
        # a square within the stretch of a shorter lag has that lag's period, and so does its whole stretch
        if 2 * p > reach:
            kept.append((p, k))
            reach = max(reach, p + k)
    return kept


def repetitions(ids: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> dict[int, dict[tuple[int, int], int]]:
    """For each text that has any, its maximal stretches: {(first word, length): smallest period}.

    Text k is ids[bounds[k]:bounds[k + 1]]. A stretch has at least `least` words and `times` (4 or more) periods.
    Blocks are halved level by level, all texts at once. A stretch is found in the one block whose middle it is
    the first to hold: on one side of that it has two periods, so the right half begins, or the left half ends,
    with a square, which the Z-function of that half shows. What goes on beyond the block was found above. Work
    and memory are of the order of n log n, whatever repeats.
    """
    if times < 4 or least < 1:
        raise ValueError("stretches of fewer than four periods need not show as a square at a middle")
    out: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    text = np.flatnonzero(np.diff(bounds) >= max(least, times))
    lo, hi = bounds[text], bounds[text + 1]
    while len(lo):
        mid = (lo + hi) // 2
        for right in (True, False):
            # words read away from the middle, on this side; the others on the other side
            first, step, size = (mid, 1, hi - mid) if right else (mid - 1, -1, mid - lo)
            for b, lags in _agreeing(ids, first, step, size // 2).items():
                a, m, z, top, end = (int(x) for x in (lo[b], mid[b], hi[b], bounds[text[b]], bounds[text[b] + 1]))
                words, half = ids[a:z].tolist(), m - a
                for p, k in _squares(words[half:] if right else words[:half][::-1], lags or None):
                    # the same lag on over the middle
                    e, s = (m + p + k, half) if right else (half, m - p - k)
                    if right:
                        while s and words[s - 1] == words[s - 1 + p]:
                            s -= 1
                        s += a
                    else:
                        while e < z - a and words[e] == words[e - p]:
                            e += 1
                        e += a
                    if e - s < max(least, times * p) or s == a > top and ids[s - 1] == ids[s - 1 + p] or e == z < end and ids[e] == ids[e - p]:
                        continue
                    key = (s - top, e - s)
                    stretches = out[int(text[b])]
                    stretches[key] = min(p, stretches.get(key, p))
        lo, hi, text = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([text, text])
        large = hi - lo >= max(least, times)
        lo, hi, text = lo[large], hi[large], text[large]
    return dict(out)


def find_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start, length, period in words, by start then period), collapsed.

    Words are what stands between ASCII white space. A run is a stretch with smallest period q and at least
    max(least, times * q) words that goes on at neither end. collapsed is the text with its kept words joined
    by one space; a word goes if any run has it behind the run's first period. Null, empty and blank texts have
    no word, no run and an empty collapsed text; repeated and missing ids are rows like others; an empty table
    gives an empty one. Each row is read whole by one task, nothing is shuffled.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in small(batches):
            words = [(t or b"").split() for t in b.column(1).to_pylist()]
            number = defaultdict(count().__next__)
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            ids = np.fromiter((number[w] for ws in words for w in ws), dtype=np.int64, count=int(bounds[-1]))
            found = repetitions(ids, bounds, least, times)
            runs, kept = [], []
            for k, ws in enumerate(words):
                own = sorted((s, n, q) for (s, n), q in found.get(k, {}).items())
                if own:
                    stay = np.ones(len(ws), dtype=bool)
                    for s, n, q in own:
                        stay[s + q : s + n] = False
                    ws = [ws[i] for i in np.flatnonzero(stay).tolist()]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in sorted(own, key=lambda r: (r[0], r[2]))])
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(runs: DataFrame) -> DataFrame:
    """What find_runs gives, as numbers and digests: n_runs, the longest run (ties: first start, then least period), sha-256 of all runs and of the kept words."""
    key = lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform("runs", key))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return runs.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.n")).alias("length"),
        F.col("_best.p").alias("period"),
        F.floor(F.lit(1000) * -F.col("_best.n") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, told by the crc32 of their id, repeat their own words from some word on.

    With h = crc32(doc_id as text), g = h // 10 and n words: if h % 10 = 0 and n > 0, each word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Others, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    a, p = (lambda n: g % n), (lambda n: F.lit(1) + F.floor((n - g % n) / (F.lit(3) + g % 8)).cast("long"))

    def loop(w):
        n = F.size(w).cast("long")
        place = lambda i: F.when(i < a(n), i).otherwise(a(n) + (i - a(n)) % p(n)).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), lambda i: F.get(w, place(i))), " ")).otherwise("")

    # one-element transform: the words are found once, not once for each that is looked up
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(words, loop)[0]).otherwise(F.col("text")).alias("text"))
