"""SimHash near-dedup: fingerprints of word shingles, linked by pigeonring search, joined to components."""

from __future__ import annotations

from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, PART_BYTES, cut, join_spread, keep_rows, scratch, small

BITS = 64
#: Most differing bits of two linked fingerprints.
DISTANCE = 4
#: The ring: one segment more than DISTANCE, so that some chain starts with an equal segment.
SEGMENTS = (13, 13, 13, 13, 12)
#: Segments of a chain that make a search key; the budgets of its prefixes are 0, 1 and 2 bits.
CHAIN = 3
#: Fingerprints under one key that are compared in pairs; those under fuller keys are linked through their balls.
PAIRED = 96
#: Up to so many tags (of 32 bytes) of rows to drop are broadcast.
BROADCAST_TAGS = 1_000_000
#: Fingerprints that show which keys are crowded; a key with so many of them is not paired at all.
SHOWN, CROWDED = 20_000, 10
#: Up to so many edges (of 16 bytes) one task contracts to the end: a round over all executors costs the driver some twelve stages with their plans.
EDGES_AT_ONCE = 1_000_000
#: Bytes of a row of signatures in a shuffle.
SIGNATURE_BYTES = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """SimHash of one text; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - size + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, votes, done = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), 0
    spans = zip(starts, islice(starts, min(size, len(words)), None))
    while done < count:
        some = np.fromiter((digest(joined[a : b - 1], seed) for a, b in islice(spans, 1 << 15)), dtype=">u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        done += len(some)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that gives fingerprints the order of chance, so that contraction takes few rounds."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, tag (of id and text), fp (the fingerprint as a signed long) and node (its vertex number) for each row."""
    def run(batches):
        for b in small(batches):
            f = np.array([fingerprint(x) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f.view(np.int64)), pa.array(_mixed(f).view(np.int64))], ["doc_id", "tag", "fp", "node"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), _tag(F.col("doc_id"), F.col(text)).alias("tag"))
    return src.mapInArrow(run, "doc_id long, tag string, fp long, node long")


def _tag(doc_id, text):
    """Tells rows apart that share their id but not their text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))


def _ring():
    """For each chain start: mask of the key's bits and the flips of at most one bit behind the first segment."""
    low = np.concatenate([[0], np.cumsum(SEGMENTS)])
    masks = [((1 << int(n)) - 1) << int(a) for a, n in zip(low, SEGMENTS)]
    out = []
    for i in range(len(SEGMENTS)):
        behind = [(i + j) % len(SEGMENTS) for j in range(1, CHAIN)]
        flips = [0] + [1 << b for s in behind for b in range(int(low[s]), int(low[s + 1]))]
        out.append((masks[i] | sum(masks[s] for s in behind), flips))
    return masks, out


def signatures(prints: DataFrame, crowded: np.ndarray | None = None) -> DataFrame:
    """key, flip, start and fp: two fingerprints within DISTANCE share a key of some chain.

    A chain's key holds its first CHAIN segments with at most one bit flipped on either side, so keys
    meet when the first segments are equal and the next ones differ in two bits at most. A fingerprint under
    one of the (sorted) crowded keys gets one row with a key of its own and tag -1 for all of them.
    """
    ring = _ring()[1]
    many = prints.sparkSession.sparkContext.broadcast(crowded) if crowded is not None and len(crowded) else None

    def run(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(f), 20_000):
                g = f[at : at + 20_000]
                for start, (mask, flips) in enumerate(ring):
                    keys = (g & np.uint64(mask))[None, :] ^ np.array(flips, dtype=np.uint64)[:, None]
                    keys = _mixed(keys ^ np.uint64((start + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
                    tag = np.repeat(np.arange(len(flips), dtype=np.int16) * 8 + start, len(g))
                    keys, own = keys.ravel().view(np.int64), np.tile(g, len(flips))
                    if many is not None:
                        full = many.value[np.minimum(np.searchsorted(many.value, keys), len(many.value) - 1)] == keys
                        some = np.unique(own[full])
                        keys, tag, own = (np.concatenate(x) for x in ((keys[~full], _mixed(some).view(np.int64)), (tag[~full], np.full(len(some), -1, dtype=np.int16)), (own[~full], some)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tag), pa.array(own.view(np.int64))], ["key", "tag", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, tag short, fp long")


def crowded_keys(prints: DataFrame, n: int) -> np.ndarray:
    """Keys that hold over about one in SHOWN / CROWDED of the n distinct fingerprints, sorted, from those of least hash.

    Only a hint: members of crowded keys are linked exactly all the same, through their balls, without meeting in one task.
    """
    some = prints.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SHOWN / max(1, n)))))
    keys = signatures(some).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= F.lit(max(CROWDED, PAIRED * min(1.0, SHOWN / max(1, n))))).select("key")
    return np.sort(np.array([r["key"] for r in keys.collect()], dtype=np.int64))


def _pairs(keys, tags, prints, masks):
    """Links among sorted rows: same key and chain, flips that meet once, prefix budgets, then the full distance."""
    found = []
    at, gap = np.arange(len(keys)), 1
    while len(at):
        at = at[at + gap < len(keys)]
        at = at[keys[at] == keys[at + gap]]
        if not len(at):
            break
        a, b = prints[at], prints[at + gap]
        ta, tb = tags[at], tags[at + gap]
        swap = a > b
        fa, fb = np.where(swap, tb, ta) >> 3, np.where(swap, ta, tb) >> 3
        ok = (a != b) & ((ta & 7) == (tb & 7)) & ((fa < fb) | ((fa == 0) & (fb == 0)))
        a, b, start = a[ok], b[ok], (ta[ok] & 7).astype(np.int64)
        differ = np.stack([np.bitwise_count((a ^ b) & np.uint64(m)) for m in masks]).astype(np.int64)
        first = np.full(len(a), -1)
        for i in reversed(range(len(masks))):
            run = np.cumsum(differ[[(i + j) % len(masks) for j in range(len(masks))]], axis=0)
            fits = np.all([run[j] <= (j + 1) * DISTANCE // len(masks) for j in range(len(masks))], axis=0)
            first[fits] = i
        ok = first == start
        found.append(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])]))
        gap += 1
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)


def _scan(batches):
    """Walk rows sorted by key: links of the small groups, and the members of full groups once each, as (a, null)."""
    masks, chunk = _ring()[0], 1_000_000
    hot, kept, size = None, [], 0

    def emit(a, b):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], ["a", "b"])

    def work(parts, last):
        nonlocal hot
        keys, tags, prints = (np.concatenate(x) for x in zip(*parts))
        out = []
        if hot is not None:
            n = int(np.searchsorted(keys != hot, True))
            out.append(emit(np.unique(prints[:n]), None))
            keys, tags, prints = keys[n:], tags[n:], prints[n:]
        end = len(keys)
        if not last and end:
            end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        rest = [(keys[end:], tags[end:], prints[end:])]
        if len(keys):
            hot = None
        if end:
            k, t, p = keys[:end], tags[:end], prints[:end]
            bounds = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            full = np.repeat(np.diff(bounds) > PAIRED, np.diff(bounds))
            if full.any():
                out.append(emit(np.unique(p[full]), None))
            link = _pairs(k[~full], t[~full], p[~full], masks)
            if link.shape[1]:
                out.append(emit(link[0], link[1]))
        if not last and len(rest[0][0]) > PAIRED:
            hot = rest[0][0][0]
            out.append(emit(np.unique(rest[0][2]), None))
            rest = []
        return rest, out

    for b in batches:
        tags = b.column(1).to_numpy()
        if (tags < 0).any():
            yield emit(np.unique(b.column(2).to_numpy().view(np.uint64)[tags < 0]), None)
            b = b.filter(pa.array(tags >= 0))
        kept.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)))
        size += b.num_rows
        if size >= chunk:
            kept, out = work(kept, False)
            size = sum(len(x[0]) for x in kept)
            yield from out
    if kept:
        yield from work(kept, True)[1]


def _balls(batches):
    """Each fingerprint with all words of 64 bits within half of DISTANCE: balls meet exactly when their centres link."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(BITS, 1)
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), one, one[i] | one[j]])
    for b in batches:
        f = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(f), 100):
            g = f[at : at + 100]
            yield pa.RecordBatch.from_arrays([pa.array((g[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(g, len(flips)).view(np.int64))], ["word", "fp"])


def _as_nodes(batches):
    for b in batches:
        a, c = (_mixed(b.column(i).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """Edges u < v between the nodes of distinct fingerprints (column fp), enough to connect all within DISTANCE."""
    n = prints.count()
    sigs = signatures(prints, crowded_keys(prints, n))
    per_row = sum(len(flips) for _, flips in _ring()[1])
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * per_row * SIGNATURE_BYTES // PART_BYTES + 1)
    found = sigs.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_scan, "a long, b long")
    found = cut(found, "simhash-found")
    pairs = found.filter("b is not null")
    dense = cut(found.filter("b is null").select(F.col("a").alias("fp")).distinct(), "simhash-dense")
    if not dense.isEmpty():
        balls = dense.repartition(parts, "fp").mapInArrow(_balls, "word long, fp long")
        least = balls.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
        stars = balls.join(least, "word").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()
        pairs = pairs.unionByName(stars)
    return cut(pairs.mapInArrow(_as_nodes, "u long, v long"), "simhash-links")


def _contracted(batches):
    """u and m, the least vertex of its component, for each vertex of all edges of the batches: the same contraction in one task."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(a):
        low = np.arange(len(names))
        np.minimum.at(low, a, b)
        np.minimum.at(low, b, a)
        while (low != low[low]).any():
            low = low[low]
        root, a, b = low[root], low[a], low[b]
        a, b = a[a != b], b[a != b]
    for i in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 100_000]), pa.array(names[root[i : i + 100_000]])], ["u", "m"])


def components(edges: DataFrame, name: str = "components", at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """u and root, the least vertex of its component, for each vertex of edges (u < v): contraction to the least neighbour until no edge is left.

    Vertex numbers must be in the order of chance; then each round leaves at most about half of the vertices. As soon as at most
    at_once edges are left, one task goes on with them.
    """
    steps = []
    while not edges.isEmpty():
        if (n := edges.count()) <= at_once:
            steps.append(cut(edges.coalesce(1).mapInArrow(_contracted, "u long, m long"), name))
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), name)
        hubs = step.filter(F.col("n") > F.lit(n / HOT_KEYS))
        left, left_hot = (x.select("u", F.col("m").alias("mu")) for x in (step, hubs))
        right, right_hot = (x.select(F.col("u").alias("v"), F.col("m").alias("mv")) for x in (step, hubs))
        moved = join_spread(join_spread(edges, left, "u", left_hot, F.col("v")), right, "v", right_hot, F.col("u")).filter("mu <> mv")
        edges = cut(moved.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), name)
        steps.append(step)
    if not steps:
        return edges.select("u", F.col("v").alias("root")).limit(0)
    out = steps[-1].select("u", F.col("m").alias("root"))
    for step in reversed(steps[:-1]):
        up = out.select(F.col("u").alias("m"), "root")
        out = cut(step.join(up, "m", "left").select("u", F.coalesce("root", "m").alias("root")), name)
    return out


def simhash_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A text is lower-cased (A-Z) and split at ASCII white space; null, like a text without words, has
    fingerprint zero and is linked like any other. component_id is the least id that can be reached over
    links of at most DISTANCE differing bits; ids that repeat share it where their texts do, and rows
    without an id get the least id of their component, null if it has none. Empty in, empty out.
    """
    with scratch() as held:
        found = _joined(docs, text)
        return held.keep(cut(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), "simhash"))


def _joined(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, tag, fp, component_id and first (the row of the component that stays) for each row."""
    narrow = cut(fingerprints(docs, text), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    nodes = cut(narrow.groupBy("node").agg(F.min(order).alias("least"), F.min("fp").alias("fp"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes), "simhash-roots")
    of = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    least = cut(of.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("nodes")), "simhash-firsts")
    total = narrow.count()
    large = least.filter(F.col("nodes") > F.lit(total / HOT_KEYS)).select("root", "first")
    found = cut(join_spread(of, least.select("root", "first"), "root", large, F.col("node")).select("node", "first", "n"), "simhash-components")
    hot = found.filter(F.col("n") > F.lit(total / HOT_KEYS)).select("node", "first")
    out = join_spread(narrow, found.select("node", "first"), "node", hot, F.col("doc_id"))
    return out.withColumn("component_id", F.col("first.doc_id"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each component, columns unchanged: that of least id (rows without an id last), then of least tag.

    Rows are known by a tag of id and text, so rows that share an id, or have none, are told apart by their
    texts; of rows that repeat both, one stays. Tags of rows to drop are broadcast up to a checked count and
    joined by shuffle beyond it. Null texts count as empty; empty in, empty out; other columns are not read.
    """
    with scratch() as held:
        found = _joined(docs, text)
        act = found.groupBy("tag").agg(F.max(F.col("tag") == F.col("first.tag")).alias("kept"), F.count("*").alias("times"))
        act = held.keep(cut(act.filter("not kept or times > 1"), "simhash-act"))
    return keep_rows(docs, lambda col: _tag(col("doc_id"), col(text)), act, BROADCAST_TAGS)
