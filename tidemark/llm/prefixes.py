"""Conversations that begin alike, as the trie of their turns: partial node tables, merged by hash, and rolled up."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, cut, join_spread, scratch

#: Turns of one conversation that one task numbers or hashes together.
STRETCH = 1024
#: Partial node tables that one step of a merge combines.
FAN = 64
#: Ids that one partial list of ends holds.
LIST = 20_000
#: The path of the root: two words of hash, no turn yet.
ROOT = "0" * 32


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), mark (md5 of role and text), words: turns in order of turn, null first, ties by mark.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. Turn
    numbers are cut into stretches, so that a long conversation is many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), words.alias("words"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / STRETCH).cast("long"))
    before = Window.partitionBy("conv_id").orderBy(F.col("part").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "mark")
    inside = rows.withColumn("own", F.row_number().over(own) - 1)
    met = inside.alias("r").join(base.alias("b"), (F.col("r.conv_id") == F.col("b.conv_id")) & F.col("r.part").eqNullSafe(F.col("b.part")))
    return met.select("r.conv_id", (F.col("own") + F.col("base")).alias("place"), "mark", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, mark, words) and conversations (conv_id, length) with beginnings shared on purpose.

    Of each conversation c the first h = crc32(c as text) % heads turns are replaced by those of conversation
    c - c % every: by all of them if it has fewer, by none if it is not there; c's own turns after its first h
    follow, if any. A conversation of no turn left is still a conversation.
    """
    rows = cut(numbered(turns), "trie-turns")
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("head"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    led = own.join(own.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n")), "head", "left")
    convs = cut(led.select("conv_id", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("used"), "n"), "trie-conversations")
    # a head has fewer than `heads` turns to give, to at most `every` conversations
    first = rows.filter(F.col("place") < heads - 1).withColumnRenamed("conv_id", "head")
    given = convs.select("conv_id", "head", "h").join(first, "head").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "mark", "words")
    # a conversation's row is met by its turns in as many pieces as it has stretches
    part = F.floor(F.col("place") / STRETCH).cast("long")
    pieces = convs.select("conv_id", "h", "used", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH).cast("long"))).alias("part"))
    kept = rows.withColumn("part", part).join(pieces, ["conv_id", "part"]).filter("place >= h").select("conv_id", (F.col("used") + F.col("place") - F.col("h") + 1).alias("depth"), "mark", "words")
    return given.unionByName(kept), convs.select("conv_id", (F.col("used") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words, ends: a row for each beginning of each conversation, the empty one (ROOT) included.

    node is a 128-bit hash of the turns so far: the exclusive or of hashes of each turn with its depth, so that
    stretches of a long conversation are hashed apart and combined through one row for each stretch.
    """
    rows = turns.withColumn("part", F.floor((F.col("depth") - 1) / STRETCH).cast("long"))
    a, b = F.xxhash64("mark", "depth", F.lit(1)), F.xxhash64("depth", "mark", F.lit(2))
    rows = rows.withColumn("a", a).withColumn("b", b)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    base = base.select("conv_id", "part", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a1", F.bit_xor("a").over(inside)).withColumn("b1", F.bit_xor("b").over(inside)).join(base, ["conv_id", "part"])
    whole = [F.col(f"{x}1").bitwiseXOR(F.col(f"{x}0")) for x in "ab"]
    path = lambda x, y: F.concat(*(F.lpad(F.lower(F.hex(c)), 16, "0") for c in (x, y)))
    parent = path(*(c.bitwiseXOR(F.col(x)) for c, x in zip(whole, "ab")))
    last = convs.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ends"))
    below = rows.select("conv_id", "depth", path(*whole).alias("node"), F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(parent).alias("parent"), "words").join(last, ["conv_id", "depth"], "left")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"), (F.col("length") == 0).alias("ends"))
    return below.withColumn("ends", F.coalesce("ends", F.lit(False))).unionByName(top)


def merged(partial: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row for each (depth, node) of partial tables, by a tree of merges; sums names aggregates that merge with themselves.

    Each task of the first step combines what it read itself before it sends anything; then FAN tasks' tables
    meet under one key, and these under the node alone. A node that is everywhere, as the root, is at most one row a task.
    """
    by = partial.withColumn("_from", F.floor(F.spark_partition_id() / FAN).cast("int"))
    step = by.groupBy("depth", "node", "_from").agg(*(c.alias(n) for n, c in sums.items()))
    return step.groupBy("depth", "node").agg(*(c.alias(n) for n, c in sums.items()))


def end_digests(ended: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 from ended (conv_id, depth, node): the digest of the ascending ids, joined by commas.

    Tasks hold disjoint ranges of ids and make lists of each node's; a node's lists then pass in order through one digest, which
    SHA-256 leaves no way round; a list holds LIST ids at most, and no more than one is in memory.
    """
    ranged = ended.select("depth", "node", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["depth", "node", "first", "ids"]

    def table(lists):
        rows = [(d, n, ids[0], ",".join(map(str, ids)).encode()) for (d, n), ids in lists.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    def lists(batches):
        own, held = {}, 0
        for b in batches:
            for d, n, c in zip(*(x.to_pylist() for x in b.columns)):
                own.setdefault((d, n), []).append(c)
                held += 1
                if held == LIST:
                    yield table(own)
                    own, held = {}, 0
        yield table(own)

    def digest(batches):
        now, sha, start = None, None, True
        out = []
        done = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())], ["depth", "node", "ends_sha256"])
        for b in batches:
            for d, n, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (d, n) != now:
                    if sha is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha, start = (d, n), hashlib.sha256(), True
                sha.update(ids if start else b"," + ids)
                start = False
            yield done(out)
            out = []
        yield done([(*now, sha.hexdigest())] if sha is not None else [])

    some = ranged.mapInArrow(lists, "depth long, node string, first long, ids binary")
    return some.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct beginning: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv_id, depth (from 1, without gaps), mark and words; convs has conv_id and length of every conversation, those
    without turns included. saved_tokens is what sharing saves in a node's subtree: words of each node's last
    turn, once for each member but one.

    The rollup needs no step for each depth: a node belongs to its smallest member, so what stands below a node is the
    sum over its members of what each owns from there down, a suffix sum along each conversation (in
    stretches), merged by node like everything else. No conversations give no node, not even a root.
    """
    with scratch() as held:
        rows = cut(paths(turns, convs), "trie-paths")
        nodes = cut(merged(rows.select("depth", "node", "parent", "conv_id", "words", F.lit(1).cast("long").alias("n_convs")), {"conv_id": F.min("conv_id"), "parent": F.min("parent"), "words": F.max("words"), "n_convs": F.sum("n_convs")}), "trie-nodes")
        children = merged(nodes.filter("parent is not null").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_children")), {"n_children": F.sum("n_children")})
        nodes = cut(nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")

        # what each member owns: nodes whose smallest member it is
        zero = F.lit(0).cast("long")
        owned = nodes.select("conv_id", "depth", F.lit(None).cast("string").alias("node"), (F.col("words") * (F.col("n_convs") - 1)).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
        both = rows.select("conv_id", "depth", "node", zero.alias("saved"), zero.alias("leaves")).unionByName(owned).withColumn("part", F.floor(F.col("depth") / STRETCH).cast("long"))
        behind = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
        base = owned.withColumn("part", F.floor(F.col("depth") / STRETCH).cast("long")).groupBy("conv_id", "part").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        # stretches that own nothing have their base too
        spans = convs.select("conv_id", F.explode(F.sequence(zero, F.floor(F.col("length") / STRETCH).cast("long"))).alias("part")).join(base, ["conv_id", "part"], "left")
        base = spans.select("conv_id", "part", F.coalesce(F.sum("s").over(behind), zero).alias("s0"), F.coalesce(F.sum("l").over(behind), zero).alias("l0"))
        down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0)
        summed = both.withColumn("s1", F.sum("saved").over(down)).withColumn("l1", F.sum("leaves").over(down)).filter("node is not null").join(base, ["conv_id", "part"])
        below = merged(summed.select("depth", "node", (F.col("s1") + F.col("s0")).alias("saved_tokens"), (F.col("l1") + F.col("l0")).alias("n_leaves")), {"saved_tokens": F.sum("saved_tokens"), "n_leaves": F.sum("n_leaves")})

        ends = end_digests(rows.filter("ends"))
        out = nodes.join(below, ["depth", "node"]).join(ends, ["depth", "node"], "left")
        out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
        out = cut(out.withColumn("up", F.concat_ws(":", (F.col("depth") - 1).cast("string"), "parent")), "trie-rolled")
        above = nodes.select(F.concat_ws(":", F.col("depth").cast("string"), "node").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        hot = above.filter(F.col("n_children") > F.lit(nodes.count() / HOT_KEYS))
        out = join_spread(out, above.drop("n_children"), "up", hot.drop("n_children"), F.struct("depth", "node"))
        return held.keep(cut(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie"))
