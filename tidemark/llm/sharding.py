"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: Bytes of text a shard may hold.
LIMIT = 32 << 20
#: Bits by which cells are finer than the mean shard, and the last bit that a bucket can split on.
FINER, DEEPEST = 4, 60


def _bits() -> Column:
    """The first DEEPEST bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, DEEPEST // 4), 16, 10).cast("long")


def _prefix(bits: Column | str, depth: Column) -> Column:
    return F.call_function("shiftright", F.col(bits) if isinstance(bits, str) else bits, (F.lit(DEEPEST) - depth).cast("int"))


def _directory(cells: DataFrame, deep: int, limit: int, done: int) -> DataFrame:
    """cell, leaf (depth, prefix, bytes): the shortest prefix of each cell, from done bits on, whose rows fit the limit.

    A prefix is a leaf if it fits and its parent does not, and each parent has two children at most. A leaf
    then names the cells below it, which are few, as it fits and cells are fine.
    """
    each = cells.select("cell", "size", F.explode(F.sequence(F.lit(done), F.lit(deep))).alias("depth"))
    up = F.call_function("shiftright", F.col("cell"), (F.lit(deep) - F.col("depth")).cast("int"))
    fits = cut(each.groupBy("depth", up.alias("prefix")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") <= limit), "shard-fits")
    parents = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    leaves = fits.join(parents, ["depth", "prefix"], "left_anti")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(deep) - F.col("depth")).cast("int"))
    below = F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)
    return leaves.select(F.explode(below).alias("cell"), F.struct("depth", "prefix", "bytes").alias("leaf")).join(cells.select("cell"), "cell", "right")


def shard(docs: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, shard (its prefix in bits), depth, shard_bytes, over_limit.

    The key is the id, so copies of one text and rows of one source spread over all shards. Null text has
    no bytes; rows without an id hash alike. Rows that no bit tells apart (a document over the limit, an id
    that repeats) make one shard marked over_limit. Empty in, empty out.
    """
    with scratch() as held:
        return held.keep(cut(_sharded(docs, text, limit), "shards"))


def _sharded(docs: DataFrame, text: str, limit: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = cut(rows.withColumn("bits", _bits()), "shard-rows")
    got = rows.agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n")).first()
    deep = min(DEEPEST, max(1, math.ceil(math.log2(max(1, got["size"] or 0) / limit + 1))) + FINER)
    done, out, left = 0, [], rows
    while True:
        cell = _prefix("bits", F.lit(deep)).alias("cell")
        cells = cut(left.groupBy(cell).agg(F.sum("n_bytes").alias("size")), "shard-cells")
        found = cut(_directory(cells, deep, limit, done), "shard-directory")
        placed = left.withColumn("cell", cell).join(found, "cell", "left")
        if deep == DEEPEST:
            alone = cells.select("cell", F.col("size").alias("cell_bytes"))
            placed = placed.join(alone, "cell")
            leaf = F.coalesce("leaf", F.struct(F.lit(deep).alias("depth"), F.col("cell").alias("prefix"), F.col("cell_bytes").alias("bytes")))
            out.append(placed.select("doc_id", "n_bytes", leaf.alias("leaf"), F.col("leaf").isNull().alias("over_limit")))
            break
        out.append(placed.filter(F.col("leaf").isNotNull()).select("doc_id", "n_bytes", "leaf", F.lit(False).alias("over_limit")))
        if found.filter("leaf is null").isEmpty():
            break
        left = cut(placed.filter(F.col("leaf").isNull()).select("doc_id", "n_bytes", "bits"), "shard-rest")
        done, deep = deep + 1, min(DEEPEST, deep + 8)
    all_rows = out[0]
    for more in out[1:]:
        all_rows = all_rows.unionByName(more)
    name = F.when(F.col("leaf.depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("leaf.prefix").cast("string"), 10, 2), F.col("leaf.depth"), F.lit("0")))
    return all_rows.select("doc_id", "n_bytes", name.alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.bytes").alias("shard_bytes"), "over_limit")


def write_shards(docs: DataFrame, folder: str, text: str = "text", limit: int = LIMIT) -> None:
    """Write docs to folder, one directory shard=... for each shard, with all their columns."""
    of = shard(docs, text, limit).select(F.col("doc_id").alias("shard_doc"), "shard").distinct()
    joined = docs.join(of, docs["doc_id"].eqNullSafe(F.col("shard_doc")), "left").drop("shard_doc")
    joined.repartition("shard").write.partitionBy("shard").parquet(folder)
