"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, join_spread, keep_rows, scratch

SPACES = r"[\x20\x09-\x0D]+"
#: Up to so many repeated hashes (of 16 bytes) are broadcast to find the texts to compare; beyond, they are joined by shuffle.
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def _report(rows: DataFrame) -> DataFrame:
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    single = F.col("first").isNull()
    return rows.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (mine == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, text: str = "text", hashed=content_hash) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after each run of white space became one space; null counts
    as empty. Rows without an id yield to rows with one. Of rows that repeat id and text one is kept.
    An empty table gives an empty result; other columns, whatever their names, are not read.

    Hashes are counted on narrow rows. Only texts whose hash repeats are moved: grouping them by hash and
    whole text compares the bytes and combines copies before the shuffle. Hot hashes meet their rows by
    broadcast, in no shuffle before that grouping. Hashes with two texts are grouped by text instead.
    """
    with scratch() as held:
        return held.keep(cut(_grouped(docs, text, hashed), "exact"))


def _grouped(docs: DataFrame, text: str, hashed) -> DataFrame:
    src = docs.select(F.col("doc_id"), normalised(F.col(text)).alias("norm"))
    src = src.select("doc_id", "norm", hashed(F.col("norm")).alias("h"))
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")
    narrow = cut(src.select("doc_id", F.monotonically_increasing_id().alias("row"), "h", sha), "exact-hashes")
    total = narrow.count()
    repeated = cut(narrow.groupBy("h").agg(_first(), F.count("*").alias("n")).filter("n > 1"), "exact-groups")
    hot = repeated.filter(F.col("n") > F.lit(total / HOT_KEYS))
    if repeated.count() <= BROADCAST_HASHES:
        again = src.join(F.broadcast(repeated.select("h")), "h", "left_semi")
    else:
        top = F.broadcast(hot.select("h"))
        again = src.join(top, "h", "left_semi").unionByName(src.join(top, "h", "left_anti").join(repeated.select("h"), "h", "left_semi"))
    texts = again.groupBy("h", "norm").agg(F.count("*").alias("n"))
    clashes = cut(texts.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "exact-clashes")
    if clashes.isEmpty():
        return _report(join_spread(narrow, repeated, "h", hot, F.col("row")))
    clean = narrow.join(clashes, "h", "left_anti")
    out = _report(join_spread(clean, repeated, "h", hot, F.col("row")))
    mixed = src.join(clashes, "h", "left_semi").select("doc_id", F.monotonically_increasing_id().alias("row"), "norm", sha)
    mixed = cut(mixed, "exact-clashing-texts")
    groups = cut(mixed.groupBy("norm").agg(_first(), F.count("*").alias("n")), "exact-clashing-groups")
    top = groups.filter(F.col("n") > F.lit(total / HOT_KEYS))
    return out.unionByName(_report(join_spread(mixed, groups, "norm", top, F.col("row"))))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the kept row of each text, columns unchanged.

    The rows to act on, known by id and hash of the text, are broadcast up to a checked count and
    joined by shuffle beyond it. Of rows that repeat id and text one stays.
    """
    def tag(doc_id, sha):
        return F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(" "), sha)

    with scratch() as held:
        found = exact_dedup(docs, text).select(tag(F.col("doc_id"), F.col("text_sha256")).alias("tag"), "kept")
        act = found.groupBy("tag").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).filter("not kept or times > 1")
        act = held.keep(cut(act, "exact-act"))
    return keep_rows(docs, lambda col: tag(col("doc_id"), F.sha2(normalised(col(text)).cast("binary"), 256)), act, BROADCAST_HASHES)
