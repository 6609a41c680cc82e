"""Mixing sources to target weights: how often each document is taken, by pivotal rounding in a reduction tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, join_spread, release, scratch

#: Documents of a source that one chain rounds, and residuals that one chain of a higher level combines.
CHAIN = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space, as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size, n) with the place of each source, its target and times, the target over its size.

    Sources get weights in order of their code points, null last, over and over. They share `share` of all
    sizes by weight; none gets over `most` times its size, and what that leaves goes to the others by weight
    until none is above. A source without words gets nothing. Sources stay rows: a round of sharing is one
    aggregate, of which the driver sees two sums, and the level it sets rises until no source is newly above.
    """
    ordered = cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    # the id counts up in each sorted partition, whose number stands above bit 33
    counts = sorted((r["part"], r["n"]) for r in ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    base, firsts = 0, []
    for part, n in counts:
        firsts.append((part, base))
        base += n
    spark = sizes.sparkSession
    place = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = ordered.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(spark.createDataFrame(firsts, "_part long, _first long")), "_part").withColumn("place", place)
    rows = rows.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    cap, level, full = F.col("source_size") * float(most), 0.0, -1
    while True:
        above = cap <= F.col("_w") * level
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("capped"), F.sum(F.when(~above, F.col("_w"))).alias("left"), F.count(F.when(above, 1)).alias("full")).first()
        if got["full"] == full or not got["left"]:
            break
        full = got["full"]
        level = (share * got["all"] - (got["capped"] or 0.0)) / got["left"]
    return rows.withColumn("target", F.least(cap, F.col("_w") * level)).withColumn("times", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).select("source", "place", "n", "source_size", "target", "times")


def pivot(a: tuple[float, float], b: tuple[float, float], draw: float) -> tuple[float, float]:
    """New chances of two documents (size, chance), of which one is then 0 or 1, while the sum of size times chance stays.

    Mass goes one way or the other with the odds that leave each chance as it is on average; draw is from [0, 1).
    """
    (sa, ca), (sb, cb) = a, b
    up, down = min((1 - ca) * sa, cb * sb), min(ca * sa, (1 - cb) * sb)
    if draw * (up + down) < down:
        # a grows by up, b shrinks
        return (1.0, max(0.0, cb - up / sb)) if (1 - ca) * sa <= cb * sb else (min(1.0, ca + up / sa), 0.0)
    return (0.0, min(1.0, cb + down / sb)) if ca * sa <= (1 - cb) * sb else (max(0.0, ca - down / sa), 1.0)


STEP = "doc_id long, place long, bucket long, size long, chance double, whole long, mark long, done boolean"


def _chains(rows: DataFrame, parts: int, level: int) -> DataFrame:
    """rows after one level: in each (place, bucket) all chances are 0 or 1 (done) but for at most one row.

    A chain walks its documents from the largest to the smallest and carries the one that is not settled, so
    what is left over tends to be small, and a chain of any length needs the memory of one row.
    """
    draw = F.shiftrightunsigned(F.xxhash64("mark", "doc_id", "size", F.lit(level)), 11) * F.lit(2.0**-53)
    order = ["place", "bucket", F.desc("size"), "mark", "doc_id"]
    chained = rows.repartition(parts, "place", "bucket").sortWithinPartitions(*order).select(*(c.split()[0] for c in STEP.split(", ")), draw.alias("draw"))

    def run(batches):
        held = None
        names = [c.split()[0] for c in STEP.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held is not None and held[1:3] != row[1:3]:
                    out.append(held)
                    held = None
                if held is None:
                    held = (*row[:7], False)
                    continue
                p, q = pivot((held[3], held[4]), (row[3], row[4]), row[8])
                one, other = (*held[:4], p, *held[5:7], p in (0.0, 1.0)), (*row[:4], q, *row[5:7], q in (0.0, 1.0))
                if one[7] and other[7]:
                    out += [one, other]
                    held = None
                else:
                    out.append(one if one[7] else other)
                    held = other if one[7] else one
            yield table(out)
        yield table([held] if held is not None else [])

    return chained.mapInArrow(run, STEP)


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 12) -> DataFrame:
    """One row for each row of docs: doc_id, source, size (words), source_size, target and times of its source, copies, taken (copies times size).

    A document of a source is taken floor(times) times for certain and once more with the chance of the rest.
    These chances are rounded by pivoting: two documents exchange mass, their words times chance staying the
    same in sum, until one chance is 0 or 1. Chains of about CHAIN documents leave at most one residual each; residuals
    of CHAIN chains are combined in the next level, and so on to one for each source, which is drawn. So a
    source's taken words differ from its target by less than one document, and a document has its due copies
    on average. Draws are hashes of the rows and the seed: runs agree however the rows are dealt out.

    Null texts have size 0 and are taken 0 times or as their source's floor says, which takes no word. A source of null is
    one more source, the last. Rows that share an id are told apart by size and text; wholly equal rows are
    rounded like others, in one chain. An empty table gives an empty one.
    """
    with scratch() as held:
        sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), F.xxhash64(F.col(text), F.lit(seed)).alias("mark")), "mix-sizes")
        plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), list(weights), share, most), "mix-targets")
        total = plan.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        hot = plan.filter(F.col("n") > F.lit((total["n"] or 0) / HOT_KEYS))
        # null is a source, but no key of a join
        key = lambda df: df.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
        due = join_spread(key(sized), key(plan), "_key", key(hot), F.struct("doc_id", "mark"))
        due = due.withColumn("whole", F.floor("times").cast("long")).withColumn("chance", F.col("times") - F.col("whole"))
        due = due.withColumn("chance", F.when(F.col("size") > 0, F.col("chance")).otherwise(0.0)).withColumn("done", F.col("chance") == 0.0)
        chains = F.ceil(F.col("n") / CHAIN).cast("long")
        due = due.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "mark", F.lit(seed)), F.greatest(chains, F.lit(1).cast("long"))))
        names = [c.split()[0] for c in STEP.split(", ")]
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        start = cut(due.select(*names), "mix-chances")
        settled, rest, level = [start.filter("done")], start.filter("not done"), 0
        buckets = -(-(total["most"] or 0) // CHAIN)
        while True:
            step = cut(_chains(rest, parts, seed + level), "mix-level")
            settled.append(step.filter("done"))
            rest = step.filter("not done").withColumn("bucket", F.floor(F.col("bucket") / CHAIN).cast("long"))
            if buckets <= 1:
                break
            buckets, level = -(-buckets // CHAIN), level + 1
        last = F.shiftrightunsigned(F.xxhash64("mark", "doc_id", "size", F.lit(seed), F.lit("last")), 11) * F.lit(2.0**-53)
        settled.append(rest.withColumn("chance", F.when(last < F.col("chance"), 1.0).otherwise(0.0)))
        out = settled[0]
        for s in settled[1:]:
            out = out.unionByName(s)
        out = out.withColumn("copies", F.col("whole") + F.col("chance").cast("long")).select("doc_id", "place", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))
        out = join_spread(out, plan.drop("n"), "place", hot.drop("n"), F.struct("doc_id", "size"))
        return held.keep(cut(out.select("doc_id", "source", "size", "source_size", "target", "times", "copies", "taken"), "mixed"))


def mixture(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: rows of docs, columns unchanged, each as often as mixed (what mix() gave for docs) says; ids must tell rows apart."""
    times = mixed.filter("copies > 0").select(F.col("doc_id").alias("mix_id"), F.col("copies").alias("mix_copies"))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    met = plain.join(times, F.col(f"c{names.index('doc_id')}") == F.col("mix_id"))
    return met.select(*plain.columns, F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies")).alias("mix_copy")).drop("mix_copy").toDF(*names)
