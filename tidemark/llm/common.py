"""What the operators of this subpackage share: cut points, joins that survive hot keys, labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; there are at most HOT_KEYS of them, whatever the input.
HOT_KEYS = 1000
#: Rows an Arrow batch may hold, so that a batch of long texts stays small.
BATCH_ROWS = 500
#: Bytes that a partition of a shuffle with a given number of partitions should hold.
PART_BYTES = 128 << 20
#: Distinct values that a label may have.
MOST_LABELS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or in local mode without it a temporary one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if _scratch.get() is not None:
        _scratch.get().cuts.append(out)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*cuts: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in cuts:
        remove(df.sparkSession, df.cut_path)


class Scratch:
    """Tables cut since scratch() was entered."""

    def __init__(self, outer: Scratch | None):
        self.outer, self.cuts = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, which outlives this scratch; the caller's scratch, if there is one, takes it over."""
        self.cuts = [c for c in self.cuts if c is not df]
        if self.outer is not None:
            self.outer.cuts.append(df)
        return df


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """On leaving, delete the tables that were cut inside and not kept."""
    own = Scratch(_scratch.get())
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        release(*own.cuts)


def small(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut to so few rows that what is made of their texts stays small; Spark bounds their bytes itself."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def parts_for(df: DataFrame, text: str, each: int = PART_BYTES) -> int:
    """Shuffle partitions for df: those the session asks for, more where each would hold over so many bytes of text."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // each + 1)


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their place, so that no name can clash, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Left join to right, which has one row for each key, without sending a hot key's rows to one task.

    hot holds the rows of right whose key has over 1/HOT_KEYS of left's rows, so it has fewer than
    HOT_KEYS rows and can be broadcast at any size. Rows that found their match there go through the
    shuffle under a salt taken from spread, which matches nothing.
    """
    names = [c for c in right.columns if c != key]
    hot = hot.select(key, *(F.col(c).alias(f"hot_{c}") for c in names), F.lit(True).alias("hot_found"))
    left = left.join(F.broadcast(hot), key, "left")
    salt = F.when(F.col("hot_found"), F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).otherwise(F.lit(0))
    right = right.select(key, F.lit(0).cast("long").alias("join_salt"), *(F.col(c).alias(f"cold_{c}") for c in names))
    joined = left.withColumn("join_salt", salt.cast("long")).join(right, [key, "join_salt"], "left")
    for c in names:
        joined = joined.withColumn(c, F.coalesce(f"hot_{c}", f"cold_{c}"))
    return joined.drop("join_salt", "hot_found", *(f"hot_{c}" for c in names), *(f"cold_{c}" for c in names))


def keep_rows(docs: DataFrame, tag, decided: DataFrame, most: int) -> DataFrame:
    """docs, columns unchanged, without the rows whose tag is decided against; of rows that share a tag decided for, one.

    tag makes the tag column from a function that finds the columns of docs by name. decided has tag, kept and times (rows with the tag) and holds only tags that are decided against or on
    several rows. It is broadcast up to a checked count; beyond, it is joined by shuffle with hot tags split.
    """
    plain, names = positional(docs)
    marked = plain.withColumn("keep_tag", tag(lambda name: F.col(names[name])))
    act = decided.select(F.col("tag").alias("keep_tag"), F.col("kept").alias("keep_kept"), F.col("times").alias("keep_times"))
    if act.count() <= most:
        marked = marked.join(F.broadcast(act), "keep_tag", "left")
    else:
        total = act.agg(F.sum("keep_times")).first()[0]
        marked = join_spread(marked, act, "keep_tag", act.filter(F.col("keep_times") > F.lit(total / HOT_KEYS)), F.monotonically_increasing_id())
    if act.filter("keep_kept and keep_times > 1").isEmpty():
        return marked.filter("keep_kept is null or keep_kept").select(*plain.columns).toDF(*docs.columns)
    single = marked.filter("keep_kept is null or (keep_kept and keep_times = 1)").select(*plain.columns)
    again = marked.filter("keep_kept and keep_times > 1").dropDuplicates(["keep_tag"]).select(*plain.columns)
    return single.unionByName(again).toDF(*docs.columns)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how the held-out rows are told."""
    return F.crc32(doc_id.cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, text: str = "text"):
    """At most about per_label documents of each label as pandas (text, label): a bounded, repeatable sample.

    labels has doc_id and the label column and only rows that may be learned from. Rows are chosen by a
    hash of their id against a threshold from the label counts, so the order of rows plays no part. Ids that
    repeat count once, with their largest label and least text. Labels are told apart by value; over
    MOST_LABELS of them are an error.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"column {label} has over {MOST_LABELS} distinct labels")
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    rule = F.lit(False)
    for y, n in counts.items():
        rule = rule | ((F.col("y") == F.lit(y)) & (place < F.lit(int(1_000_000 * min(1.0, per_label / n)))))
    chosen = one.filter(rule)
    picked = docs.select("doc_id", F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    frame = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).toPandas()
    frame = frame.sort_values("doc_id", kind="stable").drop_duplicates("text")
    return frame.reset_index(drop=True), counts
