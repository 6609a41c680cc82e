"""Cut points for iterative jobs, and reconciliation of tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Scratch:
    """Folders of the shared store that were written since scratch() was entered."""

    def __init__(self, outer: Scratch | None):
        self.outer, self.folders = outer, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, made by cut(), which outlives this scratch; the scratch around it, if there is one, takes it over."""
        self.folders.remove(df.cut_path)
        if self.outer is not None:
            self.outer.folders.append(df.cut_path)
        return df


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """On leaving, what cut() and shared_path() wrote inside is deleted, but for what was kept."""
    own = Scratch(_scratch.get())
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for folder in own.folders:
            _remove(folder)


def _remove(folder: str) -> None:
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or in local mode without it a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/tidemark/step-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().folders.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that all executors share and read it back, so that lineage ends there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def version(df: DataFrame) -> tuple:
    """The files that df reads, with their sizes and times: another value once the table has changed."""
    spark = df.sparkSession
    paths, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    states = (path.getFileSystem(conf).getFileStatus(path) for path in map(paths, df.inputFiles()))
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states))


_stored: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def stored(of: DataFrame, name: str, make) -> DataFrame:
    """What make() returns, written to the shared folder when the session first asks for this name, and anew once the files of `of` have changed."""
    key, now = (of.sparkSession.sparkContext.applicationId, name), version(of)
    if key not in _stored or _stored[key][0] != now:
        token = _scratch.set(None)  # it outlives whoever asked first
        try:
            _stored[key] = (now, cut(make()))
        finally:
            _scratch.reset(token)
    return _stored[key][1]


def ordinal(df: DataFrame, part: Column, order: list, name: str) -> DataFrame:
    """df with each row's place (from 1) in the whole order; part is a number, or a struct of them, that rises with it and cuts it into tasks."""
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each part, of which there are few: their running sum may be one task
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_own", own).join(base, "_part").withColumn(name, F.col("_own") + F.col("_base")).drop("_part", "_own", "_base")


def reconcile(local: DataFrame, remote: DataFrame, last: DataFrame, key: str, digest: str) -> DataFrame:
    """key, action of a three-way sync: push, pull, same, edited on both, gone here, gone there."""
    a = local.select(key, F.col(digest).alias("a"))
    b = remote.select(key, F.col(digest).alias("b"))
    c = last.select(key, F.col(digest).alias("c"))
    j = a.join(b, key, "full_outer").join(c, key, "full_outer")
    action = (
        F.when(F.col("a").eqNullSafe(F.col("b")), "same")
        .when(F.col("a").isNull() & F.col("c").isNotNull() & F.col("b").eqNullSafe(F.col("c")), "gone here")
        .when(F.col("b").isNull() & F.col("c").isNotNull() & F.col("a").eqNullSafe(F.col("c")), "gone there")
        .when(F.col("b").eqNullSafe(F.col("c")), "push")
        .when(F.col("a").eqNullSafe(F.col("c")), "pull")
        .otherwise("edited on both")
    )
    return j.filter("a is not null or b is not null").select(key, action.alias("action"))


def keep_newest(df: DataFrame, by: list[str], order: str, newest: int, younger_than, always=None) -> DataFrame:
    """Retention: the newest few of each group, whatever is young enough, and what is always kept."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    keep = (F.col("_place") <= newest) | younger_than
    return df.withColumn("_place", place).filter(keep if always is None else keep | always).drop("_place")
