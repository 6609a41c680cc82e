"""From raw documents to packed sequences: the stages, each on all that its predecessor kept.

All but the last return the columns of their input, whatever those are named; only doc_id and text are read. Null texts count
as empty, missing and repeated ids are rows like others, and an empty table passes every stage empty. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, exact_dedup, packing, quality, simhash
from tidemark.llm.common import cut, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; with no labels of both classes all of them."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (but for white space) that of the least id, rows without an id last; one of rows that repeat both."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the row of the least id; texts without a word are one component."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the benchmark; texts of no word stay."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; a text of no word is one piece with the end id."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written and read again, and what it needed is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as held:
        for name, stage in STAGES:
            with scratch() as own:
                after = own.keep(cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
            docs = after
        return held.keep(docs)
