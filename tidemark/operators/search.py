"""Search over names: inverted index, conjunctive match, typos, ranking."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import tokens, typo_budget
from tidemark.operators.stateful import batch
from tidemark.operators.tables import cut, ordinal, scratch


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """token and key, once for each row that has the (folded) token: the index as rows, so that frequent tokens stay spread."""
    # an inner explode would let the optimizer test the array for rows first, which folds every text again
    return df.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("token"), F.col(key)).filter("token is not null")


def laid_out(index: DataFrame) -> DataFrame:
    """The index ordered by token within each file, so that a look-up reads few row groups; nothing is shuffled, so frequent tokens stay spread."""
    return index.sortWithinPartitions("token")


def dictionary(df: DataFrame, value: str, seen: str, most: int = 65_535, width: int = 1_000_000) -> DataFrame:
    """value, n, code: distinct values by falling count, first seen (a whole number) first; codes over most are null.

    Values of one count are cut by when they were first seen, so no task orders all that were seen once. Two
    numberings do it: counts, and within a count stretches of width.
    """
    n = df.groupBy(value).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
    part = F.struct((-F.col("n")).alias("n"), F.floor(F.col("_first") / width).alias("p"))
    out = ordinal(n, part, ["_first", value], "_code").withColumn("_code", F.col("_code") - 1)
    return out.select(value, "n", F.when(F.col("_code") < most, F.col("_code")).alias("code"))


def match_all(index: DataFrame, words: list[str], key: str, prefix: bool = False) -> DataFrame:
    """Keys that hold every word; with prefix the last word may be the start of a token."""
    masks = F.lit(0)
    for i, w in enumerate(words):
        hit = F.col("token").startswith(w) if prefix and i == len(words) - 1 else F.col("token") == w
        masks = masks + F.when(hit, 1 << i).otherwise(0)
    hits = index.select(key, masks.alias("_m")).filter("_m > 0").groupBy(key).agg(F.bit_or("_m").alias("_m"))
    return hits.filter(F.col("_m") == (1 << len(words)) - 1).select(key)


def osa(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance; most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype="int32")


def near_tokens(index: DataFrame, words: DataFrame) -> DataFrame:
    """word, token, distance: tokens with the same first letter within each word's typo budget, only distinct tokens compared."""
    vocabulary = index.select("token").distinct().withColumn("_f", F.substring("token", 1, 1))
    asked = words.select("word", typo_budget(F.col("word")).alias("budget"), F.substring("word", 1, 1).alias("_f"))
    # the first letter and the length bound the candidates, so words of one letter spread over lengths
    span = F.sequence(F.length("word") - F.col("budget"), F.length("word") + F.col("budget"))
    met = asked.withColumn("_n", F.explode(span)).join(vocabulary.withColumn("_n", F.length("token")), ["_f", "_n"])
    # a built-in distance leaves few for the exact one: a swap of neighbours costs at most two of its edits
    near = met.filter((F.col("word") == F.col("token")) | F.expr("levenshtein(word, token, 4) between 0 and 2 * budget"))
    got = near.withColumn("distance", osa_distance("word", "token", "budget"))
    return got.filter(F.col("distance") <= F.col("budget")).select("word", "token", "distance")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def two_phase_top(df: DataFrame, coarse, full, tie: str, keep: int, k: int) -> DataFrame:
    """Best k rows by the full score among the best keep by the coarse one."""
    first = df.withColumn("_coarse", coarse).orderBy(F.desc("_coarse"), tie).limit(keep)
    return first.withColumn("score", full).orderBy(F.desc("score"), tie).limit(k).drop("_coarse")


def drop_repeats(ranked: DataFrame, same: list[str], order: list[str], x: str, y: str, apart: float) -> DataFrame:
    """Greedy: a row goes if a better kept row with the same keys is closer than apart.

    Rows of a key are walked in sorted partitions; what is held of them are the places kept so far, by cells as wide as
    apart, so a row looks at nine cells however many were kept. Rows without a place stay.
    """
    def step(state, row):
        n, a, b = row
        if a != a or b != b:
            return state, [(n,)]
        cells = {} if state[0] is None else state[0]
        i, j = math.floor(a / apart), math.floor(b / apart)
        near = (p for di in (-1, 0, 1) for dj in (-1, 0, 1) for p in cells.get((i + di, j + dj), ()))
        if any((a - c) ** 2 + (b - d) ** 2 < apart**2 for c, d in near):
            return (cells,), []
        cells.setdefault((i, j), []).append((a, b))
        return (cells,), [(n,)]

    with scratch() as held:
        rows = cut(ranked.withColumn("_row", F.monotonically_increasing_id()).withColumn("_same", F.to_json(F.struct(*same))))
        kept = batch(rows.select("_same", "_row", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))), "_same", ["_row", "_x", "_y"], step, (None,), "_same string, _row long", [*(f"_o{i}" for i in range(len(order))), "_row"])
        return held.keep(cut(rows.join(kept.select("_row"), "_row", "left_semi").select(*ranked.columns)))
