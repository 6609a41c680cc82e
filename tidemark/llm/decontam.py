"""Benchmark decontamination: Wu-Manber search for word windows of test items in documents."""

from __future__ import annotations

import uuid
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, positional, scratch, small

WINDOW = 10
#: Bytes of benchmark text whose tables one task holds; a larger benchmark is searched block after block.
BLOCK_BYTES = 16 << 20
#: Up to so many rows that a benchmark of several blocks hits are broadcast.
BROADCAST_HITS = 1_000_000

#: What separates words, as a pattern.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes of other alphabets belong to words.
_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The windows of an item, each as words between and around single spaces."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Occurrences of many patterns: block shift tables skip impossible positions, buckets of the last
    block of the shortest pattern's length select patterns, direct comparison confirms them."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        # long blocks keep most blocks of a text out of the table
        self.block = b = max(1, min(self.least // 2, 3 if len(patterns) < 50 else 6 if len(patterns) < 2000 else 10))
        self.default = self.least - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[bytes]]] = {}
        for p in patterns:
            for end in range(b, self.least + 1):
                key, far = p[end - b : end], self.least - end
                if far < self.shift.get(key, self.default):
                    self.shift[key] = far
            self.bucket.setdefault(p[self.least - b : self.least], {}).setdefault(p[: self.least], []).append(p)

    def find(self, text: bytes):
        """(start, pattern) of every occurrence, by start."""
        b, m, n = self.block, self.least, len(text)
        get, default, bucket = self.shift.get, self.default, self.bucket
        end = m
        while end <= n:
            key = text[end - b : end]
            far = get(key, default)
            if far:
                end += far
                continue
            start = end - m
            for p in bucket[key].get(text[start:end], ()):
                if text.startswith(p, start):
                    yield start, p
            end += 1


class Matcher:
    """Windows of a benchmark block; short items, whose length would spoil the shifts, have tables of their own."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.items: dict[bytes, set[str]] = {}
        for name, text in items:
            for w in windows(words_of(text), size):
                self.items.setdefault(w, set()).add(name)
        groups: dict[int, list[bytes]] = {}
        for w in self.items:
            groups.setdefault(len(w).bit_length(), []).append(w)
        self.tables = [WuManber(g) for g in groups.values()]
        self.length = {w: w.count(b" ") - 1 for w in self.items}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans under occurrences, and the items that have one."""
        text, spans, found = b" " + b" ".join(words) + b" ", [], set()
        for table in self.tables:
            at = word = 0
            for start, p in table.find(text):
                word += text.count(b" ", at, start)
                at = start
                spans.append((word, word + self.length[p]))
                found |= self.items[p]
        return spans, found


_matchers: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[tuple[str, str]], size: int) -> Matcher:
    """The worker's matcher for the block of this name; one is remembered over tasks, that of the last block."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items, size)
    return _matchers[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, limit: int):
    """The benchmark in blocks of (name, text) of at most about limit bytes; one is at the driver at a time."""
    held, size = [], 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text", F.octet_length("text").alias("size"))
    for r in named.filter("text is not null").toLocalIterator():
        if held and size + r["size"] > limit:
            yield held
            held, size = [], 0
        held.append((r["name"], r["text"]))
        size += r["size"]
    yield held


SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _search(src: DataFrame, text: str, block: list, size: int, width: int) -> DataFrame:
    """The first width columns of src, n_words, spans (hit word ranges, merged) and items (names, sorted) of each row."""
    sent, name = src.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    schema = T.StructType([*src.schema.fields[:width], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())
    at = src.columns.index(text)

    def run(batches):
        matcher = matcher_of(name, sent.value, size)
        for b in small(batches):
            counts, spans, items = [], [], []
            for t in b.column(at).to_pylist():
                words = words_of(t)
                own, found = matcher.hits(words)
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in _merged(own)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, kinds[0]), pa.array(items, kinds[1])], schema.names)

    return src.mapInArrow(run, schema)


def _over_blocks(src: DataFrame, text: str, blocks, size: int) -> DataFrame:
    """All columns of src, n_words, spans and items of each row, for a benchmark of several blocks.

    Rows get a number in one copy of src; each block then writes the numbers, spans and items of the rows it
    hits only, and these are united by number.
    """
    with scratch() as held:
        rows = held.keep(cut(src.withColumn("mark_row", F.monotonically_increasing_id()), "marked-rows"))
        found = None
        for block in blocks:
            hits = cut(_search(rows.select("mark_row", text), text, block, size, 1).filter("size(spans) > 0").drop("n_words"), "marked")
            found = hits if found is None else found.unionByName(hits)
        merged = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))),
            F.array().cast(SPANS),
            lambda out, x: F.when((F.size(out) > 0) & (x["a"] <= F.try_element_at(out, F.lit(-1))["b"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), F.greatest(x["b"], F.try_element_at(out, F.lit(-1))["b"]).alias("b"))))).otherwise(F.concat(out, F.array(x))),
        )
        hit = held.keep(cut(found.groupBy("mark_row").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "marked-hits"))
    if hit.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit)
    words = F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), WORD_GAP), lambda w: w != "")).cast("long")
    joined = rows.join(hit, "mark_row", "left").withColumn("n_words", words)
    return joined.select(*src.columns, "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep_text: bool = False, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id (with keep_text all columns of docs), n_words, spans (hit word ranges, merged) and items (names, sorted) of each row.

    Null texts have no words; null item ids count as one item with an empty name; repeated items and rows
    count as they come; an empty benchmark hits nothing. A benchmark beyond limit meets docs block by block.
    """
    src = docs if keep_text else docs.select(F.col("doc_id"), F.col(text))
    blocks = _blocks(benchmark, limit)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        df = _search(src, text, first, size, len(src.columns))
    else:
        df = _over_blocks(src, text, chain((first, second), blocks), size)
    return df if keep_text else df.drop(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row; see marked() for the odd cases."""
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size=size, limit=limit)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a window of the benchmark, columns unchanged.

    Null and empty texts hold none and stay, as does every row where the benchmark has no word. Each row is judged by its own text: rows that repeat
    an id or a text, or have no id, stay or go each for itself, and other columns, whatever their names, are not read. Empty in, empty out.
    """
    plain, names = positional(docs)
    found = marked(plain, benchmark, text=names["text"], keep_text=True, limit=limit)
    return found.filter(F.size("spans") == 0).select(*plain.columns).toDF(*docs.columns)
