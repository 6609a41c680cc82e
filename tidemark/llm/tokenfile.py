"""Token files: ids in canonical length-limited Huffman codes, in blocks that decode on their own.

A file set is a Parquet table of blocks. A block holds whole documents in order: their ids, first token
numbers and token counts, the bit stream, and the bit offset of every STEP-th token. The code lengths of
all ids lie beside the blocks, from which both sides derive the same canonical codes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, parts_for, scratch, shared_folder, small
from .tokens import encoder, vocabulary_path

END = 2
#: Longest code in bits; the decoding table has 2 ** LONGEST entries.
LONGEST = 16
#: Tokens between bit-offset checkpoints, and tokens after which a block ends with its document.
STEP, BLOCK = 96, 1 << 17


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most longest bits for the symbols with counts, by package-merge; 0: no code."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    while n > 1 << longest:
        longest += 1
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    level, leaves = weights, [np.ones(n, dtype=bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaves.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: in order of length, then of symbol."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == length)
        code <<= length - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), length
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset of each."""
    top = codes << (np.uint64(64) - np.maximum(lengths, 1).astype(np.uint64))
    size = lengths.astype(np.int64)[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    word = starts >> 5
    wide = top[ids] >> (starts & 31).view(np.uint64)
    words = np.zeros((total + 31) // 32 + 2, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], starts


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits that a look-up takes, and for each value of them the symbol with the length of its code in the top byte."""
    longest = max(1, int(lengths.max(initial=0)))
    table = np.full(1 << longest, 1 << 24, dtype=np.uint32)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (longest - lengths[used].astype(np.int64))
    table[: int(spans.sum())] = np.repeat((used | lengths[used].astype(np.int64) << 24).astype(np.uint32), spans)
    return longest, table


def decode_bits(data: bytes, count: int, checkpoints: np.ndarray, table, step: int = STEP) -> np.ndarray:
    """count ids of a stream, all stretches between checkpoints at once, one look-up each at a time."""
    longest, entries = table
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8).astype(np.uint32)
    near = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at, last = checkpoints.astype(np.int64), len(near) - 1
    rows = min(step, count)
    out = np.zeros((rows, len(at)), dtype=np.uint32)
    mask, drop = np.uint32((1 << longest) - 1), 32 - longest
    for i in range(rows):
        value = entries[near[np.minimum(at >> 3, last)] >> (drop - (at & 7)).astype(np.uint32) & mask]
        out[i] = value
        at = at + (value >> np.uint32(24))
    return (out.T.ravel() & np.uint32(0xFFFFFF))[:count]


def token_ids(docs: DataFrame, text: str, path: str, end: int) -> DataFrame:
    """doc_id, part, n_tokens and ids (16 bits if the vocabulary allows, else 32) in ascending doc_id within and over parts.

    Parts are ranges of id and text hash, so that an id that many rows share is no single part. Each task adds a row of its own at its end: only counts, how often each id occurred in its documents.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.repartitionByRange(parts_for(src, "text"), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    names, kinds = ["doc_id", "part", "n_tokens", "ids", "counts"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches):
        own = encoder(path)
        size = own.tokenizer.get_vocab_size()
        kind, last, total = "<u2" if size <= 1 << 16 else "<u4", np.array([end], dtype="<u4").tobytes(), np.zeros(max(size, end + 1), dtype=np.int64)
        for b in small(batches):
            ids = [x + last for x in own.encode(b.column(1).to_pylist())]
            total += np.bincount(np.frombuffer(b"".join(ids), dtype="<u4"), minlength=len(total))
            data = [np.frombuffer(x, dtype="<u4").astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(data, kinds[3]), pa.nulls(len(ids), kinds[4])], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), pa.array([total], kinds[4])], names)

    return src.mapInArrow(run, "doc_id long, part int, n_tokens long, ids binary, counts array<long>")


def _plain(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def _added(batches):
    """The sum of the tasks' counts, as rows of the ids that occur."""
    total = np.zeros(0, dtype=np.int64)
    for b in batches:
        for x in b.column(0):
            total = x.values.to_numpy() + (total if len(total) else 0)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["id", "n"])


def write_tokens(docs: DataFrame, folder: str, text: str = "text", path: str | None = None, end: int = END) -> None:
    """Write the file set for docs (null text: empty; rows without an id first; repeated ids in any order) to folder."""
    with scratch():
        _write(docs.sparkSession, cut(token_ids(docs, text, path or vocabulary_path(), end), "token-ids"), folder)


def _write(spark: SparkSession, ids: DataFrame, folder: str) -> None:
    counted = ids.filter("counts is not null").select("counts").mapInArrow(_added, "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = ids.filter("counts is null").drop("counts")
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base_of = spark.sparkContext.broadcast({r["part"]: r["base"] for r in bases.collect()})
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches):
        lengths, codes = sent.value, canonical(sent.value)
        number, start, held, size = 0, None, [], 0

        def block(part):
            nonlocal number, start
            all_ids = np.concatenate([_plain(d, n) for _, n, d in held]).astype(np.int64)
            data, offsets = encode_bits(all_ids, lengths, codes)
            n = np.array([x[1] for x in held], dtype=np.int64)
            first = start + np.cumsum(n) - n
            cols = [[part], [number], [[x[0] for x in held]], [first], [n], [offsets[::STEP]], [data]]
            number, start = number + 1, start + len(all_ids)
            kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "block", "doc_ids", "starts", "counts", "checkpoints", "bits"])

        part = None
        for b in batches:
            for doc, at, n, data in zip(*(c.to_pylist() for c in b.columns[:4])):
                if at != part:
                    if held:
                        yield block(part)
                    part, start, number, held, size = at, base_of.value[at], 0, [], 0
                held.append((doc, n, data))
                size += n
                if size >= BLOCK:
                    yield block(part)
                    held, size = [], 0
        if held:
            yield block(part)

    schema = "part int, block int, doc_ids array<long>, starts array<long>, counts array<long>, checkpoints array<long>, bits binary"
    ids.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of long) of each document, decoded block by block."""
    return _read(spark, folder, "ids array<int>", lambda ids: ids.astype(np.int32), pa.list_(pa.int32()))


def _read(spark, folder, column, value, kind) -> DataFrame:
    book = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches):
        table = decoding_table(sent.value)
        for b in batches:
            for docs, starts, counts, marks, bits in zip(*(c.to_pylist() for c in b.columns)):
                counts = np.array(counts, dtype=np.int64)
                ids = decode_bits(bits, int(counts.sum()), np.array(marks, dtype=np.int64), table)
                ends = np.cumsum(counts)
                out = [value(ids[e - n : e]) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts), pa.array(out, kind)], ["doc_id", "start", "n_tokens", column.split()[0]])

    blocks = spark.read.parquet(f"{folder}/blocks").select("doc_ids", "starts", "counts", "checkpoints", "bits")
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files of folder."""
    return _read(spark, folder, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def new_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
