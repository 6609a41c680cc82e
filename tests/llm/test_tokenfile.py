"""Codes, blocks and files of token ids: exact round trips."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokenfile as t
from tidemark.llm.tokens import encoder, vocabulary_path


@pytest.mark.parametrize("longest", [6, 9, 16])
def test_codes_are_prefix_free_and_bounded(longest):
    rng = np.random.default_rng(1)
    counts = (rng.zipf(1.3, 60) % 100_000).astype(np.int64)
    counts[::7] = 0
    n = t.code_lengths(counts, longest)
    assert (n[counts == 0] == 0).all() and (n[counts > 0] > 0).all() and n.max() <= longest
    assert sum(2.0 ** -int(x) for x in n[n > 0]) == pytest.approx(1.0)


def test_lengths_are_huffmans_when_not_limited():
    import heapq

    counts = np.array([45, 13, 12, 16, 9, 5])
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((t.code_lengths(counts) * counts).sum()) == cost


@pytest.mark.parametrize("size", [0, 1, 2, 95, 96, 97, 5000])
def test_bits_round_trip(size):
    rng = np.random.default_rng(size)
    ids = np.minimum(rng.geometric(0.01, size), 900).astype(np.int64)
    n = t.code_lengths(np.bincount(np.append(ids, [3, 5]), minlength=1000))
    data, offsets = t.encode_bits(ids, n, t.canonical(n))
    back = t.decode_bits(data, size, offsets[:: t.STEP], t.decoding_table(n))
    assert (back == ids).all() and len(back) == size


def test_files(spark, tmp_path):
    texts = ["a small text", None, "", "ein  Text\n mit\tRand ", "x" * 3000, "<|endoftext|> as text", "a small text", "end <|endoftext|> begin", "a<|endoftext|><|endoftext|>", "<|endoftext| >"]
    rows = [(i * 3, x) for i, x in enumerate(texts)] + [(3, "again"), (None, "no id")]
    t.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/f")
    tok = Tokenizer.from_file(vocabulary_path())
    got = t.read_tokens(spark, f"{tmp_path}/f").collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    def key(pair):
        return (pair[0] is not None, pair[0] or 0, pair[1])
    want = [(i, tok.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(want, key=key)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    crc = {r["doc_id"]: r["ids_crc32"] for r in t.digests(spark, f"{tmp_path}/f").collect()}
    assert crc[12] == zlib.crc32(np.array(dict(want)[12], dtype="<u4").tobytes())


def test_empty_table(spark, tmp_path):
    t.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e")
    assert t.digests(spark, f"{tmp_path}/e").collect() == []


def test_ids_are_the_librarys():
    import random

    random.seed(2)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "a", "b'", "'s", "é", "字", "12", "!", "??", "\r\n", " ", "😀", "Word,"]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(14))) for _ in range(4000)]
    own = encoder(vocabulary_path())
    want = Tokenizer.from_file(vocabulary_path()).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in want]
