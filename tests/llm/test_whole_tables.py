"""Contract queries on the smallest tables against brute force, and the large-scale paths against the small ones."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from test_operators import ODD, docs_of, plain_fingerprint, rows
from tokenizers import Tokenizer

from tidemark.llm import common, decontam, exact_dedup, langid, queries, quality, sharding, simhash, toxicity
from tidemark.llm.tokens import vocabulary_path

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_simhash_links_as_all_pairs_do(spark, docs):
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    least = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            for j in docs:
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= 4:
                    least[i], changed = least[j], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, DIR).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in docs}


def test_token_files_are_the_librarys(spark, docs):
    plain = Tokenizer.from_file(vocabulary_path())
    want, at = [], 0
    for i in sorted(docs):
        ids = plain.encode(docs[i] or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op9_token_file(spark, DIR).collect())) == want


def test_packing_holds_the_librarys_ids(spark, docs):
    plain = Tokenizer.from_file(vocabulary_path())
    got, bins = {}, {}
    for r in queries.op7_packing(spark, DIR).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in docs.items():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        size = len(ids) % 2048 or 2048
        cuts = [0, *range(size, len(ids) + 1, 2048)]
        assert sorted(got[i]) == [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_base_spans(spark, docs):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        d = [int(x) for x in re.sub("[^0-9]", "", m)]
        luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for r in queries.op10_personal_data(spark, DIR).collect():
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, docs[r["doc_id"]] or "") if valid(k, m[0])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(base)


def test_classifier_queries_score_every_row_by_its_model(spark, docs):
    t = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    models = langid.learn(t[0]), quality.learn(*t), toxicity.learn(*t)
    out = [{r["doc_id"]: r for r in q(spark, DIR).collect()} for q in (queries.op2_language_id, queries.op5_quality, queries.op6_toxicity)]
    for i, text in docs.items():
        rest = zlib.crc32(str(i).encode())
        lang, score = langid.score(models[0], text)
        assert (out[0][i]["lang_pred"], out[0][i]["held_out"]) == (lang, rest % 4 == 2) and out[0][i]["score"] == pytest.approx(score)
        for o, s, held, least in ((out[1][i], quality.score(models[1], text), rest % 5 == 0, 0.3), (out[2][i], toxicity.judge(models[2], text)[0], rest % 3 == 1, 0.7)):
            assert o["score"] == pytest.approx(s) and o["held_out"] == held and o["predicted"] == int(o["score"] >= least)


def key(r):
    return [(v is not None, str(v)) for v in r.values()]


def test_paths_beyond_the_broadcasts_agree(spark, monkeypatch):
    odd = docs_of(spark, ODD)
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wizards"), (2, "word"), (3, None)], "item_id long, text string")

    def run():
        return [
            sorted(rows(exact_dedup.exact_dedup(odd)), key=key),
            sorted(rows(exact_dedup.keep_first(odd).select("doc_id", F.md5("text").alias("m"))), key=key),
            sorted(rows(simhash.keep_one(odd).select("doc_id", F.md5("text").alias("m"))), key=key),
            sorted(rows(decontam.keep_clean(odd, bench, limit=20).select("doc_id", F.md5("text").alias("m"))), key=key),
        ]

    from pyspark.sql import functions as F

    small = run()
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(simhash, "BROADCAST_TAGS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_HITS", 0)
    assert run() == small


def test_scratch_is_empty_but_for_results(spark):
    folder = f"{common.shared_folder(spark)}/tidemark"
    odd = docs_of(spark, ODD)
    for make in (lambda: exact_dedup.exact_dedup(odd), lambda: simhash.simhash_dedup(odd), lambda: sharding.shard(odd, limit=1000), lambda: queries.op7_packing(spark, DIR), lambda: queries.op9_token_file(spark, DIR)):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = make()
        after = set(os.listdir(folder)) - before
        assert after == {os.path.basename(out.cut_path)}
        common.release(out)
        assert not (set(os.listdir(folder)) - before)
