"""Scores of the classifiers against plain loops, whatever the size of a slice; odd tables through every stage."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import features, langid, quality, toxicity

from test_operators import SCHEMA, docs_of, plain_fingerprint

TEXTS = ["", " ", "x", "a  b", "Ein Wort, noch ein Wort", "the cat the cat", "é字 😀\n\t" * 30, "word " * 400, "y" * 300, " no-break", "end "]


def collected(parts):
    return np.sort(np.concatenate([np.zeros(0, dtype=np.int32), *parts])).tolist()


@pytest.mark.parametrize("size", [1, 2, 7, 64])
def test_grams_do_not_depend_on_slices(monkeypatch, size):
    rng = random.Random(size)
    texts = TEXTS + ["".join(rng.choice("ab \n cé字") for _ in range(rng.randrange(60))) for _ in range(100)]
    makers = (langid.grams, quality.grams)
    whole = [collected(m(t)) for t in texts for m in makers]
    monkeypatch.setattr(features, "SLICE", size)
    assert [collected(m(t)) for t in texts for m in makers] == whole


def plain_bucket(points, n):
    h = n
    for c in points:
        h = (h + c) * 0x9E3779B1 % 2**32
        h ^= h >> 13
    h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
    return h >> 32 - langid.BITS


def test_language_score_is_that_of_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(2)
    model = {"classes": ["a", "b", "c"], "table": rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), "bias": rng.normal(size=3), "temperature": 1.7}
    for size in (1 << 20, 7):
        monkeypatch.setattr(features, "SLICE", size)
        for t in TEXTS:
            if not any(c.isalpha() for c in t):
                assert langid.score(model, t) == ("und", 0.0)
                continue
            folded, gap = " ", True
            for c in t.lower():
                if c.isalpha():
                    folded, gap = folded + c, False
                elif not gap:
                    folded, gap = folded + " ", True
                elif folded == " ":
                    folded = "  "
            folded += " "
            total, n = np.zeros(3), 0
            for k in langid.SIZES:
                for i in range(len(folded) - k + 1):
                    total += model["table"][plain_bucket([ord(c) for c in folded[i : i + k]], k)]
                    n += 1
            v = [(x / n + b) / 1.7 for x, b in zip(total, model["bias"])]
            p = [math.exp(x - max(v)) for x in v]
            best = max(range(3), key=p.__getitem__)
            got = langid.score(model, t)
            assert got[0] == "abc"[best] and got[1] == pytest.approx(p[best] / sum(p), abs=1e-6)


def test_quality_score_is_that_of_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(3)
    model = {"table": rng.normal(size=1 << quality.BITS).astype(np.float32), "bias": 0.2, "scale": 1.3, "shift": -0.4}

    def spread(h):
        return ((h ^ h >> 15) * 0x85EBCA77 % 2**32) >> 32 - quality.BITS

    for size in (1 << 20, 7):
        monkeypatch.setattr(features, "SLICE", size)
        for t in TEXTS:
            padded = "\n" + t + "\n"
            buckets = [plain_bucket([ord(c) for c in padded[i : i + 3]], 3) for i in range(len(padded) - 2)]
            words = "".join(c if ord(c) > 32 and ord(c) != 160 else " " for c in t).split(" ")
            hashes = [sum(ord(c) * pow(0x9E3779B1, (k & 63) + 1, 2**32) for k, c in enumerate(w)) % 2**32 for w in words if w]
            buckets += [spread(h ^ 0x5BD1E995) for h in hashes]
            buckets += [spread(((a ^ b) + 77) % 2**32) for a, b in zip(hashes, hashes[1:])]
            v = 1.3 * sum(float(model["table"][b]) for b in buckets) / max(1, len(buckets)) - 0.2
            assert quality.score(model, t) == pytest.approx(1 / (1 + math.exp(-v)), abs=1e-6)


def test_toxicity_score_is_that_of_a_plain_loop():
    """Segments by their definition, evidence by the formula."""
    rng = random.Random(5)
    odds = {w: (1.0 + i, rng.uniform(-3, 4)) for i, w in enumerate(["bad", "ba", "ugly*", "nice", "good*", "mean", "vile"])}
    model = {"weights": toxicity.Weights(odds), "law": (0.2, 0.1, 0.8), "slope": 0.7, "base": -2.0}

    def brute(v, a, b):
        best = max(((sum(v[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return brute(v, a, i) + [(i, j, best[0])] + brute(v, j, b)

    for _ in range(50):
        words = [rng.choice(["bad", "uglyness", "nice", "goodly", "mean", "vile", "stone", "tree", "river", "cloud"]) for _ in range(rng.randrange(25))]
        values = []
        for w in words:
            known = [odds[t] for t in (w, *(w[:k] + "*" for k in range(3, 9) if k <= len(w))) if t in odds]
            values.append(max(known)[1] - toxicity.DRIFT if known else -toxicity.DRIFT)
        found = brute(values, 0, len(values))
        n = math.log(2 + len(words))
        u = [(s - 0.2 - 0.1 * n) / 0.8 for s in sorted((s for *_, s in found), reverse=True)] or [(-0.2 - 0.1 * n) / 0.8]
        z = -math.log(1 - math.exp(-math.exp(-max(u[0], -5)))) if u[0] <= 30 else u[0]
        for r in range(2, len(u) + 1):
            if u[r - 1] <= 0:
                break
            t = sum(u[:r])
            if t > r:
                z = max(z, -math.log(math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) / toxicity.FURTHER ** (r - 1)))
        p, told = toxicity.judge(model, " ".join(words).upper())
        assert p == pytest.approx(1 / (1 + math.exp(-(0.7 * min(z, 60) - 2))), abs=1e-6)
        want = [(a, b, pytest.approx(s)) for a, b, s in found if 1 - math.exp(-math.exp(-max((s - 0.2 - 0.1 * n) / 0.8, -5))) <= toxicity.SIGNIFICANT]
        assert [x[:3] for x in told] == want


def test_evidence_grows_with_each_good_passage():
    law = (0.0, 0.0, 1.0)
    assert toxicity.evidence(law, [], 3.0) < toxicity.evidence(law, [4.0], 3.0) < toxicity.evidence(law, [4.0, 4.0, 4.0], 3.0)
    assert toxicity.evidence(law, [4.0, 0.01], 3.0) == toxicity.evidence(law, [4.0], 3.0)


STAGED = [(1, None), (None, "x"), (None, "other words than that one here"), (2, ""), (2, "a text of some words that is fine"), (2, "a text of some words that is fine"), (3, "word " * 5000), (4, "a  text of some words\tthat is fine"), (5, "x")]


def staged(name, pairs, model, leaked):
    """What stays of pairs, by the rule of each stage: (rows that must be there, rows of which one of each group must)."""
    if name == "quality":
        return [p for p in pairs if quality.score(model, p[1]) >= quality.THRESHOLD], []
    if name == "decontamination":
        return [p for p in pairs if p not in leaked], []
    groups = {}
    for p in pairs:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", p[1] or "") if name == "exact dedup" else plain_fingerprint(p[1]), []).append(p)
    if name == "near dedup":
        # fingerprints that are close enough link their groups
        prints = list(groups)
        for a in prints:
            for b in prints:
                if a in groups and b in groups and a != b and (a ^ b).bit_count() <= 4:
                    groups[a] += groups.pop(b)
    return [], list(groups.values())


@pytest.mark.parametrize("pairs", [[], STAGED], ids=["empty", "odd"])
def test_stages_take_odd_tables(spark, tmp_path, pairs):
    import corpus_pipeline

    base = "/root/testdata/sf0.001"
    leaked = [(6, spark.read.parquet(f"{base}/benchmark.parquet").filter("length(text) > 100").first()["text"])] if pairs else []
    pairs = pairs + leaked
    docs = docs_of(spark, pairs)
    model = quality.learn(docs, spark.read.parquet(f"{base}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        got = Counter(map(tuple, out.select("doc_id", "text").collect()))
        rows, groups = staged(name, pairs, model, leaked)
        if groups:
            assert sum(got.values()) == len(groups), name
            for g in groups:
                ids = [i for i, _ in g if i is not None]
                # the least id stays, and of rows without one any
                assert sum(got[p] for p in set(g)) == 1 and (not ids or any(got[p] for p in set(g) if p[0] == min(ids))), name
        else:
            assert got == Counter(rows), name
    spark.createDataFrame(docs.rdd if pairs else [], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{base}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert set(r["doc_id"] for r in packed.select("doc_id").collect()) <= {i for i, _ in pairs}
