"""The ten operators on odd cases and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontam, exact_dedup, langid, packing, pii, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, exact_kept string, n long, row int, spans string"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"


def docs_of(spark, pairs):
    """A table with further columns whose names clash with inner ones."""
    rows = [(i, t, "en" if t and "the" in t.lower() else None, "s", None, "x", 1, 2, "y") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(0, "a  b"), (1, "a\t b"), (2, None), (3, ""), (4, " "), (None, "a b"), (None, None), (5, BASE), (5, BASE), (6, BASE + " today"), (7, "word " * 30_000), (8, "x" * 200_000), (9, "ÄÖ ü 字 😀")]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_exact_dedup(odd, none):
    got = rows(exact_dedup.exact_dedup(odd))
    assert len(got) == len(ODD)
    by = {}
    for i, t in ODD:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in by.items()}
    for r in got:
        ids = digest[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == min(i for i in ids if i is not None)
    assert sum(r["kept"] for r in got) == len(by)
    assert exact_dedup.exact_dedup(none).collect() == []
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)


def test_exact_dedup_tells_colliding_texts_apart(odd):
    from pyspark.sql import functions as F

    same = lambda norm: F.unhex(F.md5(F.substring(norm, 1, 0)))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_sha256"], not r["kept"])
    a = sorted(rows(exact_dedup.exact_dedup(odd)), key=key)
    b = sorted(rows(exact_dedup.exact_dedup(odd, hashed=same)), key=key)
    assert a == b


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, none):
    got = rows(simhash.simhash_dedup(odd))
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{plain_fingerprint(t):016x}" for _, t in ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert simhash.simhash_dedup(none).collect() == []
    kept = rows(simhash.keep_one(odd).select("doc_id"))
    alone = len({r["fingerprint"] for r in got if r["component_id"] is None})
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({r["component_id"] for r in got} - {None}) and sum(r["doc_id"] is None for r in kept) == alone
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(none).collect() == []


def test_near_dedup_keeps_unlike_texts_that_share_an_id(spark):
    words = [" ".join(f"{a}{i * 7 % 11}" for i in range(40)) for a in ("red", "blue", "green", "grey", "pink")]
    pairs = [(None, words[0]), (None, words[1]), (None, words[2]), (5, words[3]), (5, words[4]), (6, words[4]), (6, words[4]), (None, words[0])]
    kept = sorted((r["doc_id"], r["text"]) if r["doc_id"] else (0, r["text"]) for r in simhash.keep_one(docs_of(spark, pairs)).collect())
    assert kept == sorted([(0, words[0]), (0, words[1]), (0, words[2]), (5, words[3]), (5, words[4])])


def test_crowded_keys_leave_no_link_out(spark, monkeypatch):
    """Keys shown by a sample as crowded are linked through balls: the same components as without."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)})
    signed = np.array(prints, dtype=np.uint64)
    nodes = simhash._mixed(signed).view(np.int64)
    df = spark.createDataFrame([(int(f), int(n)) for f, n in zip(signed.view(np.int64), nodes)], "fp long, node long")
    got = []
    for most in (3, 10**9):
        monkeypatch.setattr(simhash, "CROWDED", most)
        monkeypatch.setattr(simhash, "SHOWN", 100)
        assert (len(simhash.crowded_keys(df, len(prints))) > 0) == (most == 3)
        got.append({r["u"]: r["root"] for r in simhash.components(simhash.links(df)).collect()})
    same = [{u: min(v for v, r in g.items() if r == g[u]) for u in g} for g in got]
    assert same[0] == same[1]


@pytest.mark.parametrize("paired", [96, 3])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    signed = np.array(prints, dtype=np.uint64)
    nodes = simhash._mixed(signed).view(np.int64)
    df = spark.createDataFrame([(int(f), int(n)) for f, n in zip(signed.view(np.int64), nodes)], "fp long, node long")
    got = {r["u"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    theirs = {}
    for i, n in enumerate(nodes):
        theirs.setdefault(find(i), set()).add(got.get(int(n), int(n)))
    assert all(len(v) == 1 for v in theirs.values()) and len(set().union(*theirs.values())) == len(theirs)


def test_packing(spark, odd, none):
    got = rows(packing.pack(odd, capacity=64))
    assert packing.pack(none).collect() == []
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert 1 <= r["length"] <= 64
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    for i, t in ((7, "word " * 30_000), (9, "ÄÖ ü 字 😀")):
        ids = plain.encode(t, add_special_tokens=False).ids + [0]
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert [p for p, *_ in mine] == list(range(len(mine))) and sum(n for _, _, n, _ in mine) == len(ids)
        for p, a, n, crc in mine:
            assert crc == zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) and (n == 64 or p == 0)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        counts = {s: rng.randrange(6) for s in rng.sample(range(1, 41), 12)}
        rooms = []
        for s in sorted(counts, reverse=True):
            for _ in range(counts[s]):
                fit = [r for r in rooms if r >= s]
                if fit:
                    rooms.remove(min(fit))
                    rooms.append(min(fit) - s)
                else:
                    rooms.append(40 - s)
        got = packing.plan(counts, 40)
        used = {}
        for size, _, ranks, first, offset, per in got.tolist():
            for k in range(ranks):
                used.setdefault(first + k // per, []).append((offset + k % per * size, size))
        assert len(used) == len(rooms)
        assert sorted(40 - sum(n for _, n in v) for v in used.values()) == sorted(rooms)


def test_sharding(spark, odd, none):
    many = docs_of(spark, [(i, "t" * (i % 50)) for i in range(3000)])
    limit = 4000
    got = rows(sharding.shard(many, limit=limit))
    size = {}
    for r in got:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    assert len(got) == 3000 and all(r["shard_bytes"] == size[r["shard"]] <= limit and r["depth"] == len(r["shard"]) for r in got)
    names = sorted(size)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    parents = {}
    for n, b in size.items():
        parents[n[:-1]] = parents.get(n[:-1], 0) + b
    assert all(parents[p] > limit or p + "0" not in size or p + "1" not in size for p in parents)
    over = rows(sharding.shard(odd, limit=1000))
    assert len(over) == len(ODD) and {r["doc_id"] for r in over if r["over_limit"]} >= {7, 8}
    assert sharding.shard(none).collect() == []


def test_decontamination(spark, none):
    rng = random.Random(6)
    vocabulary = ["ab", "cd", "ef", "Gh", "ö", "1"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 10, 14]))) for i in range(10)] + [(20, None), (21, "..."), (None, text(12))]
    pairs = [(i, text(rng.randrange(60))) for i in range(60)] + [(100, items[8][1] + " end"), (None, None)]
    pairs += [(101, "x " + items[7][1])] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for d, t in pairs:
        words, hit, names = split(t), set(), set()
        for i, x in items:
            own = split(x)
            k = min(10, len(own))
            for a in range(len(own) - k + 1 if own else 0):
                for b in range(len(words) - k + 1):
                    if words[b : b + k] == own[a : a + k]:
                        hit |= set(range(b, b + k))
                        names.add("" if i is None else str(i))
        want.append((d, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    for limit in (1 << 20, 40, 400):
        got = [tuple(r) for r in decontam.decontaminate(docs_of(spark, pairs), bench, limit=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.decontaminate(none, bench).collect() == []
    assert decontam.decontaminate(docs_of(spark, pairs), bench.limit(0)).filter("contaminated").count() == 0
    for limit in (1 << 20, 40):
        clean = decontam.keep_clean(docs_of(spark, pairs), bench, limit=limit)
        assert clean.count() == sum(not w[-1] for w in want) and clean.columns == none.columns
    assert decontam.keep_clean(none, bench).collect() == []


PII_TEXTS = [
    None, "", "mail a.b@c.de or a@b.c_d@e.f, x@y", "ip 1.2.3.4.5 and 256.1.1.1 and 10.0.0.255", "card 4539 1488 0343 6467 and 4539148803436468",
    "call +1 (650) 555-0100 now +12 +1234567890123456", "1-2-3 4", "😀 é a@b.co 字 +49 30 1234567.", "a@b.c" * 300, "1 " * 5000, "+1" + "(" * 3000 + "5", "1" * 50_000,
    "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013001", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "IBAN DE88 3704 0044 0532 0130 00 and NO9386011117947, GB82 WEST 1234 5698 7654 32.",
    "aws secret key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY here", "secret = " + "a1" * 80, "the key is in /usr/share/lib/python/site/2024/module", "password: QWxhZGRpbjpvcGVuIHNlc2FtZQ==",
]


def test_personal_data(spark, none):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(map(int, d[::-1]))) % 10 == 0

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    rng = random.Random(8)
    texts = PII_TEXTS + ["".join(rng.choice(["a", "1", "@", ".", "-", " ", "+", "(", ")", "9", "b.c", "_", "é", "234"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (t or "")[:100]
        assert [got[i][f"n_{k}"] for k in plain] == [sum(b.startswith(k) for b in base) for k in plain]
        assert got[i]["spans"].startswith(",".join(base))
    more = {i: [s for s in got[i]["spans"].split(",") if s[:4] in ("iban", "secr")] for i in range(12, len(PII_TEXTS))}
    assert more == {12: ["iban:5:32"], 13: ["secret:9:49"], 14: ["iban:5:32"], 15: ["iban:37:52", "iban:54:81"], 16: ["secret:15:55"], 17: ["secret:9:169"], 18: [], 19: ["secret:10:38"]}
    assert all(r["found"] == (r["n_spans"] > 0) == (r["spans"] != "") and (r["score"] > 0) == r["found"] for r in got.values())
    assert pii.personal_data(none).collect() == []


def test_masking_leaves_nothing_and_mixes_no_rows(spark, none):
    pairs = [(None, "mail a@b.co"), (None, None), (1, "x a@b.co"), (1, "yy c@d.co +49 30 1234567"), (2, ""), (3, "+1 650 555 0100 4539148803436467")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in pii.masked(docs_of(spark, pairs)).collect())
    assert got == sorted([(0, "mail [email]"), (0, ""), (1, "x [email]"), (1, "yy [email] [phone]"), (2, ""), (3, "+1 650 555 0100 4539148803436467")])
    assert pii.masked(none).collect() == []


@pytest.fixture(scope="module")
def corpus(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_language_id(spark, corpus, odd, none):
    model = langid.learn(corpus[0])
    got = langid.predict(corpus[0], model).join(corpus[0].select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert float((model["table"] == 0).mean()) > 0.5
    by = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und")} <= by and len(rows(langid.predict(odd, model))) == len(ODD)
    assert langid.identify(none).collect() == []


def test_document_frequencies_cover_all_texts(spark, corpus, odd, none):
    import numpy as np

    for docs in (corpus[0], odd, none):
        df, total = langid.frequencies(docs)
        want, n = np.zeros(1 << langid.BITS), 0
        for r in docs.select("text").collect():
            if r["text"] and any(c.isalpha() for c in r["text"]):
                n += 1
                want[np.unique(np.concatenate(list(langid.grams(r["text"]))))] += 1
        assert total == n and (df == want).all()


def test_quality(spark, corpus, odd, none):
    docs, labels = corpus
    model = quality.learn(docs, labels)
    got = quality.scores(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    out = rows(quality.scores(odd, model))
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.classify(none, labels).collect() == []
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark, corpus, odd, none):
    docs, labels = corpus
    model = toxicity.learn(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.9 and (got["predicted"] & (got["toxic"] == 0)).sum() <= 2
    assert len(rows(toxicity.scores(odd, model))) == len(ODD)
    assert all(x["chance"] <= toxicity.SIGNIFICANT for p in got["passages"] for x in p) and got[got["predicted"] == 1]["passages"].map(len).min() > 0
    assert toxicity.detect(none, labels).collect() == []


def test_maximal_segments():
    """Against the definition: the best segment, then the same on what lies left and right of it."""
    def brute(v, a, b):
        best = max(((sum(v[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return brute(v, a, i) + [(i, j, best[0])] + brute(v, j, b)

    rng = random.Random(9)
    for _ in range(200):
        v = [float(rng.choice([-3, -2, -1, 1, 2, 5])) + rng.random() / 64 for _ in range(rng.randrange(18))]
        got = [(a, b) for a, b, _ in toxicity.segments(v)]
        assert got == [(a, b) for a, b, _ in brute(v, 0, len(v))]


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = out
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
