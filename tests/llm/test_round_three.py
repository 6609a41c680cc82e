"""Periodic runs, mixing and the conversation trie: odd cases, brute force and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import ODD, docs_of, rows

from tidemark.llm import mixing, periodic, prefixes, queries

DIR = "/root/testdata/sf0.001"


def all_runs(w, least=6, times=4):
    """{(start, length): period} by trying every lag at every place."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return out


@pytest.mark.parametrize("together", [1, 3, 12])
def test_repetitions_are_all_there(monkeypatch, together):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    rng = random.Random(together)
    for _ in range(1200):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 5])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.3:
                    w[rng.randrange(n)] = 9
            texts.append(w)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = periodic.repetitions(np.array([x for t in texts for x in t], dtype=np.int64), bounds)
        assert [got.get(k, {}) for k in range(len(texts))] == [all_runs(t) for t in texts]


def test_z_function():
    for s in ("", "a", "aaaa", "abaabaab", "abcabx"):
        assert periodic.z_function(list(s)) == [max(k for k in range(len(s) - i + 1) if s[:k] == s[i : i + k]) for i in range(len(s))]
    with pytest.raises(ValueError):
        periodic.repetitions(np.zeros(8, dtype=np.int64), np.array([0, 8]), times=3)


def plain_digest(i, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = sorted((s, length, q) for (s, length), q in all_runs(words).items())
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (i, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


RUNS = [(10, "a b " * 9 + "c"), (11, "x" + " la" * 7 + " y" + " la" * 3), (12, "one two three four five six"), (13, "go go go go go"), (14, "go go go go go go"), (15, " " + "no no " * 8)]


def test_runs_of_odd_texts(spark):
    odd = [(i, t) if t is None or len(t) < 10_000 else (i, t[:900]) for i, t in ODD]
    # ids whose crc32 makes them loop, with texts of each length
    odd += RUNS + [(i, " ".join(f"w{k % 11}" for k in range(i % 60))) for i in range(2000, 2400) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = periodic.digests(periodic.find_runs(periodic.looped(docs_of(spark, odd)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digest(i, t) for i, t in odd), key=str)
    assert periodic.find_runs(docs_of(spark, [])).collect() == []
    one = periodic.find_runs(docs_of(spark, [(1, "a b a b a b a b c"), (2, "word " * 30_000)])).orderBy("doc_id").collect()
    assert (one[0]["collapsed"], one[0]["n_words"]) == ("a b c", 9) and one[1]["collapsed"] == "word" and [tuple(r) for r in one[1]["runs"]] == [(0, 30_000, 1)]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op13_conversation_trie"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert got and sorted(got, key=str) == sorted(want, key=str)


def shares(sizes):
    """Target of each source by sharing, cutting off and sharing again."""
    order = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    got, free, left = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        part = {k: left * weight[k] / sum(weight[f] for f in free) for k in free}
        above = [k for k in free if part[k] > 2 * sizes[k]]
        if not above:
            return got | part
        got |= {k: 2.0 * sizes[k] for k in above}
        free, left = [k for k in free if k not in above], left - sum(2 * sizes[k] for k in above)
    return got


def mixed(docs):
    return sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "source_size", "target", "times", "copies", "taken", "source").collect()), key=str)


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows(mixing.mix(docs))
    plain = {r["doc_id"]: (len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in docs.collect()}
    sizes, taken = {}, {}
    for n, s in plain.values():
        sizes[s] = sizes.get(s, 0) + n
    assert sorted(r["doc_id"] for r in got) == sorted(plain)
    for r in got:
        assert (r["size"], r["source"]) == plain[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["copies"] - r["times"] > -1 and r["copies"] - r["times"] < 1
        assert r["target"] == pytest.approx(shares(sizes)[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in shares(sizes).items():
        assert abs(taken[s] - t) < max(n for n, k in plain.values() if k == s)


def test_mixing_agrees_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHAIN", 4)  # several levels
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = mixed(docs)
    assert mixed(docs.repartition(7)) == first and mixed(docs.coalesce(1)) == first
    sizes = {}
    for _, n, *_, s in first:
        sizes[s] = sizes.get(s, 0) + n
    for s, t in shares(sizes).items():
        assert abs(sum(r[6] for r in first if r[7] == s) - t) < max(r[1] for r in first if r[7] == s)


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    docs = spark.createDataFrame([(i, t, s, 1, "x", 0.5) for k, (i, t) in enumerate(ODD) for s in ((None, "b", "a")[k % 3],)], "doc_id long, text string, source string, size long, place string, chance double")
    got = rows(mixing.mix(docs))
    assert len(got) == len(ODD) and {r["source"] for r in got} == {None, "a", "b"}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and sum(r["size"] == 30_000 for r in got) == 1
    # no text anywhere
    none = rows(mixing.mix(docs_of(spark, [(1, None), (2, ""), (None, " ")])))
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 3
    copies = mixing.mixture(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), mixing.mix(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])))
    assert copies.columns == docs.columns


def test_pivot_keeps_words_and_chances():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ((rng.randrange(1, 50), rng.uniform(0.01, 0.99)) for _ in range(2))
        mean, n = [0.0, 0.0], 400
        for k in range(n):
            p, q = mixing.pivot(a, b, (k + 0.5) / n)
            assert 0 <= p <= 1 and 0 <= q <= 1 and (p in (0, 1) or q in (0, 1))
            assert p * a[0] + q * b[0] == pytest.approx(a[0] * a[1] + b[0] * b[1])
            mean[0] += p / n
            mean[1] += q / n
        assert mean[0] == pytest.approx(a[1], abs=0.01) and mean[1] == pytest.approx(b[1], abs=0.01)


def plain_trie(turns):
    """The contract, read off the conversations one by one."""
    own = {}
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [e[2] for e in sorted(v, key=lambda e: e[:2])] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    paths = {m[:d] for m in made.values() for d in range(len(m) + 1)}
    members = {p: sorted(c for c, m in made.items() if m[: len(p)] == p) for p in paths}
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in paths) for p in paths}
    words = {p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p in paths}
    out = []
    for p in paths:
        below = [q for q in paths if q[: len(p)] == p]
        ends = ",".join(str(c) for c in members[p] if made[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), kids[p], sum(not kids[q] for q in below), sum((len(members[q]) - 1) * words[q] for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = [(c, t, r, x) for c, t, r, x in [(0, 0, "u", "hi there"), (0, 1, "a", "yes  sir"), (0, None, "s", "be kind"), (1, 0, "u", "hi there"), (2, 0, None, None), (2, 0, None, ""), (3, 5, "", "b"), (3, 5, "", "a"), (None, 0, "u", "lost"), (25, 0, "u", "own"), (26, 0, "u", "own"), (27, 1, "u", "x"), (39, 0, "u", "alone")]]
TURNS += [(c, t, "u", f"turn {t % 3}") for c in range(40, 75) for t in range(c % 9)] + [(80, t, "u", "same words") for t in range(40)] + [(c, 0, "u", "one") for c in range(100, 130)]


@pytest.mark.parametrize("stretch", [2, 1024])
@pytest.mark.parametrize("turns", [[], TURNS, [(7, 3, "u", "x")]], ids=["empty", "odd", "one"])
def test_trie_of_odd_conversations(spark, monkeypatch, stretch, turns):
    monkeypatch.setattr(prefixes, "STRETCH", stretch)
    monkeypatch.setattr(prefixes, "LIST", stretch)
    table = spark.createDataFrame([(*t, 1, "x", "y", 2) for t in turns], "conv_id long, turn long, role string, text string, part int, mark string, node string, depth int")
    got = prefixes.trie(*prefixes.rebuilt(table)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(turns)
